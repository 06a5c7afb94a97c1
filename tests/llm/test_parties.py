from acervo.llm.parties import Trie, agreement, distance, entities, entity_pairs, identifier, parse

SCHEMA = "party_id long, name string, raw_identifier string, entity string, node string"


def test_trie_finds_what_the_distance_says():
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    trie = Trie()
    for i, w in enumerate(words):
        trie.add(w, i)
    for q in words[:60]:
        assert trie.near(q, 2) == {i for i, w in enumerate(words) if distance(q, w, 2) <= 2}


def test_distance_by_the_table():
    import random

    def table(a, b):
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(6)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(2))
        assert distance(a, b, 3) == min(4, table(a, b)), (a, b)


def test_identifiers():
    assert identifier("CPF nº 123.456.789-01") == ("12345678901", "") or identifier("CPF nº 123.456.789-02") == ("12345678902", "")
    assert identifier("11.7OO.563/OOO1-69")[0] == identifier("CNPJ: 11.700.563/0001-69")[0] == "11700563000169"
    assert identifier("***.909.789-**") == ("", "909789")
    for filler in ("111.111.111-11", "isento", "não informado", "", None, "00.000.000/0000-00"):
        assert identifier(filler) == ("", "")


def test_names_agree():
    same = [("Camila Torneste Durnalannzo", "DURNALANNZO, MILA TORNESTE"), ("Maria M. V. dos Durmalau", "Maria Mariana Vespatia dos Durmalau"), ("C. Torneste Durnalannzo", "Torneste Durnalannzo Camila"),
            ("Queromodoldi Comércio de Alimentos Ltda.", "Com. Alim. Queromodoldi"), ("Linjaneminzo Indústria S.A.", "Industria Metalurgita Linjaneminzo Sociedade Anonima"), ("Sérgio Locelau Sarquilho", "SÉRGIO LOCELAU SARKILHO")]
    other = [("Íris Luiz Belgerense Valranha", "Cláudia Belgerense Valranha"), ("Pradurarasco Transportes Ltda", "Pradurarasco Comércio Ltda"), ("Ana Belvaste Solrão", "Ana Belvaste Norilho"), ("João Silva Prado", "Maria Silva Prado")]
    for a, b in same:
        assert agreement(parse(a), parse(b)) is not None, (a, b)
    for a, b in other:
        assert agreement(parse(a), parse(b)) is None, (a, b)


def test_entities(spark):
    rows = [
        (1, "Camila Torneste Durnalannzo", "194.371.792-98", "", ""),
        (2, "C. Torneste Durnalannzo", None, "", ""),
        (3, "DURNALANNZO, MILA TORNESTE", "isento", "", ""),
        (4, "Camila Tornesto Durnalannzo", "194.371.729-98", "", ""),
        (5, "Maria Lindurão dos Narcolau", "180.294.399-23", "", ""),
        (6, "Maria Lindurão dos Narcolau", "402.985.023-72", "", ""),
        (7, "Maria Lindurão dos Narcolau", None, "", ""),
        (8, "Beatriz Torneste Durnalannzo", "555.371.792-98", "", ""),
        (15, "Ana Belvaste Solrão", "301.222.333-44", "", ""),
        (16, "Aline Belvaste Solrão", "402.333.444-55", "", ""),
        (17, "A. Belvaste Solrão", None, "", ""),  # fits two persons alike
        (9, None, None, "", ""),
        (10, "", None, "", ""),
        (11, "Vesgado Norilho Transportes Ltda", None, "", ""),
        (12, "VESGADO NORILHO TRANSP. ROD. EIRELI", "", "", ""),
        (13, "Vesgado Norilho Consultoria Ltda", None, "", ""),
        (14, "x" * 20_000, "111.111.111-11", "", ""),
        (1, "Camila Torneste Durnalannzo", "194.371.792-98", "", ""),
        (None, "Camila Torneste Durnalannzo", None, "", ""),
    ]
    found = entities(spark.createDataFrame(rows, SCHEMA))
    groups = {}
    for r in found.collect():
        groups.setdefault(r.entity, set()).add(r.party_id)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4], [5], [6], [7], [8], [9], [10], [11, 12], [13], [14], [15], [16], [17]]
    assert {(r.party_id_a, r.party_id_b) for r in entity_pairs(found).collect()} == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (11, 12)}


def test_crowded_shards_are_dealt(spark):
    """Variants of one name meet through its frequent forms, even where a shard is dealt over many parts."""
    import random

    rng = random.Random(5)
    rows = []
    for i in range(120):
        surname = list("Durnalannzo" if i % 2 else "Torneste")
        at = rng.randrange(2, len(surname) - 1)
        surname[at] = rng.choice("bcd")
        typed = "".join(surname)
        rows.append((i, f"Camila Torneste {typed}" if i % 2 else f"Camila {typed} Durnalannzo", None, "", ""))
    rows += [(1000 + i, "Camila Torneste Durnalannzo", "194.371.792-98", "", "") for i in range(30)]
    found = entities(spark.createDataFrame(rows, SCHEMA), crowd=10)
    assert found.select("entity").distinct().count() == 1


def test_permuted_and_mistyped_words_are_compared(spark):
    rows = [
        (1, "Duralindo Sarlanrolo Transportes Ltda", "11.700.563/0001-69", "", ""),
        (2, "Sarlanrolo Duralindo Transp.", None, "", ""),
        (3, "Camila Torneste Durnalannzo", "194.371.792-98", "", ""),
        (4, "Camila Durnalannzo Torneste", None, "", ""),
        (5, "Camila Tornesta Durmalanco Vespatia", "301.222.333-44", "", ""),
        (6, "Camila Tornasta Durnalamco Vespatia", None, "", ""),  # three errors
    ]
    found = {r.party_id: r.entity for r in entities(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1] == found[2] and found[3] == found[4] and found[5] == found[6] and len(set(found.values())) == 3


def test_rare_forms_of_a_crowded_shard_meet(spark):
    """Each of 150 identified relatives has a row without identifier; all of them crowd into one shard."""
    letters = "bcdfghjlmnprstvz"
    given = [f"{a}e{b}o{c}ax" for a in letters[:6] for b in letters[:5] for c in letters[:5]]
    rows = [(i, f"{g} Torneste Durnalannzo", f"{10000000000 + 7919 * 13 * i}", "", "") for i, g in enumerate(given)]
    rows += [(1000 + i, f"{g} Durnalannzo Torneste", None, "", "") for i, g in enumerate(given)]
    df = spark.createDataFrame(rows, SCHEMA)
    dealt, whole = ({(r.party_id, r.entity) for r in entities(df, **x).collect()} for x in ({"crowd": 10}, {}))
    assert dealt == whole


def test_all_forms_of_an_identifier_are_matched(spark):
    forms = ["Camila Torneste Durnalannzo Vespatia", "Camila Torneste Durnalannzo Norilho", "Camila Torneste Durnalannzo Belvaste", "Camila Torneste Durnalannzo Solrao", "Camila Lindurao Narcolau"]
    rows = [(i, f, "194.371.792-98", "", "") for i, f in enumerate(forms)] + [(10, "Camila Lindurao Narcolau", None, "", "")]
    assert entities(spark.createDataFrame(rows, SCHEMA)).select("entity").distinct().count() == 1


def test_short_names_meet(spark):
    rows = [
        (1, "Camila Durnalannzo", "194.371.792-98", "", ""),
        (2, "Camila Durnalanzzo", None, "", ""),
        (3, "Sergio Vespatia", "301.222.333-44", "", ""),
        (4, "S. Vespatia", None, "", ""),
        (5, "Sarlanrolo Transportes Ltda", "11.700.563/0001-69", "", ""),
        (6, "Sarlanrolo Ltda", None, "", ""),
        (7, "Camila Durmalannzo", None, "", ""),
    ]
    found = {r.party_id: r.entity for r in entities(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1] == found[2] == found[7] and found[3] == found[4] and found[5] == found[6] and len(set(found.values())) == 3


def test_empty_table(spark):
    assert entities(spark.createDataFrame([], SCHEMA)).count() == 0
