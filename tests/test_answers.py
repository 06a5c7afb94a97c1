"""Lexicon, temporal grammar, closure, answers, reuse and running values: literal cases, nulls, ties, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from acervo.functions.lexicon import dates_in, identifiers_in, lexical_tokens, numeric_identifiers_in, planned, prefiltered, slices
from acervo.functions.scalars import company_key, iso_seconds, letter_number, masked_properties, redacted, role_of, safe_code, split_parties
from acervo.functions.temporal import execution_dates, mentions, with_mentions
from acervo.operators.answers import case_checks, citations, listed, quoted, rates, selection_findings, term_coverage, unsupported
from acervo.operators.closure import Registry, blocked_by_family, inverse_relations, resolve
from acervo.operators.curation import twins
from acervo.operators.measures import micro_recall, percentiles
from acervo.operators.ordered import in_pieces, last_value, running_sum
from acervo.operators.reuse import appended, cache_lookup, decided, lru_kept, mapped_by_place, vector_plan, with_former_input, with_opinion


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_identifiers_and_dates(spark):
    text = "CNPJ 11.222.333/0001-44, cpf 123.456.789-01; 12345678901 e ab.cde.fgh/0001-99, de novo 11222333000144; x12345678901"
    assert one(spark, identifiers_in, text) == ["11222333000144", "12345678901", "ABCDEFGH000199"]
    assert one(spark, numeric_identifiers_in, "cpf 123.456.789-01 cnpj 11.222.333/0001-44 e 123456789012") == ["11222333000144", "12345678901"]
    found = one(spark, dates_in, "Em 31/02/2020, 2021-03-04 e aos 5 dias do mês de março de 2019; 1.2.2020 mas não 1/2-2020 nem 99-2021-03-04")
    assert [(d.raw, d.date) for d in found] == [("31/02/2020", None), ("2021-03-04", "2021-03-04"), ("aos 5 dias do mês de março de 2019", "2019-03-05"), ("1.2.2020", "2020-02-01")]
    assert one(spark, lexical_tokens, "Ação 123.456.789-01 em 04/03/2021") == ["acao", "123", "456", "789", "01", "em", "04", "03", "2021", "identifier:12345678901", "date:2021-03-04"]
    assert one(spark, identifiers_in, None) is None and one(spark, dates_in, "") == []


def test_plans_and_prefilter(spark):
    q = spark.createDataFrame([(1, "de 123.456.789-01", ["12345678901", "b"]), (2, None, None)], "q int, t string, given array<string>")
    plan = {r.query_id: r.party_ids for r in planned(q, "q", "t", "given").collect()}
    assert plan == {1: ["12345678901", "b"], 2: []}
    items = spark.createDataFrame([(10, "a"), (11, "a"), (12, "b"), (None, "b"), (12, "b"), (13, None)], "doc int, ident string")
    asked = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["z"]), (4, None), (5, ["a", "b"])], "q int, ids array<string>")
    got = {(r.query_id, r.id, r.direct) for r in prefiltered(items, "doc", "ident", asked, "q", "ids").collect()}
    assert got == {(1, 10, False), (1, 11, False), (2, 12, True), (5, 10, False), (5, 11, False), (5, 12, False)}


@pytest.mark.parametrize("budget", [1, 7, 50])
def test_slices_lose_nothing(spark, budget):
    rng = random.Random(budget)
    texts = ["", "x", "a\n" * 40, "\n\n\n", "é" * 120] + ["".join(rng.choice("ab \n") for _ in range(rng.randint(1, 300))) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    for r in df.select("i", "t", slices(F.col("t"), budget).alias("s")).collect():
        if not r.t:
            assert r.s is None
            continue
        assert "".join(x.text for x in r.s) == r.t and all(0 < len(x.text) <= budget for x in r.s)
        at = 0
        for x in r.s[:-1]:
            head = r.t[at : at + budget]
            newline = head.rfind("\n") + 1
            assert x.start == at and len(x.text) == (newline if newline >= max(1, budget // 2) else budget)
            at += len(x.text)


def test_scalars(spark):
    assert one(spark, redacted, "a 12345678901, 11222333000144 e 123.456.789-01x9") == "a [CPF], [CNPJ] e 123.456.789-01x9"
    assert one(spark, lambda c: masked_properties(c, ["senha"]), {"Senha do cofre": "x", "cpf": "123.456.789-01"}, "map<string,string>") == {"Senha do cofre": "[***]", "cpf": "[CPF]"}
    assert one(spark, company_key, "Açúcar União S/A - ME") == "acucar uniao"
    assert [one(spark, letter_number, n, "int") for n in (0, 1, 26, 27, 53, 702, 703)] == [None, "a", "z", "aa", "ba", "zz", None]
    assert one(spark, iso_seconds, "1970-01-01T00:01:00Z") == 60.0 and one(spark, iso_seconds, "nada") == 0.0 and one(spark, iso_seconds, None) == 0.0
    assert one(spark, safe_code, "closure_cycle:x") == "closure_cycle:x" and one(spark, safe_code, "É <b>").startswith("code:")
    assert one(spark, split_parties, "Ana Sá; Bia Reis e Caio Luz, e Ana Sá.") == ["Ana Sá", "Bia Reis", "Caio Luz"]
    assert one(spark, role_of, "doravante LOCATÁRIA, e o locador") == "locatario" and one(spark, role_of, "nada") is None
    assert one(spark, quoted, "a\n\nb") == "> a\n>\n> b"
    assert [one(spark, listed, x, "array<string>") for x in ([], ["a"], ["a", "b"], ["a", "b", "c"])] == ["", "a", "a e b", "a, b e c"]


def kinds(text, **how):
    return [(m.date, m.kind, m.flags) for m in mentions(text, **how)]


def test_events_of_dates():
    assert kinds("Assinatura: 01/02/2020") == [("2020-02-01", "signature", [])]
    assert kinds("Cláusula 5ª – Vencimento em 2020-02-01.") == [("2020-02-01", "due", [])]
    assert kinds("Prazo de vigência de 01/02/2020 a 01/02/2021.") == [("2020-02-01", "effective_start", []), ("2021-02-01", "effective_end", [])]
    assert kinds("Início da vigência: 01/02/2020; término da vigência: 01/03/2021")[1][:2] == ("2021-03-01", "effective_end")
    assert kinds("Vencimento em 31/02/2020") == [(None, "unknown", ["invalid_calendar_date"])]
    assert kinds("O contrato anterior, firmado em 01/02/2020") == [("2020-02-01", "unknown", ["historical_reference", "unqualified_event_frame", "signature_attribution_uncertain"])]
    assert kinds("Pagamento em 01/02/2020, salvo acordo")[0][1:] == ("unknown", ["unresolved_event_qualification"])
    assert kinds("São Paulo, 1º de março de 2020.", last=True) == [("2020-03-01", "signature", ["closing_line_candidate"])]
    assert kinds("São Paulo, 1º de março de 2020.")[0][1] == "unknown"
    assert kinds("Firmado em 01/02/2020", signature=True)[0][1] == "signature" and kinds("Firmado em 01/02/2020")[0][1] == "unknown"
    assert kinds("") == [] and kinds("Rescisão: 01/02/2020\nRenovação: 02/02/2020") == [("2020-02-01", "termination", []), ("2020-02-02", "renewal", [])]


def test_execution_dates(spark):
    rows = [(1, "a", 1, "clause", "Assinatura: 01/02/2020"), (1, "b", 2, None, None), (2, "c", 1, "clause", "Assinatura: 01/02/2020"), (2, "d", 2, "clause", "Assinatura em 02/02/2020"), (3, "e", 1, "clause", "O contrato original foi assinado em 01/02/2020"), (None, "f", 1, "clause", "Assinatura: 05/02/2020")]
    found = with_mentions(spark.createDataFrame(rows, "doc_id long, block_id string, order_index int, block_type string, text_raw string"))
    assert found.count() == 5
    assert {r.doc_id: r.date for r in execution_dates(found).collect()} == {1: "2020-02-01", 2: None, 3: None}


def registry(spark, relations=(), resolutions=(), extra=()):
    units = spark.createDataFrame([("a1", "A", 10), ("a2", "A", 10), ("b1", "B", 10), ("b2", "B", 10), ("c1", "C", 10), *extra], "unit_id string, instrument_id string, tokens long")
    depends = spark.createDataFrame([("a2", "a1"), ("b2", "b1")], "child string, parent string")
    r = spark.createDataFrame(list(relations), "relation_id string, from_instrument string, to_instrument string, state string, affected array<string>, support array<string>")
    f = spark.createDataFrame(list(resolutions), "family_id string, instrument_id string, state string, relation_ids array<string>")
    return Registry(units, depends, r, f)


def resolved(spark, reg, selected, **how):
    outcome, proof = resolve(reg, spark.createDataFrame(selected, "query_id int, unit_id string"), **how)
    got = {}
    for r in proof.collect():
        got.setdefault(r.query_id, set()).add((r.unit_id, r.role))
    return {r.query_id: (r.status, r.reason, r.tokens, r.warnings) for r in outcome.collect()}, got


def test_closure_over_relations(spark):
    approved = ("r1", "B", "A", "approved", ["a2"], ["b2"])
    sound = ("f", "A", "resolved", ["r1"])
    reg = registry(spark, [approved], [sound])
    told, proof = resolved(spark, reg, [(1, "a2"), (2, "c1"), (3, "a1"), (4, "zz"), (None, "a1"), (5, None)])
    assert told == {1: ("complete", None, 40, []), 2: ("complete", None, 10, []), 3: ("complete", None, 10, []), 4: ("blocked", "closure_unit_missing", 0, [])}
    assert proof == {1: {("a2", "selected"), ("a1", "closure"), ("b1", "closure"), ("b2", "closure")}, 2: {("c1", "selected")}, 3: {("a1", "selected")}}
    assert resolved(spark, reg, [(1, "a2")], token_budget=39)[0][1][:2] == ("blocked", "closure_over_budget")
    assert {(r.query_id, r.unit_id) for r in inverse_relations(reg.relations, spark.createDataFrame([(1, "a2"), (2, "b2")], "query_id int, unit_id string")).collect()} == {(1, "a2"), (1, "b2")}


def test_closure_faults(spark):
    approved = ("r1", "B", "A", "approved", ["a2"], ["b2"])
    for relations, resolutions, reason in (
        ([approved], [("f", "A", "open", ["r1"])], "family_unresolved"),
        ([approved], [("f", "A", "resolved", ["r1", "r9"])], "family_relation_mismatch"),
        ([("r1", "B", "A", "approved", ["a2"], ["c1"])], [("f", "A", "resolved", ["r1"])], "relation_support_missing"),
        ([approved, ("r2", "A", "B", "approved", ["b1"], ["a1"])], [("f", "A", "resolved", ["r1", "r2"])], "relation_cycle"),
    ):
        reg = registry(spark, relations, resolutions)
        assert resolved(spark, reg, [(1, "a1")])[0][1][:2] == ("blocked", reason), reason
    reg = registry(spark, [("r1", "B", "A", "proposed", ["a2"], ["b2"]), ("r3", "C", "A", "rejected", ["a1"], ["c1"])], [("f", "A", "open", ["r1"])])
    told, proof = resolved(spark, reg, [(1, "a2")], scope="original_text")
    assert told[1] == ("complete", None, 20, ["historical_text_not_effect", "family_unresolved:A", "relation_unresolved:r1"]) and proof[1] == {("a2", "selected"), ("a1", "closure")}
    blocked = blocked_by_family(reg.relations, spark.createDataFrame([("B",), ("Z",), (None,)], "instrument_id string"))
    assert {r.instrument_id for r in blocked.collect()} == {"A", "B", "C", "Z"}


def test_terms_findings_and_citations(spark):
    pair = "query_id int, text string"
    q = spark.createDataFrame([(1, "Qual a multa do contrato Alfa e o foro?"), (2, None), (3, "garantia prestada")], pair)
    cover = term_coverage(q, spark.createDataFrame([(1, "A MULTAS de dez por cento"), (1, None), (3, "nada")], pair), spark.createDataFrame([(1, "Contrato Alfa")], pair))
    assert {(r.query_id, r.term): r.state for r in cover.collect()} == {(1, "multa"): "present", (1, "contrato"): "identifying", (1, "alfa"): "identifying", (1, "foro"): "absent", (3, "garantia"): "absent", (3, "prestada"): "absent"}
    assert [(r.query_id, r.terms) for r in unsupported(cover).collect()] == [(3, 2)]
    s = spark.createDataFrame([(1, "u1", "i1"), (1, "u9", "i9"), (1, None, None)], "query_id int, unit_id string, item string")
    found = selection_findings(s, spark.createDataFrame([(1, "u1")], "query_id int, unit_id string"), spark.createDataFrame([(1, "i1"), (1, "i2")], "query_id int, item string"))
    assert {(r.code, r.subject) for r in found.collect()} == {("unit_not_offered", "u9"), ("question_item_unknown", "i9"), ("question_item_uncovered", "i2")}
    proof = spark.createDataFrame([(1, "B", "u2", True, 5, None, "x\n"), (1, "A", "u1", False, 1, "T", None), (1, "B", "u0", False, 5, None, "y")], "query_id int, instrument_id string, unit_id string, selected boolean, position int, title string, text string")
    assert [(r.instrument_no, r.unit_no, r.unit_id) for r in citations(proof).orderBy("instrument_no", "unit_no").collect()] == [(1, 1, "u0"), (1, 2, "u2"), (2, 1, "u1")]
    cases = spark.createDataFrame([(1, ["a"], ["Foro"]), (2, ["a", "b"], []), (3, ["a"], [])], "case_id int, contracts array<string>, terms array<string>")
    got = case_checks(cases, spark.createDataFrame([(1, ["a"], ["o FÓRO é"]), (2, ["a"], None)], "case_id int, contracts array<string>, quotes array<string>"))
    assert {r.case_id: (r.passed, r.missing) for r in got.collect()} == {1: (True, []), 2: (False, ["b"]), 3: (False, ["a"])}
    r = rates(spark.createDataFrame([("x", True, False, 0, 0)], "k string, faithful boolean, right_action boolean, quotes int, faithful_quotes int"), "k").first()
    assert (r.fidelity, r.actions, r.quotes) == (1.0, 0.0, None)


def test_reuse(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "x")], "id int, k string, v string")
    cache = spark.createDataFrame([], "state_key string, opinion string")
    out, fresh = with_opinion(rows, ["k", "v"], cache, F.when(F.col("state_json").contains("x"), None).otherwise(F.lit("yes")))
    assert {r.id: r.opinion for r in out.collect()} == {1: "yes", 2: "yes", 3: None} and fresh.count() == 1
    former = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, None, "n")], "id int, v int, entered string")
    got = with_former_input(spark.createDataFrame([(1, 1), (1, 9), (2, None), (3, 1)], "id int, v int"), former, "id", "v", "entered").collect()
    assert {(r.id, r.v): (r.former_value, r.former_match) for r in got} == {(1, 1): ("old", "version"), (1, 9): ("new", "key"), (2, None): ("n", "key"), (3, 1): (None, None)}
    log = spark.createDataFrame([("s", "d1", 1, "approved"), ("s", "d2", 2, "approved"), ("t", "d1", 1, "rejected")], "k string, digest string, seq int, state string")
    got = decided(spark.createDataFrame([("s", "d1"), ("s", "d2"), ("t", "d1"), ("u", "d")], "k string, digest string"), log, ["k"], ["digest"], "seq", "state")
    assert {(r.k, r.digest): r.decision for r in got.collect()} == {("s", "d1"): "blocked", ("s", "d2"): "approved", ("t", "d1"): "rejected", ("u", "d"): "blocked"}
    entries = spark.createDataFrame([("a", "2020-01-01 00:00:00", 3), ("b", "2020-01-01 00:00:00", 1)], "k string, stored_at string, epoch int").withColumn("stored_at", F.to_timestamp("stored_at"))
    asked = spark.createDataFrame([("a", "2020-01-01 00:00:59"), ("a", "2020-01-01 00:01:00"), ("b", "2020-01-01 00:00:10"), ("c", "2020-01-01 00:00:10")], "k string, at string").withColumn("at", F.to_timestamp("at"))
    assert [r.outcome for r in cache_lookup(asked, entries, ["k"], "at", 60, F.lit(2)).orderBy("k", "at").collect()] == ["hit", "expired", "stale", "miss"]
    kept = lru_kept(spark.createDataFrame([("g", 1, 5, "x"), ("g", 2, 5, "y"), ("g", 3, 6, "z")], "g string, used int, size int, id string"), "g", "used", "size", 11, "id")
    assert {r.id for r in kept.collect()} == {"z", "y"}
    ledger = spark.createDataFrame([("a", "1"), ("b", "1")], "key string, v string")
    more = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("d", "1"), ("d", "2"), (None, "1")], "key string, v string")
    assert {r.key: r.outcome for r in appended(ledger, more, "key", ["v"]).collect()} == {"a": "repeated", "b": "conflict", "c": "new", "d": "conflict"}
    chunks = spark.createDataFrame([("a", "t"), ("b", "t2"), ("c", None), ("e", "new")], "id string, t string")
    digest = lambda t: F.sha2(F.concat_ws("\x1f", F.lit("m"), F.lit(t)), 256)
    prior = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("id"), digest(t).alias("digest"), F.array(F.lit(1.0)).alias("vector")) for k, t in (("a", "t"), ("b", "old"), ("x", "gone"))])).alias("e")).select("e.*")
    assert {r.id: (r.action, r.vector) for r in vector_plan(chunks, prior, "id", "t", F.lit("m")).collect()} == {"a": ("reuse", [1.0]), "b": ("embed", None), "c": ("skip", None), "e": ("embed", None), "x": ("drop", None)}
    told = mapped_by_place(spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "b string, s int"), spark.createDataFrame([("p", 1, "x"), ("p", 2, "x"), ("p", 2, "y")], "b string, s int, v string"), ["b", "s"], "v")
    assert {(r.b, r.s): r.v for r in told.collect()} == {("p", 1): "x", ("p", 2): None, ("q", 1): None}


def test_running_values_of_one_group_of_a_third(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}", i, rng.choice([None, 1, 2])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at int, v int").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be put together
    pieces = in_pieces(df, ["k"], ["at"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert pieces.where("k = 'hot'").select("__piece").distinct().count() > 1
    sums = {(r.k, r.at): r.total for r in running_sum(pieces, ["k"], ["at"], F.coalesce("v", F.lit(0)), "total").collect()}
    last = {(r.k, r.at): r.seen for r in last_value(pieces, ["k"], ["at"], F.col("v"), "seen", inclusive=False).collect()}
    total, seen = {}, {}
    for k, at, v in rows:
        total[k] = total.get(k, 0) + (v or 0)
        assert sums[k, at] == total[k] and last[k, at] == seen.get(k)
        seen[k] = seen.get(k) if v is None else v


def test_percentiles_and_recall_of_hot_groups(spark):
    values = [5] * 400 + list(range(300)) + [None]
    got = percentiles(spark.createDataFrame([("g", v) for v in values] + [(None, 1)], "g string, v int"), "g", "v", 0.95)
    ordered = sorted(v for v in values if v is not None)
    r = {x.g: x for x in got.collect()}
    assert r["g"].nearest_rank == ordered[-(-95 * 700 // 100) - 1] and r["g"].upper_middle == ordered[350] and r["g"].rounded_index == ordered[round(0.95 * 699)] and r[None].n == 1
    wanted = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("t", None)], "split string, w string")
    held = spark.createDataFrame([("pt", "a"), ("pt", "a"), ("en", "z")], "lang string, w string")
    assert {(r.split, r.lang): r.recall for r in micro_recall(wanted, held, "split", "w", "lang").collect()} == {("s", "pt"): 0.666667, ("s", "en"): 0.0, ("t", "pt"): 1.0, ("t", "en"): 1.0}


def test_twins_against_all_pairs(spark):
    rng = random.Random(4)
    items = []
    for i in range(120):
        base = items[rng.randrange(len(items))][3] if items and rng.random() < 0.6 else [f"g{rng.randrange(500)}" for _ in range(rng.randint(1, 20))]
        grams = sorted({*base, *([f"g{rng.randrange(500)}"] if rng.random() < 0.5 else [])})
        items.append((i, "s" if i % 3 else None if i % 2 else "t", len(grams), grams))
    items.append((500, "s", 0, []))
    got = {(r.id_a, r.id_b): r.similarity for r in twins(spark.createDataFrame(items, "id int, scope string, n int, grams array<string>"), 0.8).collect()}
    want = {}
    for a in items:
        for b in items:
            if a[0] < b[0] and a[1] and a[1] == b[1] and a[3] and b[3]:
                x, y = set(a[3]), set(b[3])
                if len(x & y) / len(x | y) >= 0.8:
                    want[a[0], b[0]] = round(len(x & y) / len(x | y), 6)
    assert got == want and want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "query_id int, unit_id string")
    outcome, proof = resolve(registry(spark), none)
    assert outcome.count() == 0 and proof.count() == 0
    empty = spark.createDataFrame([], "doc_id long, block_id string, order_index int, block_type string, text_raw string")
    assert with_mentions(empty).count() == 0 and execution_dates(with_mentions(empty)).count() == 0
    assert running_sum(in_pieces(empty, ["doc_id"], ["order_index"]), ["doc_id"], ["order_index"], F.lit(1), "n").count() == 0
