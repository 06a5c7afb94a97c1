from pyspark.sql import functions as F

from acervo.llm.languages import declared, languages_of, sentences, wrong_or_mixed

SCHEMA = "doc_id long, text string, lang string, source string, client_code string, label string, segments string"
TEXT = {
    "pt": "As partes reconhecem que o imóvel e a fiança integram o presente instrumento. O locatário deverá pagar o valor da multa no prazo de dez dias.",
    "es": "Las partes reconocen que la fianza y el alquiler forman parte del presente contrato. El arrendatario deberá pagar el importe de la multa en diez días.",
    "en": "The parties acknowledge that the lease and the deposit are part of this agreement. The tenant shall pay the amount of the fine within ten days.",
    "fr": "Les parties reconnaissent que le bail et la caution font partie du présent contrat. Le locataire devra payer le montant de la pénalité dans dix jours.",
    "it": "Le parti riconoscono che la locazione e la cauzione sono parte del presente contratto. Il conduttore dovrà pagare il valore della penale entro dieci giorni.",
}


def test_labels(spark):
    cases = {"pt_BR": "pt", "Portuguese": "pt", "español": "es", "ENG": "en", "fr-FR": "fr", "italiano": "it", "de": "other", "nl": "other", "": None, "?": None, "und": None, "N/A": None, None: None, "12": None}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r.l: r.d for r in df.select("l", declared(F.col("l")).alias("d")).collect()} == cases


def test_sentences():
    text = "Sobre o valor de R$ 44.521 nada.\n\n(due diligence) As partes\nsabem. do perito Ana quando houver"
    found = [(text[a:b], len(w), full) for a, b, w, full in sentences(text)]
    assert [x[2] for x in found] == [True, True, False] and found[1][1] == 5
    assert list(sentences(" \n 12.450,00 | 31/12 ")) == []


def test_documents(spark):
    rows = [(100 * i + n, TEXT[x], x, "s", f"c{n % 3}", "", "") for i, x in enumerate(TEXT) for n in range(12)]
    rows += [
        (1001, TEXT["pt"], "es", "s", None, "", ""),
        (1002, TEXT["it"], None, None, "c", "", ""),
        (1003, TEXT["en"] + "\n\n" + TEXT["fr"], "en", "s", "c", "", ""),
        (1004, TEXT["es"], "es-AR", "s", "c", "", ""),
        (1005, TEXT["en"], "de", "s", "c", "", ""),
        (1006, None, None, "s", "c", "", ""),
        (1007, "", "pt", "s", "c", "", ""),
        (1008, "12,00 | 4", "?", "s", "c", "", ""),
        (1009, TEXT["fr"] + " (stand by)", "fra", "s", "c", "", ""),
        (1010, TEXT["pt"].upper() * 300, "?", "s", "c", "", ""),
        (1011, "Só três palavras.", None, "s", "c", "", ""),
        (None, TEXT["pt"], None, "s", "c", "", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    read = languages_of(df, "doc_id", "text", "lang", "source", "client_code")
    got = sorted((r.doc_id, r.lang) for r in wrong_or_mixed(read).collect())
    assert got == [(1001, "pt"), (1002, "it"), (1003, "en"), (1003, "fr"), (1005, "en"), (1010, "pt")]
    told = {r.id: r for r in read.collect()}
    assert told[1004].lang == "es" and told[1004].confidence > 0.9 and told[1006].lang is None and told[1008].lang is None
    assert all(0 <= s["confidence"] <= 1 for s in told[1003].segments)


def test_empty_table(spark):
    assert wrong_or_mixed(languages_of(spark.createDataFrame([], SCHEMA), "doc_id", "text", "lang", "source", "client_code")).count() == 0


def test_held_out_accuracy(spark):
    """Trained on half of the labelled sentences, the model names the language of the others."""
    rows = [(i, " ".join(TEXT[x].split()[i % 5 :]), x if i % 2 else None, "s", "c", "", "") for i, x in enumerate(list(TEXT) * 12)]
    read = languages_of(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "lang", "source", "client_code")
    truth = {i: x for i, x in enumerate(list(TEXT) * 12)}
    right = [r.lang == truth[r.id] for r in read.collect() if r.id % 2 == 0]
    assert sum(right) / len(right) >= 0.95


def test_a_host_of_most_rows_gets_its_prior_either_way(spark):
    from acervo.llm.languages import with_prior

    heads = spark.range(300).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 7 AS string)) AS source", "'c' AS client")
    priors = heads.select("source", "client").distinct().where("source <> '4'").selectExpr("source", "client", "array(double(length(source))) AS prior")
    small, large = ({tuple(map(str, r)) for r in with_prior(heads, priors, broadcast_rows=n).select("id", "source", "client", "prior").collect()} for n in (100, 0))
    assert small == large and len(small) == 300
