from acervo.llm.records import curation_order, is_real, surviving_fields, surviving_records
from pyspark.sql import functions as F

SCHEMA = "row_id long, mfiles_id long, mfiles_version int, sync_status string, synced_at string, title string, cliente string, field_name string, value string"
FIELDS = ["title", "cliente"]


def test_real_values(spark):
    values = {"Distrato": True, "Documento": True, "N/D": False, "(vazio)": False, "xxx": False, "Xxx Ltda": True, " - ": False, "???": False, "A PREENCHER": False, "": False, None: False, "não informado": False, "a" * 50_000: True}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r.v: r.ok for r in df.select("v", is_real(F.col("v")).alias("ok")).collect()} == values


def test_order_of_survivors(spark):
    rows = [
        (1, 7, 5, "FAILED ", "2024-01-01T00:00:00Z", "failed newest version", "c1", "x", "y"),
        (2, 7, 4, "ok", "20240301T000000Z", "v4", None, None, None),
        (3, 7, 4, "ok", "2024-03-01T01:00:00+02:00", "v4 earlier instant", "N/D", None, None),
        (4, 7, None, "ok", "2025-01-01 00:00:00+00:00", "no version", "c4", None, None),
        (5, 7, 4, "OK", "2024-03-01T00:00:00.000Z", "v4 higher row", "  ", None, None),
        (6, None, 1, "ok", None, "no id", "c", None, None),
        (7, 8, None, None, "not a time", None, "-", None, None),
        (7, 8, None, None, "not a time", None, "-", None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.mfiles_id, r.field_name): r.row_id for r in surviving_fields(df, "mfiles_id", FIELDS, "row_id", curation_order()).collect()}
    assert got == {(7, "title"): 5, (7, "cliente"): 4}
    whole = {r.mfiles_id: r for r in surviving_records(df, "mfiles_id", FIELDS, "row_id", curation_order()).collect()}
    assert whole[7].title == "v4 higher row" and whole[7].cliente_row == 4 and whole[7].row_count == 5
    assert whole[8].title is None and whole[8].cliente_row is None and set(whole) == {7, 8}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert surviving_records(df, "mfiles_id", FIELDS, "row_id", curation_order()).count() == 0
