from pyspark.sql import functions as F

from acervo.streaming.windows import anchored_windows, append_latest, latest_table, rate_limited, sessions, tumbling

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")


def stream(spark, sf, tmp_path):
    folder = str(tmp_path / "in")
    events(spark, sf).write.parquet(folder)
    return spark.readStream.schema(SCHEMA).parquet(folder)


def run(df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_windows_on_a_stream_are_those_of_the_table(spark, sf, tmp_path):
    source = stream(spark, sf, tmp_path)
    for n, make in enumerate((lambda e: tumbling(e, "1 hour", "3650 days"), lambda e: sessions(e, "30 minutes", "3650 days"))):
        got = run(make(source), f"w{n}", "complete")
        want = make(events(spark, sf))
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_rate_limit_with_state(spark, sf, tmp_path):
    got = run(rate_limited(stream(spark, sf, tmp_path), 86400, 2), "limited", "append")
    refused = anchored_windows(events(spark, sf), 86400, 2).groupBy("user_id").agg(F.sum("refused").alias("n")).where("n > 0")
    mine = got.where("NOT allowed").groupBy("user_id").count()
    assert {(r.user_id, r["count"]) for r in mine.collect()} == {(r.user_id, r.n) for r in refused.collect()}


def test_latest_by_merge(spark, sf, tmp_path):
    path, check = str(tmp_path / "t"), str(tmp_path / "c")
    append_latest(stream(spark, sf, tmp_path), ["user_id"], "event_id", path, check, buckets=3).awaitTermination()
    want = {r.user_id: r.m for r in events(spark, sf).where("user_id IS NOT NULL").groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    assert {r.user_id: r.event_id for r in latest_table(spark, path, 3).collect()} == want
