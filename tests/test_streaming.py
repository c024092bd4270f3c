"""Streams give what the batch form gives; ingest is the same when a batch is run again."""

from pyspark.sql import functions as F

from rosterspark.functions import fields
from rosterspark.streaming import feeds, limits


def events(spark):
    rows = [(i, f"u{i % 3}", 1_700_000_000 + 25 * i) for i in range(40)]
    return spark.createDataFrame(rows, "event_id int, user_id string, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))


def test_cooldown_counts_issued_only(spark):
    got = {r.event_id: r.issued for r in limits.cooled(events(spark), "user_id", "ts", "event_id", seconds=100).collect()}
    last = {}
    for i in range(40):
        u, s = i % 3, 25 * i
        want = u not in last or s - last[u] >= 100
        if want:
            last[u] = s
        assert got[i] == want


def test_window_counts_stream(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events(spark).schema).parquet(str(tmp_path / "in"))
    q = limits.window_counts(stream, "user_id", "ts").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    want = {tuple(r) for r in limits.window_counts(events(spark), "user_id", "ts").collect()}
    assert {tuple(r) for r in spark.table("counts").collect()} == want


def test_cooldown_stream(spark, tmp_path):
    events(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events(spark).schema).parquet(str(tmp_path / "in"))
    q = limits.cooled_stream(stream.select("user_id", "ts"), "user_id", "ts", seconds=100).writeStream.format("memory").queryName("cool").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    want = {(r.user_id, r.ts, r.issued) for r in limits.cooled(events(spark), "user_id", "ts", "event_id", seconds=100).collect()}
    assert {tuple(r) for r in spark.table("cool").collect()} == want


def test_ingest(spark, tmp_path):
    kind = "id string, source string, status string, content_hash string, ord long"
    prepare = lambda b: b.select("id", "source", "status", F.lit(None).cast("timestamp").alias("listed_at"), "content_hash", F.lit("{}").alias("body"), "ord")
    run = lambda: feeds.ingest(spark, str(tmp_path / "in"), kind, str(tmp_path / "store"), str(tmp_path / "c"), prepare, files=1).awaitTermination()
    spark.createDataFrame([("a", "EU", None, "1", 0), ("c", "CUSTOM", None, "1", 1)], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    run()
    assert {(r.id, r.content_hash) for r in feeds.latest_state(spark, str(tmp_path / "store")).collect()} == {("a", "1")}
    spark.createDataFrame([("a", "EU", None, "2", 0), ("b", "EU", "delisted", "1", 1)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert {(r.id, r.content_hash, r.status) for r in feeds.latest_state(spark, str(tmp_path / "store")).collect()} == {("a", "2", "active"), ("b", "1", "delisted")}
    assert spark.read.parquet(str(tmp_path / "store/versions")).count() == 3


def test_dispatch(spark, tmp_path):
    rows = [(1, "error", "{}", 1000), (2, "view", "{}", 1000)]
    kind = "event_id int, event_type string, body string, at long"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    subs = spark.createDataFrame([("all", ["*"]), ("err", ["error"])], "subscription_id string, events array<string>")
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    feeds.dispatch(stream, subs, "s", str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.event_id, r.subscription_id) for r in out} == {(1, "all"), (1, "err"), (2, "all")}
    assert all(fields.verify(r.body, r.signature, "s", 1100) for r in out)
    feeds.audit(stream, str(tmp_path / "log"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
