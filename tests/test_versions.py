"""Diff classes, guard, upsert table, overlays and logs."""

import pytest
from pyspark.sql import functions as F

from rosterspark.operators import overlay, versions

IN = "id string, source string, status string, listed_at timestamp, content_hash string, body string, ord long"
STORED = "id string, source string, status string, listed_at timestamp, delisted_at timestamp, content_hash string, body string, created_at timestamp, updated_at timestamp"


def stored(spark, rows):
    return spark.createDataFrame([(i, s, st, None, None, h, "b", None, None) for i, s, st, h in rows], STORED).withColumn("created_at", F.to_timestamp(F.lit("2020-01-01")))


def incoming(spark, rows):
    return spark.createDataFrame([(i, "EU", st, None, h, "n", k) for k, (i, st, h) in enumerate(rows)], IN)


def test_classify_with_repeats(spark):
    s = stored(spark, [("a", "EU", "active", "1"), ("b", "EU", "delisted", "1"), ("c", "EU", None, "1"), ("x", "CUSTOM", None, "1"), ("z", "EU", None, "1")])
    i = incoming(spark, [("a", None, "1"), ("b", None, "1"), ("c", None, "2"), ("n", None, "5"), ("n", None, "5"), ("n", None, "6")])
    got = [(r.id, r.change) for r in versions.classify(i, s).orderBy("ord").collect()]
    assert got == [("a", "unchanged"), ("b", "updated"), ("c", "updated"), ("n", "added"), ("n", "unchanged"), ("n", "updated")]
    assert [r.id for r in versions.to_delist(i, s).collect()] == ["z"]
    row = versions.diff_counts(i, s).first()
    assert (row.parsed, row.added, row.updated, row.unchanged, row.delisted, row.active_count) == (6, 1, 3, 2, 1, 4) and row.guard_tripped
    with pytest.raises(versions.GuardTripped):
        versions.guard(versions.diff_counts(i, s))
    versions.guard(versions.diff_counts(i, s), force=True)
    assert versions.diff_counts(i, s, mode="append").first().delisted == 0


def test_guard_is_strict(spark):
    s = stored(spark, [(str(k), "EU", None, "1") for k in range(5)])
    assert not versions.diff_counts(incoming(spark, [(str(k), None, "1") for k in range(4)]), s).first().guard_tripped


def test_upsert_table_and_idempotence(spark):
    s = stored(spark, [("same", "EU", "active", "1"), ("other", "EU", "active", "1"), ("back", "EU", "delisted", "1"), ("off", "EU", "active", "1"), ("offoff", "EU", "delisted", "1"), ("gone", "EU", "active", "1"), ("own", "CUSTOM", "active", "1")])
    i = incoming(spark, [("same", "active", "1"), ("other", None, "2"), ("back", None, "1"), ("off", "delisted", "1"), ("offoff", "delisted", "2"), ("new", None, "1"), ("newoff", "delisted", "1")])
    now = F.to_timestamp(F.lit("2024-01-01"))
    j = versions.upsert(i, s, now, "imp", delist=True)
    kinds = {r.id: r.change_type for r in j.collect()}
    assert kinds == {"same": "unchanged", "other": "updated", "back": "relisted", "off": "delisted", "offoff": "updated", "new": "created", "newoff": "created", "gone": "delisted", "own": "kept"}
    state = versions.new_state(j)
    rows = {r.id: r for r in state.collect()}
    assert rows["gone"].status == "delisted" and rows["gone"].delisted_at.year == 2024 and rows["back"].delisted_at is None and rows["newoff"].status == "delisted"
    assert rows["other"].content_hash == "2" and rows["other"].created_at.year == 2020 and rows["new"].created_at.year == 2024 and rows["same"].updated_at is None
    assert {r.id for r in versions.version_rows(j).collect()} == set(kinds) - {"same", "own"}
    again = versions.upsert(i, state, now, "imp", delist=True)
    assert {r.change_type for r in again.collect()} <= {"unchanged", "kept"}


def test_overlay(spark):
    r = spark.createDataFrame([("a", "EU", "x", "y"), ("b", "EU", "x", "y")], "id string, source string, p string, q string")
    o = spark.createDataFrame([("a", ["p", "q", "source", "nosuch"], "new", None, "UN")], "id string, present array<string>, p string, q string, source string")
    got = {x.id: x for x in overlay.apply_overrides(r, o, "id").collect()}
    assert (got["a"].p, got["a"].q, got["a"].source, got["a"].overridden) == ("new", None, "EU", ["p", "q"]) and got["b"].overridden == []


def test_validity_order(spark):
    rows = [("true_match", "2020-01-01", "1", "2"), ("false_positive", "2020-01-01", "1", "2"), ("false_positive", "2030-01-01", "1", "2"), ("false_positive", None, None, "2"), ("false_positive", None, "2", "2"), ("false_positive", "2024-01-01", "2", "2")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, e string, a string, b string").withColumn("e", F.to_timestamp("e"))
    got = df.select("i", overlay.decision_validity(F.col("v"), F.col("e"), F.col("a"), F.col("b"), F.to_timestamp(F.lit("2024-01-01"))).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == ["not_whitelisted", "invalidated_expired", "invalidated_data_changed", "valid", "valid", "invalidated_expired"]


def test_alert_ids_are_stable(spark):
    h = spark.createDataFrame([("s", "r", 90, False), ("s", "q", 90, True)], "subject_id string, record_id string, score int, auto_cleared boolean")
    a, b = overlay.alerts(h).collect(), overlay.alerts(h).collect()
    assert a == b and len(a) == 1


def test_not_yet_applied(spark):
    log = spark.createDataFrame([("x", "applied"), ("y", "failed")], "sha256 string, status string")
    up = spark.createDataFrame([("x",), ("y",), ("z",)], "sha256 string")
    assert {r.sha256 for r in overlay.not_yet_applied(up, log).collect()} == {"y", "z"}
