"""Import sessions, their lock, merging of fields, digests, and lookups."""

import datetime

import pytest
from pyspark.sql import functions as F

from rosterspark.operators import imports, lookup, versions

ROWS = "id string, source string, status string, listed_at timestamp, content_hash string, body string, ord long"
STORED = "id string, source string, status string, listed_at timestamp, delisted_at timestamp, content_hash string, body string, created_at timestamp, updated_at timestamp"
AT = datetime.datetime(2024, 1, 1)


def now():
    return F.to_timestamp(F.lit("2024-06-01"))


def stored(spark):
    rows = [(f"a{i}", "EU", "active", AT, None, f"h{i}", "{}", AT, AT) for i in range(10)] + [("z", "UN", "active", AT, None, "h", "{}", AT, AT), ("c", "CUSTOM", None, AT, None, "h", "{}", AT, AT)]
    return spark.createDataFrame(rows, STORED)


def chunk(spark, ids, source="EU", h="h"):
    return spark.createDataFrame([(f"a{i}", source, None, None, f"{h}{i}", "{}", k) for k, i in enumerate(ids)], ROWS)


def test_session(spark, tmp_path):
    s = imports.ImportSession(spark, str(tmp_path), "EU", "i1", mode="sync")
    with pytest.raises(imports.Locked):
        imports.ImportSession(spark, str(tmp_path), "EU", "i2")
    imports.ImportSession(spark, str(tmp_path), "UN", "i3").abort()
    s.add(chunk(spark, range(6)))
    s.add(chunk(spark, [5, 6, 7, 8, 20], h="new"))  # a5 again, with other content
    s.add(chunk(spark, [1], source="UN"))  # another source's rows are no part of it
    counts, state, trail = s.finish(stored(spark), now())
    c = counts.first()
    assert (c.parsed, c.added, c.updated, c.unchanged, c.delisted, c.guard_tripped) == (11, 1, 4, 6, 1, False)
    got = {r.id: (r.status, r.content_hash) for r in state.collect()}
    assert len(got) == 13 and got["a9"][0] == "delisted" and got["a5"] == ("active", "new5") and got["a20"] == ("active", "new20") and got["z"] == ("active", "h") and "c" in got
    assert {(r.id, r.change_type) for r in trail.collect()} == {("a9", "delisted"), ("a20", "created"), *[(f"a{i}", "updated") for i in (5, 6, 7, 8)]}


def test_append_dry_run_guard_and_abort(spark, tmp_path):
    before = stored(spark)
    s = imports.ImportSession(spark, str(tmp_path), "EU", "i1")
    s.add(chunk(spark, [0]))
    assert s.finish(before, now())[0].first().delisted == 0  # append never delists
    s = imports.ImportSession(spark, str(tmp_path), "EU", "i2", mode="sync", dry_run=True)
    s.add(chunk(spark, [0]))
    counts, state, trail = s.finish(before, now())
    assert counts.first().delisted == 9 and counts.first().guard_tripped and trail.count() == 0
    assert {tuple(r) for r in state.collect()} == {tuple(r) for r in before.collect()}
    s = imports.ImportSession(spark, str(tmp_path), "EU", "i3", mode="sync")
    s.add(chunk(spark, [0]))
    with pytest.raises(versions.GuardTripped):
        s.finish(before, now())
    forced = imports.ImportSession(spark, str(tmp_path), "EU", "i4", mode="sync", force=True)
    forced.add(chunk(spark, [0]))
    assert forced.finish(before, now())[1].where("status = 'delisted'").count() == 9
    empty = imports.ImportSession(spark, str(tmp_path), "EU", "i5", mode="sync", force=True)
    assert empty.finish(before, now())[1].where("status = 'delisted'").count() == 0  # without any chunk nothing is delisted
    gone = imports.ImportSession(spark, str(tmp_path), "EU", "i6")
    gone.add(chunk(spark, [0]))
    gone.abort()
    assert not (tmp_path / "staged" / "i6").exists()
    with pytest.raises(ValueError):
        imports.ImportSession(spark, str(tmp_path), "EU", "i7", mode="x")


def test_stale_lock(spark, tmp_path):
    import time

    lock = imports.ImportLock(spark, str(tmp_path), "EU")
    lock.acquire()
    with pytest.raises(imports.Locked):
        imports.ImportLock(spark, str(tmp_path), "EU").acquire()
    imports.ImportLock(spark, str(tmp_path), "EU").acquire(time.time() + imports.LOCK_SECONDS + 60)
    lock.release()


def test_merge_fields(spark):
    kind = "id string, a string, b string, note string"
    old = spark.createDataFrame([("1", "x", "y", "mine"), ("2", "x", None, None)], kind)
    new = spark.createDataFrame([("1", "x2", None, "theirs"), ("3", None, "n", "theirs")], kind)
    assert {tuple(r) for r in imports.merge_fields(new, old, "id", ["note"]).collect()} == {("1", "x2", None, "mine"), ("2", "x", None, None), ("3", None, "n", "theirs")}


def test_unseen(spark):
    files = spark.createDataFrame([("p1", "d1"), ("p2", "d1"), ("p3", "d2"), ("p4", "d3")], "path string, sha256 string")
    assert {r.path for r in imports.unseen(files, spark.createDataFrame([("d2",)], "sha256 string")).collect()} == {"p1", "p4"}


def test_lookups(spark):
    r = spark.createDataFrame([("1", "a"), ("2", None)], "record_id string, programme string")
    asked = spark.createDataFrame([("1",), ("1",), ("9",), (None,)], "record_id string")
    assert {tuple(x) for x in lookup.multi_get(r, asked, "record_id").select("record_id", "programme", "found").collect()} == {("1", "a", True), ("9", None, False)}
    tokens = spark.createDataFrame([("t1", "me", None), ("t2", "old", AT), ("t1", "you", None)], "token string, owner string, expires_at timestamp").withColumn("hash", F.sha2("token", 256)).drop("token")
    got = lookup.token_owners(spark.createDataFrame([("t1",), ("t2",), ("t3",), (None,)], "token string"), tokens, now()).collect()
    assert {(x.token, x.owner) for x in got} == {("t1", "me"), ("t2", None), ("t3", None), (None, None)}
