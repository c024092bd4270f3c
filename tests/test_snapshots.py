"""Snapshot changes against brute force over random deliveries."""

import random

import pytest
from pyspark.sql import functions as F

from rosterspark.operators.snapshots import canonical_set, canonical_text, snapshot_changes

SCHEMA = "source string, snapshot_no int, line_no long, record_id string, name string, tags array<string>, digest string"


def changes(spark, rows, applied, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    log = spark.createDataFrame(applied, "source string, snapshot_no int")
    compared = [canonical_text(F.col("name")), canonical_set(F.col("tags"))]
    out = snapshot_changes(df, log, "source", "snapshot_no", "record_id", "line_no", compared, **more)
    return sorted(tuple(r) for r in out.collect())


def brute(rows, applied):
    log = {}
    for s, n in applied:
        log.setdefault(s, set()).add(n)
    of = {}
    for s, n, line, key, name, tags, _ in rows:
        if None in (s, n, key):
            continue
        tags = frozenset(t.strip() for t in tags or [] if t and t.strip())
        d = of.setdefault((s, n), {})
        if key not in d or line > d[key][0]:
            d[key] = (line, (name or "").strip(), tags)
    out = []
    for s, numbers in log.items():
        numbers = sorted(numbers)
        for a, b in zip(numbers, numbers[1:]):
            x, y = of.get((s, a), {}), of.get((s, b), {})
            for k in x.keys() | y.keys():
                if k not in x:
                    out.append((s, b, k, "added"))
                elif k not in y:
                    out.append((s, b, k, "removed"))
                elif x[k][1:] != y[k][1:]:
                    out.append((s, b, k, "changed"))
    return sorted(out)


@pytest.mark.parametrize("chunk", [1, 4, 64])
def test_random(spark, chunk):
    rnd = random.Random(5)
    rows = []
    for s in "ABB":  # B is repeated: a hot source
        for n in (1, 2, 4, 5):
            for i in range(120):
                if rnd.random() < 0.9:
                    rows.append((s, n, rnd.randrange(10**6), f"k{i:03}", rnd.choice(["x", " x ", "y", None, ""]) if rnd.random() < 0.1 else f"n{i}", rnd.choice([["a", "b"], ["b", "a", "a"], ["b"]]) if i % 7 == 0 else None, "clash"))
    rows += [("A", 3, 1, "k1", "failed attempt", None, None), (None, 1, 1, "k1", "x", None, None), ("A", 1, 1, None, "x", None, None)]
    applied = [("A", 1), ("A", 2), ("A", 4), ("A", 5), ("B", 1), ("B", 2), ("B", 4), ("B", 5), ("B", 5), ("C", 1), ("C", 2), (None, 1)]
    assert changes(spark, rows, applied, chunk_keys=chunk) == brute(rows, applied)


def test_empty_delivery_removes_all(spark):
    rows = [("A", 1, 1, "k", "x", None, None)]
    assert changes(spark, rows, [("A", 1), ("A", 2)]) == [("A", 2, "k", "removed")]


def test_empty_tables(spark):
    assert changes(spark, [], []) == []
    assert changes(spark, [], [("A", 1)]) == []
    assert changes(spark, [("A", 1, 1, "k", "x", None, None)], []) == []
