"""Minimum bin slack: exact subset sums, whole items, filled containers."""

import itertools
import random
from collections import Counter

import pytest

from rosterspark.llm.packing import best_subset, fill_report, pack, patterns


def test_best_subset_is_optimal():
    rnd = random.Random(1)
    for _ in range(200):
        lengths = [rnd.randrange(1, 30) for _ in range(rnd.randrange(1, 10))]
        room = rnd.randrange(1, 60)
        counts = sorted(Counter(lengths).items(), reverse=True)
        used = best_subset(counts, room)
        best = max(s for r in range(len(lengths) + 1) for c in itertools.combinations(lengths, r) if (s := sum(c)) <= room)
        assert sum(n * k for n, k in used.items()) == best
        assert all(k <= dict(counts)[n] for n, k in used.items())


def test_patterns_hold_all():
    rnd = random.Random(2)
    lengths = [rnd.choice([5, 7, 11, 100, rnd.randrange(1, 101)]) for _ in range(3000)]
    out = patterns(lengths, 100)
    held = Counter()
    for used, times in out:
        assert sum(n * k for n, k in used.items()) <= 100
        for n, k in used.items():
            held[n] += k * times
    assert held == Counter(lengths)
    assert sum(t for _, t in out) <= -(-sum(lengths) // 100) + 2


def test_pack(spark):
    sizes = [(i, n) for i, n in enumerate([10, 10, 10, 250, 100, 1, 0, None, 99] * 40)] + [(3, 250), (None, 5)]
    df = spark.createDataFrame(sizes, "doc long, n long")
    rows = pack(df, "doc", "n", 100, group_items=100).collect()
    per = Counter()
    for r in rows:
        per[r.container_id] += r.n_tokens
    assert max(per.values()) <= 100
    whole = Counter((r.doc, r.n_tokens) for r in rows if r.n_tokens < 100 and r.start_token == 0)
    want = Counter((d, n) for d, n in sizes if n and n < 100 and d is not None)
    assert whole == want
    assert sum(r.n_tokens for r in rows) == sum(n for d, n in sizes if n and d is not None)
    long = [r for r in rows if r.doc == 3]
    assert sorted((r.part, r.start_token, r.n_tokens) for r in long) == sorted([(0, 0, 100), (1, 100, 100), (2, 200, 50)] * 2)
    report = fill_report(pack(df, "doc", "n", 100), 100).first()
    assert report.tokens == sum(per.values()) and report.filled > 0.98


def test_empty(spark):
    df = spark.createDataFrame([], "doc string, n long")
    assert pack(df, "doc", "n", 10).count() == 0
    assert fill_report(pack(df, "doc", "n", 10), 10).first().containers == 0
    with pytest.raises(ValueError):
        pack(df, "doc", "n", 0)
