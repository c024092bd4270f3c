"""Poisson replication: shares reached, caps kept, the same counts in any partitioning."""

from rosterspark.llm.mixing import capped_quantiles, mix, plan, shares, tokens_by_chance


def test_quantiles():
    for rate, cap in [(0.3, 1), (1.5, 3), (0.9, 4)]:
        below = capped_quantiles(rate, cap)
        assert abs(cap - sum(below) - rate) < 1e-9 and below == sorted(below)
    assert capped_quantiles(0, 2) == [1.0, 1.0]
    assert capped_quantiles(2, 2) == [0.0, 0.0]


def sources(spark):
    rows = [(f"a{i}", "big", 10 + i % 7) for i in range(9000)] + [(f"b{i}", "small", 30) for i in range(300)] + [(f"c{i}", "other", 5) for i in range(50)] + [(None, "small", 5), ("z", None, 5)]
    sizes = spark.createDataFrame(rows, "doc string, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("gone", 0.1, 2), (None, 0.1, 2)], "source string, target_share double, max_repeats int")
    return sizes, targets


def test_shares_and_caps(spark):
    sizes, targets = sources(spark)
    p = plan(tokens_by_chance(sizes, "doc", 1), targets)
    out = {r.source: r for r in shares(sizes, "doc", p, 1).collect()}
    assert set(out) == {"big", "small", "gone"}
    assert abs(out["big"].actual_share - 2 / 3) < 0.01 and abs(out["small"].actual_share - 1 / 3) < 0.01
    assert out["gone"].mix_rows == 0 and out["small"].most_copies <= 3 and out["big"].most_copies <= 1
    mixed = mix(sizes.withColumnRenamed("n_tokens", "copy"), "doc", p, 1)
    rows = mixed.collect()
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    assert len(rows) == sum(r.mix_rows for r in out.values())
    again = mix(sizes.repartition(13), "doc", p, 1).collect()
    assert sorted((r.doc or "", r.copy_no) for r in again) == sorted((r.doc or "", r.copy_no) for r in rows)
    firsts = [r.source for r in rows[: len(rows) // 4]]
    assert 0.05 < firsts.count("small") / len(firsts) < 0.4


def test_size_over_caps_falls_short(spark):
    sizes, targets = sources(spark)
    p = plan(tokens_by_chance(sizes, "doc", 1), targets, size=10**7)
    out = {r.source: r for r in shares(sizes, "doc", p, 1).collect()}
    assert out["small"].mix_tokens == 3 * (300 * 30 + 5) and out["big"].mix_rows == 9000


def test_empty(spark):
    sizes, targets = sources(spark)
    none = sizes.where("false")
    p = plan(tokens_by_chance(none, "doc", 1), targets)
    assert mix(none, "doc", p, 1).count() == 0
    assert {r.actual_share for r in shares(none, "doc", p, 1).collect()} == {0.0}
    assert plan(tokens_by_chance(sizes, "doc", 1), targets.where("false")) == []
    assert mix(sizes, "doc", [], 1).count() == 0
