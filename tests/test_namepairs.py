"""Words and names compared in groups, against the plain rule: nothing is lost, and pairs are not sent between tasks."""

import contextlib
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rosterspark.functions import namepairs
from rosterspark.operators import screening
from rosterspark.plans import core_queries

from test_screening import frames, score, words_of


def names(seed, n):
    rnd = random.Random(seed)
    pool = ["company", "limited", "al", "bin"] * 8 + words_of(random.Random(2), 25)
    return sorted({" ".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 6))) for _ in range(n)})


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_names_in_small_lots(spark, monkeypatch):
    """Many lots, tables of few lines and blocks of few pairs give what the plain rule gives."""
    asked, have = names(1, 50), names(2, 120)
    want = {(a, b): s for a in asked for b in have if (s := score(a, b)) >= 50}
    q, r = frames(spark, asked, have)
    of_q, q = screening.distinct_names(q, ["q_id"])
    of_r, r = screening.distinct_names(r, ["record_id", "ci"])
    text = {x.id: x.name for x in [*of_q.collect(), *of_r.collect()]}
    monkeypatch.setattr(namepairs, "CELLS", 200)
    a, b = namepairs._Names(q.toArrow()), namepairs._Names(r.toArrow())
    got = [(text[a.id[i]], text[b.id[j]], int(s)) for rows in namepairs.scores_of(a, b, 50) for i, j, s in zip(*rows)]
    assert len(got) == len(want) and {(x, y): s for x, y, s in got} == want


def test_pairs_stay_in_their_task(spark):
    """Pairs of names are made and compared within a task: no join makes them and no shuffle holds them."""
    q, n = frames(spark)
    plan = plan_of(screening.name_scores(q, n, least=50))
    assert "FlatMapCoGroupsInArrow" in plan and "jaro_winkler" not in plan and "greedy" not in plan


@pytest.mark.parametrize("mode", ["lossless", "reference"])
def test_groups_are_sent_as_one_small_value(spark, monkeypatch, mode):
    """A group is one row whatever it holds, unpacks to what was packed, and its names take fewer bytes than their rows; groups of any number give the same pairs."""
    keys = (lambda t: screening.reference_keys(t, False)) if mode == "reference" else None
    asked, have = names(3, 60), names(4, 3000)
    q, r = frames(spark, asked, have)
    _, plain = screening.distinct_names(r, ["record_id", "ci"], keys=keys)
    rows = namepairs.packed_groups(plain, 3).collect()
    assert sorted(x.own for x in rows) == [0, 1, 2]
    assert sum(len(x.body) for x in rows) < plain.toArrow().nbytes / 4
    table = plain.toArrow()
    a = namepairs._Names(table)
    b = namepairs._Names.unpacked(a.packed())
    assert vars(a).keys() == vars(b).keys()
    for c, x in vars(a).items():
        y = vars(b)[c]
        assert (x == y).all() and x.dtype.kind == y.dtype.kind if hasattr(x, "dtype") else x == y if not isinstance(x, (pa.Table, pa.Array)) else x.to_pylist() == y.to_pylist()
    monkeypatch.setattr(namepairs.wordpairs, "LEAST_GROUPS", 1)
    found = [sorted(map(tuple, screening.name_scores(q, r, mode, 60).collect()))]
    monkeypatch.setattr(namepairs, "GROUP_QUERIES", 25)
    monkeypatch.setattr(namepairs, "GROUP_NAMES", 700)
    found.append(sorted(map(tuple, screening.name_scores(q, r, mode, 60).collect())))
    assert found[0] and found[0] == found[1]


@pytest.mark.parametrize("name", ["sim05_best_alias", "jn01_blocking_recall_gap", "ag11_calibration_recall"])
def test_threshold_is_known_to_the_search(spark, monkeypatch, name):
    """Queries that keep hits of the threshold ask for these, and do not score all others first."""
    asked = []
    monkeypatch.setattr(screening, "name_scores", lambda q, n, mode="lossless", least=1: (asked.append(least), q.crossJoin(n).where("false").select(F.col("q_id"), "record_id", F.lit(0).alias("score"), F.lit("").alias("matched_name"), "ci"))[1])
    core_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked and set(asked) == {screening.THRESHOLD}
