"""The words of shown hits: each pair of names is compared by its own words, and by the plain rule."""

import random

from rosterspark.functions import namepairs, similarity
from rosterspark.operators import screening

from test_namepairs import names, plan_of
from test_screening import pair


def plain(a, b):
    """Greedy choice among the words of two names, and the words left over."""
    a, b = a.split(), b.split()
    taken = []
    for s, i, j in sorted(((pair(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), key=lambda t: (-t[0], *t[1:])):
        if s > 0 and all(i != x and j != y for x, y, _ in taken):
            taken.append((i, j, s))
    got = [(a[i], b[j], round(round(s, 6), 4)) for i, j, s in taken]
    got += [(x, None, None) for i, x in enumerate(a) if i not in {t[0] for t in taken}]
    return sorted(got + [(None, y, None) for j, y in enumerate(b) if j not in {t[1] for t in taken}], key=str)


def shown_of(spark, pairs):
    q = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "q_id long, name string")
    h = spark.createDataFrame([(i, f"r{i}", b, False) for i, (_, b) in enumerate(pairs)], "q_id long, record_id string, matched_name string, id_hit boolean")
    return h, q


def test_words_of_shown_hits(spark, monkeypatch):
    rnd = random.Random(5)
    asked, have = names(1, 60), names(2, 60)
    pairs = [(rnd.choice(asked), rnd.choice(have)) for _ in range(200)]
    for cells in (namepairs.CELLS, 7):
        monkeypatch.setattr(namepairs, "CELLS", cells)
        got = {}
        for x in screening.explain(*shown_of(spark, pairs)).collect():
            got.setdefault(x.q_id, []).append((x.query_word, x.record_word, None if x.word_score is None else round(x.word_score, 4)))
            assert x.particle == ((x.query_word or x.record_word) in similarity.PARTICLES)
        assert {i: sorted(x, key=str) for i, x in got.items()} == {i: plain(*p) for i, p in enumerate(pairs)}


def test_nameless_and_foreign(spark):
    h, q = shown_of(spark, [("anna", None), ("іван", "ivan petrov"), ("ivan", "...")])
    got = {(x.q_id, x.query_word, x.record_word, x.word_score) for x in screening.explain(h, q).collect()}
    assert got == {(0, "anna", None, None), (1, "іван", "ivan", 1.0), (1, None, "petrov", None), (2, "ivan", None, None)}
    assert screening.explain(h.where("false"), q).count() == 0


def test_vocabularies_do_not_meet(spark):
    """Only words of one pair are compared: no group of words meets another one, and pairs of words are not shuffled."""
    plan = plan_of(screening.explain(*shown_of(spark, [("anna berg", "anna bergh")])))
    assert "MapInArrow" in plan and "CoGroups" not in plan and plan.count("Exchange hashpartitioning") <= 2
