"""Screening against a plain statement of the scoring rule, acceptance bounds, and modes against each other."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterspark.functions.similarity import jaro, jaro_many, jaro_winkler, jaro_winkler_many
from rosterspark.operators.screening import Options, explain, id_hits, name_scores, ranked, screen, with_decisions, word_scores

CODES = {c: d for d, letters in {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in letters}


def soundex(w):
    w = "".join(c for c in w if c.isascii() and c.isalpha())
    if not w:
        return ""
    out, last = w[0].upper(), CODES.get(w[0], "")
    for c in w[1:]:
        if c in "hw":
            continue
        d = CODES.get(c, "")
        if d and d != last:
            out += d
        last = d
    return (out + "000")[:4]


def pair(a, b):
    if a == b:
        return 1.0
    sa, sb, m = soundex(a), soundex(b), min(len(a), len(b))
    same = sa == sb and sa != ""
    if not same and m < 3:
        return 0.0
    raw = jaro_winkler(a, b)
    if a[0] != b[0] and sa and sa[1:] == sb[1:] and (a[1:] == b[1:] or raw >= 0.95):
        return 0.92
    jw = raw * (1 if a[0] == b[0] else 0.9)
    ph = (0.9 if jw >= 0.8 else 0.5) if same else 0.0
    ed = jw if m >= 3 and jw >= (0.9 if m <= 6 else 0.75) else 0.0
    return max(ph, ed)


def score(q, c):
    q, c = q.lower().replace("-", " ").split(), c.lower().replace("-", " ").split()
    cells = sorted(((-pair(x, y), i, j) for i, x in enumerate(q) for j, y in enumerate(c)), key=lambda t: t)
    used_q, used_c, got = set(), set(), []
    for s, i, j in cells:
        if s < 0 and i not in used_q and j not in used_c:
            used_q.add(i)
            used_c.add(j)
            got.append((-s, i, j))
    w = lambda x: 0.3 if x in ("al", "bin", "ibn", "el", "abu", "van", "de") else 1.0
    qc = sum(s * w(q[i]) for s, i, _ in got) / sum(map(w, q))
    cc = sum(s * w(c[j]) for s, _, j in got) / sum(map(w, c))
    raw = qc * (0.7 + 0.3 * cc) if qc and cc else 0.0
    return int(min(raw, 1.0 if q == c else 0.99) * 100 + 0.5)


NAMES = ["Vladimir Putin", "Muhammad Al-Amin", "Ali Hassan", "Al-Tikriti Hassan Omar", "Kim Jong Un", "Abu Nidal", "Khawa Deng", "Germain Katanga", "Sultani Makenga", "Emmanuel Bemba", "Saif", "Linda Lamd", "Musa", "Souleiman Irhayyim", "Al Rashid Bin Laden Al-Sayed"]
QUERIES = ["Vladmir Putin", "Mohammed Al-Amin", "Hassan Ali", "Al Hassan", "Angela Merkel", "Kahwa", "Ghermay", "Souleiman", "Esmaeli", "Qusay", "k", "linda", "kim", "Al Bin Omar", "Ibrahim"]


def frames(spark, queries=QUERIES, names=NAMES):
    q = spark.createDataFrame([(f"q{i}", n) for i, n in enumerate(queries)], "q_id string, name string")
    n = spark.createDataFrame([(f"r{i}", 0, x) for i, x in enumerate(names)], "record_id string, ci int, name string")
    return q, n


def test_all_pairs_by_rule(spark):
    q, n = frames(spark)
    got = {(r.q_id, r.record_id): r.score for r in name_scores(q, n, "exhaustive").collect()}
    want = {(f"q{i}", f"r{j}"): s for (i, a), (j, b) in itertools.product(enumerate(QUERIES), enumerate(NAMES)) if (s := score(a, b)) > 0}
    assert got == want


def test_modes(spark):
    q, n = frames(spark)
    hits = {m: {tuple(r) for r in name_scores(q, n, m).where("score >= 65").collect()} for m in ("lossless", "reference", "exhaustive")}
    assert hits["lossless"] == hits["exhaustive"] and hits["reference"] <= hits["exhaustive"]


BOUNDS = [
    ("Vladmir Putin", "Vladimir Putin", 80, 99), ("Mohammed Al-Amin", "Muhammad Al-Amin", 65, 99), ("Ali Hassan", "Hassan Ali", 80, 99), ("Kim Jong Un", "kim jong un", 100, 100),
    ("Al Hassan", "Al-Tikriti Hassan Omar", 0, 89), ("Al Bin Omar", "Al Rashid Bin Laden Al-Sayed", 0, 64), ("Angela Merkel", "Kim Jong Un", 0, 39), ("Abu Nidal", "Абу Нидал", 65, 99),
    ("linda", "LAMD", 0, 64), ("musa", "MZEE", 0, 64), ("linda", "INDA", 0, 64), ("Qusay", "Musa", 0, 0),
]


def test_bounds(spark):
    q = spark.createDataFrame([(i, b[0]) for i, b in enumerate(BOUNDS)], "q_id int, name string")
    n = spark.createDataFrame([(i, 0, b[1]) for i, b in enumerate(BOUNDS)], "record_id int, ci int, name string")
    got = {r.q_id: r.score for r in name_scores(q, n).where("q_id = record_id").collect()}
    for i, (query, name, low, high) in enumerate(BOUNDS):
        assert low <= got.get(i, 0) <= high, (query, name)


def words_of(rnd, n):
    """Words of few and of many letters, and of each some with letters exchanged, left out, doubled or another at the beginning."""
    out = ["abcdefgh", "badcfehg", "abcdefghi", "badcfehgi", "ва", "вано", "x", "xy", "bob", "rob"]
    for _ in range(n):
        w = "".join(rnd.choice("aeioubcdfghklmnprstz") for _ in range(rnd.randrange(1, 13)))
        out.append(w)
        for _ in range(3):
            v = list(w)
            for _ in range(rnd.randrange(1, 4)):
                i = rnd.randrange(len(v))
                k = rnd.randrange(4)
                if k == 0 and i + 1 < len(v):
                    v[i], v[i + 1] = v[i + 1], v[i]
                elif k == 1 and len(v) > 1:
                    del v[i]
                elif k == 2:
                    v.insert(i, v[i])
                else:
                    v[0] = rnd.choice("abcdemnst")
            out.append("".join(v))
    base = "zoravnemistukepgladhibcofurnepat"
    out += [base[:n] for n in range(10, 33, 3)] + ["x" + base[1:n] for n in range(12, 33, 3)] + [base[1] + base[0] + base[2:n] for n in range(11, 33, 3)]
    return sorted(set(out))


def test_word_keys_lose_nothing(spark):
    """Every pair of words that scores at all is found by keys, also words whose neighbours are all exchanged."""
    rnd = random.Random(8)
    q, r = words_of(rnd, 120), words_of(random.Random(8), 120)
    found = {(x.qt, x.rt): x.s for x in word_scores(spark.createDataFrame([(w,) for w in q], "t string"), spark.createDataFrame([(w,) for w in r], "t string"), "lossless").collect()}
    want = {(a, b): s for a in q for b in r if (s := pair(a, b)) > 0}
    assert set(found) == set(want) and all(abs(found[k] - s) < 1e-9 for k, s in want.items())
    assert found["abcdefgh", "badcfehg"] > 0


def test_probes_lose_nothing(spark):
    """Names of common and rare words at several thresholds: the probes find what comparing every pair finds."""
    rnd = random.Random(5)
    pool = ["anna", "ana", "maria", "karl", "ali", "al", "bin"] * 6 + words_of(random.Random(2), 25)
    name = lambda: " ".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 5)))
    q, n = frames(spark, [name() for _ in range(60)], [name() for _ in range(150)])
    every = {(x.q_id, x.record_id, x.score) for x in name_scores(q, n, "exhaustive").collect()}
    for least in (45, 70):
        assert {(x.q_id, x.record_id, x.score) for x in name_scores(q, n, least=least).collect()} == {x for x in every if x[2] >= least}
    assert {(x.q_id, x.record_id, x.score) for x in name_scores(q, n).collect()} == every


def test_jaro_of_batches():
    rnd = random.Random(1)
    texts = words_of(rnd, 60) + ["", "a b c d" * 20, "x" * 300, "ünïcödé", "a" * 64, "a" * 65]
    a, b = [rnd.choice(texts) for _ in range(3000)], [rnd.choice(texts) for _ in range(3000)]
    got, raised = jaro_many(np.array(a), np.array(b)), jaro_winkler_many(np.array(a), np.array(b))
    assert all(abs(g - jaro(x, y)) < 1e-12 for g, x, y in zip(got, a, b)) and all(abs(g - jaro_winkler(x, y)) < 1e-12 for g, x, y in zip(raised, a, b))


def test_threshold_zero_returns_every_record(spark):
    r = records(spark)
    names = spark.createDataFrame([(i, 0, x) for i, x in zip("abcd", ["Anna Berg", "Kim", "Olga", "Zoe"])], "record_id string, ci int, name string")
    q = spark.createDataFrame([("1", "Anna Berg", None, None)], "q_id string, name string, dob string, country string")
    got = {x.record_id: x.score for x in screen(q, r, names, Options(threshold=0)).collect()}
    assert set(got) == {"a", "b", "d"} and got["a"] == 100 and got["d"] == 0


RECORD = "record_id string, source string, type string, status string, birth_dates array<struct<raw:string,birth_year:int,birth_month:int,birth_day:int,year_range_from:int,year_range_to:int>>, countries array<string>"


def records(spark):
    born = [("1960-01-02", None, None, None, None, None)]
    return spark.createDataFrame([("a", "EU", "individual", "active", born, ["SE"]), ("b", "UN", "entity", None, None, []), ("c", "EU", "individual", "delisted", born, ["SE"]), ("d", "US", "individual", "active", None, ["DE"])], RECORD)


def test_screen(spark):
    r = records(spark)
    names = spark.createDataFrame([(i, k, x) for i in "abcd" for k, x in enumerate(["", "Anna Berg", "Berg Anna Maria"])], "record_id string, ci int, name string")
    q = spark.createDataFrame([("1", "Anna Bergh", "1960", "SE"), ("2", "AB-12 34", None, None), ("3", "  ", None, None)], "q_id string, name string, dob string, country string")
    numbers = spark.createDataFrame([("d", "ab1234"), ("a", "12")], "record_id string, number string")
    rows = {(x.q_id, x.record_id): x for x in screen(q, r, names, Options(threshold=50), numbers).collect()}
    assert set(rows) == {("1", "a"), ("1", "b"), ("1", "d"), ("2", "d")}
    base = rows["1", "b"].score
    assert rows["1", "a"].score == min(100, base + 20) and rows["1", "d"].score == base - 20 and rows["2", "d"].score == 100
    assert rows["1", "a"].matched_name == "Anna Berg" and rows["2", "d"].id_hit
    delisted = screen(q, r, names, Options(include_delisted=True, source="eu", type="INDIVIDUAL", threshold=50), numbers)
    assert {x.record_id for x in delisted.collect()} == {"a", "c"}
    top = ranked(screen(q, r, names, Options(threshold=50), numbers), 2).where("q_id = '1'").orderBy("rank").collect()
    assert [x.record_id for x in top] == ["a", "b"] and top[0].total_matches == 3 and top[0].truncated
    words = explain(ranked(screen(q, r, names, Options(threshold=50)), 1), q).where("q_id = '1'").collect()
    assert {(w.query_word, w.record_word) for w in words} == {("anna", "anna"), ("bergh", "berg")}


def test_id_hits_need_length(spark):
    q = spark.createDataFrame([("1", "1 2-3"), ("2", None)], "q_id string, name string")
    assert id_hits(q, spark.createDataFrame([("r", "123")], "record_id string, number string")).count() == 0


def test_options():
    o = Options(limit=float("nan"), threshold=900).clean()
    assert (o.limit, o.threshold) == (20, 100) and Options(limit=1000).clean().limit == 100 and Options(limit=-1).clean().limit == 20 and Options(limit=0).clean().limit == 0
    assert Options(threshold=0).clean().mode == "exhaustive"
    with pytest.raises(ValueError):
        Options(mode="x").clean()


def test_decisions(spark):
    hits = spark.createDataFrame([("a", "s", 80), ("b", "s", 70)], "record_id string, subject_id string, score int")
    d = spark.createDataFrame([("a", "s", "false_positive", "valid"), ("b", "t", "false_positive", "valid")], "record_id string, subject_id string, verdict string, validity string")
    assert {(r.record_id, r.auto_cleared) for r in with_decisions(hits, d).collect()} == {("a", True), ("b", False)}
    assert [r.record_id for r in with_decisions(hits, d, suppress=True).collect()] == ["b"]


def test_empty(spark):
    q, n = frames(spark)
    assert name_scores(q.where("false"), n).count() == 0 and name_scores(q, n.where("false")).count() == 0
    assert name_scores(q, n.withColumn("name", F.lit(None).cast("string"))).count() == 0
