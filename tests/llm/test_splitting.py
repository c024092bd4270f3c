"""Pieces: round trip, limits, overlap, boundaries, and the same result for any range size."""

import random

import pytest

from rosterspark.llm.splitting import split_files, split_texts
from rosterspark.llm.tokens import tokenizer, tokenizer_path

LIMIT, OVERLAP = 64, 8


def long_text(rnd, n):
    words = ["alpha", "Straße", "кафе", "über-all", "don't", "x", "100", "tail."]
    out = []
    for i in range(n):
        out.append(rnd.choice(words))
        out.append(rnd.choice([" ", " ", " ", "  ", ". ", ".\n", "\n\n", "\t"]))
    return "".join(out)


def texts():
    rnd = random.Random(4)
    return [
        (1, "short one"), (2, ""), (3, None), (4, long_text(rnd, 300)), (5, long_text(rnd, 4000)),
        (6, "x" * 5000), (7, " " * 3000), (8, "é" * 2500), (9, "word " * 900), (10, "\n\n".join(["para one two three."] * 200)),
        (11, long_text(rnd, 500) + "ї" * 1500 + long_text(rnd, 500)), (None, "lost"), (4, long_text(rnd, 300)),
    ]


def check(rows, source):
    t = tokenizer(tokenizer_path())
    raw = source.encode()
    rows = sorted(rows, key=lambda r: r.piece_no)
    assert [r.piece_no for r in rows] == list(range(len(rows))) and {r.n_pieces for r in rows} == {len(rows)}
    assert rows[0].begin_byte == 0 and rows[-1].end_byte == len(raw)
    for r in rows:
        assert r.piece == raw[r.begin_byte : r.end_byte].decode()
        assert t.count(r.piece) <= LIMIT
    for a, b in zip(rows, rows[1:]):
        assert a.begin_byte < b.begin_byte <= a.end_byte < b.end_byte
        assert b.overlap_tokens <= OVERLAP
    assert (len(rows) > 1) == (t.count(source) > LIMIT)


@pytest.mark.parametrize("range_bytes", [512, 1 << 18])
def test_pieces(spark, range_bytes):
    data = texts()[:-1]
    df = spark.createDataFrame([(k, x, "clash") for k, x in data], "doc int, text string, piece string")
    got = {}
    for r in split_texts(df, "doc", "text", LIMIT, OVERLAP, range_bytes=range_bytes).collect():
        got.setdefault(r.doc, []).append(r)
    assert set(got) == {k for k, x in data if x is not None and k is not None}
    for k, x in data:
        if k in got:
            check(got[k], x)


def test_ranges_do_not_matter(spark):
    data = [(k, x) for k, x in texts() if k in (5, 9, 10)]
    df = spark.createDataFrame(data, "doc int, text string")
    runs = [sorted(tuple(r) for r in split_texts(df, "doc", "text", LIMIT, OVERLAP, range_bytes=n).collect()) for n in (300, 1000, 1 << 20)]
    assert runs[0] == runs[1] == runs[2]


def test_natural_boundaries(spark):
    df = spark.createDataFrame([(1, "\n\n".join(["para one two three."] * 200))], "doc int, text string")
    rows = sorted(split_texts(df, "doc", "text", LIMIT, OVERLAP).collect(), key=lambda r: r.piece_no)
    assert all(r.piece.endswith("three.") for r in rows)
    assert all(1 <= r.overlap_tokens for r in rows[1:])


def test_empty_and_bad_parameters(spark):
    df = spark.createDataFrame([], "doc int, text string")
    assert split_texts(df, "doc", "text", LIMIT, OVERLAP).count() == 0
    with pytest.raises(ValueError):
        split_texts(df, "doc", "text", 10, 5)


def test_repeated_rows_and_equal_keys(spark):
    """Texts of one key stay apart, repeated rows come out as often as they came, at any range size."""
    rnd = random.Random(9)
    a, b = long_text(rnd, 900), long_text(rnd, 700)
    df = spark.createDataFrame([("k", a), ("k", b), ("k", a)], "doc string, text string")
    runs = [sorted(tuple(r) for r in split_texts(df, "doc", "text", LIMIT, OVERLAP, range_bytes=n).collect()) for n in (500, 1 << 20)]
    assert runs[0] == runs[1]
    one = sorted(tuple(r) for r in split_texts(df.limit(2), "doc", "text", LIMIT, OVERLAP, range_bytes=500).collect())
    assert len(runs[0]) > len(one) and set(runs[0]) == set(one)


def test_files_by_range(spark, tmp_path):
    """Files are read by ranges alone and give the pieces of their whole texts."""
    rnd = random.Random(2)
    data = {"a.txt": long_text(rnd, 3000), "b.txt": long_text(rnd, 40), "c.txt": ""}
    for name, text in data.items():
        (tmp_path / name).write_bytes(text.encode())
    whole = spark.createDataFrame([(k, v) for k, v in data.items()], "doc string, text string")
    want = sorted(tuple(r) for r in split_texts(whole.where("text <> ''"), "doc", "text", LIMIT, OVERLAP).collect())
    got = sorted((r.path.rsplit("/", 1)[1], *tuple(r)[1:]) for r in split_files(spark, str(tmp_path), LIMIT, OVERLAP, range_bytes=700).collect())
    assert got == want


def test_table_without_pieces(spark):
    df = spark.createDataFrame([(1, long_text(random.Random(3), 2000)), (2, "short")], "doc int, text string")
    full = sorted(tuple(r)[:7] for r in split_texts(df, "doc", "text", LIMIT, OVERLAP, range_bytes=800).collect())
    assert full == sorted(tuple(r) for r in split_texts(df, "doc", "text", LIMIT, OVERLAP, range_bytes=800, with_piece=False).collect())
