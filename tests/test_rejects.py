"""Raw list lines: the reason of each bad line, and the same verdicts on the fast path and line by line."""

import random

from rosterspark.operators.rejects import Header, diagnose, loadable, parse_uploads, rejected, strict_values

HEAD = "﻿Key;FullName;aliases;type;source;dob\r"
LINES = [
    ("a1;Ann;;individual;PEP;1960", None),
    (" a2 ; Ann ;\"x;y\"; ENTITY;pep;", None),
    ('"a3";"A ""B"" C";;;;', None),
    (' "a4" ;Ann;;;;', None),
    ('a5;An"n;;;;', "quoting"),
    ('a6;"Ann";"x"y;;;', "quoting"),
    ('a7;"Ann;;;;', "quoting"),
    ("a8;Ann;;;", "columns"),
    ("a9;Ann;;;;;", "columns"),
    ("$1;Ann;;;;", "id"),
    (";Ann;;;;", "id"),
    ("__x__;Ann;;;;", "id"),
    ("b1;Ann;;;UN;", "source"),
    ("$2;Ann;;boat;UN;", "id"),
    ("b2;Ann;;boat;;", "type"),
    ("b3;" + "long " * 9000 + ";;;;", None),
]


def frame(spark, lines, upload="u", source=" pep "):
    rows = [(upload, 1, source, HEAD, "c")] + [(upload, i + 2, source, line, "c") for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "upload_id string, line_no int, default_source string, line string, header string")


def test_reasons(spark):
    lines = [x for x, _ in LINES] + ["", " \t", None]
    parsed = parse_uploads(frame(spark, lines), block_lines=5)
    bad = {r.line_no: r.reason for r in rejected(parsed).collect()}
    assert bad == {i + 2: why for i, (_, why) in enumerate(LINES) if why}
    good = {r.line_no: r for r in loadable(parsed).collect()}
    assert set(good) == {i + 2 for i, (_, why) in enumerate(LINES) if not why}
    assert good[3].id == "a2" and good[3].aliases == "x;y" and good[3].type == "ENTITY"
    assert good[4].name == 'A "B" C' and good[4].passports is None


def test_blocks_equal_lines(spark):
    rnd = random.Random(3)
    alphabet = ['"', '""', ";", "a", " ", "individual", "PEP", "$", "b;c", ""]
    lines = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 14))) + ";x" for _ in range(1500)]
    lines += [f"k{i};n;;entity;PEP;" for i in range(1500)]
    rnd.shuffle(lines)
    header = Header(HEAD)
    want = {i + 2: diagnose(x, header, "PEP")[0] for i, x in enumerate(lines) if x.strip()}
    for block in (1, 64, 4096):
        got = {r.line_no: r.failure for r in parse_uploads(frame(spark, lines), block).select("line_no", "failure").collect()}
        assert got == want


def test_strict_values():
    assert strict_values('a; "b;c" ;d', ";") == ["a", "b;c", "d"]
    assert strict_values("", ";") == [""]
    assert strict_values('"', ";") is None
    assert strict_values("a\t\tb\t", "\t") == ["a", "", "b", ""]


def test_empty_and_headless(spark):
    df = frame(spark, ["a1;Ann;;;;"])
    assert parse_uploads(df.where("false")).count() == 0
    assert parse_uploads(df.where("line_no > 1")).count() == 0
