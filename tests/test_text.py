"""Scalar functions: golden values."""

import unicodedata

from pyspark.sql import functions as F

from rosterspark.functions import country, fields, similarity
from rosterspark.functions.text import normalize_text, search_tokens, soundex_code, transliterate


def values(spark, f, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    got = values(spark, normalize_text, ["  Éric-Ng  O'Brien ", "", None, "ÅSA\tBjörn", "a^b`c", "Việt", "Ёлка Їжак", "!!!"])
    assert got == ["eric ng o brien", "", "", "asa bjorn", "abc", "viet", "елка іжак", ""]


def test_accents_agree_with_decomposition(spark):
    letters = [chr(c) for a, b in [(0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x1F00)] for c in range(a, b) if chr(c).isalpha() and len(chr(c).lower()) == 1]
    want = ["".join(x for x in unicodedata.normalize("NFD", c.lower()) if not unicodedata.combining(x)) for c in letters]
    got = values(spark, normalize_text, letters)
    assert [(c, g) for c, w, g in zip(letters, want, got) if len(w) == 1 and w.isalpha() and g != w] == []


def test_transliterate(spark):
    assert values(spark, transliterate, ["Абу Нидал", "Щука", "Αθήνα", "plain", None, "mixЖ"]) == ["abu nidal", "shtuka", "athina", None, None, "mixzh"]


def test_tokens(spark):
    df = spark.createDataFrame([(["Абу N", "abu Nidal", None],)], "n array<string>")
    assert df.select(search_tokens(F.col("n")).alias("t")).first().t == ["абу", "abu", "nidal"]


def test_soundex(spark):
    assert values(spark, soundex_code, ["Mohammed", "Muhammad", "Ashcraft", "Tymczak", "", None, "абу", "O'Hara"]) == ["M530", "M530", "A261", "T522", "", "", "", "O600"]


def test_jaro_winkler():
    pairs = {("MARTHA", "MARHTA"): 0.9611, ("DWAYNE", "DUANE"): 0.84, ("DIXON", "DICKSONX"): 0.8133, ("", "a"): 0.0, ("a", "a"): 1.0, ("abc", "xyz"): 0.0}
    for (a, b), want in pairs.items():
        assert abs(similarity.jaro_winkler(a, b) - want) < 1e-4 and similarity.jaro_winkler(a, b) == similarity.jaro_winkler(b, a)


def test_csv_escape_and_ids(spark):
    assert values(spark, fields.csv_escape, ["=1+1", 'a"b', "a,b", None, "-x\n", "ok"]) == ["'=1+1", '"a""b"', '"a,b"', "", '"\'-x\n"', "ok"]
    assert values(spark, fields.valid_entity_id, ["a_B-9", "__x__", "", None, "a b"]) == [True, False, False, False, False]
    assert values(spark, fields.redact_emails, ["to anna.b@x.org!"]) == ["to a***@x.org!"]


def test_documents_and_map(spark):
    kind = "array<struct<number:string,type_code:string,type_description:string,country_iso2:string,known_false:boolean,known_expired:boolean,reported_lost:boolean,revoked_by_issuer:boolean>>"
    df = spark.createDataFrame([([("007", "p", None, "SE", True, None, None, True), ("8", None, None, None, None, None, None, None)], {"apiToken": "x", "note": "mail b@c.de"})], f"d {kind}, m map<string,string>")
    row = df.select(fields.format_documents(F.col("d")).alias("d"), fields.redact_map(F.col("m")).alias("m")).first()
    assert row.d == ["p 007 (SE) [known false, revoked]", "8"] and row.m == {"apiToken": "[REDACTED]", "note": "mail b***@c.de"}


def test_signature():
    h = fields.sign("{}", "s", 1000)
    assert fields.verify("{}", h, "s", 1200) and not fields.verify("{}", h, "s", 1301) and not fields.verify("{ }", h, "s", 1000) and not fields.verify("{}", "junk", "s", 1000)


def test_country(spark):
    extra = spark.createDataFrame([("Sverige", "SE"), ("Talvenia", "XT")], "name string, code string")
    names = country.dictionary(spark, extra)
    df = spark.createDataFrame([(x,) for x in ["Sweden", "SWE", "sverige", "Швеция", "Talvenia", "qq", "nowhere", None, ""]], "c string")
    got = {r.c: r.code for r in country.with_codes(df, "c", "code", names).collect()}
    assert got == {"Sweden": "SE", "SWE": "SE", "sverige": "SE", "Швеция": "SE", "Talvenia": "XT", "qq": "QQ", "nowhere": None, None: None, "": None}
