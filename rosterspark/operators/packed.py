"""Several values packed in one field, split into one value per row with its position.

The text is split on its quote character. Odd pieces are literals; even pieces are split on the
delimiters of the field. An array fold puts the parts together again: the first part of a piece
belongs to the value that is open, each further part opens a new one. All of it is Column
expressions, so the operator is one narrow stage without shuffle or Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Always separators when outside quotes: bar, semicolon, tab, line end, bullet, a slash between blanks,
#: "aka" between values and the numbering "1) ... 2) ...".
STRONG = r"[|;\t\r\n•]|\s/(?=\s)|(?:^|\s)(?:a\.k\.a\.|aka|alias)(?=\s)|(?:^|\s)\d{1,2}\)(?=\s)"
_NOT_END = r'|;\t\r\n•,"'

#: Marks a single quote that encloses a value (private use, never in texts).
_MARK = "\ue000"
_OPEN = r"(^|[|;,\t\r\n•/]|\d\)|aka|a\.k\.a\.)(\s*)'(?=\S)"
_CLOSE = r"(?<=\S)'(\s*)(?=$|[|;,\t\r\n•]|/\s|\d{1,2}\)\s|aka\s|a\.k\.a\.\s)"


@dataclass(frozen=True)
class FieldRule:
    """How a field is packed beyond the strong separators.

    comma: ``always`` or ``alone`` (a separator only if the field has no strong one).
    comma_regex: the commas that separate.
    word: a word that separates values, or None.
    joined: for ``word``, pairs (word after it, largest edit distance): these are one name with what precedes.
    names: two comma parts without any similar word, the first of one word, are a surname and first names.
    """

    comma: str = "alone"
    comma_regex: str = ","
    word: str | None = None
    joined: tuple[tuple[str, int], ...] = ()
    names: bool = False


NAMES = FieldRule(names=True)
DATES = FieldRule("always", r"(?<![A-Za-z]{3,9}\.? \d{1,2}),|,(?!\s*\d{4}\b)", word="or")
COUNTRIES = FieldRule(
    "alone",
    rf",(?!\s*[^{_NOT_END}]*\b(?i:of|fo|off|oof)\s*(?:$|[|;,\t\r\n•]))",
    word="and",
    joined=(("herzegovina", 4), ("tobago", 2)),
)
NUMBERS = FieldRule("always")

PEP_FIELDS = {"aliases": NAMES, "dates_of_birth": DATES, "citizenships": COUNTRIES, "passports": NUMBERS}


def _marked(text: Column) -> Column:
    """Enclosing single quotes as marks, if the field has a pair of them at value edges."""
    pair = rf"(?:^|[|;,\t\r\n•/]|\d\)|aka|a\.k\.a\.)\s*'\S[^']*(?:\S'\S[^']*)*'\s*(?:$|[|;,\t\r\n•]|/\s|\d{{1,2}}\)\s|aka\s|a\.k\.a\.\s)"
    swapped = F.regexp_replace(F.regexp_replace(text, _OPEN, rf"$1$2{_MARK}"), _CLOSE, rf"{_MARK}$1")
    return F.when(text.rlike(pair), swapped).otherwise(text)


def _words(x: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: F.length(w) > 2)


def _rejoin_words(parts: Column, rule: FieldRule) -> Column:
    """Undo the split at ``rule.word`` before the words that belong to one name."""

    def own(p: Column) -> Column:
        first = F.regexp_extract(F.lower(F.translate(p, "&", "")), r"^\s*(\p{L}+)", 1)
        hit = F.lit(False)
        for word, most in rule.joined:
            hit = hit | ((F.substring(first, 1, 1) == word[0]) & (F.levenshtein(first, F.lit(word)) <= most))
        return hit

    def step(acc: Column, p: Column) -> Column:
        n = F.size(acc)
        glued = F.concat(F.slice(acc, 1, n - 1), F.array(F.concat(F.element_at(acc, -1), p)))
        return F.when((n > 0) & own(F.regexp_replace(p, r"^\s*(?i:and)\s", "")), glued).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


_CUT = "\ue001"


def _cut(even: Column, rule: FieldRule, comma: Column) -> Column:
    """The parts of an even piece: cut marks at the separators, then one split."""
    t = F.regexp_replace(even, STRONG, _CUT)
    t = F.when(comma, F.regexp_replace(t, rule.comma_regex, _CUT)).otherwise(t)
    if rule.word and not rule.joined:
        t = F.regexp_replace(t, rf"\s{rule.word}(?=\s)", _CUT)
    parts = F.split(t, _CUT, -1)
    if rule.word and rule.joined:
        # a look-ahead keeps the word, so that a joined name can be put together unchanged
        cut_words = F.flatten(F.transform(parts, lambda p: _rejoin_words(F.split(p, rf"(?=\s(?i:{rule.word})\s)", -1), rule)))
        parts = F.transform(cut_words, lambda p: F.regexp_replace(p, rf"^\s(?i:{rule.word})\s", ""))
    return parts


def _fold(pieces: Column, quote: Column, rule: FieldRule, comma: Column) -> Column:
    n = F.size(pieces)
    tagged = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        literal = (x["i"] % 2 == 1) & (x["i"] < n - 1)
        # after an odd number of quotes the last piece has no closing quote and is text with a quote in front
        text = F.when((x["i"] % 2 == 1) & (x["i"] == n - 1), F.concat(quote, x["p"])).otherwise(x["p"])
        parts = _cut(text, rule, comma)
        k = F.size(parts)
        closed = F.concat(acc["done"], F.array(F.concat(acc["open"], F.element_at(parts, 1))), F.slice(parts, 2, F.greatest(k - 2, F.lit(0))))
        return (
            F.when(literal, F.struct(acc["done"].alias("done"), F.concat(acc["open"], quote, x["p"], quote).alias("open")))
            .when(k == 1, F.struct(acc["done"].alias("done"), F.concat(acc["open"], text).alias("open")))
            .otherwise(F.struct(closed.alias("done"), F.element_at(parts, -1).alias("open")))
        )

    return F.aggregate(tagged, zero, step, lambda a: F.concat(a["done"], F.array(a["open"])))


def _clean(value: Column) -> Column:
    """Without outer blanks and what encloses, numbers or joins the value."""
    v = F.regexp_replace(value, r"^[\s ]+|[\s ]+$", "")
    v = F.regexp_replace(v, rf"^{_MARK}(.*){_MARK}$", "$1")
    v = F.translate(v, _MARK, "'")
    whole = v.rlike(r'(?s)^"(?:[^"]|"")*"$')
    inner = F.regexp_replace(F.regexp_replace(v, r'(?s)^"(.*)"$', "$1"), '""', '"')
    return F.regexp_replace(F.when(whole, inner).otherwise(v), r"^[\s ]+|[\s ]+$", "")


def unpack(field: Column, rule: FieldRule) -> Column:
    """The values of ``field`` in order, as ``array<string>``.

    Null, empty and blank fields, and fields of separators only, give an empty array. A repeated
    value is kept at each of its positions. A quote that does not enclose a value stays in it.
    """
    text = _marked(F.coalesce(field, F.lit("")))
    quote = F.when(F.contains(text, F.lit(_MARK)), F.lit(_MARK)).otherwise(F.lit('"'))
    bare = F.regexp_replace(text, rf'"[^"]*"|{_MARK}[^{_MARK}]*{_MARK}', "")
    strong = bare.rlike(STRONG)
    comma = F.lit(True) if rule.comma == "always" else ~strong
    pieces = F.when(F.contains(text, F.lit(_MARK)), F.split(text, _MARK, -1)).otherwise(F.split(text, '"', -1))
    if rule.names:
        halves = F.split(bare, ",", -1)
        alike = F.exists(_words(halves[0]), lambda a: F.exists(_words(halves[1]), lambda b: (F.levenshtein(a, b) <= 2) | F.startswith(a, b) | F.startswith(b, a)))
        one = (F.size(halves) == 2) & (bare == text) & F.trim(halves[0]).rlike(r"^\S+$") & F.trim(halves[1]).rlike(r"\S") & ~alike
        comma = comma & ~one
    values = F.transform(_fold(pieces, quote, rule, comma), _clean)
    return F.filter(values, lambda v: v != "")


def unpack_fields(df: DataFrame, key: list[str], fields: dict[str, FieldRule]) -> DataFrame:
    """One row (key..., field_name, pos, item) for each value of each of ``fields``.

    ``pos`` counts the non-empty values from 0. Other columns of ``df`` are dropped, so names that
    clash with the output do no harm; rows whose fields are all empty give no row.
    """
    packed = F.array(*[F.struct(F.lit(name).alias("field_name"), unpack(F.col(f"`{name}`"), rule).alias("items")) for name, rule in fields.items()])
    rows = df.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(key)], F.explode(packed).alias("__f"))
    out = rows.select(*[f"__k{i}" for i in range(len(key))], F.col("__f.field_name").alias("field_name"), F.posexplode("__f.items").alias("pos", "item"))
    return out.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(key)], "field_name", "pos", "item")
