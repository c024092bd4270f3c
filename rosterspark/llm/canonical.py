"""Freely typed values mapped to a canonical list: token repair, then soft TF-IDF over complete entries.

Every distinct word of the values is joined once with the words of the reference vocabulary that it may
be a misspelling of: the two share a form with up to two letters left out, and their edit distance decides.
A value is then compared with each entry that shares a repaired, telling word with it, by the cosine of
rarity weights in which a repaired word counts by its similarity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.functions.text import strip_accents
from rosterspark.llm import places
from rosterspark.session import checkpointed

#: Least soft cosine of a value with the entry it is mapped to.
LEAST_SCORE = 0.72
#: Weight of words of official forms, against 1 to about 8 of telling words.
FORM_WEIGHT = 0.35

_UNMATCHED = "-"


def plain_words(c: Column, notes: bool = False) -> Column:
    """Lower case without accents, initials with full stops as one word, only letters and digits; a note in brackets is left out unless ``notes``."""
    x = strip_accents(F.lower(F.coalesce(c, F.lit(""))))
    for a, b in (("ß", "ss"), ("ø", "o"), ("æ", "ae"), ("ł", "l"), ("đ", "d")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, r"(?<![\p{L}\p{N}])(\p{L})\.(?=\p{L}(?:\.|$|\s))", "$1")
    if not notes:
        noted = F.regexp_replace(x, r"[\[(][^\])]*[\])]", " ")
        x = F.when(noted.rlike(r"[\p{L}\p{N}]"), noted).otherwise(x)  # a note in brackets beside the value
    return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))


def left_out(word: Column, longest: Column) -> Column:
    """The word, and its forms with one letter left out (from 4 letters) or two (from 6).

    A word over three letters longer than ``longest``, the longest of the vocabulary, is no misspelling of any of its words and has no forms.
    """
    n = F.length(word)

    def without_one(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    one = without_one(word)
    two = F.flatten(F.transform(one, without_one))
    none = F.array().cast("array<string>")
    near = n <= longest + 3
    return F.array_distinct(F.concat(F.array(word), F.when((n >= 4) & near, one).otherwise(none), F.when((n >= 6) & near, two).otherwise(none)))


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / length; an exchange of two letters counts as little more than one error."""
    lev = F.levenshtein(a, b)
    exchanged = (lev == 2) & (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    distance = F.when(exchanged, F.lit(1.2)).otherwise(lev.cast("double"))
    length = F.greatest(F.length(a), F.length(b))
    most = F.when(length <= 3, 0).when(length <= 5, 1.2).when(length <= 8, 2).otherwise(3)
    return F.when(distance <= most, 1 - distance / length)


def vocabulary(entries: DataFrame, form_words: list[str]) -> tuple[DataFrame, DataFrame, float, int]:
    """(known, weight, form), (phrase, code, listed, known, phrase_norm, telling), weight of an unknown word, and letters of the longest word.

    ``entries``: code, phrase (plain words), listed. A word weighs the more the fewer codes have it; form words weigh little.
    """
    spark = entries.sparkSession
    each = entries.select("code", "listed", "phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("known")).where("known <> ''")
    forms = spark.createDataFrame([(w,) for w in form_words], "known string").select("known", F.lit(None).cast("string").alias("code"))
    counted = each.select("known", "code").unionByName(forms).groupBy("known").agg(F.collect_set("code").alias("codes"), F.max(F.col("code").isNull()).alias("form"))
    size = each.agg(F.count_distinct("code").alias("codes"), F.max(F.length("known")).alias("longest")).first()
    unknown = 1 + math.log(max(1, size.codes))
    words = checkpointed(counted.select("known", F.when(F.col("form"), FORM_WEIGHT).otherwise(unknown - F.log(F.size("codes").cast("double"))).alias("weight"), "form"))
    per = each.join(words, "known").groupBy("code", "phrase", "listed").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("phrase_norm"), F.min("form").alias("only_form"), F.collect_list(F.struct("known", "form")).alias("w"))
    phrases = per.select("code", "phrase", "listed", "phrase_norm", "only_form", F.explode("w").alias("w")).select("phrase", "code", "listed", "w.known", "phrase_norm", (F.col("only_form") | ~F.col("w.form")).alias("telling"))
    return words, phrases, unknown, size.longest or 0


def map_values(values: DataFrame, column: str, entries: DataFrame, form_words: list[str], least: float = LEAST_SCORE) -> DataFrame:
    """(column, code, score, listed) of each distinct value: the best entry's code, or ``-`` with the score below ``least``.

    ``entries``: code, phrase (by ``plain_words``), listed; a table of any size. Null, empty and wordless values map to ``-``.
    Ties go to listed entries, then more words matched, then the smaller code.
    """
    words, phrases, unknown_weight, most = vocabulary(entries, form_words)
    longest = F.lit(most)
    distinct = checkpointed(values.select(F.col(column).alias("value")).distinct().withColumn("plain", plain_words(F.col("value"))))
    # values that differ only in case, accents and punctuation share one comparison
    plain = distinct.select("plain").where("plain != ''").distinct().withColumn("typed", F.explode(F.array_distinct(F.split("plain", " "))))
    # a form is met by its hash; what two words have in common by accident of it their distance tells apart
    keys = words.select("known", "weight", F.explode(left_out(F.col("known"), longest)).alias("key")).select("known", "weight", F.xxhash64("key").alias("key"))
    typed = plain.select("typed").distinct().select("typed", F.explode(left_out(F.col("typed"), longest)).alias("key")).select("typed", F.xxhash64("key").alias("key"))
    met = typed.join(keys, "key").groupBy("typed").agg(F.collect_set(F.struct("known", "weight")).alias("k"))
    near = F.filter(F.transform("k", lambda k: F.struct(similarity(F.col("typed"), k["known"]).alias("sim"), (-k["weight"]).alias("lighter"), k["known"].alias("known"))), lambda k: k["sim"].isNotNull())
    repaired = met.select("typed", near.alias("k")).where(F.size("k") > 0)
    # words too short for repair may still be a mistyped form word
    short = F.array(*[F.lit(w) for w in form_words if len(w) <= 3]) if any(len(w) <= 3 for w in form_words) else F.array().cast("array<string>")
    mistyped = (F.length("typed") <= 3) & F.exists(short, lambda w: F.levenshtein(F.col("typed"), w) <= F.floor(F.length(w) / 2))
    unknown = F.when(mistyped, F.lit(FORM_WEIGHT)).otherwise(F.lit(unknown_weight))
    # the nearest known word, the lightest of equally near ones
    own = F.array_max("k")
    weighed = plain.join(repaired, "typed", "left").select("plain", "typed", "k", F.coalesce(-own["lighter"], unknown).alias("own_weight"))
    value_norm = F.sum(F.col("own_weight") ** 2).over(Window.partitionBy("plain"))
    each = weighed.withColumn("value_norm", value_norm).where("k is not null").select("plain", "typed", "own_weight", "value_norm", F.explode("k").alias("k"))
    each = each.select("plain", "typed", "own_weight", "value_norm", "k.sim", "k.known", (-F.col("k.lighter")).alias("weight"))
    # all that follows is per plain value: one exchange serves it
    hits = each.join(phrases, "known").repartition("plain")
    hits = hits.select("plain", "value_norm", "phrase", "code", "listed", "phrase_norm", "typed", "known", "telling", (F.col("sim") * F.col("weight") ** 2).alias("part"), (F.col("weight") ** 2 - F.col("own_weight") ** 2).alias("swap"))
    # a typed word stands for one word of an entry, and a word of an entry is met once
    entry = ["plain", "value_norm", "phrase", "code", "listed", "phrase_norm"]
    once = hits.groupBy(*entry, "typed").agg(F.max(F.struct("part", "known", "telling", "swap")).alias("m")).groupBy(*entry, "m.known").agg(F.max(F.struct("m.part", "m.telling", "m.swap")).alias("m"))
    scored = once.groupBy(*entry).agg(F.sum("m.part").alias("dot"), F.max("m.telling").alias("telling"), F.sum("m.swap").alias("swap"), F.count("*").alias("matched")).where("telling")
    # in the value's norm, a word that is met counts with the weight of the word it stands for
    cosine = F.least(F.lit(1.0), F.col("dot") / (F.col("phrase_norm") * F.sqrt(F.col("value_norm") + F.col("swap"))))
    ranked = scored.select("plain", "code", F.round(cosine, 6).alias("score"), "matched", "listed")
    best = ranked.groupBy("plain").agg(F.max_by(F.struct("code", "score", "listed"), F.struct("score", "listed", "matched", _falling("code"))).alias("b"))
    found = distinct.join(best, "plain", "left")
    score = F.coalesce(F.col("b.score"), F.lit(0.0))
    return found.select(F.col("value").alias(column), F.when(score >= least, F.col("b.code")).otherwise(_UNMATCHED).alias("code"), score.alias("score"), F.coalesce((score >= least) & F.col("b.listed"), F.lit(False)).alias("listed"))


def _falling(code: str) -> Column:
    """A column that is larger for smaller codes, so that ``max_by`` prefers those."""
    return F.translate(F.col(code), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ZYXWVUTSRQPONMLKJIHGFEDCBA")


def map_countries(values: DataFrame, column: str, reference: DataFrame) -> DataFrame:
    """(column, code, score) with codes of ``reference`` (iso2, iso3, country_name) only: others are ``-``.

    The world's other countries stand in the vocabulary beside, so that a value that means one of them is not bent to a listed one.
    """
    listed = reference.where("iso2 is not null").select(F.col("iso2").alias("code"), F.explode(F.array("iso2", "iso3", "country_name")).alias("name"))
    named = listed.select("code", plain_words(F.col("name"), notes=True).alias("phrase"), F.lit(True).alias("listed"))
    world = values.sparkSession.createDataFrame(places.country_names(values.sparkSession), "code string, phrase string").withColumn("listed", F.lit(False))
    entries = world.unionByName(named).where("phrase <> ''").groupBy("code", "phrase").agg(F.max("listed").alias("listed"))
    # a code is listed with all its names
    entries = checkpointed(entries.groupBy("code").agg(F.collect_list("phrase").alias("p"), F.max("listed").alias("listed")).select("code", "listed", F.explode("p").alias("phrase")))
    mapped = map_values(values, column, entries, places.FORM_WORDS)
    return mapped.select(column, F.when(F.col("listed"), F.col("code")).otherwise(_UNMATCHED).alias("code"), "score")
