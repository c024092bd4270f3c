"""Variant spellings of names: merge and rematch.

Profiles meet in blocks of the consonants of their telling words, one consonant left out each time.
Matched profiles are merged: the merged one has the spellings, initials, births, countries and numbers of
both, so it meets and matches profiles that neither met alone. Rounds go on until nothing merges.
Each round only compares pairs of which one side is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterspark.llm import agreement, words
from rosterspark.session import settled

#: Profiles in a block above which only members meet whose other fields allow a match.
HOT_BLOCK = 48
#: Merges of classes that are carried out together, as joins of one plan.
MERGES_KEPT = 4

_PARTS = ("kind", "names", "births", "countries", "numbers", "weights")


def consonants(word: Column) -> Column:
    """First letter and consonants, runs as one: what most misspellings leave as it is."""
    return F.regexp_replace(F.concat(F.substring(word, 1, 1), F.regexp_replace(F.substring(word, F.lit(2), F.length(word)), "[aeiouh]", "")), r"(.)\1+", "$1")


def _telling(strong: float) -> Column:
    found = F.filter("weights", lambda x: (x["w"] >= strong) & (F.length(x["t"]) >= 4))
    return F.array_distinct(F.transform(found, lambda x: x["t"]))


def block_keys(profiles: DataFrame, strong: float) -> DataFrame:
    """(entry_id, key, new, light): keys of the telling words; ``light`` is what rules pairs out."""

    def left_out(c: Column) -> Column:
        n = F.length(c)
        one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))
        return F.when(n >= 4, F.concat(F.array(c), one)).otherwise(F.array(c))

    keys = F.array_distinct(F.flatten(F.transform(_telling(strong), lambda t: left_out(consonants(t)))))
    return profiles.select("entry_id", F.explode(keys).alias("k"), "new", F.struct(*agreement.LIGHT).alias("light")).select("entry_id", F.xxhash64("k").alias("key"), "new", "light")


def split_by(of: str = "") -> list[Column]:
    """marks, own, meets: two profiles that are ``not_excluded`` share a mark (a year that fits, a country, a number), or
    neither births nor countries decide, as one of the two lacks them: then ``own`` of one is among ``meets`` of the other."""
    years = F.flatten(F.transform(of + "births", lambda b: F.transform(F.sequence(b["y1"] - 3, F.greatest(b["y1"], b["y2"]) + 3), lambda y: F.concat(F.lit("y"), y.cast("string")))))
    lands = F.transform(of + "countries", lambda c: F.concat(F.lit("c"), c))
    births, countries = F.size(of + "births") > 0, F.size(of + "countries") > 0
    own = F.when(births & countries, "has:both").when(births, "has:births").when(countries, "has:countries").otherwise("has:none")
    few = lambda *x: F.array(*[F.lit(f"has:{w}") for w in ("none", *x)])
    meets = F.when(births & countries, few()).when(births, few("countries")).when(countries, few("births")).otherwise(few("births", "countries", "both"))
    return [F.array_distinct(F.concat(years, lands, of + "numbers")).alias("marks"), own.alias("own"), meets.alias("meets")]


def candidates(profiles: DataFrame, strong: float, hot: int = HOT_BLOCK) -> DataFrame:
    """(a, b), a < b, one of them new, of profiles that meet in a block and that kind, births, countries and numbers do not exclude.

    In a hot block they meet by what they have in common of these, so that pairs they exclude are never made.
    """
    keys = settled(block_keys(profiles, strong))
    sizes = settled(keys.groupBy("key").agg(F.count("*").alias("n"), F.max("new").alias("any")).where("n > 1 and any").select("key", "n"))
    blocked = keys.join(sizes, "key")

    def met(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
        x = rows.select(*on, F.col("entry_id").alias("a"), F.col("light").alias("la"), F.col("new").alias("na"))
        y = other.select(*on, F.col("entry_id").alias("b"), F.col("light").alias("lb"), F.col("new").alias("nb"))
        pairs = x.join(y, on).where((F.col("a") < F.col("b")) & (F.col("na") | F.col("nb")) & agreement.of_one_kind("la", "lb"))
        return pairs.where(agreement.not_excluded(*agreement.beside("la", "lb"))).select("a", "b")

    calm = blocked.where(F.col("n") <= hot)
    pairs = met(calm, calm, ["key"])
    if not sizes.where(F.col("n") > hot).isEmpty():
        busy = blocked.where(F.col("n") > hot).select("entry_id", "key", "new", "light", *split_by("light."))
        # what may be met by, with the side it is for: marks for both, what one has for what the other meets
        ways = lambda of: F.explode(F.array_union(F.transform("marks", lambda m: F.concat(F.lit("m:"), m)), of))
        pairs = pairs.unionByName(met(busy.withColumn("m", ways(F.array("own"))), busy.withColumn("m", ways(F.col("meets"))), ["key", "m"]))
    return pairs.distinct()


def judged(pairs: DataFrame, profiles: DataFrame, variants: frozenset[tuple[str, str]], strong: float, more: list[str] = []) -> DataFrame:
    """``pairs`` (a, b, more...) with same and level by ``agreement``; ``profiles`` with ``body``."""
    full = pairs.join(profiles.select(F.col("entry_id").alias("a"), F.col("body").alias("body_a")), "a").join(profiles.select(F.col("entry_id").alias("b"), F.col("body").alias("body_b")), "b")
    schema = pairs.select("a", "b", *more).schema.add("same", "boolean").add("level", "integer")
    return full.select("a", "b", *more, "body_a", "body_b").mapInPandas(agreement.judge_pairs(variants, strong, ["a", "b", *more]), schema)


def roots_of(links: DataFrame) -> DataFrame:
    """(entry_id, root) for the ends of links: each points to its least neighbour, and pointers are followed to the end.

    Every step doubles the way followed and writes one small table; classes are small, so that one step is the rule.
    """
    both = links.select(F.col("b").alias("entry_id"), F.col("a").alias("to")).unionByName(links.select(F.col("a").alias("entry_id"), F.col("b").alias("to")))
    to = settled(both.groupBy("entry_id").agg(F.min("to").alias("to")).select("entry_id", F.least("entry_id", "to").alias("root")))
    beyond = lambda t, name: t.select(F.col("entry_id").alias("root"), F.col("root").alias(name))
    while True:
        twice = to.join(beyond(to, "next"), "root", "left").select("entry_id", F.coalesce("next", "root").alias("root"))
        step = settled(twice.join(beyond(to, "next"), "root", "left").select("entry_id", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")))
        to = step.select("entry_id", "root")
        if step.where("moved").isEmpty():
            return to


def merged(profiles: DataFrame) -> DataFrame:
    """One profile per ``root``: the union of what its members have."""
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    return profiles.groupBy(F.col("root").alias("entry_id")).agg(F.mode("kind", True).alias("kind"), *[flat(c) for c in ("names", "births", "countries", "numbers", "weights")])


def resolve(profiles: DataFrame, total: int, variants: frozenset[tuple[str, str]]) -> DataFrame:
    """(entry_id, class_id) of all profiles; ``profiles`` with ``weights``. Entries without a name are classes of their own.

    Equal profiles are put together first, so a profile that a third of all entries have is compared once.
    """
    strong = words.strong_weight(total)
    body = F.md5(F.to_json(F.struct(*[F.col(c) if c == "kind" else F.array_sort(c) for c in ("kind", "names", "births", "countries", "numbers")])).cast("binary"))
    first = profiles.withColumn("same", F.when(F.size("names") > 0, body).otherwise(F.concat(F.lit("own:"), "entry_id")))
    heads = first.groupBy("same").agg(F.min("entry_id").alias("class_id"))
    first = settled(first.join(heads, "same").drop("same"))
    members = first.select("entry_id", "class_id")
    shown = lambda df, new: df.select("entry_id", *_PARTS, F.lit(new).alias("new"), agreement.encoded().alias("body"))
    now = settled(shown(first.where((F.size("names") > 0) & (F.col("entry_id") == F.col("class_id"))), True))
    merges = 0
    while True:
        links = settled(judged(candidates(now, strong), now, variants, strong).where("same").select("a", "b"))
        if links.isEmpty():
            return members
        roots = roots_of(links)
        members = members.join(roots.select(F.col("entry_id").alias("class_id"), "root"), "class_id", "left").select("entry_id", F.coalesce("root", "class_id").alias("class_id"))
        merges += 1
        if merges % MERGES_KEPT == 0:
            members = settled(members)
        grown = shown(merged(now.join(roots, "entry_id")), True)
        now = settled(now.join(roots.select("entry_id"), "entry_id", "left_anti").withColumn("new", F.lit(False)).unionByName(grown.select(*now.columns)))


def pairs_of(members: DataFrame) -> DataFrame:
    """All pairs of entries of one class (the classes are the compact form)."""
    return members.select(F.col("entry_id").alias("a"), "class_id").join(members.select(F.col("entry_id").alias("b"), "class_id"), "class_id").where("a < b").select("a", "b")
