"""Word statistics of profiles: rarity, and variants of a name learned from entries that use both."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is telling (a surname, the stem of a firm) from this part of the largest possible rarity on.
STRONG_PART = 0.55
#: Entries that must use two words in the same place before they count as variants of each other.
VARIANT_SUPPORT = 3


def with_weights(profiles: DataFrame, total: int) -> DataFrame:
    """``profiles`` with ``weights``: (t, w) of each word of its names; w is the word's rarity over all profiles."""
    each = profiles.select("entry_id", F.explode(F.array_distinct(F.flatten("names"))).alias("t"))
    counted = each.groupBy("t").agg(F.count("*").alias("n"))
    weighted = each.join(counted, "t").groupBy("entry_id").agg(F.collect_list(F.struct("t", F.log(1 + F.lit(float(total)) / F.col("n")).alias("w"))).alias("weights"))
    return profiles.join(weighted, "entry_id", "left").withColumn("weights", F.coalesce("weights", F.array().cast("array<struct<t:string,w:double>>")))


def strong_weight(total: int) -> float:
    return STRONG_PART * math.log(1 + total)


def variants(profiles: DataFrame, support: int = VARIANT_SUPPORT) -> frozenset[tuple[str, str]]:
    """Pairs of words that stand for each other in the names of ``support`` or more entries.

    Two names of one entry with all words but one in common, and at least one in common, give a pair. The whole
    table is collected, whatever its size, so that the support asked for does not depend on it.
    """
    slim = profiles.where(F.size("names") > 1).select("entry_id", "names")
    a = slim.select("entry_id", "names", F.explode("names").alias("a"))
    b = a.select("entry_id", "a", F.explode("names").alias("b")).where((F.size("a") == F.size("b")) & (F.size("a") > 1))
    only_a, only_b = F.array_except("a", "b"), F.array_except("b", "a")
    one = b.where((F.size(only_a) == 1) & (F.size(only_b) == 1)).select("entry_id", only_a[0].alias("x"), only_b[0].alias("y")).where((F.length("x") > 2) & (F.length("y") > 2) & (F.col("x") < F.col("y")))
    counted = one.groupBy("x", "y").agg(F.count_distinct("entry_id").alias("n"))
    return frozenset((r.x, r.y) for r in counted.where(F.col("n") >= support).select("x", "y").collect())
