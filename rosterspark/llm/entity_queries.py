"""Queries p2, p3, p4 and p7 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.llm import addresses, canonical, matching, profiles, resolution, words
from rosterspark.operators import packed
from rosterspark.session import checkpointed, table


#: Official lists: one entry of a match across lists comes from these.
OFFICIAL = ["US", "EU", "UK", "UN", "CH", "UA"]


def country_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, row_key, field_name, pos, entry) of every non-empty country entry, as typed."""
    address = table(spark, sf_dir, "address")
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("entry")) for f in ("country", "country_iso2")]))
    of_address = address.select(F.lit("address").alias("src_table"), F.col("address_id").alias("row_key"), fields.alias("f")).select("src_table", "row_key", "f.field_name", F.lit(0).alias("pos"), "f.entry")
    pep = packed.unpack_fields(table(spark, sf_dir, "test_pep"), ["row_no"], {"citizenships": packed.COUNTRIES})
    of_pep = pep.select(F.lit("test_pep").alias("src_table"), F.col("row_no").alias("row_key"), "field_name", "pos", F.col("item").alias("entry"))
    return of_address.unionByName(of_pep).where(F.trim(F.coalesce("entry", F.lit(""))) != "")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = table(spark, sf_dir, "country_ref")
    entries = country_entries(spark, sf_dir)
    literal = reference.select(F.explode(F.array("iso2", "country_name")).alias("entry")).where("entry is not null").distinct()
    typed = checkpointed(entries.join(literal, "entry", "left_anti"))
    mapped = canonical.map_countries(typed, "entry", reference)
    return typed.join(mapped, "entry").select("src_table", "row_key", "field_name", "pos", F.col("code").alias("iso2"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = addresses.same_building(table(spark, sf_dir, "address"), "address_id", table(spark, sf_dir, "country_ref"))
    return pairs.select(F.col("a").alias("address_id_a"), F.col("b").alias("address_id_b"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per address with its class and the number of its links."""
    rows = addresses.with_links(table(spark, sf_dir, "address"), "address_id", table(spark, sf_dir, "country_ref"))
    return rows.withColumnRenamed("id", "address_id")


def _weighted(spark: SparkSession, sf_dir: str, only_custom: bool) -> tuple[DataFrame, int, frozenset]:
    plain = checkpointed(profiles.profiles(spark, sf_dir, only_custom))
    total = plain.count()
    return checkpointed(words.with_weights(plain, total)), total, words.variants(plain)


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their confidence."""
    found, total, variants = _weighted(spark, sf_dir, only_custom=False)
    pairs = matching.match(found, total, variants, OFFICIAL)
    return pairs.select(F.col("a").alias("entry_id_a"), F.col("b").alias("entry_id_b"), F.round("cosine", 4).alias("cosine"), "confidence")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_matches(spark, sf_dir).select("entry_id_a", "entry_id_b")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entry with its class."""
    found, total, variants = _weighted(spark, sf_dir, only_custom=True)
    return resolution.resolve(found, total, variants)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = resolution.pairs_of(p4_classes(spark, sf_dir))
    return pairs.select(F.col("a").alias("entry_id_a"), F.col("b").alias("entry_id_b"))


QUERIES = {"p2_found": p2_found, "p2_matches": p2_matches, "p3_found": p3_found, "p3_classes": p3_classes, "p4_found": p4_found, "p4_classes": p4_classes, "p7_found": p7_found}
