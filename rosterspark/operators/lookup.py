"""Single records and small sets of them by key, tokens by hash, and the stored table of name words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterspark.functions.fields import token_hash
from rosterspark.operators import overlay, screening


def scan(records: DataFrame, source: str | None, columns: list[str]) -> DataFrame:
    """``columns`` of the records of one source, of all if null; filter and columns reach the file scan."""
    return (records if source is None else records.where(F.col("source") == source)).select(*columns)


def multi_get(records: DataFrame, asked: DataFrame, key: str, overrides: DataFrame | None = None) -> DataFrame:
    """A row for each distinct asked key: the record with its overrides applied, ``found`` false where there is none. Null keys ask nothing."""
    full = overlay.apply_overrides(records, overrides, key) if overrides is not None else records
    ids = asked.select(key).where(F.col(key).isNotNull()).distinct()
    return ids.join(full.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def token_owners(presented: DataFrame, tokens: DataFrame, as_of: Column) -> DataFrame:
    """(presented columns, owner): the owner of each presented ``token`` whose hash is stored and not expired, else null.

    ``tokens``: hash, owner, expires_at (null: never). Of several rows with one hash the smallest owner counts.
    """
    valid = tokens.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of)).groupBy("hash").agg(F.min("owner").alias("owner"))
    return presented.withColumn("hash", token_hash(F.col("token"))).join(valid, "hash", "left").drop("hash")


def name_tokens(names: DataFrame, key: str) -> DataFrame:
    """(key, ci, i, t): the words of all names, as written and in Latin letters; written once as a table, it spares every search the tokenizing."""
    return screening.name_groups(names, key).select(key, "ci", F.col("gi").alias("i"), "t").distinct()
