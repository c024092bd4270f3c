"""Snapshot against stored records: classes of change, soft delete, guard, new state and version trail.

Incoming and stored rows meet once, in a full outer join on the id (co-located if both are bucketed by it).
Everything else is read off the joined row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELIST_GUARD = 0.20
SAMPLES = 5


class GuardTripped(RuntimeError):
    """More of the active records would be delisted than the guard allows."""


def in_arrival_order(incoming: DataFrame) -> DataFrame:
    """``incoming`` (id, content_hash, ord...) with the hash of the same id's preceding row in the run, if any."""
    w = Window.partitionBy("id").orderBy("ord")
    return incoming.withColumn("earlier_hash", F.lag("content_hash").over(w)).withColumn("is_last", F.lead("ord").over(w).isNull())


def classify(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, ord, change) of incoming rows: added, updated (relisted or other content) or unchanged.

    ``stored``: id, status, content_hash. A repeated id is compared with what the run itself wrote before.
    """
    x = in_arrival_order(incoming).join(stored.select("id", F.lit(True).alias("known"), F.coalesce("status", F.lit("active")).alias("was"), F.col("content_hash").alias("old_hash")), "id", "left")
    change = (
        F.when(F.col("earlier_hash").isNotNull(), F.when(F.col("earlier_hash") == F.col("content_hash"), "unchanged").otherwise("updated"))
        .when(F.col("known").isNull(), "added")
        .when(F.col("was") == "delisted", "updated")
        .when(F.col("old_hash").eqNullSafe(F.col("content_hash")), "unchanged")
        .otherwise("updated")
    )
    return x.select("id", "ord", change.alias("change"))


def to_delist(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(id) of active stored records that the snapshot lacks; CUSTOM records are never among them."""
    active = stored.where((F.coalesce("status", F.lit("active")) != "delisted") & (F.col("source") != "CUSTOM"))
    return active.select("id").join(incoming.select("id").distinct(), "id", "left_anti")


def diff_counts(incoming: DataFrame, stored: DataFrame, skipped: int = 0, mode: str = "sync") -> DataFrame:
    """One row: parsed, added, updated, unchanged, delisted, skipped, active_count, delist_ratio, guard_tripped. ``append`` never delists."""
    c = classify(incoming, stored).agg(F.count("*").alias("parsed"), *[F.count_if(F.col("change") == k).alias(k) for k in ("added", "updated", "unchanged")])
    gone = (to_delist(incoming, stored) if mode == "sync" else stored.select("id").where("false")).agg(F.count("*").alias("delisted"))
    active = stored.agg(F.count_if(F.coalesce("status", F.lit("active")) != "delisted").alias("active_count"))
    ratio = F.when(F.col("active_count") > 0, F.col("delisted") / F.col("active_count")).otherwise(0.0)
    # three single rows
    return c.join(gone).join(active).withColumn("skipped", F.lit(skipped)).withColumn("delist_ratio", F.round(ratio, 6)).withColumn("guard_tripped", (F.col("active_count") > 0) & (ratio > DELIST_GUARD))


def guard(counts: DataFrame, force: bool = False) -> None:
    """Raise if the snapshot would delist more than a fifth of the active records, unless forced."""
    row = counts.first()
    if row.guard_tripped and not force:
        raise GuardTripped(f"{row.delisted} of {row.active_count} active records would be delisted")


def samples(changes: DataFrame, most: int = SAMPLES) -> DataFrame:
    """(change, id, n): the first ``most`` ids of each class in order of arrival."""
    w = Window.partitionBy("change").orderBy("ord", "id")
    return changes.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("change", "id", "n")


def upsert(incoming: DataFrame, stored: DataFrame, now: Column, import_id: str, delist: bool = False) -> DataFrame:
    """The joined state: id, change_type and both sides as structs ``i`` and ``s``.

    change_type: created, updated, delisted, relisted, unchanged (in the snapshot) or kept, delisted (not in it).
    ``incoming``: id, source, status, listed_at, content_hash, body; ``stored`` also created_at, delisted_at.
    The last row of a repeated id counts.
    """
    last = in_arrival_order(incoming).where("is_last").drop("earlier_hash", "is_last", "ord")
    i = last.select("id", F.struct(*[F.col(c) for c in last.columns if c != "id"]).alias("i"))
    s = stored.select("id", F.struct(*[F.col(c) for c in stored.columns if c != "id"]).alias("s"))
    j = i.join(s, "id", "full_outer")
    was, will = F.coalesce("s.status", F.lit("active")), F.coalesce("i.status", F.lit("active"))
    same = F.col("i.content_hash").eqNullSafe(F.col("s.content_hash"))
    gone = F.when(F.lit(delist) & (was != "delisted") & (F.col("s.source") != "CUSTOM"), "delisted").otherwise("kept")
    kind = (
        F.when(F.col("i").isNull(), gone)
        .when(F.col("s").isNull(), "created")
        .when((was == "delisted") & (will != "delisted"), "relisted")
        .when((was != "delisted") & (will == "delisted"), "delisted")
        .when(same, "unchanged")
        .otherwise("updated")
    )
    return j.withColumn("change_type", kind).withColumn("now", now).withColumn("import_id", F.lit(import_id))


def new_state(j: DataFrame) -> DataFrame:
    """The records after the import; nothing is deleted, created_at and the first listed_at stay."""
    wrote = F.col("change_type").isin("created", "updated", "relisted") | ((F.col("change_type") == "delisted") & F.col("i").isNotNull())
    pick = lambda c: F.when(wrote, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}"))
    status = F.when(F.col("change_type") == "delisted", "delisted").when(F.col("change_type") == "created", F.coalesce("i.status", F.lit("active"))).when(F.col("change_type") == "relisted", "active").otherwise(F.coalesce("s.status", F.lit("active")))
    delisted_at = F.when(F.col("change_type") == "delisted", F.col("now")).when(F.col("change_type") == "relisted", F.lit(None)).otherwise(F.col("s.delisted_at"))
    changed = ~F.col("change_type").isin("unchanged", "kept")
    return j.select(
        "id", pick("source").alias("source"), status.alias("status"), F.coalesce("s.listed_at", "i.listed_at", F.when(F.col("change_type") == "created", F.col("now"))).alias("listed_at"),
        delisted_at.alias("delisted_at"), pick("content_hash").alias("content_hash"), pick("body").alias("body"), F.coalesce("s.created_at", "now").alias("created_at"), F.when(changed, F.col("now")).otherwise(F.col("s.updated_at")).alias("updated_at"),
    )


def version_rows(j: DataFrame) -> DataFrame:
    """Rows to append to the version trail: one for each record that was written."""
    state = new_state(j.where("change_type not in ('unchanged', 'kept')"))
    kinds = j.select("id", "change_type", "import_id", "now")
    return state.join(kinds, "id").select("id", "import_id", "change_type", F.col("now").alias("changed_at"), "status", "content_hash", "body")


def drop_custom(incoming: DataFrame) -> DataFrame:
    """Automated imports never carry CUSTOM records."""
    return incoming.where(F.col("source") != "CUSTOM")
