"""Analysts' layers over records: overrides, decisions, custom records, alerts; all as logs with a latest view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.functions.fields import stable_id, valid_entity_id

#: Columns that no override changes.
IMMUTABLE = ("id", "record_id", "source", "created_at", "updated_at", "first_seen_import", "last_seen_import", "content_hash")


def latest(log: DataFrame, key: list[str], order: str, action: str | None = None) -> DataFrame:
    """The last row of each key; keys whose last ``action`` is ``deleted`` are gone."""
    newest = log.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in log.columns if c not in key]), F.col(order)).alias("v")).select(*key, "v.*")
    return newest.where(F.col(action) != "deleted") if action else newest


def apply_overrides(records: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """``records`` with the fields an override names; ``overridden`` lists them.

    ``overrides``: key, ``present`` (names of fields it sets, null being a value too) and the fields themselves.
    """
    fields = [c for c in overrides.columns if c not in (key, "present") and c in records.columns and c not in IMMUTABLE]
    o = overrides.select(key, "present", *[F.col(f).alias(f"__{f}") for f in fields])
    j = records.join(o, key, "left")
    sets = lambda f: F.coalesce(F.array_contains("present", f), F.lit(False))
    out = [F.when(sets(c), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in records.columns]
    allowed = F.array(*[F.lit(f) for f in fields]).cast("array<string>")
    return j.select(*out, F.array_sort(F.array_intersect(F.coalesce("present", F.array().cast("array<string>")), allowed)).alias("overridden"))


def override_history(log: DataFrame, key: list[str], order: str, action: str) -> DataFrame:
    """The log with ``change``: created, replaced or deleted (a deletion of nothing leaves no row)."""
    before = F.lag(action).over(Window.partitionBy(*key).orderBy(order))
    none = before.isNull() | (before == "deleted")
    change = F.when(F.col(action) == "deleted", F.when(~none, "deleted")).when(none, "created").otherwise("replaced")
    return log.withColumn("change", change).where("change is not null")


def decision_validity(verdict: Column, expires_at: Column, decided_hash: Column, current_hash: Column, as_of: Column) -> Column:
    """not_whitelisted, invalidated_expired (not after ``as_of``), invalidated_data_changed or valid; the first that applies."""
    return (
        F.when(verdict != "false_positive", "not_whitelisted")
        .when(expires_at <= as_of, "invalidated_expired")
        .when(decided_hash.isNotNull() & current_hash.isNotNull() & (decided_hash != current_hash), "invalidated_data_changed")
        .otherwise("valid")
    )


def insert_missing(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``stored`` and the rows of ``new`` whose key it lacks."""
    return stored.unionByName(new.join(stored.select(key), key, "left_anti").select(*stored.columns))


def patch(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``stored`` with the non-null fields of ``changes``."""
    fields = [c for c in changes.columns if c != key]
    j = stored.join(changes.select(key, *[F.col(f).alias(f"__{f}") for f in fields]), key, "left")
    return j.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in stored.columns])


def delete_custom(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``stored`` without the given ids, of source CUSTOM only: no other record is ever deleted."""
    return stored.join(ids.select(key, F.lit("CUSTOM").alias("source")), [key, "source"], "left_anti").select(*stored.columns)


def checked_subjects(subjects: DataFrame) -> DataFrame:
    """``subjects`` with ``error`` (null if they can be registered) and their id from content."""
    error = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "name is required").when(~valid_entity_id(F.col("customer_id")), "customer id is invalid")
    return subjects.withColumn("error", error).withColumn("subject_id", F.when(error.isNull(), stable_id("sub", F.col("customer_id"), F.col("name"))))


def alerts(hits: DataFrame) -> DataFrame:
    """Alerts of hits that are not cleared: the id is made of subject and record, so a second run adds none."""
    return hits.where("not auto_cleared").select(stable_id("alt", F.col("subject_id"), F.col("record_id")).alias("alert_id"), "subject_id", "record_id", "score", F.lit("open").alias("status"))


def resolve_alerts(open_alerts: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts with their new status, decisions made). ``verdicts``: alert_id, verdict (false_positive or true_match), decided_by."""
    j = open_alerts.join(verdicts, "alert_id", "left")
    status = F.when(F.col("verdict") == "false_positive", "dismissed").when(F.col("verdict").isNotNull(), "confirmed").otherwise(F.col("status"))
    done = j.where("verdict is not null").select("record_id", "subject_id", "verdict", "decided_by")
    return j.select(*[status.alias(c) if c == "status" else F.col(c) for c in open_alerts.columns]), done


def subscribed(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(event, subscription) pairs: a subscription names the event's type, or ``*`` for all. Both are exploded to an equi-join."""
    wanted = subscriptions.select("subscription_id", F.explode(F.array_distinct("events")).alias("wanted"))
    asked = events.select("*", F.explode(F.array(F.col("event_type"), F.lit("*"))).alias("wanted"))
    return asked.join(wanted, "wanted").drop("wanted").distinct()


def import_state(log: DataFrame, as_of: Column, stale_minutes: int = 15) -> DataFrame:
    """The last state of each import with ``retry``: failed, rejected, or pending for longer than ``stale_minutes``."""
    last = latest(log, ["import_id"], "at")
    stale = (F.col("status") == "pending") & (F.col("at") < as_of - F.make_dt_interval(mins=F.lit(stale_minutes)))
    return last.withColumn("retry", F.col("status").isin("failed", "rejected") | stale)


def not_yet_applied(uploads: DataFrame, log: DataFrame) -> DataFrame:
    """Uploads whose digest no applied import has."""
    return uploads.join(log.where("status = 'applied'").select("sha256"), "sha256", "left_anti")
