"""One import of a source from its first chunk to its end: lock, chunks, dry run, guard, merge of fields, digests already seen."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.operators import versions

#: Seconds after which another run may take over the lock of a run that has not ended.
LOCK_SECONDS = 15 * 60
MODES = ("append", "sync")


class Locked(RuntimeError):
    """Another import of the source is running."""


class ImportLock:
    """One running import for each source: a file in the shared store, created only if it is not there, on any file system of Spark."""

    def __init__(self, spark: SparkSession, store: str, source: str, stale: float = LOCK_SECONDS):
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(f"{store}/locks/{source}")
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.stale = stale

    def acquire(self, now: float | None = None) -> None:
        now = time.time() if now is None else now
        if self.fs.exists(self.path) and now - self.fs.getFileStatus(self.path).getModificationTime() / 1000 > self.stale:
            self.fs.delete(self.path, False)
        if not self.fs.createNewFile(self.path):
            raise Locked(str(self.path))

    def release(self) -> None:
        self.fs.delete(self.path, False)


def blocked(log: DataFrame, stale: int = LOCK_SECONDS) -> DataFrame:
    """(import_id, blocked): whether an earlier import of the same source, not older than ``stale`` seconds, was still running. ``log``: import_id, source, uploaded_at, finished_at."""
    o = log.select(F.col("source").alias("s"), F.col("import_id").alias("other"), F.col("uploaded_at").alias("from"), F.col("finished_at").alias("to"))
    before = (F.col("from") < F.col("uploaded_at")) & (F.col("from") >= F.col("uploaded_at") - F.expr(f"interval {stale} seconds"))
    running = F.col("to").isNull() | (F.col("to") > F.col("uploaded_at"))
    j = log.join(o, (F.col("source") == F.col("s")) & (F.col("import_id") != F.col("other")) & before & running, "left")
    return j.groupBy("import_id").agg((F.count("other") > 0).alias("blocked"))


def unseen(files: DataFrame, applied: DataFrame) -> DataFrame:
    """Files (sha256...) whose content no applied import (sha256) had; of equal files in one go the first path."""
    first = files.groupBy("sha256").agg(F.min("path").alias("path"))
    return files.join(first, ["sha256", "path"], "left_semi").join(applied.select("sha256").distinct(), "sha256", "left_anti")


def merge_fields(incoming: DataFrame, stored: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """``stored`` after an upsert of single fields.

    Rows of ``incoming`` bring their own fields, also null ones: what is gone upstream is removed. ``kept`` fields stay as stored (incoming ones count for
    new rows alone), and rows that are not in ``incoming`` stay whole.
    """
    fields = [c for c in stored.columns if c != key]
    i, s = incoming.select(key, F.struct(*[F.col(c) for c in fields]).alias("i")), stored.select(key, F.struct(*[F.col(c) for c in fields]).alias("s"))
    old = F.col("i").isNull()

    def value(c: str) -> Column:
        return F.when(old | (F.lit(c in kept) & F.col("s").isNotNull()), F.col(f"s.{c}")).otherwise(F.col(f"i.{c}")).alias(c)

    return i.join(s, key, "full_outer").select(key, *[value(c) for c in fields])


class ImportSession:
    """An import that takes its rows in chunks. Nothing is changed before ``finish``; ``abort`` leaves all as it was.

    Chunks (id, source, status, listed_at, content_hash, body, ord) are staged under ``store``; a later chunk counts as later. Mode ``append`` never
    delists, ``sync`` delists active records that are in no chunk, unless the guard holds. A dry run only counts.
    """

    def __init__(self, spark: SparkSession, store: str, source: str, import_id: str, mode: str = "append", dry_run: bool = False, force: bool = False, now: float | None = None):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.spark, self.store, self.source, self.import_id = spark, store, source, import_id
        self.mode, self.dry_run, self.force = mode, dry_run, force
        self.staged, self.chunks = f"{store}/staged/{import_id}", 0
        self.lock = ImportLock(spark, store, source)
        self.lock.acquire(now)

    def add(self, chunk: DataFrame) -> None:
        rows = chunk.where(F.col("source") == self.source)
        rows.write.mode("overwrite").parquet(f"{self.staged}/chunk={self.chunks:06d}")
        self.chunks += 1

    def _incoming(self, stored: DataFrame) -> DataFrame:
        if not self.chunks:
            return stored.limit(0).select("id", "source", "status", "listed_at", "content_hash", "body", F.lit(0).cast("long").alias("ord"))
        rows = self.spark.read.option("basePath", self.staged).parquet(self.staged)
        return rows.withColumn("ord", F.col("chunk").cast("long") * F.lit(1 << 40) + F.col("ord").cast("long")).drop("chunk")

    def finish(self, stored: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(counts, state, versions); state is ``stored`` and versions are empty in a dry run. Raises ``versions.GuardTripped`` unless forced or only counted."""
        mine = stored.where(F.col("source") == self.source)
        incoming = self._incoming(stored)
        counts = versions.diff_counts(incoming, mine, mode=self.mode)
        try:
            if self.dry_run:
                return counts, stored, versions.version_rows(versions.upsert(incoming.limit(0), mine.limit(0), now, self.import_id))
            if self.mode == "sync":
                versions.guard(counts, self.force)
            joined = versions.upsert(incoming, mine, now, self.import_id, delist=self.mode == "sync" and self.chunks > 0)
            others = stored.where(~F.col("source").eqNullSafe(self.source))
            state = versions.new_state(joined)
            return counts, state.unionByName(others.select(*state.columns)), versions.version_rows(joined)
        finally:
            self.lock.release()

    def abort(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.staged)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.lock.release()
