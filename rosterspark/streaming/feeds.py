"""Streaming ingest, audit log and event dispatch: file streams with ``foreachBatch`` sinks that may run twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rosterspark.functions.fields import signature_udf
from rosterspark.operators import overlay, versions

#: Files in a batch of an ingest.
FILES_PER_BATCH = 16


def ingest(spark: SparkSession, path: str, schema: str, store: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], files: int = FILES_PER_BATCH) -> StreamingQuery:
    """Parquet deliveries as they arrive, upserted into the state under ``store``; ends when all that is there is done.

    Batch n reads state n-1 and writes state n and the versions of batch n, both by overwriting, so a batch that
    is run again gives the same. ``prepare`` brings rows to (id, source, status, listed_at, content_hash, body, ord).
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)

    def run(batch: DataFrame, number: int) -> None:
        incoming = versions.drop_custom(prepare(batch))
        before = latest_state(batch.sparkSession, store, number)
        joined = versions.upsert(incoming, before, F.current_timestamp(), f"batch_{number}")
        versions.new_state(joined).write.mode("overwrite").parquet(f"{store}/state/n={number:08d}")
        versions.version_rows(joined).write.mode("overwrite").parquet(f"{store}/versions/n={number:08d}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "id string, source string, status string, listed_at timestamp, delisted_at timestamp, content_hash string, body string, created_at timestamp, updated_at timestamp"


def latest_state(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """The state written last (before batch ``before``); empty if there is none."""
    try:
        all_states = spark.read.schema(STATE + ", n int").parquet(f"{store}/state")
        number = (all_states if before is None else all_states.where(F.col("n") < before)).agg(F.max("n")).first()[0]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        number = None
    if number is None:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{store}/state/n={number:08d}")


def audit(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only log of a stream."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def dispatch(stream: DataFrame, subscriptions: DataFrame, secret: str, path: str, checkpoint: str, send: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Deliveries of events to subscriptions, signed, logged under ``path``. ``stream``: event_id, event_type, body, at (seconds).

    ``send`` takes the signed deliveries and adds what became of them; a failed one is a row, not an error.
    """

    def run(batch: DataFrame, number: int) -> None:
        due = overlay.subscribed(batch, subscriptions).withColumn("signature", signature_udf(secret)("body", "at"))
        (send(due) if send else due.withColumn("outcome", F.lit("logged"))).write.mode("overwrite").parquet(f"{path}/n={number:08d}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
