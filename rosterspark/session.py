"""Session defaults, table loading and the two guards every operator shares: checkpoint folder and broadcast bound."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes of its text form, that ``bounded_broadcast`` lets be broadcast.
BROADCAST_BYTES = 4 * 1024 * 1024
PLAN_TEXT = "spark.sql.maxPlanStringLength"


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "rosterspark") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    The folder is the session's ``spark.checkpoint.dir``; only where the session has none
    (local tests) is one made on this machine.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), f"rosterspark-{sc.applicationId}"))
    # long expressions make plan texts of megabytes, and the driver keeps one for each execution
    kept = spark.conf.get(PLAN_TEXT)
    spark.conf.set(PLAN_TEXT, "20000")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(PLAN_TEXT, kept)


def settled(df: DataFrame) -> DataFrame:
    """``checkpointed`` without the estimate of the plan's size, for loops.

    A checkpoint keeps that estimate, and a join's is the product of its sides': in a loop over joins the number's digits multiply with
    every turn, until it fills the driver's memory. AQE goes by measured sizes.
    """
    done = checkpointed(df)
    spark, plan = df.sparkSession, done._jdf.queryExecution().analyzed()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), done._jdf.schema(), False), spark)


def text_bytes(df: DataFrame) -> int:
    """Bytes of ``df`` in text form, by one aggregation."""
    row = df.select(F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).cast("long")).alias("n")).first()
    return int(row.n or 0)


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` hinted for broadcast if its measured size is within ``limit``, else as it came.

    Unhinted, Catalyst and AQE choose a shuffled join with skew splitting.
    """
    return F.broadcast(df) if text_bytes(df) <= limit else df


def partitions_for(df: DataFrame) -> int:
    """Partitions for an explicit ``repartition``: what the session's shuffles use."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
