"""Rate limits and cooldowns over an event stream, and the same over a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the limits.
WINDOW_SECONDS, PER_KEY, COOLDOWN_SECONDS, TTL_SECONDS, ATTEMPTS = 60, 5, 60, 600, 5


def window_counts(events: DataFrame, key: str, ts: str, seconds: int = WINDOW_SECONDS, late: str = "10 minutes") -> DataFrame:
    """(window_start, key, n) of fixed windows; for a stream, events later than ``late`` are dropped."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    w = timed.groupBy(F.window(ts, f"{seconds} seconds"), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), key, "n")


def admitted(events: DataFrame, key: str, ts: str, order: str, seconds: int = WINDOW_SECONDS, limit: int = PER_KEY) -> DataFrame:
    """``events`` with ``admitted``: among the first ``limit`` of its key in its window (a table)."""
    start = F.window(ts, f"{seconds} seconds")["start"]
    place = F.row_number().over(Window.partitionBy("__w", key).orderBy(ts, order))
    return events.withColumn("__w", start).withColumn("admitted", place <= limit).drop("__w")


def cooled(events: DataFrame, key: str, ts: str, order: str, seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """(key, ts, order, issued): an event is issued if its key's last issued one is at least ``seconds`` before; refused ones do not count.

    Keys stream through sorted partitions, so a key of any size needs one number of state.
    """
    slim = events.select(key, ts, order).where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    ordered = slim.repartition(key).sortWithinPartitions(key, ts, order)
    gap = pd.Timedelta(seconds=seconds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, last = None, None
        for b in batches:
            out = []
            for k, at in zip(b[key], b[ts]):
                if k != who:
                    who, last = k, None
                yes = last is None or at - last >= gap
                if yes:
                    last = at
                out.append(yes)
            yield b.assign(issued=out)

    return ordered.mapInPandas(run, slim.schema.add("issued", "boolean"))


def cooled_stream(events: DataFrame, key: str, ts: str, seconds: int = COOLDOWN_SECONDS, ttl: int = TTL_SECONDS) -> DataFrame:
    """(key, ts, issued) of a stream in order of arrival; a key's state is forgotten ``ttl`` seconds of event time after its last event."""
    kind, gap = events.schema[key].dataType.simpleString(), seconds

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(ts)
        out = []
        for at in rows[ts]:
            now = at.timestamp()
            yes = last is None or now - last >= gap
            if yes:
                last = now
            out.append(yes)
        state.update((last,))
        state.setTimeoutTimestamp(max(int(rows[ts].max().timestamp() * 1000) + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), ts: rows[ts].to_numpy(), "issued": out})

    timed = events.withWatermark(ts, f"{ttl} seconds")
    return timed.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {ts} timestamp, issued boolean", "last double", "append", "EventTimeTimeout")
