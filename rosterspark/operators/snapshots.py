"""What changed between full deliveries of the same source.

Rows of all deliveries are range-partitioned and sorted by key, so each key's versions lie together
and every delivery is cut at the same places. Chunks end at keys whose hash meets a fixed rule
(content-defined), so an insertion moves no other boundary. A chunk whose digest equals that of
the preceding delivery is discarded; only rows of the other chunks are joined and classified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.session import bounded_broadcast, partitions_for

#: Mean keys in a chunk: small enough that one change keeps few rows, large enough that digests are few.
CHUNK_KEYS = 32

_SIDES = "series string, snapshot_no long, key string, side int, digest string"


def canonical_text(c: Column) -> Column:
    """Null and blank alike; outer blanks ignored."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"^[\s ]+|[\s ]+$", "")


def canonical_set(c: Column) -> Column:
    """An array as a set of canonical texts; null, empty and all-blank alike."""
    values = F.transform(F.coalesce(c, F.array().cast("array<string>")), canonical_text)
    return F.to_json(F.array_sort(F.array_distinct(F.filter(values, lambda v: v != ""))))


def row_digest(columns: list[Column]) -> Column:
    """128-bit digest of canonical columns; a length in front of each keeps them apart."""
    return F.md5(F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in columns]).cast("binary"))


def delivery_sequence(applied: DataFrame) -> DataFrame:
    """(series, snapshot_no) of applied deliveries with the numbers before and after."""
    w = Window.partitionBy("series").orderBy("snapshot_no")
    return applied.distinct().select("series", "snapshot_no", F.lag("snapshot_no").over(w).alias("prev_no"), F.lead("snapshot_no").over(w).alias("next_no"))


def _is_end(keys: pd.Series, every: int) -> pd.Series:
    """Keys that end a chunk, by their own content."""
    return pd.util.hash_array(keys.to_numpy(dtype=object), categorize=False) % every == 0


def _unmatched(chunk: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Of one chunk, the rows of each delivery pair whose digests differ, as two sides (0 before, 1 after)."""
    of: dict[int, pd.DataFrame] = dict(tuple(chunk.groupby("snapshot_no", sort=False)))
    digest = {no: hashlib.blake2b("".join(rows["key"] + rows["digest"]).encode(), digest_size=16).digest() for no, rows in of.items()}
    pairs: set[tuple[int, int]] = set()
    for rows in of.values():
        no, prev_no, next_no = int(rows["snapshot_no"].iat[0]), rows["prev_no"].iat[0], rows["next_no"].iat[0]
        if prev_no >= 0:
            pairs.add((int(prev_no), no))
        if next_no >= 0:
            pairs.add((no, int(next_no)))
    for before, after in pairs:
        if digest.get(before) == digest.get(after):
            continue
        for side, no in enumerate((before, after)):
            if no in of:
                rows = of[no]
                yield pd.DataFrame({"series": rows["series"], "snapshot_no": after, "key": rows["key"], "side": side, "digest": rows["digest"]})


def _sift(every: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if rows.empty:
                continue
            # the first row of a key starts a chunk if the key before it ended one, or belongs to another series
            first = (rows["key"] != rows["key"].shift()) | (rows["series"] != rows["series"].shift())
            ended = pd.Series(_is_end(rows["key"], every), index=rows.index).shift(fill_value=False) | (rows["series"] != rows["series"].shift())
            number = (first & ended).cumsum()
            last = number.iat[-1]
            rest = rows[number == last]
            done = [x for _, chunk in rows[number != last].groupby(number, sort=False) for x in _unmatched(chunk)]
            if done:
                yield pd.concat(done, ignore_index=True)
        if rest is not None:
            done = list(_unmatched(rest))
            if done:
                yield pd.concat(done, ignore_index=True)

    return run


def snapshot_changes(rows: DataFrame, applied: DataFrame, series: str, number: str, key: str, order: str, compared: list[Column], chunk_keys: int = CHUNK_KEYS) -> DataFrame:
    """(series, snapshot_no, key, change_kind) of each change against the series' preceding delivery.

    ``rows``: all deliveries; ``applied``: (series, number) of those that count, ``compared``: canonical
    columns. A key repeated in a delivery counts with its highest ``order`` (ties: the largest digest).
    The first delivery of a series has no changes; an applied delivery without rows removes every key.
    Rows with a null key, series or number are left out, as are deliveries that were not applied.
    """
    steps = bounded_broadcast(delivery_sequence(applied.select(F.col(series).alias("series"), F.col(number).cast("long").alias("snapshot_no")).dropna()))
    # one aggregation before anything else moves: repeats collapse map-side
    slim = rows.select(F.col(series).alias("series"), F.col(number).cast("long").alias("snapshot_no"), F.col(key).alias("key"), F.col(order).alias("o"), row_digest(compared).alias("digest")).dropna(subset=["series", "snapshot_no", "key"])
    latest = slim.join(steps, ["series", "snapshot_no"]).groupBy("series", "snapshot_no", "prev_no", "next_no", "key").agg(F.max(F.struct("o", "digest")).alias("v"))
    ordered = (
        latest.select("series", "key", "snapshot_no", F.coalesce("prev_no", F.lit(-1)).alias("prev_no"), F.coalesce("next_no", F.lit(-1)).alias("next_no"), F.col("v.digest").alias("digest"))
        .repartitionByRange(partitions_for(rows), "series", "key")
        .sortWithinPartitions("series", "key", "snapshot_no")
    )
    sides = ordered.mapInPandas(_sift(chunk_keys), _SIDES)
    # the full outer join of the two sides, as one aggregation: the sifted rows are read once
    joined = (
        sides.groupBy("series", "snapshot_no", "key")
        .agg(F.max(F.when(F.col("side") == 0, F.col("digest"))).alias("was"), F.max(F.when(F.col("side") == 1, F.col("digest"))).alias("is"))
        .where(~F.col("was").eqNullSafe(F.col("is")))
    )
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("changed")
    return joined.select(F.col("series").alias(series), F.col("snapshot_no").cast("int").alias(number), F.col("key").alias(key), kind.alias("change_kind"))
