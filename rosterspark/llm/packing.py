"""Items of varying length into containers of fixed capacity: minimum bin slack.

Each container is seeded with the longest item left. A bitset subset-sum program over the remaining
lengths (one bit per reachable sum, bounded multiples by binary splitting) gives the sum closest to
the room left; backtracking gives how many items of each length make it up. A pattern is repeated
while the counts last, so many equal lengths cost one program. Groups of items are formed by hash
of the key, with sizes that do not depend on the data, and only keys and lengths move.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items in a group: thousands of containers, so that the last ones of a group weigh little.
GROUP_ITEMS = 16384


def best_subset(counts: list[tuple[int, int]], room: int) -> dict[int, int]:
    """Of (length, count) in falling order of length, the counts whose sum is the largest within ``room``."""
    if sum(n * c for n, c in counts) <= room:
        return dict(counts)
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n, c in counts:
        if n > room:
            continue
        before, left, k = reach, min(c, room // n), 1
        while left > 0:
            take = min(k, left)
            reach |= (reach << (n * take)) & mask
            left -= take
            k *= 2
        steps.append((n, c, before))
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for n, c, before in reversed(steps):
        k = 0
        while not before >> (at - k * n) & 1:
            k += 1
        if k:
            used[n] = k
            at -= k * n
    return used


def patterns(lengths: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(counts by length, times) of containers that hold all ``lengths`` (each in 1..capacity)."""
    left = Counter(lengths)
    order = sorted(left, reverse=True)
    out = []
    while order:
        seed = order[0]
        left[seed] -= 1
        used = best_subset([(n, left[n]) for n in order if left[n]], capacity - seed)
        left[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        out.append((used, times))
        for n, k in used.items():
            left[n] -= k * times
        order = [n for n in order if left[n]]
    return out


def _pack_group(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "item", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = rows["n_tokens"].to_numpy()
        at = {int(n): int(i) for n, i in zip(*np.unique(-sizes, return_index=True))}
        at = {-n: i for n, i in at.items()}
        where = np.empty(len(rows), dtype=np.int64)
        number = 0
        for used, times in patterns(sizes.tolist(), capacity):
            for _ in range(times):
                for n, k in used.items():
                    where[at[n] : at[n] + k] = number
                    at[n] += k
                number += 1
        rows["container_id"] = (int(key[0]) << 32) + where
        return rows[["container_id", "item", "part", "start_token", "n_tokens"]]

    return run


def pack(sizes: DataFrame, key: str, size: str, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container_id, key, part, start_token, n_tokens): each item in one container of at most ``capacity``.

    Items within the capacity are never split (part 0). A longer one fills containers of its own (parts
    0, 1, ...) and only its rest is packed with others. Items of size 0 or null, and null keys, are left
    out: they need no room. A repeated row is an item of its own. ``group_items`` bounds a task's group.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    n = sizes.count()
    groups = max(1, -(-n // group_items))
    items = sizes.select(F.col(key).alias("item"), F.col(size).cast("long").alias("n")).where("n > 0 and item is not null")
    # whole containers of an oversized item are known at once; only rests take part in the packing
    parts = items.select("item", F.posexplode(F.expr(f"transform(sequence(0L, (n - 1) div {capacity}), i -> named_struct('at', i * {capacity}, 'len', least(n - i * {capacity}, {capacity})))")).alias("part", "p")).select(
        "item", "part", F.col("p.at").alias("start_token"), F.col("p.len").alias("n_tokens"), F.pmod(F.xxhash64("item", "part"), F.lit(groups)).alias("grp")
    )
    kind = items.schema["item"].dataType.simpleString()
    packed = parts.groupBy("grp").applyInPandas(_pack_group(capacity), f"container_id long, item {kind}, part int, start_token long, n_tokens long")
    return packed.withColumnRenamed("item", key)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, room unused and the share filled."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    return per.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.lit(capacity) - F.col("t")), F.lit(0)).alias("slack"),
        F.coalesce(F.max("t"), F.lit(0)).alias("fullest"),
        F.round(F.sum("t") / (F.count("*") * F.lit(capacity)), 6).alias("filled"),
    )
