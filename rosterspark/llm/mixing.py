"""A mix of sources with target shares: Poisson replication.

Each source has a mean number of copies per record, set so that its expected tokens are its share of
the mix. A record's number of copies is the Poisson quantile at a uniform number made from its key and
the seed, capped; the mean is corrected for the cap and for the records' own numbers. Counts need no coordination and are the same in
any partitioning and on any retry. The copies are spread by a global sort on a hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Part of the cap up to which a source's mean may go before every record is simply taken cap times.
NEAR_CAP = 0.98
#: Bins of the records' uniform numbers in which tokens are summed.
BINS = 1 << 14


def capped_quantiles(rate: float, cap: int) -> list[float]:
    """P(N <= k) for k < cap, of a Poisson number N whose capped mean E[min(N, cap)] is ``rate``."""
    if rate <= 0:
        return [1.0] * cap
    if rate >= NEAR_CAP * cap:
        return [0.0] * cap

    def below(mean: float) -> list[float]:
        term, total, out = math.exp(-mean), 0.0, []
        for k in range(cap):
            total += term
            out.append(total)
            term *= mean / (k + 1)
        return out

    low, high = 0.0, 1.0
    while cap - sum(below(high)) < rate:  # E[min(N, cap)] = sum over k < cap of P(N > k)
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if cap - sum(below(middle)) < rate else (low, middle)
    return below(high)


def tokens_by_chance(sizes: DataFrame, key: str, seed: int) -> DataFrame:
    """(source, bin, tokens): tokens of each source by the uniform number of their records; at most ``BINS`` rows a source."""
    return sizes.groupBy("source", F.floor(uniform(F.col(key), seed) * BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("tokens"))


def _calibrated(rate: float, cap: int, available: float, above: np.ndarray) -> list[float]:
    """Quantiles of the capped Poisson law whose counts, with the records' own numbers, hold ``rate`` times the tokens.

    ``above[i]``: tokens of records whose number is in bin i or higher. More copies on average never mean
    fewer of any record, so the tokens held rise with the mean and bisection finds it.
    """
    low, high = 0.0, float(cap)
    below = capped_quantiles(rate, cap)
    for _ in range(60):
        middle = (low + high) / 2
        below = capped_quantiles(middle, cap)
        held = sum(float(np.interp(q * BINS, np.arange(BINS + 1), above)) for q in below)
        low, high = (middle, high) if held < rate * available else (low, middle)
    return below


def plan(available: DataFrame, targets: DataFrame, size: float | None = None) -> list[dict]:
    """For each target source: tokens there, mean copies and quantiles. Grows with the sources of the mix only.

    ``available``: from ``tokens_by_chance``, whole corpus. ``size``: tokens of the mix. By default it is the largest
    at which every source that has tokens can give its share within its cap: the source that is scarcest
    against its share is repeated cap times. With a larger one, scarce sources stay at their caps and fall short.
    Sources without tokens cannot give their share; the others keep theirs in proportion.
    """
    aims = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).where("share > 0 and cap > 0").collect()
    above = {r.source: np.zeros(BINS + 1) for r in aims}
    for r in available.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").collect():
        if r.source in above:
            above[r.source][r.bin] += r.tokens
    above = {s: x[::-1].cumsum()[::-1] for s, x in above.items()}
    tokens = {s: int(x[0]) for s, x in above.items()}
    shares = sum(r.share for r in aims if tokens[r.source])
    if size is None:
        size = min((r.cap * tokens[r.source] * shares / r.share for r in aims if tokens[r.source]), default=0.0)
    out = []
    for r in sorted(aims, key=lambda r: r.source):
        n = tokens[r.source]
        rate = min(float(r.cap), size * r.share / shares / n) if n else 0.0
        below = _calibrated(rate, r.cap, n, above[r.source]) if 0 < rate < NEAR_CAP * r.cap else capped_quantiles(rate, r.cap)
        out.append({"source": r.source, "share": r.share, "cap": r.cap, "tokens": n, "rate": rate, "below": below})
    return out


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the key: 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))


def copies(df: DataFrame, key: str, planned: list[dict], seed: int) -> DataFrame:
    """``df`` of the mix's sources with ``n_copies``. The plan is a row per source: a literal map, not a join."""
    if not planned:
        return df.where("false").withColumn("n_copies", F.lit(0))
    below = F.create_map(*[x for p in planned for x in (F.lit(p["source"]), F.array(*[F.lit(q) for q in p["below"]]))])
    u = uniform(F.col(key), seed)
    mine = df.where(F.col("source").isin([p["source"] for p in planned]))
    return mine.withColumn("n_copies", F.size(F.filter(below[F.col("source")], lambda q: q <= u)))


def mix(df: DataFrame, key: str, planned: list[dict], seed: int) -> DataFrame:
    """The mixed records: each with its copies (copy_no 0, 1, ...), in the order of ``shuffle_key``."""
    many = copies(df, key, planned, seed).where("n_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1))).drop("n_copies")
    return many.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), F.col(key), F.col("copy_no"))).orderBy("shuffle_key")


def shares(sizes: DataFrame, key: str, planned: list[dict], seed: int) -> DataFrame:
    """Per target source: its target share and what the mix really holds. ``sizes``: (key, source, n_tokens)."""
    spark = sizes.sparkSession
    got = copies(sizes, key, planned, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("t"), F.sum("n_copies").cast("long").alias("c"), F.max("n_copies").alias("m"))
    rows = [(p["source"], float(p["share"]), int(p["cap"]), int(p["tokens"]), float(p["rate"])) for p in planned]
    targets = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available_tokens long, mean_copies double")
    total = F.sum("mix_tokens").over(Window.partitionBy())
    out = targets.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "available_tokens", F.round("mean_copies", 6).alias("mean_copies"),
        F.coalesce("t", F.lit(0)).alias("mix_tokens"), F.coalesce("c", F.lit(0)).alias("mix_rows"), F.coalesce("m", F.lit(0)).alias("most_copies"),
    )
    return out.withColumn("actual_share", F.round(F.when(total > 0, F.col("mix_tokens") / total).otherwise(0.0), 6))

