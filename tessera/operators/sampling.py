"""Planning and sampling: reproducible by hash, so that a sample doesn't depend on how rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.series import merge_intervals

_MOD = 2_147_483_647


def unit(key: str | Column, seed: int) -> Column:
    """A number in (0, 1) from a whole-number key: two rounds of a multiplicative congruence, which any SQL engine can repeat."""
    k = F.col(key) if isinstance(key, str) else key
    x = F.pmod((k + seed) * 48271 + 11, F.lit(_MOD))
    return (F.pmod(x * 69621 + 7, F.lit(_MOD)) + 0.5) / _MOD


def sample_n(df: DataFrame, n: int, by: list[str], key: str, seed: int) -> DataFrame:
    """At most n rows of each group."""
    w = W.partitionBy(*by).orderBy(unit(key, seed), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def weighted_sample(df: DataFrame, quota: str, weight: Column, by: list[str], key: str, seed: int) -> DataFrame:
    """quota rows of each stratum without replacement, a row's chance in proportion to its weight (exponential keys)."""
    e = -F.log(unit(key, seed)) / weight
    return df.withColumn("__e", e).withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy("__e", key))).where(F.col("__r") <= F.col(quota)).drop("__e", "__r")


def block_split(df: DataFrame, at: str, block_s: float, share: float, by: list[str], seed: int) -> DataFrame:
    """split = val for round(share x blocks) whole time blocks of each series (at least one), train for others."""
    d = df.withColumn("block", F.floor(F.col(at) / block_s))
    blocks = d.select(*by, "block").distinct()
    n = F.count("*").over(W.partitionBy(*by))
    r = F.row_number().over(W.partitionBy(*by).orderBy(unit("block", seed), "block"))
    held = blocks.withColumn("split", F.when(r <= F.greatest(F.lit(1), F.bround(n * share)), "val").otherwise("train"))
    return d.join(held, [*by, "block"])


def keyframes(blocks: DataFrame, key: list[str], every: int, first: str = "frame_start", end: str = "frame_end") -> DataFrame:
    """Every n-th frame of each block, the end left out."""
    d = blocks.where(F.col(first) < F.col(end))
    return d.select(*key, F.explode(F.sequence(F.col(first), F.col(end) - 1, F.lit(every).cast("long"))).alias("frame_idx"))


def segments(times: DataFrame, by: list[str], at: str = "t_s", before: float = 10.0, after: float = 25.0, total: str | None = None, touching: bool = False, least: float = 5.0) -> DataFrame:
    """Stretches around events, clamped to [0, total], overlapping ones merged, short ones dropped: (by, segment_id, start_s, end_s, n_events)."""
    end = F.col(at) + after
    d = times.withColumns({"start_s": F.greatest(F.lit(0.0), F.col(at) - before), "end_s": end if total is None else F.least(end, F.col(total))})
    m = merge_intervals(d, "start_s", "end_s", by, touching).where(F.col("end_s") - F.col("start_s") >= least)
    return m.select(*by, F.row_number().over(W.partitionBy(*by).orderBy("start_s")).cast("long").alias("segment_id"), "start_s", "end_s", F.col("merged").alias("n_events"))


def to_local(times: DataFrame, segment_map: DataFrame, by: list[str], at: str = "t_s") -> DataFrame:
    """Source times as times in the segment that holds them."""
    d = times.join(segment_map, by).where(F.col(at).between(F.col("source_start_s"), F.col("source_end_s")))
    return d.withColumn("local_s", F.col(at) - F.col("source_start_s"))
