"""Sliding windows over dense frame series, their scores, and presence bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features that windows summarise.
FEATURES = ("n_tracks", "mean_bbox_height", "cluster_density", "centroid_spread", "mean_vertical_velocity", "max_vertical_velocity")
TERMS = ("compress", "density", "quality", "leap")


def half_even(x: float) -> int:
    return int(round(x))


def starts(n: str | Column, width: int, stride: int) -> Column:
    """First frames of the windows of a series of n frames."""
    n = F.col(n) if isinstance(n, str) else n
    return F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long") - width, F.lit(0).cast("long")), F.lit(stride).cast("long"))


def window_stats(feat: DataFrame, by: list[str], width: int, stride: int, features: tuple[str, ...] = FEATURES, peak: tuple[str, bool] = ("mean_vertical_velocity", True)) -> DataFrame:
    """A row for each window: of each feature mean, population deviation, least and greatest; fractions of cut and valid frames; the peak's time.

    A frame goes to the windows that hold it (width / stride of them), and one grouped
    aggregation does the rest. peak: the feature, and whether its maximum (else minimum) marks
    the peak; the earliest of equals; the mean time where the feature is missing throughout.
    """
    sizes = feat.groupBy(*by).agg((F.max("frame_idx") + 1).alias("__n"))
    last = F.floor(F.greatest(F.col("__n") - width, F.lit(0)) / stride)
    first = F.greatest(F.ceil((F.col("frame_idx") - width + 1) / stride), F.lit(0))
    upto = F.least(last, F.floor(F.col("frame_idx") / stride))
    d = feat.join(sizes, by).withColumn("__w", F.explode(F.when(first <= upto, F.sequence(first.cast("long"), upto.cast("long")))))
    name, largest = peak
    seen = F.col(name).isNotNull()
    order = F.struct(F.col(name), -F.col("timestamp_s")) if largest else F.struct(F.col(name), F.col("timestamp_s"))
    at = (F.max_by if largest else F.min_by)(F.when(seen, F.col("timestamp_s")), F.when(seen, order))
    stats = [f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    out = d.groupBy(*by, "__w").agg(F.min("timestamp_s").alias("w_start_s"), F.max("timestamp_s").alias("w_end_s"), *stats, F.avg("scene_change_flag").alias("cut_frac"), F.avg("valid_frame").alias("valid_frac"), F.coalesce(at, F.avg("timestamp_s")).alias("t_peak_s"), F.max("n_tracks").cast("long").alias("n_players_in_contest"))
    return out.withColumn("w_frame", F.col("__w") * stride).drop("__w")


def rule_score(windows: DataFrame, by: list[str], terms: tuple[str, ...] = ("compress", "density", "quality"), spread_pct: float = 25.0, velocity_pct: float = 85.0, min_tracks: float = 8.0) -> DataFrame:
    """windows with `score`: the product of the named terms, each between 0 and 1. Thresholds are exact percentiles over each series."""
    if bad := [t for t in terms if t not in TERMS]:
        raise ValueError(f"unknown term {bad[0]}")
    limits = windows.groupBy(*by).agg(F.percentile("centroid_spread_mean", F.lit(spread_pct / 100)).alias("__spread"), F.percentile("mean_vertical_velocity_max", F.lit(velocity_pct / 100)).alias("__leap"))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    of = {
        "compress": unit((F.col("__spread") - F.col("centroid_spread_mean")) / F.greatest(F.col("__spread"), F.lit(1e-6)) + 0.5),
        "density": unit(F.col("n_tracks_max") / min_tracks),
        "quality": unit(1 - F.col("cut_frac")) * F.col("valid_frac"),
        "leap": unit(F.col("mean_vertical_velocity_max") / F.greatest(F.col("__leap"), F.lit(1e-6))),
    }
    score = F.lit(1.0)
    for t in terms:
        score = score * of[t]
    return windows.join(limits, by).withColumn("score", F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0))).drop("__spread", "__leap")


def presence_bins(events: DataFrame, totals: DataFrame, by: list[str], start: str, end: str, width: float = 5.0) -> DataFrame:
    """(by, bin, present): whether an event touches each bin of a series; its end doesn't count. totals: (by, total_s)."""
    n = F.ceil(F.col("total_s") / width).cast("long")
    axis = totals.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("bin")).where("bin >= 0")
    low, high = F.floor(F.col(start) / width), F.floor(F.greatest(F.col(end) - 1e-9, F.col(start)) / width)
    marked = events.join(totals, by).withColumns({"__l": F.greatest(low, F.lit(0)), "__h": F.least(high, n - 1)}).where("__l <= __h")
    marked = marked.select(*by, F.explode(F.sequence(F.col("__l").cast("long"), F.col("__h").cast("long"))).alias("bin")).distinct()
    return axis.join(marked.withColumn("present", F.lit(1)), [*by, "bin"], "left").withColumn("present", F.coalesce("present", F.lit(0)))
