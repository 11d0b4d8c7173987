"""Operators on frame-indexed series and trajectories. Every window is partitioned by its series' keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.boxes import Name, col


def dense(df: DataFrame, length: DataFrame, by: list[str], n: str = "n_frames", frame: str = "frame_idx") -> DataFrame:
    """A row for each frame 0 .. n - 1 of each series; frames without one have nulls. length: (by, n)."""
    axis = length.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)).alias(frame)).where(F.col(frame) >= 0)
    return axis.join(df, [*by, frame], "left")


def lagged(value: Name, rows: int, by: list[str], order: str = "frame_idx") -> Column:
    return F.lag(col(value), rows).over(W.partitionBy(*by).orderBy(order))


def velocity(value: Name, rows: int, fps: float, by: list[str], frame: str = "frame_idx") -> Column:
    """Upward speed over so many rows of a trajectory, by the frames that really lie between."""
    return -(col(value) - lagged(value, rows, by, frame)) * fps / (F.col(frame) - lagged(frame, rows, by, frame))


def speed(x: Name, y: Name, rows: int, fps: float, by: list[str], order: str = "frame_idx") -> Column:
    """Planar speed over so many rows, taken as so many frames."""
    dx, dy = col(x) - lagged(x, rows, by, order), col(y) - lagged(y, rows, by, order)
    return F.sqrt(dx * dx + dy * dy) * fps / rows


def moving_average(value: Name, width: int, by: list[str], order: str = "frame_idx") -> Column:
    """Centred mean of what isn't null; an even width reaches one row further back than ahead."""
    return F.avg(col(value)).over(W.partitionBy(*by).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2))


def interpolate(df: DataFrame, value: str, by: list[str], order: str = "frame_idx", out: str | None = None) -> DataFrame:
    """Linear interpolation over rows; both ends take the nearest value."""
    w = W.partitionBy(*by).orderBy(order)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    d = df.withColumn("__i", F.row_number().over(w))
    at = F.when(F.col(value).isNotNull(), F.col("__i"))
    d = d.withColumns({"__v0": F.last(value, True).over(back), "__v1": F.first(value, True).over(ahead), "__i0": F.last(at, True).over(back), "__i1": F.first(at, True).over(ahead)})
    step = (F.col("__i") - F.col("__i0")) / F.nullif(F.col("__i1") - F.col("__i0"), F.lit(0))
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * F.coalesce(step, F.lit(0.0))
    return d.withColumn(out or value, F.coalesce(line, "__v0", "__v1")).drop("__i", "__v0", "__v1", "__i0", "__i1")


def churn(ids: str, by: list[str], order: str = "frame_idx", compat: bool = True) -> Column:
    """Jaccard distance of a frame's id set and the one before; null at the first. compat: two empty sets differ (1), else they are equal (0)."""
    now = F.coalesce(F.col(ids), F.array().cast("array<bigint>"))
    then = F.lag(now).over(W.partitionBy(*by).orderBy(order))
    union = F.size(F.array_union(now, then))
    return F.when(then.isNotNull(), F.when((union == 0) & F.lit(not compat), 0.0).otherwise(1 - F.size(F.array_intersect(now, then)) / F.greatest(union, F.lit(1))))


def shots(df: DataFrame, flag: str, min_frames: int, by: list[str], fps: float, frame: str = "frame_idx") -> DataFrame:
    """Runs between flagged frames of at least min_frames: (by, shot_id, frame_start, frame_end, t_start_s, t_end_s, keyframe)."""
    w = W.partitionBy(*by).orderBy(frame)
    d = df.withColumn("__run", F.sum(F.coalesce(F.col(flag).cast("int"), F.lit(0))).over(w))
    runs = d.groupBy(*by, "__run").agg(F.min(frame).alias("frame_start"), F.max(frame).alias("frame_end")).where(F.col("frame_end") - F.col("frame_start") + 1 >= min_frames)
    runs = runs.withColumn("shot_id", (F.row_number().over(W.partitionBy(*by).orderBy("frame_start")) - 1).cast("long"))
    return runs.select(*by, "shot_id", "frame_start", "frame_end", (F.col("frame_start") / fps).alias("t_start_s"), (F.col("frame_end") / fps).alias("t_end_s"), F.floor((F.col("frame_start") + F.col("frame_end") + 1) / 2).alias("keyframe"))


def merge_intervals(df: DataFrame, start: str, end: str, by: list[str], touching: bool = False, members: str | None = None) -> DataFrame:
    """Overlapping (or also touching) intervals as one: (by, start, end, merged[, members])."""
    w = W.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.coalesce((F.col(start) > reach) if touching else (F.col(start) >= reach), F.lit(True))
    d = df.withColumn("__new", fresh.cast("int")).withColumn("__g", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    extra = [F.array_sort(F.collect_list(members)).alias("members")] if members else []
    return d.groupBy(*by, "__g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged"), *extra).drop("__g")


def gaps(df: DataFrame, step: int, by: list[str], frame: str = "frame_idx", listed: int = 6) -> DataFrame:
    """Per series: how often it skips more than step frames, the longest skip, and where the first few begin."""
    before = F.lag(frame).over(W.partitionBy(*by).orderBy(frame))
    d = df.withColumn("__before", before).withColumn("__skip", F.col(frame) - F.col("__before"))
    wide = F.col("__skip") > step
    starts = F.slice(F.array_sort(F.collect_list(F.when(wide, F.col("__before")))), 1, listed)
    return d.groupBy(*by).agg(F.count_if(wide).alias("n_gaps"), F.max(F.when(wide, F.col("__skip"))).alias("longest_gap"), F.array_join(starts.cast("array<string>"), ";").alias("first_gaps"))


def modal_step(df: DataFrame, by: list[str], frame: str = "frame_idx") -> DataFrame:
    """Per series: the commonest, least and greatest step between rows (the least of equally common ones)."""
    d = df.select(*by, (F.col(frame) - F.lag(frame).over(W.partitionBy(*by).orderBy(frame))).alias("step")).where("step IS NOT NULL")
    counts = d.groupBy(*by, "step").count()
    return counts.groupBy(*by).agg(F.min_by("step", F.struct(-F.col("count"), F.col("step"))).alias("modal_step"), F.min("step").alias("min_step"), F.max("step").alias("max_step"))


def long_series(df: DataFrame, min_rows: int, by: list[str]) -> DataFrame:
    """Rows of series with at least min_rows."""
    return df.join(df.groupBy(*by).count().where(F.col("count") >= min_rows).select(*by), by, "left_semi")


def numbered(name: str, order: list[Column | str], by: list[str] | None = None, digits: int = 3) -> Column:
    """Ids <name>_001, _002, ... in an order."""
    return F.format_string(f"{name}_%0{digits}d", F.row_number().over(W.partitionBy(*(by or [])).orderBy(*order)))
