"""Per-frame features from trajectories, in the image and on the field."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.functions.pitch import WIDTH, line_x
from tessera.operators.matching import nearest_others
from tessera.operators.series import churn, dense, interpolate, moving_average, speed, velocity


def knn_mean(df: DataFrame, x: str, y: str, k: int, by: list[str], key: str) -> DataFrame:
    """Per group: the mean over members of the mean distance to their k nearest others (k at most members - 1); groups of one have none.

    A group's members meet in one task and are searched there in tiles: pairs are never rows.
    """
    d = df.select(*by, F.col(key).alias("__a"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where(reduce(and_, [F.col(c).isNotNull() for c in [*by, "__a"]]))
    schema = StructType([*[StructField(c, df.schema[c].dataType) for c in by], StructField("knn_distance", DoubleType())])
    arrow = to_arrow_schema(schema)

    def mean(t: pa.Table) -> pa.Table:
        ids = np.unique(pc.dictionary_encode(t["__a"].combine_chunks()).indices.to_numpy(), return_inverse=True)[1]
        if ids.max() == 0:
            return arrow.empty_table()
        px, py = t["__x"].to_numpy(), t["__y"].to_numpy()
        real = np.isfinite(px) & np.isfinite(py)
        ids, px, py = ids[real], px[real], py[real]
        each = nearest_others(px, py, k) if len(np.unique(ids)) == len(ids) else _of_repeated(ids, px, py, k)
        each = each[~np.isnan(each)]
        value = pa.array([float(each.mean()) if len(each) else None], pa.float64())
        return pa.table([*[t[c].slice(0, 1) for c in by], value], names=arrow.names).cast(arrow)

    return d.groupBy(*by).applyInArrow(mean, schema)


def _of_repeated(ids: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The mean distance of each id to the k nearest rows of other ids, where an id has several rows."""
    out = []
    for i in np.unique(ids):
        a, b = ids == i, ids != i
        d = np.sort(np.concatenate([np.sqrt((u - x[b]) ** 2 + (v - y[b]) ** 2) for u, v in zip(x[a], y[a], strict=True)]))[:k]
        out.append(d.mean() if len(d) else np.nan)
    return np.array(out)


def frame_stats(tracks: DataFrame, by: list[str]) -> DataFrame:
    """Per frame: number of boxes, heights, and the spread of their centres (population deviations of both axes, combined)."""
    g = tracks.groupBy(*by, "frame_idx").agg(F.count("*").alias("n_tracks"), F.max("bbox_h").alias("max_bbox_height"), F.avg("bbox_h").alias("mean_bbox_height"), F.stddev_pop("cx").alias("__sx"), F.stddev_pop("cy").alias("__sy"))
    sq = lambda c: F.coalesce(F.col(c), F.lit(0.0)) * F.coalesce(F.col(c), F.lit(0.0))
    return g.withColumn("centroid_spread_px", F.sqrt(sq("__sx") + sq("__sy"))).drop("__sx", "__sy")


def image_features(tracks: DataFrame, lengths: DataFrame, by: list[str], fps: float = 25.0, window: int = 8, smooth: int = 5, k: int = 6, cut: float = 0.85, min_tracks: int = 4, repeats: DataFrame | None = None, compat: bool = True) -> DataFrame:
    """The dense image features of each series. lengths: (by, n_frames); repeats: (by, frame_idx) of frames that repeat the one before, which take no part in velocities."""
    moving = tracks if repeats is None else tracks.join(repeats, [*by, "frame_idx"], "left_anti")
    v = moving.withColumn("__v", velocity("cy", window, fps, [*by, "track_id"])).groupBy(*by, "frame_idx").agg(F.avg("__v").alias("mean_vertical_velocity"), F.max("__v").alias("max_vertical_velocity"))
    ids = tracks.groupBy(*by, "frame_idx").agg(F.collect_set("track_id").alias("__ids"))
    d = dense(frame_stats(tracks, by), lengths, by)
    d = d.join(knn_mean(tracks, "cx", "cy", k, [*by, "frame_idx"], "track_id").withColumnRenamed("knn_distance", "cluster_density_px"), [*by, "frame_idx"], "left").join(v, [*by, "frame_idx"], "left").join(ids, [*by, "frame_idx"], "left")
    for c in ("mean_vertical_velocity", "max_vertical_velocity"):
        d = interpolate(d, c, by).withColumn(c, moving_average(c, smooth, by))
    d = d.withColumns({"n_tracks": F.coalesce("n_tracks", F.lit(0).cast("long")), "centroid_spread_px": F.coalesce("centroid_spread_px", F.lit(0.0)), "timestamp_s": F.col("frame_idx") / fps})
    flag = F.coalesce(churn("__ids", by, compat=compat) > cut, F.lit(False))
    d = d.withColumn("scene_change_flag", flag.cast("byte")).withColumn("valid_frame", (F.col("n_tracks") >= min_tracks).cast("byte")).drop("__ids")
    if repeats is None:
        return d.withColumn("is_repeat_frame", F.lit(0).cast("byte"))
    return d.join(repeats.select(*by, "frame_idx").distinct().withColumn("__r", F.lit(1)), [*by, "frame_idx"], "left").withColumn("is_repeat_frame", F.coalesce("__r", F.lit(0)).cast("byte")).drop("__r")


def repeat_frames(diffs: DataFrame, by: list[str], threshold: float = 0.0005) -> DataFrame:
    """Frames whose mean absolute difference to the frame before (column diff) is below the threshold."""
    first = F.row_number().over(W.partitionBy(*by).orderBy("frame_idx")) == 1
    return diffs.withColumn("__first", first).where(~F.col("__first") & (F.col("diff") < threshold)).select(*by, "frame_idx")


def pitch_features(positions: DataFrame, lengths: DataFrame, by: list[str], fps: float = 25.0, window: int = 8, smooth: int = 5, k: int = 6, sprint: float = 5.5, compat: bool = True) -> DataFrame:
    """The dense field features of projected trajectories (track_id, pitch_x, pitch_y, sign). compat: rows without a speed count as not sprinting."""
    p = positions.where(F.col("pitch_x").isNotNull() & F.col("pitch_y").isNotNull())
    inside = lambda d: F.sum((F.col("sign") * F.col("pitch_x") >= line_x(d)).cast("long"))
    g = p.groupBy(*by, "frame_idx").agg(
        F.count("*").alias("n_players_registered"), inside(65.0).alias("n_inside_65"), inside(45.0).alias("n_inside_45"), F.avg("pitch_x").alias("mean_x_m"), F.stddev_pop("pitch_x").alias("spread_x_m"),
        F.stddev_pop("pitch_y").alias("spread_y_m"), (F.max("pitch_y") - F.min("pitch_y")).alias("width_used_m"), (F.max("pitch_x") - F.min("pitch_x")).alias("depth_used_m"))
    fast = F.col("__v") > sprint
    v = p.withColumn("__v", speed("pitch_x", "pitch_y", window, fps, [*by, "track_id"])).groupBy(*by, "frame_idx").agg(F.avg("__v").alias("mean_speed_ms"), F.max("__v").alias("max_speed_ms"), F.avg((F.coalesce(fast, F.lit(False)) if compat else fast).cast("double")).alias("frac_above_sprint"))
    near = knn_mean(p, "pitch_x", "pitch_y", 1, [*by, "frame_idx"], "track_id").withColumnRenamed("knn_distance", "nn_distance_m")
    crowd = knn_mean(p, "pitch_x", "pitch_y", k, [*by, "frame_idx"], "track_id").withColumnRenamed("knn_distance", "cluster_density_m")
    d = dense(g, lengths, by)
    for more in (v, near, crowd):
        d = d.join(more, [*by, "frame_idx"], "left")
    for c in ("mean_speed_ms", "max_speed_ms"):
        d = d.withColumn(c, moving_average(c, smooth, by))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_players_registered", "n_inside_65", "n_inside_45")}
    return d.withColumns({**zero, "timestamp_s": F.col("frame_idx") / fps})


def canonical(image: DataFrame, by: list[str], pitch: DataFrame | None = None) -> DataFrame:
    """The features that windows are cut from, in metres where there are some, else in pixels; tagged with which."""
    keep = [*by, "frame_idx", "timestamp_s", "n_tracks", "max_bbox_height", "mean_bbox_height"]
    rest = ["mean_vertical_velocity", "max_vertical_velocity", "scene_change_flag", "valid_frame", "is_repeat_frame"]
    if pitch is None:
        return image.select(*keep, F.col("cluster_density_px").alias("cluster_density"), F.col("centroid_spread_px").alias("centroid_spread"), *rest, F.lit("pixel").alias("feature_space"))
    p = pitch.select(*by, "frame_idx", F.col("cluster_density_m").alias("cluster_density"), F.sqrt(F.col("spread_x_m") ** 2 + F.col("spread_y_m") ** 2).alias("centroid_spread"))
    return image.select(*keep, *rest).join(p, [*by, "frame_idx"], "left").select(*keep, "cluster_density", "centroid_spread", *rest, F.lit("pitch").alias("feature_space"))


def clean(c: str) -> Column:
    """NaN as null, as it comes from outside."""
    return F.nanvl(F.col(c), F.lit(None).cast("double"))
