"""Stand-ins for the engine's inputs, made from the driver's tables by whole-number arithmetic that Spark and SQL repeat alike.

trk: trajectories (events' users as tracks, hours as frames); gtb: true boxes, a shifted part of
them; pe and ge: predicted and true interval events; fs: dense frame statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.boxes import derived
from tessera.operators.features import frame_stats
from tessera.operators.series import dense


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds() -> Column:
    """Whole seconds of `ts` since the first day of 2024."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 1000000")


def trk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    d = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 2).alias("video_id"), F.col("user_id").alias("track_id"), F.floor(seconds() / 3600).alias("frame_idx"))
    d = d.groupBy("video_id", "track_id", "frame_idx").agg(F.max("event_id").alias("event_id"))
    x1, y1 = (e * 7919 % 1200).cast("double"), (e * 104729 % 600).cast("double")
    d = d.withColumns({"x1": x1, "y1": y1, "x2": x1 + 10 + e * 17 % 40, "y2": y1 + 20 + e * 31 % 100, "conf": (1 + e * 13 % 97) / 100, "timestamp_s": F.col("frame_idx").cast("double")})
    return d.withColumns(derived())


TRK = """
trk AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, y2 - y1 AS bbox_h, (x2 - x1) * (y2 - y1) AS bbox_area FROM (
  SELECT *, x1 + 10 + (event_id * 17) % 40 AS x2, y1 + 20 + (event_id * 31) % 100 AS y2 FROM (
    SELECT video_id, track_id, frame_idx, event_id, ((event_id * 7919) % 1200)::DOUBLE AS x1, ((event_id * 104729) % 600)::DOUBLE AS y1,
           (1 + (event_id * 13) % 97) / 100 AS conf, frame_idx::DOUBLE AS timestamp_s
    FROM (SELECT user_id % 2 AS video_id, user_id AS track_id, ((epoch_us(ts) - 1704067200000000) // 1000000) // 3600 AS frame_idx, max(event_id) AS event_id FROM events GROUP BY 1, 2, 3))))"""


def gtb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True boxes: (video_id, frame_idx, gt_id, g_x1 .. g_y2)."""
    dx, dy = F.col("event_id") % 5, F.col("event_id") % 7
    return trk(spark, sf_dir).where("event_id % 3 <> 0").select("video_id", "frame_idx", F.col("track_id").alias("gt_id"), (F.col("x1") + dx).alias("g_x1"), (F.col("y1") + dy).alias("g_y1"), (F.col("x2") + dx).alias("g_x2"), (F.col("y2") + dy).alias("g_y2"))


GTB = """
gtb AS (SELECT video_id, frame_idx, track_id AS gt_id, x1 + event_id % 5 AS g_x1, y1 + event_id % 7 AS g_y1, x2 + event_id % 5 AS g_x2, y2 + event_id % 7 AS g_y2 FROM trk WHERE event_id % 3 <> 0)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted boxes: (video_id, frame_idx, pred_id, p_x1 .. p_y2, conf)."""
    return trk(spark, sf_dir).select("video_id", "frame_idx", F.col("track_id").alias("pred_id"), F.col("x1").alias("p_x1"), F.col("y1").alias("p_y1"), F.col("x2").alias("p_x2"), F.col("y2").alias("p_y2"), "conf")


def _intervals(spark: SparkSession, sf_dir: str, kind: str, prefix: str, key: str) -> DataFrame:
    d = table(spark, sf_dir, "events").where(F.col("event_type") == kind).select((F.col("user_id") % 10).alias("grp"), F.col("event_id").alias(key), seconds().alias("s"), "value")
    return d.select("grp", key, F.col("s").cast("double").alias(f"{prefix}_start"), (F.col("s") + (1 + F.col(key) % 5) * 3600).cast("double").alias(f"{prefix}_end"), F.round("value", 4).alias("confidence"))


def pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir, "purchase", "p", "pred_id")


def ge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir, "signup", "g", "gt_id").drop("confidence")


_INTERVALS = "{name} AS (SELECT user_id % 10 AS grp, event_id AS {key}, s::DOUBLE AS {p}_start, (s + (1 + event_id % 5) * 3600)::DOUBLE AS {p}_end{more} FROM (SELECT *, (epoch_us(ts) - 1704067200000000) // 1000000 AS s FROM events WHERE event_type = '{kind}'))"
PE = _INTERVALS.format(name="pe", key="pred_id", p="p", more=", round(value, 4) AS confidence", kind="purchase")
GE = _INTERVALS.format(name="ge", key="gt_id", p="g", more="", kind="signup")


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, n_frames)."""
    return trk(spark, sf_dir).groupBy("video_id").agg((F.max("frame_idx") + 1).alias("n_frames"))


def fs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense frame statistics."""
    d = dense(frame_stats(trk(spark, sf_dir), ["video_id"]), lengths(spark, sf_dir), ["video_id"])
    return d.withColumns({"n_tracks": F.coalesce("n_tracks", F.lit(0).cast("long")), "centroid_spread_px": F.coalesce("centroid_spread_px", F.lit(0.0))})


FS = """
axis AS (SELECT video_id, unnest(range(n)) AS frame_idx FROM (SELECT video_id, max(frame_idx) + 1 AS n FROM trk GROUP BY 1)),
fs AS (SELECT a.video_id, a.frame_idx, coalesce(n_tracks, 0) AS n_tracks, max_bbox_height, mean_bbox_height, coalesce(sp, 0) AS centroid_spread_px
  FROM axis a LEFT JOIN (SELECT video_id, frame_idx, count(*) AS n_tracks, max(bbox_h) AS max_bbox_height, avg(bbox_h) AS mean_bbox_height,
    sqrt(stddev_pop(cx) ^ 2 + stddev_pop(cy) ^ 2) AS sp FROM trk GROUP BY 1, 2) s ON a.video_id = s.video_id AND a.frame_idx = s.frame_idx)"""


def shots_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots of 40 frames with 8 frames between them, each with a homography."""
    d = lengths(spark, sf_dir).select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_frames") / 48))).alias("shot_id"))
    row = lambda *v: F.array(*[x.cast("double") if not isinstance(x, (int, float)) else F.lit(float(x)) for x in v])
    s = F.col("shot_id")
    h = F.array(row(0.125, 0.0078125, -77.0 + s % 5), row(0.0, 0.1640625, -52.0 + s % 3), row(0.0, 0.0, 1.0))
    return d.select("video_id", "shot_id", (s * 48).alias("frame_start"), (s * 48 + 39).alias("frame_end"), h.alias("h"))


SHOTS = """
shots AS (SELECT video_id, s AS shot_id, s * 48 AS frame_start, s * 48 + 39 AS frame_end FROM (SELECT video_id, unnest(range((max(frame_idx) + 1) // 48 + 1)) AS s FROM trk GROUP BY video_id)),
pos AS (SELECT t.*, shot_id, 0.125 * foot_x + 0.0078125 * y2 - 77.0 + shot_id % 5 AS pitch_x, 0.1640625 * y2 - 52.0 + shot_id % 3 AS pitch_y,
  CASE WHEN t.track_id % 7 = 0 THEN 'unassigned' WHEN (t.track_id // 2) % 2 = 0 THEN 'team_a' ELSE 'team_b' END AS team
  FROM (SELECT *, (x1 + x2) / 2 AS foot_x FROM trk) t JOIN shots s ON t.video_id = s.video_id AND t.frame_idx BETWEEN s.frame_start AND s.frame_end)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected trajectories with teams: pitch_x, pitch_y, team, sign."""
    from tessera.functions.boxes import foot
    from tessera.functions.pitch import project
    from tessera.operators.joins import range_lookup

    s = shots_dim(spark, sf_dir)
    d = range_lookup(trk(spark, sf_dir).withColumns(foot()), s, "frame_idx", "frame_start", "frame_end", "shot_id", 48, ["video_id"])
    d = d.join(s.select("video_id", "shot_id", "h"), ["video_id", "shot_id"], "left").withColumns(project("h", "foot_x", "foot_y")).drop("h")
    team = F.when(F.col("track_id") % 7 == 0, "unassigned").when(F.floor(F.col("track_id") / 2) % 2 == 0, "team_a").otherwise("team_b")
    return d.withColumns({"team": team, "sign": F.lit(1.0)})


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(p.strip() for p in parts)
