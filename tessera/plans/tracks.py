"""Queries on trajectories: presets, contracts, series, joins and geometry."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import boxes as B
from tessera.functions import pitch as P
from tessera.operators import features, joins, sampling, series, vectors
from tessera.plans import surrogates as G
from tessera.plans.registry import query, rounded
from tessera.sources import contracts, files

V = ["video_id"]
X = G.with_


@query("preset_busiest_frames", X(G.TRK, G.FS) + " SELECT video_id, frame_idx, n_tracks, round(centroid_spread_px, 6) AS centroid_spread FROM fs WHERE n_tracks >= 4 ORDER BY n_tracks DESC, round(centroid_spread_px, 6) ASC NULLS LAST, video_id, frame_idx LIMIT 20")
def busiest_frames(spark, sf_dir):
    d = rounded(G.fs(spark, sf_dir).where("n_tracks >= 4").select("video_id", "frame_idx", "n_tracks", F.col("centroid_spread_px").alias("centroid_spread")))
    return d.orderBy(F.desc("n_tracks"), F.asc_nulls_last("centroid_spread"), "video_id", "frame_idx").limit(20)


@query("preset_contest_windows", X(G.TRK, G.FS, G.PE) + """ SELECT pred_id, video_id, p_start, p_end, confidence, round(avg(centroid_spread_px), 6) AS mean_spread, max(max_bbox_height) AS peak_height, count(*) AS n_frames
FROM pe JOIN fs ON grp % 2 = video_id AND frame_idx * 3600 BETWEEN p_start AND p_end GROUP BY ALL""")
def contest_windows(spark, sf_dir):
    e = G.pe(spark, sf_dir).withColumn("video_id", F.col("grp") % 2)
    f = G.fs(spark, sf_dir).withColumn("t", F.col("frame_idx") * 3600)
    d = joins.points_in_intervals(e, f, "p_start", "p_end", "t", 4 * 3600, V)
    return rounded(d.groupBy("pred_id", "video_id", "p_start", "p_end", "confidence").agg(F.avg("centroid_spread_px").alias("mean_spread"), F.max("max_bbox_height").alias("peak_height"), F.count("*").alias("n_frames")))


@query("preset_track_lifetimes", X(G.TRK) + " SELECT track_id, count(*) AS n_frames, min(timestamp_s) AS first_seen, max(timestamp_s) AS last_seen, max(timestamp_s) - min(timestamp_s) AS lifetime_s, round(avg(bbox_area), 6) AS mean_area FROM trk GROUP BY track_id ORDER BY lifetime_s DESC, track_id LIMIT 25")
def track_lifetimes(spark, sf_dir):
    t = F.col("timestamp_s")
    d = G.trk(spark, sf_dir).groupBy("track_id").agg(F.count("*").alias("n_frames"), F.min(t).alias("first_seen"), F.max(t).alias("last_seen"), (F.max(t) - F.min(t)).alias("lifetime_s"), F.avg("bbox_area").alias("mean_area"))
    return rounded(d.orderBy(F.desc("lifetime_s"), "track_id").limit(25))


@query("preset_detection_density", X(G.TRK) + " SELECT floor(timestamp_s / 30) * 30 AS half_minute, count(*) / 30.0::DOUBLE AS per_second, round(avg(conf), 6) AS mean_conf FROM trk GROUP BY 1")
def detection_density(spark, sf_dir):
    d = G.trk(spark, sf_dir).groupBy((F.floor(F.col("timestamp_s") / 30) * 30).cast("double").alias("half_minute")).agg((F.count("*") / F.lit(30.0)).alias("per_second"), F.avg("conf").alias("mean_conf"))
    return d.withColumn("mean_conf", F.round("mean_conf", 6))


@query("contract_violations", X(G.TRK) + """, d AS (SELECT track_id // 40 AS frame_idx, event_id % 200 AS det_idx, conf * 1.05 AS conf FROM trk)
SELECT 'range' AS rule, 'conf' AS "column", count(*) FILTER (NOT conf BETWEEN 0 AND 1) AS violations FROM d
UNION ALL SELECT 'key', 'frame_idx, det_idx', (count(*) - count(DISTINCT (frame_idx, det_idx))) FROM d
UNION ALL SELECT 'extra', 'note', 1 UNION ALL SELECT 'missing', 'class_id', 1""")
def contract_violations(spark, sf_dir):
    d = G.trk(spark, sf_dir).select(F.floor(F.col("track_id") / 40).alias("frame_idx"), (F.col("event_id") % 200).alias("det_idx"), "timestamp_s", "x1", "y1", "x2", "y2", (F.col("conf") * 1.05).alias("conf"), F.lit("x").alias("note"))
    return contracts.violations(d, "detections")


@query("registry_hash", "SELECT source AS video_id, sha256(coalesce(text, '')) AS sha256, sha256(substr(coalesce(text, ''), 1, 64)) AS prefix_sha256 FROM documents")
def registry_hash(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return G.table(spark, sf_dir, "documents").select(F.col("source").alias("video_id"), files.content_hash(F.encode(t, "UTF-8")).alias("sha256"), files.content_hash(F.encode(F.substring(t, 1, 64), "UTF-8")).alias("prefix_sha256"))


@query("registry_upsert", "SELECT s_suppkey AS id, s_name AS name, 'old' AS version FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, upper(s_name), 'new' FROM supplier WHERE s_suppkey % 3 = 0")
def registry_upsert(spark, sf_dir):
    d = G.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return files.upsert(d.withColumn("version", F.lit("old")), d.where("id % 3 = 0").select("id", F.upper("name").alias("name"), F.lit("new").alias("version")), ["id"])


@query("frame_stats_dense", X(G.TRK, G.FS) + " SELECT video_id, frame_idx, n_tracks, max_bbox_height, round(mean_bbox_height, 6) AS mean_bbox_height, round(centroid_spread_px, 6) AS centroid_spread_px FROM fs")
def frame_stats_dense(spark, sf_dir):
    return rounded(G.fs(spark, sf_dir).select("video_id", "frame_idx", "n_tracks", "max_bbox_height", "mean_bbox_height", "centroid_spread_px"))


@query("foot_and_box", X(G.TRK) + " SELECT event_id, (x1 + x2) / 2 AS foot_x, y2 AS foot_y, cx, cy, bbox_h, bbox_area FROM trk")
def foot_and_box(spark, sf_dir):
    return G.trk(spark, sf_dir).withColumns(B.foot()).select("event_id", "foot_x", "foot_y", "cx", "cy", "bbox_h", "bbox_area")


@query("detection_index", X(G.TRK) + " SELECT video_id, frame_idx, track_id, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY conf DESC, track_id) - 1 AS det_idx FROM trk")
def detection_index(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("video_id", "frame_idx").orderBy(F.desc("conf"), "track_id")
    return G.trk(spark, sf_dir).select("video_id", "frame_idx", "track_id", (F.row_number().over(w) - 1).cast("long").alias("det_idx"))


@query("knn_mean_distance", X(G.TRK) + """, d AS (SELECT a.video_id, a.frame_idx, a.track_id, sqrt((a.cx - b.cx) ^ 2 + (a.cy - b.cy) ^ 2) AS d, b.track_id AS o FROM trk a JOIN trk b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.track_id <> b.track_id),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx, track_id ORDER BY d, o) AS r FROM d)
SELECT video_id, frame_idx, round(avg(m), 6) AS knn_distance FROM (SELECT video_id, frame_idx, track_id, avg(d) AS m FROM n WHERE r <= 6 GROUP BY ALL) GROUP BY ALL""")
def knn_mean_distance(spark, sf_dir):
    return rounded(features.knn_mean(G.trk(spark, sf_dir), "cx", "cy", 6, ["video_id", "frame_idx"], "track_id"))


@query("knn_embedding", """WITH e AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT e.vec_id AS query_id, b.vec_id, round(sqrt(list_sum(list_transform(list_zip(e.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ^ 2))), 6) AS distance FROM e JOIN embeddings b ON e.vec_id <> b.vec_id)
SELECT query_id, vec_id, distance FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 5""")
def knn_embedding(spark, sf_dir):
    """The five nearest of all vectors to each query vector (every fiftieth id): a top-k report."""
    e = G.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return vectors.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "v", 5)


@query("velocity_true_elapsed", X(G.TRK) + " SELECT video_id, track_id, frame_idx, round(-(cy - lag(cy, 8) OVER w) * 25 / (frame_idx - lag(frame_idx, 8) OVER w), 6) + 0.0 AS velocity FROM trk WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_idx)")
def velocity_true_elapsed(spark, sf_dir):
    return rounded(G.trk(spark, sf_dir).select("video_id", "track_id", "frame_idx", series.velocity("cy", 8, 25.0, ["video_id", "track_id"]).alias("velocity")))


@query("speed_assumed_rows", X(G.TRK) + " SELECT video_id, track_id, frame_idx, round(sqrt((cx - lag(cx, 8) OVER w) ^ 2 + (cy - lag(cy, 8) OVER w) ^ 2) * 25 / 8, 6) AS speed FROM trk WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_idx)")
def speed_assumed_rows(spark, sf_dir):
    return rounded(G.trk(spark, sf_dir).select("video_id", "track_id", "frame_idx", series.speed("cx", "cy", 8, 25.0, ["video_id", "track_id"]).alias("speed")))


@query("moving_average", X(G.TRK, G.FS) + " SELECT video_id, frame_idx, round(avg(mean_bbox_height) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM fs")
def moving_average(spark, sf_dir):
    return rounded(G.fs(spark, sf_dir).select("video_id", "frame_idx", series.moving_average("mean_bbox_height", 5, V).alias("smooth")))


@query("interpolate_linear", X(G.TRK, G.FS) + """, s AS (SELECT video_id, frame_idx, CASE WHEN frame_idx % 3 = 1 THEN mean_bbox_height END AS v FROM fs),
k AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS v0, first_value(v IGNORE NULLS) OVER n AS v1, last_value(CASE WHEN v IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER p AS i0, first_value(CASE WHEN v IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER n AS i1
  FROM s WINDOW p AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT video_id, frame_idx, round(coalesce(v0 + (v1 - v0) * coalesce((frame_idx - i0) / nullif(i1 - i0, 0)::DOUBLE, 0), v0, v1), 6) AS value FROM k""")
def interpolate_linear(spark, sf_dir):
    d = G.fs(spark, sf_dir).select("video_id", "frame_idx", F.when(F.col("frame_idx") % 3 == 1, F.col("mean_bbox_height")).alias("value"))
    return rounded(series.interpolate(d, "value", V))


_CHURN = """, ids AS (SELECT a.video_id, a.frame_idx, coalesce(list(track_id) FILTER (track_id IS NOT NULL), []) AS ids FROM axis a LEFT JOIN trk t ON a.video_id = t.video_id AND a.frame_idx = t.frame_idx GROUP BY 1, 2),
ch AS (SELECT video_id, frame_idx, ids, lag(ids) OVER (PARTITION BY video_id ORDER BY frame_idx) AS was FROM ids),
churn AS (SELECT video_id, frame_idx, CASE WHEN was IS NOT NULL THEN 1 - len(list_intersect(ids, was))::DOUBLE / greatest(len(list_distinct(list_concat(ids, was))), 1) END AS churn FROM ch)"""


def _churn(spark, sf_dir):
    ids = G.trk(spark, sf_dir).groupBy("video_id", "frame_idx").agg(F.collect_set("track_id").alias("ids"))
    return series.dense(ids, G.lengths(spark, sf_dir), V).select("video_id", "frame_idx", series.churn("ids", V).alias("churn"))


@query("track_churn", X(G.TRK, G.FS) + _CHURN + " SELECT video_id, frame_idx, round(churn, 6) AS churn, coalesce(churn > 0.9, false) AS cut FROM churn")
def track_churn(spark, sf_dir):
    return _churn(spark, sf_dir).select("video_id", "frame_idx", F.round("churn", 6).alias("churn"), F.coalesce(F.col("churn") > 0.9, F.lit(False)).alias("cut"))


@query("shots_islands", X(G.TRK, G.FS) + _CHURN + """, r AS (SELECT *, sum(CASE WHEN churn > 0.97 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame_idx) AS run FROM churn),
g AS (SELECT video_id, run, min(frame_idx) AS frame_start, max(frame_idx) AS frame_end FROM r GROUP BY 1, 2 HAVING max(frame_idx) - min(frame_idx) + 1 >= 3)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_start) - 1 AS shot_id, frame_start, frame_end, round(frame_start / 25.0::DOUBLE, 6) AS t_start_s, round(frame_end / 25.0::DOUBLE, 6) AS t_end_s, (frame_start + frame_end + 1) // 2 AS keyframe FROM g""")
def shots_islands(spark, sf_dir):
    d = _churn(spark, sf_dir).withColumn("cut", F.col("churn") > 0.97)
    return rounded(series.shots(d, "cut", 3, V, 25.0))


@query("track_gaps", X(G.TRK) + """, g AS (SELECT video_id, track_id, frame_idx, lag(frame_idx) OVER (PARTITION BY video_id, track_id ORDER BY frame_idx) AS b FROM trk)
SELECT video_id, track_id, count(*) FILTER (frame_idx - b > 24) AS n_gaps, max(frame_idx - b) FILTER (frame_idx - b > 24) AS longest_gap, coalesce(array_to_string(list_slice(list(b ORDER BY b) FILTER (frame_idx - b > 24), 1, 6), ';'), '') AS first_gaps FROM g GROUP BY 1, 2""")
def track_gaps(spark, sf_dir):
    return series.gaps(G.trk(spark, sf_dir), 24, ["video_id", "track_id"])


@query("modal_step", X(G.TRK) + """, g AS (SELECT video_id, track_id, frame_idx - lag(frame_idx) OVER (PARTITION BY video_id, track_id ORDER BY frame_idx) AS step FROM trk), c AS (SELECT video_id, track_id, step, count(*) AS n FROM g WHERE step IS NOT NULL GROUP BY ALL)
SELECT video_id, track_id, arg_min(step, {'a': -n, 'b': step}) AS modal_step, min(step) AS min_step, max(step) AS max_step FROM c GROUP BY 1, 2""")
def modal_step(spark, sf_dir):
    return series.modal_step(G.trk(spark, sf_dir), ["video_id", "track_id"])


@query("min_length_tracks", X(G.TRK) + " SELECT * FROM (SELECT video_id, track_id, frame_idx, count(*) OVER (PARTITION BY video_id, track_id) AS n FROM trk) WHERE n >= 60", )
def min_length_tracks(spark, sf_dir):
    d = G.trk(spark, sf_dir).select("video_id", "track_id", "frame_idx")
    kept = series.long_series(d, 60, ["video_id", "track_id"])
    return kept.join(d.groupBy("video_id", "track_id").agg(F.count("*").alias("n")), ["video_id", "track_id"])


@query("keyframe_differences", X(G.TRK, G.FS) + """, w AS (SELECT video_id, unnest(range(0, n, 5)) AS frame_idx FROM (SELECT video_id, max(frame_idx) + 1 AS n FROM trk GROUP BY 1)), h AS (SELECT DISTINCT video_id, frame_idx FROM trk)
SELECT video_id, frame_idx, 'missing' AS what FROM (SELECT * FROM w EXCEPT SELECT * FROM h) UNION ALL SELECT video_id, frame_idx, 'extra' FROM (SELECT * FROM h EXCEPT SELECT * FROM w)""")
def keyframe_differences(spark, sf_dir):
    blocks = G.lengths(spark, sf_dir).select("video_id", F.lit(0).cast("long").alias("frame_start"), F.col("n_frames").alias("frame_end"))
    want = sampling.keyframes(blocks, V, 5)
    have = G.trk(spark, sf_dir).select("video_id", "frame_idx").distinct()
    return want.subtract(have).withColumn("what", F.lit("missing")).unionByName(have.subtract(want).withColumn("what", F.lit("extra")))


@query("box_checks", X(G.TRK) + """ SELECT count(*) AS n, count(*) FILTER (x1 IS NULL OR isnan(x1)) AS n_nan, count(*) FILTER (x2 <= x1 OR y2 <= y1) AS n_flat, count(*) FILTER (x1 < 0 OR y1 < 0 OR x2 > 1220 OR y2 > 640) AS n_outside,
count(*) FILTER (NOT (y2 - y1) / (x2 - x1) BETWEEN 0.8 AND 6) AS n_aspect, round(median((y2 - y1) / (x2 - x1)), 6) AS median_aspect FROM trk""")
def box_checks(spark, sf_dir):
    d = G.trk(spark, sf_dir).withColumn("a", F.col("bbox_h") / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0)))
    return rounded(d.agg(F.count("*").alias("n"), F.count_if(F.col("x1").isNull() | F.isnan("x1")).alias("n_nan"), F.count_if((F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))).alias("n_flat"),
                         F.count_if((F.col("x1") < 0) | (F.col("y1") < 0) | (F.col("x2") > 1220) | (F.col("y2") > 640)).alias("n_outside"), F.count_if(~F.col("a").between(0.8, 6)).alias("n_aspect"), F.median("a").alias("median_aspect")))


@query("box_quantiles", X(G.TRK) + " SELECT video_id, round(quantile_cont(bbox_area, 0.1), 6) AS p10, round(quantile_cont(bbox_area, 0.25), 6) AS p25, round(median(bbox_area), 6) AS p50, round(quantile_cont(bbox_area, 0.75), 6) AS p75, round(quantile_cont(bbox_area, 0.9), 6) AS p90 FROM trk GROUP BY 1")
def box_quantiles(spark, sf_dir):
    d = G.trk(spark, sf_dir).groupBy("video_id").agg(F.percentile("bbox_area", F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)])).alias("q"))
    return rounded(d.select("video_id", *[F.col("q")[i].alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))]))


@query("interval_join", X(G.TRK, G.PE) + " SELECT pred_id, track_id, frame_idx FROM pe JOIN trk ON grp % 2 = video_id AND grp = track_id % 10 AND frame_idx * 3600 BETWEEN p_start AND p_end")
def interval_join(spark, sf_dir):
    e = G.pe(spark, sf_dir).drop("confidence")
    t = G.trk(spark, sf_dir).select((F.col("track_id") % 10).alias("grp"), "track_id", (F.col("frame_idx") * 3600).alias("t"))
    return joins.every_point_in_intervals(e, t, "p_start", "p_end", "t", 3600, ["grp"], frame_idx=F.floor(F.col("t") / 3600)).select("pred_id", "track_id", "frame_idx")


@query("frames_near_peak", X(G.TRK, G.FS, G.PE) + " SELECT video_id, frame_idx FROM fs WHERE EXISTS (SELECT 1 FROM pe WHERE grp % 2 = video_id AND abs(frame_idx * 3600 - p_start) <= 900)")
def frames_near_peak(spark, sf_dir):
    f = G.fs(spark, sf_dir).select("video_id", "frame_idx", (F.col("frame_idx") * 3600).alias("t"))
    c = G.pe(spark, sf_dir).select((F.col("grp") % 2).alias("video_id"), "p_start")
    return joins.points_near(f, c, "t", "p_start", 900, V).select("video_id", "frame_idx")


@query("frames_outside_events", X(G.TRK, G.FS, G.PE) + " SELECT video_id, frame_idx FROM fs WHERE NOT EXISTS (SELECT 1 FROM pe WHERE grp % 2 = video_id AND frame_idx * 3600 BETWEEN p_start AND p_end)")
def frames_outside_events(spark, sf_dir):
    f = G.fs(spark, sf_dir).select("video_id", "frame_idx", (F.col("frame_idx") * 3600).alias("t"))
    e = G.pe(spark, sf_dir).withColumn("video_id", F.col("grp") % 2)
    return joins.points_outside(f, e, "t", "p_start", "p_end", 4 * 3600, V).select("video_id", "frame_idx")


@query("overlap_seconds", X(G.PE, G.GE) + " SELECT pred_id, round(coalesce(sum(greatest(0, least(p_end, g_end) - greatest(p_start, g_start))), 0), 6) AS covered FROM pe LEFT JOIN ge ON pe.grp = ge.grp GROUP BY pred_id")
def overlap_seconds(spark, sf_dir):
    return rounded(joins.covered_length(G.pe(spark, sf_dir), G.ge(spark, sf_dir), ["pred_id"], ("p_start", "p_end"), ("g_start", "g_end"), 4 * 3600, ["grp"]))


@query("shot_lookup", X(G.TRK, G.SHOTS) + " SELECT event_id, coalesce(s.shot_id, -1) AS shot_id FROM trk t LEFT JOIN shots s ON t.video_id = s.video_id AND t.frame_idx BETWEEN s.frame_start AND s.frame_end")
def shot_lookup(spark, sf_dir):
    return joins.range_lookup(G.trk(spark, sf_dir), G.shots_dim(spark, sf_dir), "frame_idx", "frame_start", "frame_end", "shot_id", 48, V).select("event_id", "shot_id")


@query("homography_project", X(G.TRK, G.SHOTS) + " SELECT t.event_id, round(pitch_x, 6) AS pitch_x, round(pitch_y, 6) AS pitch_y FROM trk t LEFT JOIN pos p ON t.event_id = p.event_id")
def homography_project(spark, sf_dir):
    return rounded(G.positions(spark, sf_dir).select("event_id", "pitch_x", "pitch_y"))


@query("on_field", X(G.TRK, G.SHOTS) + " SELECT event_id, CASE WHEN abs(pitch_x) <= 77.5 AND abs(pitch_y) <= 49 THEN round(pitch_x, 6) END AS pitch_x, CASE WHEN abs(pitch_x) <= 77.5 AND abs(pitch_y) <= 49 THEN round(pitch_y, 6) END AS pitch_y FROM pos")
def on_field(spark, sf_dir):
    d = G.positions(spark, sf_dir).where("pitch_x IS NOT NULL")
    return rounded(d.select("event_id", *[c.alias(n) for n, c in P.on_field("pitch_x", "pitch_y").items()]))


@query("zone_grid", X(G.TRK, G.SHOTS) + """ SELECT zone, count(*) AS n FROM (SELECT CASE WHEN pitch_x BETWEEN 7.5 AND 72.5 AND pitch_y BETWEEN -44 AND 44 THEN
 (floor(least(greatest((pitch_y + 44) / (88 / 3.0::DOUBLE), 0), 2.999)) * 3 + floor(least(greatest((pitch_x - 7.5) / (65 / 3.0::DOUBLE), 0), 2.999)) + 1)::BIGINT END AS zone FROM pos) GROUP BY zone""")
def zone_grid(spark, sf_dir):
    d = G.positions(spark, sf_dir).where("pitch_x IS NOT NULL")
    return d.select(P.zone("pitch_x", "pitch_y").cast("long").alias("zone")).groupBy("zone").agg(F.count("*").alias("n"))


@query("inside_line_pivot", X(G.TRK, G.SHOTS) + """ SELECT video_id, frame_idx, count(*) FILTER (team = 'team_a' AND pitch_x >= 7.5) AS team_a, count(*) FILTER (team = 'team_b' AND pitch_x >= 7.5) AS team_b, count(*) FILTER (team = 'unassigned' AND pitch_x >= 7.5) AS unassigned FROM pos GROUP BY 1, 2""")
def inside_line_pivot(spark, sf_dir):
    d = G.positions(spark, sf_dir).where("pitch_x IS NOT NULL").withColumn("i", P.inside_line("pitch_x", 1.0, 65.0).cast("long"))
    return d.groupBy("video_id", "frame_idx").pivot("team", ["team_a", "team_b", "unassigned"]).sum("i").na.fill(0)


@query("pitch_features", X(G.TRK, G.SHOTS) + """ SELECT video_id, frame_idx, count(*) AS n_players_registered, sum((pitch_x >= 7.5)::INT)::BIGINT AS n_inside_65, sum((pitch_x >= 27.5)::INT)::BIGINT AS n_inside_45, round(avg(pitch_x), 6) AS mean_x_m,
 round(stddev_pop(pitch_x), 6) AS spread_x_m, round(max(pitch_y) - min(pitch_y), 6) AS width_used_m FROM pos GROUP BY 1, 2""")
def pitch_features(spark, sf_dir):
    d = features.pitch_features(G.positions(spark, sf_dir), G.lengths(spark, sf_dir), V)
    return rounded(d.where("n_players_registered > 0").select("video_id", "frame_idx", "n_players_registered", "n_inside_65", "n_inside_45", "mean_x_m", "spread_x_m", "width_used_m"))


@query("fov_labels", X(G.TRK) + " SELECT event_id, CASE WHEN bbox_area < 1000 THEN 'small' WHEN bbox_area < 2500 THEN 'medium' ELSE 'large' END AS size, format('{:02d}:{:02d}:{:06.3f}', (frame_idx * 7 // 3600)::INT, (frame_idx * 7 % 3600 // 60)::INT, (frame_idx * 7 % 60)::DOUBLE) AS clock FROM trk")
def fov_labels(spark, sf_dir):
    from tessera.functions.timebase import seconds_clock

    size = F.when(F.col("bbox_area") < 1000, "small").when(F.col("bbox_area") < 2500, "medium").otherwise("large")
    return G.trk(spark, sf_dir).select("event_id", size.alias("size"), seconds_clock((F.col("frame_idx") * 7).cast("double")).alias("clock"))
