"""Queries on interval events: matching, suppression, windows, planning, coding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import boxes as B
from tessera.operators import coding, features, greedy, joins, mot, sampling, series, windows
from tessera.plans import surrogates as G
from tessera.plans.registry import query, rounded

V = ["video_id"]
X = G.with_
DAY = 4 * 3600

_PAIRS = """cand AS (SELECT grp, pred_id, confidence, gt_id, i / nullif(u - i, 0)::DOUBLE AS tiou FROM (
  SELECT pe.grp, pred_id, confidence, gt_id, least(p_end, g_end) - greatest(p_start, g_start) AS i, (p_end - p_start) + (g_end - g_start) AS u FROM pe JOIN ge ON pe.grp = ge.grp AND least(p_end, g_end) > greatest(p_start, g_start)))"""
_MATCH = """, ord AS (SELECT grp, pred_id, row_number() OVER (PARTITION BY grp ORDER BY max(confidence) DESC, pred_id) AS i, list({{'n': -tiou, 'g': gt_id}} ORDER BY -tiou, gt_id) AS cands FROM cand WHERE tiou >= {thr} GROUP BY grp, pred_id),
fold(grp, i, taken, pred_id, gt_id) AS (SELECT DISTINCT grp, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM ord
  UNION ALL SELECT f.grp, o.i, CASE WHEN len(x) > 0 THEN list_append(f.taken, x[1].g) ELSE f.taken END, o.pred_id, x[1].g FROM (SELECT f.*, o.i AS oi, o.pred_id AS op, list_filter(o.cands, lambda c: NOT list_contains(f.taken, c.g)) AS x FROM fold f JOIN ord o ON o.grp = f.grp AND o.i = f.i + 1) f JOIN ord o ON o.grp = f.grp AND o.i = f.oi),
hits AS (SELECT grp, pred_id, gt_id FROM fold WHERE gt_id IS NOT NULL),
matches AS (SELECT pe.grp, CASE WHEN h.gt_id IS NOT NULL THEN 'TP' ELSE 'FP' END AS kind, pe.pred_id, h.gt_id, pe.confidence, coalesce(c.tiou, b.best, 0) AS tiou
  FROM pe LEFT JOIN hits h ON pe.pred_id = h.pred_id LEFT JOIN cand c ON c.pred_id = h.pred_id AND c.gt_id = h.gt_id LEFT JOIN (SELECT pred_id, max(tiou) AS best FROM cand GROUP BY 1) b ON b.pred_id = pe.pred_id
  UNION ALL SELECT grp, 'FN', NULL, gt_id, NULL, 0 FROM ge WHERE gt_id NOT IN (SELECT gt_id FROM hits))"""
MATCHES = ", ".join([G.PE, G.GE.strip(), _PAIRS]) + _MATCH.format(thr=0.3)


def matches(spark, sf_dir, threshold=0.3):
    return greedy.match_events(G.pe(spark, sf_dir), G.ge(spark, sf_dir), ["grp"], threshold, DAY)


@query("temporal_iou_pairs", X(G.PE, G.GE, _PAIRS) + " SELECT pred_id, gt_id, round(tiou, 6) AS tiou FROM cand")
def temporal_iou_pairs(spark, sf_dir):
    return greedy.candidate_pairs(G.pe(spark, sf_dir).drop("confidence"), G.ge(spark, sf_dir), ["grp"], DAY, 6).select("pred_id", "gt_id", "tiou")


@query("match_events_greedy", X(MATCHES) + " SELECT grp, kind, pred_id, gt_id, confidence, round(tiou, 6) AS tiou FROM matches")
def match_events_greedy(spark, sf_dir):
    return rounded(matches(spark, sf_dir))


@query("event_scores", X(MATCHES) + """, c AS (SELECT count(*) FILTER (kind = 'TP') AS tp, count(*) FILTER (kind = 'FP') AS fp, count(*) FILTER (kind = 'FN') AS fn FROM matches)
SELECT tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS precision_value, round(tp / (tp + fn)::DOUBLE, 6) AS recall_value, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1_value FROM c""")
def event_scores(spark, sf_dir):
    from tessera.functions.stats import precision_recall

    c = matches(spark, sf_dir).agg(*[F.count_if(F.col("kind") == k).alias(k.lower()) for k in ("TP", "FP", "FN")])
    d = precision_recall("tp", "fp", "fn")
    return rounded(c.select("tp", "fp", "fn", *[d[k].alias(k) for k in ("precision_value", "recall_value", "f1_value")]))


@query("error_classes", X(MATCHES) + " SELECT CASE WHEN kind = 'FN' THEN 'FN' WHEN tiou > 0.1 THEN 'boundary' ELSE 'FP' END AS error_type, count(*) AS n FROM matches WHERE kind <> 'TP' GROUP BY 1")
def error_classes(spark, sf_dir):
    from tessera.operators.agreement import error_class

    return matches(spark, sf_dir).where("kind <> 'TP'").groupBy(error_class().alias("error_type")).agg(F.count("*").alias("n"))


@query("accept_by_band", X(MATCHES) + """, b(band, lo, hi) AS (VALUES ('low', 20.0, 60.0), ('middle', 60.0, 100.0), ('high', 100.0, 1e9))
SELECT band, count(kind) AS n, round(avg((kind = 'TP')::INT), 6) AS accept_rate FROM b LEFT JOIN (SELECT * FROM matches WHERE kind <> 'FN') m ON m.confidence > lo AND m.confidence <= hi GROUP BY band""")
def accept_by_band(spark, sf_dir):
    c = F.col("confidence")
    band = F.when((c > 20) & (c <= 60), "low").when((c > 60) & (c <= 100), "middle").when((c > 100) & (c <= 1e9), "high")
    d = matches(spark, sf_dir).where("kind <> 'FN'").select(band.alias("band"), (F.col("kind") == "TP").cast("double").alias("ok")).where("band IS NOT NULL")
    bands = spark.createDataFrame([("low",), ("middle",), ("high",)], "band string")
    return rounded(bands.join(d.groupBy("band").agg(F.count("*").alias("n"), F.avg("ok").alias("accept_rate")), "band", "left").withColumn("n", F.coalesce("n", F.lit(0))))


@query("temporal_offsets", X(MATCHES) + ", d AS (SELECT p_start - g_start AS d FROM hits JOIN pe ON hits.pred_id = pe.pred_id JOIN ge ON hits.gt_id = ge.gt_id) SELECT count(*) AS n, round(avg(abs(d)), 6) AS mean_abs, median(abs(d)) AS median_abs, round(avg(d), 6) AS mean_signed, round(quantile_cont(abs(d), 0.95), 6) AS p95_abs FROM d")
def temporal_offsets(spark, sf_dir):
    from tessera.operators.agreement import offsets

    m = matches(spark, sf_dir).where("kind = 'TP'").select("pred_id", "gt_id")
    d = m.join(G.pe(spark, sf_dir), "pred_id").join(G.ge(spark, sf_dir), "gt_id")
    return rounded(offsets(d, "p_start", "g_start"))


_AP = """, s AS (SELECT grp, confidence, (kind = 'TP')::INT AS hit, pred_id, (SELECT count(*) FROM ge) AS n_gt FROM matches WHERE kind <> 'FN'),
c AS (SELECT *, sum(hit) OVER w AS tp, count(*) OVER w AS n FROM s WINDOW w AS (ORDER BY confidence DESC, pred_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, tp / n_gt::DOUBLE AS recall, tp / n::DOUBLE AS precision FROM c),
e AS (SELECT *, max(precision) OVER (ORDER BY confidence DESC, pred_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope, recall - coalesce(lag(recall) OVER (ORDER BY confidence DESC, pred_id), 0) AS step FROM r)"""


def _scored(spark, sf_dir):
    n = G.ge(spark, sf_dir).agg(F.count("*").alias("n_gt"))
    d = matches(spark, sf_dir).where("kind <> 'FN'").select(F.lit(0).alias("set"), "confidence", (F.col("kind") == "TP").cast("long").alias("hit"), F.col("pred_id").alias("key"))
    return d.crossJoin(F.broadcast(n))  # one row


@query("average_precision", X(MATCHES) + _AP + " SELECT round(sum(step * envelope), 6) AS ap FROM e")
def average_precision(spark, sf_dir):
    return rounded(greedy.average_precision(_scored(spark, sf_dir), ["set"]).select("ap"))


@query("precision_recall_curve", X(MATCHES) + _AP + " SELECT pred_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(envelope, 6) AS envelope FROM e")
def precision_recall_curve(spark, sf_dir):
    return rounded(greedy.sequence_matches(_scored(spark, sf_dir), ["set"]).select(F.col("key").alias("pred_id"), "recall", "precision", "envelope"))


_IOU = """bx AS (SELECT video_id, frame_idx, pred_id, gt_id, CASE WHEN a + b - i > 0 THEN i / (a + b - i) ELSE 0 END AS iou FROM (
  SELECT t.video_id, t.frame_idx, t.track_id AS pred_id, gt_id, greatest(0, least(x2, g_x2) - greatest(x1, g_x1)) * greatest(0, least(y2, g_y2) - greatest(y1, g_y1)) AS i, (x2 - x1) * (y2 - y1) AS a, (g_x2 - g_x1) * (g_y2 - g_y1) AS b
  FROM trk t JOIN gtb g ON t.video_id = g.video_id AND t.frame_idx = g.frame_idx)),
bo AS (SELECT *, row_number() OVER (PARTITION BY t, video_id, frame_idx ORDER BY top DESC, pred_id) AS i FROM (SELECT t, video_id, frame_idx, pred_id, max(iou) AS top, list({'n': -iou, 'g': gt_id} ORDER BY -iou, gt_id) AS cands FROM bx, (VALUES (0.3), (0.4), (0.5), (0.6), (0.7)) v(t) WHERE iou >= t GROUP BY 1, 2, 3, 4)),
bf(t, video_id, frame_idx, i, taken, pred_id, hit) AS (SELECT DISTINCT t, video_id, frame_idx, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::STRUCT(n DOUBLE, g BIGINT) FROM bo
  UNION ALL SELECT f.t, f.video_id, f.frame_idx, f.oi, CASE WHEN len(x) > 0 THEN list_append(f.taken, x[1].g) ELSE f.taken END, f.op, x[1]
  FROM (SELECT f.*, o.i AS oi, o.pred_id AS op, list_filter(o.cands, lambda c: NOT list_contains(f.taken, c.g)) AS x FROM bf f JOIN bo o ON o.t = f.t AND o.video_id = f.video_id AND o.frame_idx = f.frame_idx AND o.i = f.i + 1) f)"""


@query("box_iou_pairs", X(G.TRK, G.GTB, _IOU.split("bo AS")[0].rstrip().rstrip(",")) + " SELECT video_id, frame_idx, pred_id, gt_id, round(iou, 6) AS iou FROM bx WHERE iou > 0")
def box_iou_pairs(spark, sf_dir):
    d = joins.boxes_meeting(G.boxes(spark, sf_dir).drop("conf"), G.gtb(spark, sf_dir), "p_", "g_", (64.0, 128.0), ["video_id", "frame_idx"]).withColumn("iou", B.box_iou("p_", "g_"))
    return rounded(d.where("iou > 0").select("video_id", "frame_idx", "pred_id", "gt_id", "iou"))


def _boxes(spark, sf_dir, thresholds):
    return greedy.match_boxes(G.boxes(spark, sf_dir).drop("conf"), G.gtb(spark, sf_dir), ["video_id", "frame_idx"], thresholds)


@query("match_boxes_greedy", X(G.TRK, G.GTB, _IOU) + " SELECT video_id, frame_idx, pred_id, hit.g AS gt_id, round(-hit.n, 6) AS iou FROM bf WHERE hit IS NOT NULL AND t = 0.5")
def match_boxes_greedy(spark, sf_dir):
    return rounded(_boxes(spark, sf_dir, (0.5,)).drop("threshold"))


@query("iou_sweep", X(G.TRK, G.GTB, _IOU) + " SELECT t::DOUBLE AS threshold, count(*) AS tp, round(count(*) / (SELECT count(*) FROM gtb)::DOUBLE, 6) AS recall FROM bf WHERE hit IS NOT NULL GROUP BY t")
def iou_sweep(spark, sf_dir):
    n = G.gtb(spark, sf_dir).agg(F.count("*").alias("n"))
    d = _boxes(spark, sf_dir, (0.3, 0.4, 0.5, 0.6, 0.7)).groupBy("threshold").agg(F.count("*").alias("tp"))
    return rounded(d.crossJoin(F.broadcast(n)).select("threshold", "tp", (F.col("tp") / F.col("n")).alias("recall")))  # one row


@query("recall_by_tercile", X(G.TRK, G.GTB, _IOU) + """, a AS (SELECT video_id, frame_idx, gt_id, (g_x2 - g_x1) * (g_y2 - g_y1) AS area FROM gtb), q AS (SELECT quantile_cont(area, 0.333) AS q1, quantile_cont(area, 0.667) AS q2 FROM a),
h AS (SELECT video_id, frame_idx, hit.g AS gt_id FROM bf WHERE t = 0.5 AND hit IS NOT NULL)
SELECT CASE WHEN area <= q1 THEN 'small' WHEN area <= q2 THEN 'medium' ELSE 'large' END AS size, count(*) AS n, count(h.gt_id) AS hits, round(count(h.gt_id) / count(*)::DOUBLE, 6) AS recall FROM a CROSS JOIN q LEFT JOIN h ON a.video_id = h.video_id AND a.frame_idx = h.frame_idx AND a.gt_id = h.gt_id GROUP BY 1""")
def recall_by_tercile(spark, sf_dir):
    a = G.gtb(spark, sf_dir).select("video_id", "frame_idx", "gt_id", ((F.col("g_x2") - F.col("g_x1")) * (F.col("g_y2") - F.col("g_y1"))).alias("area"))
    q = a.agg(F.percentile("area", F.array(F.lit(0.333), F.lit(0.667))).alias("q"))
    hit = _boxes(spark, sf_dir, (0.5,)).select("video_id", "frame_idx", "gt_id", F.lit(1).alias("hit"))
    size = F.when(F.col("area") <= F.col("q")[0], "small").when(F.col("area") <= F.col("q")[1], "medium").otherwise("large")
    d = a.crossJoin(F.broadcast(q)).join(hit, ["video_id", "frame_idx", "gt_id"], "left").groupBy(size.alias("size"))  # one row
    return rounded(d.agg(F.count("*").alias("n"), F.count("hit").alias("hits")).withColumn("recall", F.col("hits") / F.col("n")))


@query("mot_scores")
def mot_scores(spark, sf_dir):
    d = G.boxes(spark, sf_dir).drop("conf").withColumn("block", F.floor(F.col("frame_idx") / 60))
    g = G.gtb(spark, sf_dir).withColumn("block", F.floor(F.col("frame_idx") / 60))
    return rounded(mot.mot_scores(d, g, ["video_id", "block"]))


_FEAT = """, feat AS (SELECT video_id, frame_idx, frame_idx / 25.0::DOUBLE AS timestamp_s, n_tracks, mean_bbox_height, centroid_spread_px AS centroid_spread, (n_tracks >= 4)::INT AS valid_frame, (n_tracks < 2)::INT AS scene_change_flag FROM fs),
ws AS (SELECT video_id, unnest(range(0, greatest(n - 75, 0) + 1, 12)) AS w_frame FROM (SELECT video_id, max(frame_idx) + 1 AS n FROM feat GROUP BY 1)),
win AS (SELECT w.video_id, w_frame, min(timestamp_s) AS w_start_s, max(timestamp_s) AS w_end_s, avg(centroid_spread) AS spread_mean, stddev_pop(centroid_spread) AS spread_std, max(mean_bbox_height) AS height_max, avg(scene_change_flag) AS cut_frac, avg(valid_frame) AS valid_frac,
  coalesce(arg_max(timestamp_s, {'a': mean_bbox_height, 'b': -timestamp_s}) FILTER (mean_bbox_height IS NOT NULL), avg(timestamp_s)) AS t_peak_s, max(n_tracks) AS n_max FROM ws w JOIN feat f ON w.video_id = f.video_id AND f.frame_idx BETWEEN w_frame AND w_frame + 74 GROUP BY 1, 2),
lim AS (SELECT video_id, quantile_cont(spread_mean, 0.25) AS lim FROM win GROUP BY 1),
scored AS (SELECT win.*, greatest(0, least(1, (lim - spread_mean) / greatest(lim, 1e-6) + 0.5)) * greatest(0, least(1, n_max / 20.0::DOUBLE)) * greatest(0, least(1, 1 - cut_frac)) * valid_frac AS score FROM win JOIN lim ON win.video_id = lim.video_id)"""


def _windows(spark, sf_dir):
    f = G.fs(spark, sf_dir).select("video_id", "frame_idx", (F.col("frame_idx") / 25.0).alias("timestamp_s"), "n_tracks", "mean_bbox_height", F.col("centroid_spread_px").alias("centroid_spread"), (F.col("n_tracks") >= 4).cast("int").alias("valid_frame"), (F.col("n_tracks") < 2).cast("int").alias("scene_change_flag"), F.lit(0.0).alias("mean_vertical_velocity"))
    return windows.window_stats(f, V, 75, windows.half_even(0.5 * 25), ("n_tracks", "mean_bbox_height", "centroid_spread", "mean_vertical_velocity"), ("mean_bbox_height", True))


@query("window_stats", X(G.TRK, G.FS) + _FEAT + " SELECT video_id, w_frame, round(w_start_s, 6) AS w_start_s, round(w_end_s, 6) AS w_end_s, round(spread_mean, 6) AS centroid_spread_mean, round(spread_std, 6) AS centroid_spread_std, round(height_max, 6) AS mean_bbox_height_max, round(cut_frac, 6) AS cut_frac, round(valid_frac, 6) AS valid_frac, round(t_peak_s, 6) AS t_peak_s, n_max AS n_players_in_contest FROM win")
def window_stats(spark, sf_dir):
    return rounded(_windows(spark, sf_dir).select("video_id", "w_frame", "w_start_s", "w_end_s", "centroid_spread_mean", "centroid_spread_std", "mean_bbox_height_max", "cut_frac", "valid_frac", "t_peak_s", "n_players_in_contest"))


def _scores(spark, sf_dir):
    return windows.rule_score(_windows(spark, sf_dir), V, min_tracks=20.0).withColumn("score", F.round("score", 9))


@query("rule_score", X(G.TRK, G.FS) + _FEAT + " SELECT video_id, w_frame, round(score, 6) AS score FROM scored")
def rule_score(spark, sf_dir):
    return rounded(_scores(spark, sf_dir).select("video_id", "w_frame", "score"))


@query("nms_time", X(G.TRK, G.FS.strip()) + _FEAT + """, no AS (SELECT video_id, w_frame, t_peak_s, round(score, 9) AS score, row_number() OVER (PARTITION BY video_id ORDER BY round(score, 9) DESC, t_peak_s, w_frame) AS i FROM scored WHERE round(score, 9) >= 0.05),
nf(video_id, i, taken, w_frame, keep) AS (SELECT DISTINCT video_id, 0::BIGINT, []::DOUBLE[], NULL::BIGINT, false FROM no
  UNION ALL SELECT f.video_id, f.oi, CASE WHEN ok THEN list_append(taken, t) ELSE taken END, ow, ok FROM (SELECT f.*, o.i AS oi, o.w_frame AS ow, o.t_peak_s AS t, len(list_filter(f.taken, lambda u: abs(u - o.t_peak_s) < 2.0)) = 0 AS ok FROM nf f JOIN no o ON o.video_id = f.video_id AND o.i = f.i + 1) f)
SELECT no.video_id, no.w_frame, round(t_peak_s, 6) AS t_peak_s, round(score, 6) AS score FROM nf JOIN no ON nf.video_id = no.video_id AND nf.i = no.i WHERE keep""")
def nms_time(spark, sf_dir):
    d = _scores(spark, sf_dir).select("video_id", "w_frame", "t_peak_s", "score")
    return rounded(greedy.nms_time(d, V, 2.0))


@query("presence_bins", X(G.PE) + """, t AS (SELECT grp, max(p_end) AS total FROM pe GROUP BY 1), b AS (SELECT grp, total, unnest(range(ceil(total / 43200)::BIGINT)) AS bin FROM t)
SELECT b.grp, bin, coalesce(max((pe.grp IS NOT NULL)::INT), 0)::INT AS present FROM b LEFT JOIN pe ON b.grp = pe.grp AND bin BETWEEN floor(p_start / 43200) AND floor(greatest(p_end - 1e-9, p_start) / 43200) GROUP BY 1, 2""")
def presence_bins(spark, sf_dir):
    e = G.pe(spark, sf_dir)
    return windows.presence_bins(e, e.groupBy("grp").agg(F.max("p_end").alias("total_s")), ["grp"], "p_start", "p_end", 43200.0)


@query("segment_merge", X(G.PE) + """, s AS (SELECT grp, greatest(0, p_start - 600) AS s, p_start + 1500 AS e FROM pe), r AS (SELECT *, max(e) OVER (PARTITION BY grp ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum((reach IS NULL OR s >= reach)::INT) OVER (PARTITION BY grp ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM r)
SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY min(s)) AS segment_id, min(s) AS start_s, max(e) AS end_s, count(*) AS n_events FROM g GROUP BY grp, g""")
def segment_merge(spark, sf_dir):
    return sampling.segments(G.pe(spark, sf_dir).select("grp", F.col("p_start").alias("t_s")), ["grp"], before=600.0, after=1500.0)


@query("time_mapping", X(G.PE) + ", m AS (SELECT grp, unnest(range(31)) AS segment_id FROM (SELECT DISTINCT grp FROM pe)) SELECT pred_id, segment_id, p_start - segment_id * 86400 AS local_s FROM pe JOIN m ON pe.grp = m.grp AND p_start BETWEEN segment_id * 86400 AND segment_id * 86400 + 43200")
def time_mapping(spark, sf_dir):
    e = G.pe(spark, sf_dir).select("grp", "pred_id", F.col("p_start").alias("t_s"))
    m = e.select("grp").distinct().withColumn("segment_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(30).cast("long"))))
    m = m.withColumns({"source_start_s": F.col("segment_id") * 86400.0, "source_end_s": F.col("segment_id") * 86400.0 + 43200})
    return sampling.to_local(e, m, ["grp"]).select("pred_id", "segment_id", "local_s")


@query("replay_gaps", X(G.PE) + " SELECT grp, pred_id, p_start - lag(p_start) OVER w AS gap_s, coalesce(p_start - lag(p_start) OVER w < 1500, false) AS probable_replay FROM pe WINDOW w AS (PARTITION BY grp ORDER BY p_start, pred_id)")
def replay_gaps(spark, sf_dir):
    from pyspark.sql import Window as W

    gap = F.col("p_start") - F.lag("p_start").over(W.partitionBy("grp").orderBy("p_start", "pred_id"))
    return G.pe(spark, sf_dir).select("grp", "pred_id", gap.alias("gap_s"), F.coalesce(gap < 1500, F.lit(False)).alias("probable_replay"))


_BEST = """SELECT grp, arg_min(s, {{'a': -covered, 'b': s}}) AS s, max(covered) AS covered FROM (SELECT a.grp, a.s, count(*) AS covered FROM (SELECT *, greatest(p_start - 3600, 0) AS s FROM {0}) a JOIN {0} b ON a.grp = b.grp AND b.p_start BETWEEN a.s + 3600 AND a.s + 86400 - 3600 GROUP BY a.grp, a.pred_id, a.s) GROUP BY grp"""


@query("window_cover_all", X(G.PE) + f""", w1 AS ({_BEST.format("pe")}), rest AS (SELECT pe.* FROM pe JOIN w1 ON pe.grp = w1.grp WHERE NOT p_start BETWEEN s + 3600 AND s + 86400 - 3600), w2 AS ({_BEST.format("rest")})
SELECT grp, "window", s AS start_s, s + 86400 AS end_s, covered FROM (SELECT *, 1::BIGINT AS "window" FROM w1 UNION ALL SELECT *, 2::BIGINT FROM w2)""")
def window_cover_all(spark, sf_dir):
    """Both windows of the greedy cover of each group."""
    e = G.pe(spark, sf_dir).select("grp", F.col("p_start").alias("t_s"))
    return greedy.cover_windows(e, ["grp"], 86400.0, 3600.0, 2)


_UNIT = "(((((({k} + {seed}) * 48271 + 11) % 2147483647) * 69621 + 7) % 2147483647) + 0.5) / 2147483647"


@query("stratified_sample", X(G.TRK) + f""", u AS (SELECT event_id, (frame_idx % 3 = 0)::INT AS stratum, -ln({_UNIT.format(k="event_id", seed=7)}) / (1 + bbox_area / 10000) AS e FROM trk)
SELECT stratum, event_id FROM u QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY e, event_id) <= CASE WHEN stratum = 1 THEN 40 ELSE 60 END""")
def stratified_sample(spark, sf_dir):
    d = G.trk(spark, sf_dir).withColumn("stratum", (F.col("frame_idx") % 3 == 0).cast("int")).withColumn("quota", F.when(F.col("stratum") == 1, 40).otherwise(60))
    return sampling.weighted_sample(d, "quota", 1 + F.col("bbox_area") / 10000, ["stratum"], "event_id", 7).select("stratum", "event_id")


@query("group_sample", X(G.TRK) + f" SELECT track_id, event_id FROM trk QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY {_UNIT.format(k='event_id', seed=1729)}, event_id) <= 25")
def group_sample(spark, sf_dir):
    return sampling.sample_n(G.trk(spark, sf_dir), 25, ["track_id"], "event_id", 1729).select("track_id", "event_id")


@query("block_split", X(G.TRK) + f""", b AS (SELECT DISTINCT video_id, frame_idx // 24 AS block FROM trk), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {_UNIT.format(k='block', seed=7)}, block) AS r, count(*) OVER (PARTITION BY video_id) AS n FROM b)
SELECT t.event_id, block, CASE WHEN r <= greatest(1, round_even(n * 0.25, 0)) THEN 'val' ELSE 'train' END AS split FROM trk t JOIN r ON t.video_id = r.video_id AND t.frame_idx // 24 = block""")
def block_split(spark, sf_dir):
    return sampling.block_split(G.trk(spark, sf_dir), "frame_idx", 24, 0.25, V, 7).select("event_id", "block", "split")


@query("keyframe_grid", X(G.TRK, G.SHOTS) + " SELECT video_id, shot_id, unnest(range(frame_start, frame_end, 5)) AS frame_idx FROM shots")
def keyframe_grid(spark, sf_dir):
    return sampling.keyframes(G.shots_dim(spark, sf_dir), ["video_id", "shot_id"], 5)


def _coded(spark, sf_dir):
    """Predictions coded from the positions of their hours."""
    e = G.pe(spark, sf_dir).select("pred_id", (F.col("grp") % 2).alias("video_id"), F.floor(F.col("p_start") / 3600).cast("double").alias("t_start_s"), (F.floor(F.col("p_start") / 3600) + 1).cast("double").alias("t_peak_s"))
    return coding.code_series(e, G.positions(spark, sf_dir), V, 4, gap_m=0.5)


_CODE = """, ev AS (SELECT pred_id, grp % 2 AS video_id, floor(p_start / 3600) AS t0, floor(p_start / 3600) + 1 AS t1 FROM pe),
st AS (SELECT pred_id, p.* FROM ev JOIN pos p ON ev.video_id = p.video_id AND p.timestamp_s BETWEEN t0 - 1.5 AND t0),
pk AS (SELECT pred_id, p.* FROM ev JOIN pos p ON ev.video_id = p.video_id AND p.timestamp_s BETWEEN t1 - 0.5 AND t1 + 0.5),
tm AS (SELECT pred_id, count(DISTINCT track_id) AS n_reg, list_sort(coalesce(list(DISTINCT team) FILTER (team <> 'unassigned'), [])) AS known FROM st GROUP BY 1),
dp AS (SELECT pred_id, arg_min(team, {'a': pitch_x, 'b': track_id, 'c': frame_idx}) AS kick, min(pitch_x) AS deep FROM st WHERE team <> 'unassigned' GROUP BY 1),
kg AS (SELECT st.pred_id, abs(any_value(deep) - quantile_cont(pitch_x, 0.1)) AS gap FROM st JOIN dp ON st.pred_id = dp.pred_id AND st.team = dp.kick GROUP BY 1),
ci AS (SELECT f.pred_id, t.team, round_even(median(coalesce(n, 0)), 0)::BIGINT AS n FROM (SELECT DISTINCT pred_id, frame_idx FROM st) f JOIN (SELECT DISTINCT pred_id, team FROM st) t ON f.pred_id = t.pred_id
  LEFT JOIN (SELECT pred_id, frame_idx, team, count(*) FILTER (pitch_x >= 7.5) AS n FROM st GROUP BY ALL) c ON c.pred_id = f.pred_id AND c.frame_idx = f.frame_idx AND c.team = t.team GROUP BY 1, 2),
cd AS (SELECT ev.*, tm.known, n_reg, CASE WHEN len(known) >= 2 THEN kick END AS kick, gap, CASE WHEN len(known) >= 2 THEN list_filter(known, lambda x: x <> kick)[1] END AS def FROM ev LEFT JOIN tm USING (pred_id) LEFT JOIN dp USING (pred_id) LEFT JOIN kg USING (pred_id)),
rs AS (SELECT *, CASE WHEN known IS NULL THEN 'no registered tracks in setup window' WHEN len(known) = 0 THEN 'all tracks unassigned' WHEN len(known) < 2 THEN 'only one team assigned in setup window' WHEN gap < 0.5 THEN printf('deepest player only %.1f m behind team', gap) END AS reason FROM cd),
pm AS (SELECT pred_id, track_id, median(pitch_x) AS x, median(pitch_y) AS y FROM pk GROUP BY 1, 2),
nd AS (SELECT a.pred_id, a.track_id, any_value(a.x) AS x, min(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)) AS d FROM pm a JOIN pm b ON a.pred_id = b.pred_id AND a.track_id <> b.track_id GROUP BY 1, 2),
rc AS (SELECT pred_id, avg(x) FILTER (r <= 3) AS rx, min(d) AS least FROM (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY d, track_id) AS r FROM nd) GROUP BY 1),
op AS (SELECT pred_id, frame_idx, x.track_id, min(d) AS d FROM (SELECT b.pred_id, b.frame_idx, b.track_id, sqrt((b.pitch_x - a.pitch_x) ^ 2 + (b.pitch_y - a.pitch_y) ^ 2) AS d, count(DISTINCT a.track_id) OVER (PARTITION BY b.pred_id, b.frame_idx) AS na, count(DISTINCT b.track_id) OVER (PARTITION BY b.pred_id, b.frame_idx) AS nb
  FROM st b JOIN rs ON b.pred_id = rs.pred_id AND reason IS NULL AND b.team = rs.def AND b.pitch_x >= 7.5 JOIN st a ON a.pred_id = b.pred_id AND a.frame_idx = b.frame_idx AND a.team = rs.kick) x WHERE na >= 3 AND nb >= 3 GROUP BY 1, 2, 3),
nn AS (SELECT pred_id, median(d) AS nn FROM (SELECT pred_id, frame_idx, median(d) AS d FROM op GROUP BY 1, 2) GROUP BY 1)"""
_CODED = """ SELECT rs.pred_id, (reason IS NULL)::TINYINT AS codeable, reason AS reason_not_codeable, CASE WHEN reason IS NULL THEN def END AS defending_team, CASE WHEN reason IS NULL OR (len(known) >= 2 AND gap < 0.5) THEN round(gap, 6) END AS keeper_gap_m,
CASE WHEN reason IS NULL THEN c.n END AS n_defenders_in_65, CASE WHEN reason IS NOT NULL THEN NULL WHEN c.n <= 4 THEN '0-4' WHEN c.n <= 7 THEN '5-7' WHEN c.n <= 10 THEN '8-10' ELSE '11+' END AS n_defenders_band,
CASE WHEN reason IS NULL THEN round(nn, 6) END AS nn_opponent_m, CASE WHEN reason IS NULL THEN CASE WHEN c.n <= 4 THEN 'concede' WHEN nn IS NULL THEN 'unclear' WHEN nn <= 1.5 THEN 'player_to_player' ELSE 'zonal' END END AS defensive_strategy,
CASE WHEN reason IS NULL THEN round(rx, 6) END AS receive_x_m, CASE WHEN reason IS NULL THEN CASE WHEN rx IS NULL THEN 'unclear' WHEN rx < 27.5 THEN 'short' ELSE 'long' END END AS distance_class,
CASE WHEN reason IS NULL THEN CASE WHEN least IS NULL THEN 'unclear' WHEN least <= 2 THEN 'contested' ELSE 'uncontested' END END AS contested_proxy, CASE WHEN reason IS NULL THEN n_reg END AS n_registered_setup
FROM rs LEFT JOIN ci c ON c.pred_id = rs.pred_id AND c.team = rs.def LEFT JOIN rc ON rc.pred_id = rs.pred_id LEFT JOIN nn ON nn.pred_id = rs.pred_id"""


@query("event_coding", X(G.TRK, G.SHOTS, G.PE) + _CODE + _CODED)
def event_coding(spark, sf_dir):
    d = _coded(spark, sf_dir)
    return rounded(d.select("pred_id", "codeable", "reason_not_codeable", "defending_team", "keeper_gap_m", "n_defenders_in_65", "n_defenders_band", "nn_opponent_m", "defensive_strategy", "receive_x_m", "distance_class", "contested_proxy", "n_registered_setup"))


@query("coverage_rate", X(G.TRK, G.SHOTS, G.PE) + _CODE + " SELECT count(*) AS n, count(*) FILTER (reason IS NOT NULL) AS excluded, round(count(*) FILTER (reason IS NULL) / count(*)::DOUBLE, 6) AS coverage, round(908 / 3081::DOUBLE, 6) AS published_exclusion FROM rs")
def coverage_rate(spark, sf_dir):
    d = _coded(spark, sf_dir)
    ok = F.count_if(F.col("codeable") == 1)
    return rounded(d.agg(F.count("*").alias("n"), F.count_if(F.col("codeable") == 0).alias("excluded"), (ok / F.count("*")).alias("coverage"), F.lit(908 / 3081).alias("published_exclusion")))


@query("contest_rates", X(G.TRK, G.FS, G.PE) + """, f AS (SELECT fs.*, EXISTS (SELECT 1 FROM pe WHERE grp % 2 = fs.video_id AND abs(frame_idx * 3600 - p_start) <= 600) AS contest FROM fs)
SELECT video_id, count(*) FILTER (contest) AS n_contest, count(*) FILTER (NOT contest) AS n_elsewhere, round(count(*) FILTER (contest AND n_tracks >= 8) / greatest(count(*) FILTER (contest), 1)::DOUBLE, 6) AS contest_rate, round(count(*) FILTER (NOT contest AND n_tracks >= 8) / greatest(count(*) FILTER (NOT contest), 1)::DOUBLE, 6) AS elsewhere_rate FROM f GROUP BY 1""")
def contest_rates(spark, sf_dir):
    f = G.fs(spark, sf_dir).select("video_id", "frame_idx", "n_tracks", (F.col("frame_idx") * 3600).alias("t"))
    near = joins.points_near(f, G.pe(spark, sf_dir).select((F.col("grp") % 2).alias("video_id"), "p_start"), "t", "p_start", 600, V).select("video_id", "frame_idx", F.lit(True).alias("contest"))
    d = f.join(near, ["video_id", "frame_idx"], "left").withColumn("contest", F.coalesce("contest", F.lit(False)))
    c, busy = F.col("contest"), F.col("n_tracks") >= 8
    rate = lambda on: F.count_if(on & busy) / F.greatest(F.count_if(on), F.lit(1))
    return rounded(d.groupBy("video_id").agg(F.count_if(c).alias("n_contest"), F.count_if(~c).alias("n_elsewhere"), rate(c).alias("contest_rate"), rate(~c).alias("elsewhere_rate")))


@query("banner_state_all", X(G.TRK, G.FS, G.PE, G.GE) + """ SELECT video_id, frame_idx, CASE WHEN p AND g THEN 'hit' WHEN p THEN 'false alarm' WHEN g THEN 'miss' ELSE 'quiet' END AS state FROM (SELECT video_id, frame_idx,
EXISTS (SELECT 1 FROM pe WHERE grp % 2 = fs.video_id AND frame_idx * 3600 BETWEEN p_start AND p_end) AS p, EXISTS (SELECT 1 FROM ge WHERE grp % 2 = fs.video_id AND frame_idx * 3600 BETWEEN g_start AND g_end) AS g FROM fs)""")
def banner_state_all(spark, sf_dir):
    """What each frame of every series shows: in a predicted event, in a true one, in both, in none."""
    f = G.fs(spark, sf_dir).select("video_id", "frame_idx", (F.col("frame_idx") * 3600).alias("t"))
    inside = lambda e, a, b, name: joins.points_in_intervals(e.select((F.col("grp") % 2).alias("video_id"), a, b), f, a, b, "t", DAY, V).select("video_id", "frame_idx").distinct().withColumn(name, F.lit(True))
    d = f.join(inside(G.pe(spark, sf_dir), "p_start", "p_end", "p"), ["video_id", "frame_idx"], "left").join(inside(G.ge(spark, sf_dir), "g_start", "g_end", "g"), ["video_id", "frame_idx"], "left")
    return d.select("video_id", "frame_idx", F.when(F.col("p") & F.col("g"), "hit").when(F.col("p"), "false alarm").when(F.col("g"), "miss").otherwise("quiet").alias("state"))


@query("image_features")
def image_features(spark, sf_dir):
    """The whole dense feature table."""
    return rounded(features.canonical(features.image_features(G.trk(spark, sf_dir), G.lengths(spark, sf_dir), V), V))


_DENSE = """, feat AS (SELECT video_id, i AS frame_idx, i / 25.0::DOUBLE AS timestamp_s, 6 + (i // 25 * 31 + video_id * 17) % 15 AS n_tracks, (30 + (i * 48271 + video_id) % 211)::DOUBLE AS mean_bbox_height,
  (40 + (i // 50 * 7919 + video_id * 104729) % 160)::DOUBLE AS centroid_spread, (i * 69621 % 10 <> 0)::INT AS valid_frame, (i % 977 = 0)::INT AS scene_change_flag FROM (SELECT DISTINCT video_id FROM trk), range(18000) r(i))""" + _FEAT[_FEAT.index(",\nws AS") :]


def _dense_scores(spark, sf_dir):
    """Scores of windows over 18,000 frames of each series, twelve minutes at 25 a second, as a real recording has them: no frame is without tracks."""
    i, v = F.col("frame_idx"), F.col("video_id")
    f = G.lengths(spark, sf_dir).select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(17_999).cast("long"))).alias("frame_idx"))
    f = f.select("video_id", "frame_idx", (i / 25.0).alias("timestamp_s"), (6 + (F.floor(i / 25) * 31 + v * 17) % 15).alias("n_tracks"), (30 + (i * 48271 + v) % 211).cast("double").alias("mean_bbox_height"),
                 (40 + (F.floor(i / 50) * 7919 + v * 104729) % 160).cast("double").alias("centroid_spread"), (i * 69621 % 10 != 0).cast("int").alias("valid_frame"), (i % 977 == 0).cast("int").alias("scene_change_flag"), F.lit(0.0).alias("mean_vertical_velocity"))
    w = windows.window_stats(f, V, 75, windows.half_even(0.5 * 25), ("n_tracks", "mean_bbox_height", "centroid_spread", "mean_vertical_velocity"), ("mean_bbox_height", True))
    return windows.rule_score(w, V, min_tracks=20.0).withColumn("score", F.round("score", 9))


@query("predicted_events", X(G.TRK) + _DENSE + """, no AS (SELECT *, round(score, 9) AS sc, row_number() OVER (PARTITION BY video_id ORDER BY round(score, 9) DESC, t_peak_s, w_frame) AS i FROM scored WHERE round(score, 9) >= 0.05),
nf(video_id, i, taken, w_frame, keep) AS (SELECT DISTINCT video_id, 0::BIGINT, []::DOUBLE[], NULL::BIGINT, false FROM no
  UNION ALL SELECT f.video_id, f.oi, CASE WHEN ok THEN list_append(taken, t) ELSE taken END, ow, ok FROM (SELECT f.*, o.i AS oi, o.w_frame AS ow, o.t_peak_s AS t, len(list_filter(f.taken, lambda u: abs(u - o.t_peak_s) < 2.0)) = 0 AS ok FROM nf f JOIN no o ON o.video_id = f.video_id AND o.i = f.i + 1) f),
k AS (SELECT no.* FROM nf JOIN no ON nf.video_id = no.video_id AND nf.i = no.i WHERE keep)
SELECT video_id, printf('pred_%03d', row_number() OVER (PARTITION BY video_id ORDER BY t_peak_s, w_frame)) AS event_id, round(w_start_s, 6) AS t_start_s, round(w_end_s, 6) AS t_end_s, round(t_peak_s, 6) AS t_peak_s, round(w_end_s - w_start_s, 6) AS duration_s,
       round(sc, 6) AS confidence, n_max::BIGINT AS n_players_in_contest, 'rule' AS detector_mode FROM k""")
def predicted_events(spark, sf_dir):
    """Windows, scores and suppression over dense series, as a table of events with ids."""
    d = greedy.nms_time(_dense_scores(spark, sf_dir), V, 2.0)
    return rounded(d.select("video_id", series.numbered("pred", ["t_peak_s", "w_frame"], V).alias("event_id"), F.col("w_start_s").alias("t_start_s"), F.col("w_end_s").alias("t_end_s"), "t_peak_s", (F.col("w_end_s") - F.col("w_start_s")).alias("duration_s"), F.col("score").alias("confidence"), "n_players_in_contest", F.lit("rule").alias("detector_mode")))


@query("block_choice", X(G.PE) + """, c AS (SELECT grp, b * 14400.0::DOUBLE AS t_start_s, b * 14400.0::DOUBLE + 21600 AS t_end_s, n FROM (SELECT grp, floor(p_start / 14400) AS b, count(*) AS n FROM pe GROUP BY 1, 2)),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY -n, t_start_s) AS i FROM c),
f(grp, i, taken, s, keep) AS (SELECT DISTINCT grp, 0::BIGINT, []::DOUBLE[], NULL::DOUBLE, false FROM o
  UNION ALL SELECT f.grp, f.oi, CASE WHEN ok THEN list_append(taken, t) ELSE taken END, t, ok FROM (SELECT f.*, o.i AS oi, o.t_start_s AS t, len(f.taken) < 3 AND len(list_filter(f.taken, lambda u: abs(u - o.t_start_s) < 21600)) = 0 AS ok FROM f JOIN o ON o.grp = f.grp AND o.i = f.i + 1) f)
SELECT f.grp, f.s AS t_start_s, f.s + 21600 AS t_end_s, n AS n_events FROM f JOIN o ON f.grp = o.grp AND f.i = o.i WHERE keep""")
def block_choice(spark, sf_dir):
    """Three blocks of six hours for each group, those with the most events first, none overlapping another."""
    d = G.pe(spark, sf_dir).groupBy("grp", (F.floor(F.col("p_start") / 14400) * 14400.0).alias("t_start_s")).agg(F.count("*").alias("n_events"))
    d = d.withColumns({"t_end_s": F.col("t_start_s") + 21600, "rank": -F.col("n_events")})
    return greedy.choose_blocks(d, ["grp"], 3).select("grp", "t_start_s", "t_end_s", "n_events")


@query("time_blocks", X(G.PE) + " SELECT grp, pred_id, ntile(5) OVER (PARTITION BY grp ORDER BY p_start, pred_id) AS block FROM pe")
def time_blocks(spark, sf_dir):
    """Contiguous blocks of equal counts, the first ones one larger."""
    from pyspark.sql import Window as W

    return G.pe(spark, sf_dir).select("grp", "pred_id", F.ntile(5).over(W.partitionBy("grp").orderBy("p_start", "pred_id")).cast("long").alias("block"))


@query("best_and_worst", X(MATCHES) + """ SELECT grp, kind, pred_id, gt_id, n FROM (SELECT grp, kind, pred_id, gt_id, row_number() OVER (PARTITION BY grp, kind ORDER BY confidence DESC, pred_id, gt_id) AS n FROM matches) WHERE n <= CASE kind WHEN 'TP' THEN 2 ELSE 1 END""")
def best_and_worst(spark, sf_dir):
    """Of each group the two surest hits, the surest false alarm and the first miss: a top-k report."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("grp", "kind").orderBy(F.desc("confidence"), "pred_id", "gt_id"))
    d = matches(spark, sf_dir).withColumn("n", n).where("n <= 2").withColumn("n", F.col("n").cast("long"))  # a limit in numbers lets each task keep two rows
    return d.where(F.col("n") <= F.when(F.col("kind") == "TP", 2).otherwise(1)).select("grp", "kind", "pred_id", "gt_id", "n")


@query("label_windows", X(G.PE, G.GE, _PAIRS) + " SELECT pe.grp, pe.pred_id, coalesce(max(tiou) >= 0.5, false)::INT AS label FROM pe LEFT JOIN cand ON pe.pred_id = cand.pred_id GROUP BY 1, 2")
def label_windows(spark, sf_dir):
    from tessera.operators.learned import label_windows as label

    return label(G.pe(spark, sf_dir), G.ge(spark, sf_dir), ["grp"], "pred_id", ("p_start", "p_end"), ("g_start", "g_end"), DAY).select("grp", "pred_id", "label")


@query("learned_scores")
def learned_scores(spark, sf_dir):
    """Predicted intervals scored across purged time blocks by their length and confidence."""
    from tessera.operators.learned import blocked_scores
    from tessera.operators.learned import label_windows as label

    d = label(G.pe(spark, sf_dir), G.ge(spark, sf_dir), ["grp"], "pred_id", ("p_start", "p_end"), ("g_start", "g_end"), DAY).withColumn("length", F.col("p_end") - F.col("p_start"))
    return rounded(blocked_scores(d, ["grp"], "pred_id", "p_start", ["length", "confidence"], 3, 3600.0))


@query("shot_registration")
def shot_registration(spark, sf_dir):
    """Each shot's homography again from its landmarks in the image, two held out."""
    from tessera.functions import pitch
    from tessera.operators import registration

    marks = spark.createDataFrame(pitch.landmarks(), "landmark string, pitch_x double, pitch_y double")
    s = G.shots_dim(spark, sf_dir).select("video_id", "shot_id").crossJoin(F.broadcast(marks))  # 31 rows
    y = (F.col("pitch_y") + 52.0 - F.col("shot_id") % 3) / 0.1640625
    k = s.withColumn("img_y", y).withColumn("img_x", (F.col("pitch_x") - 0.0078125 * F.col("img_y") + 77.0 - F.col("shot_id") % 5) / 0.125)
    d = registration.fit_shots(registration.hold_out(k, ["video_id", "shot_id"]), ["video_id", "shot_id"])
    return d.select("video_id", "shot_id", "n_landmarks", "n_inliers", "n_holdout", "validated")
