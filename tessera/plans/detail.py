"""Queries on agreement in detail, on choices for annotation, and on functions that SQL calls by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import callables
from tessera.functions import stats as S
from tessera.operators import agreement as A
from tessera.operators import features, review
from tessera.plans import events as E
from tessera.plans import surrogates as G
from tessera.plans.agreement import _BANDS, _bands, _wilson_sql
from tessera.plans.registry import query, rounded
from tessera.sources import files

V = ["video_id"]
X = G.with_


def _r(name: str, parts: tuple[str, str, str]) -> str:
    return ", ".join(f"round({c}, 6) AS {name}_{part}" for part, c in zip(("value", "ci_low", "ci_high"), parts, strict=True))


@query("class_recall", f"WITH {_BANDS}, l AS (SELECT a AS l FROM o UNION SELECT b FROM o) SELECT l AS label, count(o.a) AS n, round(count(*) FILTER (o.a = o.b) / nullif(count(o.a), 0)::DOUBLE, 6) AS recall FROM l LEFT JOIN o ON o.a = l GROUP BY 1")
def class_recall(spark, sf_dir):
    """Of each label's rows, the share that the second coding agrees on."""
    return rounded(A.class_recall(_bands(spark, sf_dir), "a", "b"))


@query("nominal_interval", f"WITH {_BANDS}, c AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS k FROM o) SELECT n, {_r('exact', _wilson_sql('k', 'n'))} FROM c")
def nominal_interval(spark, sf_dir):
    """Exact agreement of two codings, with its Wilson interval."""
    d = _bands(spark, sf_dir).where("a IS NOT NULL AND b IS NOT NULL").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("k"))
    return rounded(d.select("n", *[c.alias(f"exact_{k}") for k, c in S.wilson("k", "n").items()]))


@query("count_agreement", f"""WITH d AS (SELECT abs(x.l_quantity - y.l_quantity)::DOUBLE AS far, (x.l_discount * 100)::DOUBLE AS u FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = 1 AND y.l_linenumber = 2),
c AS (SELECT count(*) AS n, count(*) FILTER (far = 0) AS k0, count(*) FILTER (far <= 1) AS k1, avg(far) AS mae, median(u) AS u FROM d) SELECT n, {_r('exact', _wilson_sql('k0', 'n'))}, {_r('within_one', _wilson_sql('k1', 'n'))}, round(mae, 6) AS mae, round(u, 6) AS median_uncertainty FROM c""")
def count_agreement(spark, sf_dir):
    """Counts of two codings of each event: equal, at most one apart, how far apart, how uncertain."""
    side = lambda k, c, name: G.table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") == k).select("l_orderkey", F.col(c).cast("double").alias(name), *([(F.col("l_discount") * 100).cast("double").alias("u")] if k == 1 else []))
    return rounded(A.count_agreement(side(1, "l_quantity", "p").join(side(2, "l_quantity", "t"), "l_orderkey"), "p", "t", "u"))


_PRF = f"round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1_value, {_r('precision', _wilson_sql('tp', '(tp + fp)'))}, {_r('recall', _wilson_sql('tp', '(tp + fn)'))}"


@query("binary_agreement", f"""WITH {_BANDS}, c AS (SELECT count(*) FILTER (a = '2' AND b = '2') AS tp, count(*) FILTER (a = '2' AND b <> '2') AS fp, count(*) FILTER (a <> '2' AND b = '2') AS fn, count(*) FILTER (a <> '2' AND b <> '2') AS tn, count(*)::DOUBLE AS n FROM o),
k AS (SELECT *, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM c) SELECT tp, fp, fn, tn, round((po - pe) / (1 - pe), 6) AS kappa, {_PRF} FROM k""")
def binary_agreement(spark, sf_dir):
    """One label against the rest in two codings: kappa, precision, recall and F1."""
    d = A.binary_agreement(_bands(spark, sf_dir), "a", "b", "2")
    return rounded(d.select("tp", "fp", "fn", "tn", "kappa", "f1_value", *[f"{x}_{p}" for x in ("precision", "recall") for p in ("value", "ci_low", "ci_high")]))


@query("weighted_kappa_ci")
def weighted_kappa_ci(spark, sf_dir):
    """Weighted kappa with the interval of 2,000 resamples."""
    return rounded(A.weighted_kappa_interval(_bands(spark, sf_dir), "a", "b", ["1", "2", "3", "4", "5"], 2))


@query("bootstrap_precision")
def bootstrap_precision(spark, sf_dir):
    """Precision of the matches, by the bootstrap of any statistic of sums."""
    hit, found = (F.col("kind") == "TP").cast("int"), (F.col("kind") != "FN").cast("int")
    return rounded(A.bootstrap(E.matches(spark, sf_dir), {"hit": hit, "found": found}, F.col("hit") / F.nullif(F.col("found"), F.lit(0.0))))


_RATE = "(k1 / n1::DOUBLE / (k2 / n2::DOUBLE))"
_SE = f"{S.z_of()!r} * sqrt(1 / k1::DOUBLE + 1 / k2::DOUBLE)"


@query("rate_ratio_by_line", f"""WITH c AS (SELECT l_linenumber AS line, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 40) AS k1, count(*) FILTER (l_returnflag = 'R') AS n1, count(*) FILTER (l_returnflag <> 'R' AND l_quantity > 40) AS k2, count(*) FILTER (l_returnflag <> 'R') AS n2 FROM lineitem GROUP BY 1)
SELECT line, k1, n1, k2, n2, round({_RATE}, 6) AS ratio, round({_RATE} * exp(-{_SE}), 6) AS ci_low, round({_RATE} * exp({_SE}), 6) AS ci_high FROM c""")
def rate_ratio_by_line(spark, sf_dir):
    """How much likelier large quantities are among returned lines, for each line number."""
    r, big = F.col("l_returnflag") == "R", F.col("l_quantity") > 40
    d = G.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("line")).agg(F.count_if(r & big).alias("k1"), F.count_if(r).alias("n1"), F.count_if(~r & big).alias("k2"), F.count_if(~r).alias("n2"))
    return rounded(d.withColumns(S.rate_ratio("k1", "n1", "k2", "n2")))


@query("tracks_with_team", X(G.TRK, "tm AS (SELECT DISTINCT video_id, track_id, CASE WHEN (track_id // 2) % 2 = 0 THEN 'team_a' ELSE 'team_b' END AS team FROM trk WHERE track_id % 5 <> 0)") + " SELECT event_id, trk.track_id, coalesce(team, 'unassigned') AS team FROM trk LEFT JOIN tm ON trk.video_id = tm.video_id AND trk.track_id = tm.track_id")
def tracks_with_team(spark, sf_dir):
    """Every position with its track's team; tracks that no team was found for are unassigned."""
    t = G.trk(spark, sf_dir)
    teams = t.where("track_id % 5 <> 0").select("video_id", "track_id").distinct().withColumn("team", F.when(F.floor(F.col("track_id") / 2) % 2 == 0, "team_a").otherwise("team_b"))
    return review.with_team(t, teams, ["video_id", "track_id"]).select("event_id", "track_id", "team")


@query("coding_pairs", "SELECT o_orderkey AS event_id, o_orderpriority AS label_pred, l_returnflag AS label_gt, o_totalprice::DOUBLE AS score_pred, l_quantity::DOUBLE AS score_gt, o_custkey AS source FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1")
def coding_pairs(spark, sf_dir):
    """Predicted and true coding of each event side by side: only columns of both sides get a suffix."""
    p = G.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("label"), F.col("o_totalprice").cast("double").alias("score"), F.col("o_custkey").alias("source"))
    t = G.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("event_id"), F.col("l_returnflag").alias("label"), F.col("l_quantity").cast("double").alias("score"))
    return files.suffixed(p, t, ["event_id"], ("_pred", "_gt"))


@query("box_summary", X(G.TRK, "q AS (SELECT quantile_cont(bbox_area, 0.333) AS q FROM trk)") + " SELECT video_id, frame_idx, count(*) AS n_boxes, count(*) FILTER (bbox_area < q) AS n_small, median(bbox_area) AS median_area, round(avg(conf), 6) AS mean_conf, round(count(*) FILTER (bbox_area < q) / count(*)::DOUBLE, 6) AS small_frac FROM trk, q GROUP BY 1, 2")
def box_summary(spark, sf_dir):
    """What a frame's boxes are like: how many, how many small, the median area, the mean confidence."""
    return rounded(review.box_summary(G.trk(spark, sf_dir), ["video_id", "frame_idx"], "bbox_area", "conf"))


@query("recall_by_size", X(G.TRK, G.GTB, E._IOU) + f""", a AS (SELECT video_id, frame_idx, gt_id, (g_x2 - g_x1) * (g_y2 - g_y1) AS area FROM gtb), q AS (SELECT quantile_cont(area, 0.333) AS q1, quantile_cont(area, 0.667) AS q2 FROM a),
h AS (SELECT video_id, frame_idx, hit.g AS gt_id FROM bf WHERE t = 0.5 AND hit IS NOT NULL),
c AS (SELECT CASE WHEN area <= q1 THEN 'small' WHEN area <= q2 THEN 'medium' ELSE 'large' END AS size, count(*) AS n, count(h.gt_id) AS k FROM a CROSS JOIN q LEFT JOIN h ON a.video_id = h.video_id AND a.frame_idx = h.frame_idx AND a.gt_id = h.gt_id GROUP BY 1)
SELECT size, n, k AS hits, {_r('recall', _wilson_sql('k', 'n'))} FROM c""")
def recall_by_size(spark, sf_dir):
    """Recall of small, medium and large boxes, with Wilson intervals."""
    d = E.recall_by_tercile(spark, sf_dir)
    return rounded(d.select("size", "n", "hits", *[c.alias(f"recall_{k}") for k, c in S.wilson("hits", "n").items()]))


@query("box_tightness", X(G.TRK, G.GTB, "g AS (SELECT video_id, median((g_y2 - g_y1) / nullif(g_x2 - g_x1, 0)) AS t FROM gtb GROUP BY 1), d AS (SELECT video_id, median((y2 - y1) / nullif(x2 - x1, 0)) AS f FROM trk GROUP BY 1)") + " SELECT video_id, round(t, 6) AS true_aspect, round(f, 6) AS found_aspect, t < 0.75 * f AS too_wide FROM g FULL JOIN d USING (video_id)")
def box_tightness(spark, sf_dir):
    """Whether true boxes are drawn too wide, beside those that were found."""
    ratio = lambda p: (F.col(f"{p}y2") - F.col(f"{p}y1")) / F.nullif(F.col(f"{p}x2") - F.col(f"{p}x1"), F.lit(0.0))
    return rounded(review.tightness(G.gtb(spark, sf_dir), G.trk(spark, sf_dir), V, ratio("g_"), ratio("")))


@query("segment_picks", X(E.MATCHES) + """, m AS (SELECT x.grp, x.kind, x.pred_id, x.gt_id, x.confidence, coalesce(p_start, g_start) AS t FROM matches x LEFT JOIN pe ON pe.pred_id = x.pred_id LEFT JOIN ge ON ge.gt_id = x.gt_id),
r AS (SELECT grp, kind, greatest(t - 3600, 0) AS start_s, least(t + 3600, 2678400) AS end_s FROM m QUALIFY row_number() OVER (PARTITION BY grp, kind ORDER BY confidence DESC NULLS LAST, pred_id, gt_id) <= CASE kind WHEN 'TP' THEN 2 ELSE 1 END)
SELECT grp, kind, start_s, end_s, row_number() OVER (PARTITION BY grp ORDER BY start_s, end_s, kind) AS place FROM r QUALIFY place <= 4""")
def segment_picks(spark, sf_dir):
    """Four stretches of each group to look at: the surest hits, a false alarm and a miss, in order of time."""
    p, g = G.pe(spark, sf_dir).select("pred_id", "p_start"), G.ge(spark, sf_dir).select("gt_id", "g_start")
    m = E.matches(spark, sf_dir).join(p, "pred_id", "left").join(g, "gt_id", "left").withColumn("t", F.coalesce("p_start", "g_start"))
    return review.pick_segments(m, ["grp"], "t", ["pred_id", "gt_id"], 2_678_400.0, 3600.0)


@query("recode_blocks", X(G.PE) + f""", n AS (SELECT grp, d, ceil(d / 86400)::BIGINT AS n FROM (SELECT grp, max(p_end) AS d FROM pe GROUP BY 1)), b AS (SELECT grp, d, n, unnest(range(n)) AS block FROM n)
SELECT grp, block, block * 86400.0::DOUBLE AS start_s, least((block + 1) * 86400.0::DOUBLE, d) AS end_s FROM b QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {E._UNIT.format(k="block", seed=1729)}, block) <= greatest(1, round_even(n * 0.25, 0))""")
def recode_blocks(spark, sf_dir):
    """Days of each group to be coded again: a quarter of them, one at least."""
    d = G.pe(spark, sf_dir).groupBy("grp").agg(F.max("p_end").alias("duration_s"))
    return review.recode_blocks(d, ["grp"], "duration_s", 86400.0)


@query("annotation_blocks", X(G.PE, G.GE) + """, x AS (SELECT grp, g_start, g_end FROM ge WHERE gt_id % 3 = 0), b AS (SELECT DISTINCT grp, floor(p_start / 14400) * 14400.0::DOUBLE AS s FROM pe),
c AS (SELECT b.grp, b.s, count(*) AS n FROM b JOIN pe ON pe.grp = b.grp AND p_start BETWEEN s AND s + 21600 WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.grp = b.grp AND g_start < s + 21600 AND g_end > s) GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY -n, s) AS i FROM c),
f(grp, i, taken, s, keep) AS (SELECT DISTINCT grp, 0::BIGINT, []::DOUBLE[], NULL::DOUBLE, false FROM o
  UNION ALL SELECT f.grp, f.oi, CASE WHEN ok THEN list_append(taken, t) ELSE taken END, t, ok FROM (SELECT f.*, o.i AS oi, o.s AS t, len(f.taken) < 3 AND len(list_filter(f.taken, lambda u: abs(u - o.s) < 21600)) = 0 AS ok FROM f JOIN o ON o.grp = f.grp AND o.i = f.i + 1) f)
SELECT f.grp, f.s AS t_start_s, f.s + 21600 AS t_end_s, n AS n_events FROM f JOIN o ON f.grp = o.grp AND f.i = o.i WHERE keep""")
def annotation_blocks(spark, sf_dir):
    """Three blocks of six hours of each group that have an event and nothing that is excluded."""
    e, g = G.pe(spark, sf_dir), G.ge(spark, sf_dir).where("gt_id % 3 = 0").select("grp", "g_start", "g_end")
    b = e.select("grp", (F.floor(F.col("p_start") / 14400) * 14400.0).alias("t_start_s")).distinct().withColumn("t_end_s", F.col("t_start_s") + 21600)
    return review.annotation_blocks(b, e, g, ["grp"], "p_start", ("g_start", "g_end"), 21600.0, 3).select("grp", "t_start_s", "t_end_s", "n_events")


@query("repeat_frames", X(G.TRK, G.FS) + " SELECT video_id, frame_idx FROM fs WHERE (frame_idx * 7919 % 1000) / 1000000.0::DOUBLE < 0.0005 AND frame_idx > 0")
def repeat_frames(spark, sf_dir):
    """Frames that repeat the one before; the first of a series repeats none."""
    d = G.fs(spark, sf_dir).select("video_id", "frame_idx", (F.col("frame_idx") * 7919 % 1000 / 1_000_000.0).alias("diff"))
    return features.repeat_frames(d, V)


@query("sql_callables", X(G.TRK) + f""", w AS (SELECT video_id, unnest(range(0, greatest(n - 75, 0) + 1, 12)) AS w_start FROM (SELECT video_id, max(frame_idx) + 1 AS n FROM trk GROUP BY 1)),
j AS (SELECT w.video_id, w_start, frame_idx, cy, conf, row_number() OVER (PARTITION BY w.video_id, w_start ORDER BY cy, track_id, frame_idx) AS r FROM w JOIN trk ON trk.video_id = w.video_id AND frame_idx BETWEEN w_start AND w_start + 74),
m AS (SELECT video_id, w_start, cy, round(sum(conf * 100) OVER (PARTITION BY video_id, w_start ORDER BY r)) AS up, round(sum(conf * 100) OVER (PARTITION BY video_id, w_start)) AS al, conf, frame_idx FROM j),
a AS (SELECT video_id, w_start, min(cy) FILTER (2 * up >= al) AS mid, count(*) FILTER (conf > 0.5) AS k, count(*) AS n, min(frame_idx)::DOUBLE AS f0, max(frame_idx)::DOUBLE AS f1 FROM m GROUP BY 1, 2)
SELECT video_id, w_start, round(mid, 6) AS middle, round({_wilson_sql('k', 'n')[1]}, 6) AS low, round((f1 - f0) / 74, 6) AS filled FROM a""")
def sql_callables(spark, sf_dir):
    """A user's SQL with the registered functions: windows from a table function, a weighted median, an interval's bound and an overlap."""
    callables.register(spark)
    t = G.trk(spark, sf_dir)
    t.select("video_id", "frame_idx", "cy", F.round(F.col("conf") * 100).alias("weight"), "conf").createOrReplaceTempView("callable_tracks")
    return rounded(spark.sql("""
        WITH w AS (SELECT s.video_id, x.w_start, x.w_end FROM (SELECT video_id, max(frame_idx) + 1 AS n FROM callable_tracks GROUP BY video_id) s, LATERAL window_starts(s.n, 75, 12) x),
        j AS (SELECT w.video_id, w.w_start, w.w_end, t.frame_idx, t.cy, t.weight, t.conf FROM w JOIN callable_tracks t ON t.video_id = w.video_id AND t.frame_idx BETWEEN w.w_start AND w.w_end),
        m AS (SELECT video_id, w_start, weighted_median(cy, weight) AS middle FROM j GROUP BY video_id, w_start),
        c AS (SELECT video_id, w_start, w_end, wilson_low(count_if(conf > 0.5), count(*)) AS low, min(frame_idx) AS f0, max(frame_idx) AS f1 FROM j GROUP BY video_id, w_start, w_end)
        SELECT c.video_id, c.w_start, middle, low, interval_iou(f0, f1, w_start, w_end) AS filled FROM c JOIN m USING (video_id, w_start)"""))
