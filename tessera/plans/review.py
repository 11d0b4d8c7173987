"""Queries of annotation review."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import review
from tessera.plans import surrogates as G
from tessera.plans.registry import query, rounded

V = ["video_id"]


def X(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts)


@query("track_id_hygiene", X(G.TRK, "b AS (SELECT video_id, CASE WHEN event_id % 11 = 0 THEN -1 ELSE track_id END AS id FROM trk)") + """
SELECT video_id, count(*) AS n_rows, count(*) FILTER (id = -1) AS n_shapes, count(DISTINCT id) FILTER (id <> -1) AS n_tracks, min(id) FILTER (id <> -1) AS first_id, max(id) FILTER (id <> -1) AS last_id,
       len(list_filter(range(min(id) FILTER (id <> -1), max(id) FILTER (id <> -1) + 1), lambda x: NOT list_contains(list(DISTINCT id), x))) AS n_missing FROM b GROUP BY 1""")
def track_id_hygiene(spark, sf_dir):
    """Track ids of each series: rows that are shapes, and gaps between the ids."""
    b = G.trk(spark, sf_dir).withColumn("id", F.when(F.col("event_id") % 11 == 0, -1).otherwise(F.col("track_id")))
    return review.track_ids(b, V, "id")


_CUTS = """c AS (SELECT video_id, frame_idx::DOUBLE AS at FROM axis WHERE frame_idx % 97 = 13 AND video_id = 1 OR frame_idx = 40),
f AS (SELECT video_id, frame_idx::DOUBLE AS t, n_tracks FROM fs),
m AS (SELECT f.*, EXISTS (SELECT 1 FROM c WHERE c.video_id = f.video_id AND abs(c.at - f.t) <= 1) AS near FROM f WHERE video_id IN (
  SELECT c.video_id FROM c JOIN (SELECT video_id, min(t) AS a, max(t) AS b FROM f GROUP BY 1) s ON s.video_id = c.video_id AND c.at BETWEEN a AND b))"""


@query("cut_rates_within_blocks", X(G.TRK, G.FS, _CUTS) + " SELECT video_id, near, sum(n_tracks)::BIGINT AS n_hits, count(*) AS n_frames, round(sum(n_tracks) / count(*)::DOUBLE, 6) AS rate FROM m GROUP BY 1, 2")
def cut_rates_within_blocks(spark, sf_dir):
    """Tracks a frame within a second of a confirmed cut, and elsewhere in the same series."""
    f = G.fs(spark, sf_dir).select("video_id", "frame_idx", F.col("frame_idx").cast("double").alias("t"), "n_tracks")
    cuts = f.where("frame_idx % 97 = 13 AND video_id = 1 OR frame_idx = 40").select("video_id", F.col("t").alias("at"))
    return rounded(review.rates_near(f.drop("frame_idx"), cuts, V, "t", "at", "n_tracks"))


@query("planned_segments", """WITH p AS (SELECT o_custkey AS c_custkey, min({'s': o_orderdate, 'd': o_orderpriority}) AS p FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT c.c_custkey, coalesce(strftime(p.p.s, '%Y-%m-%d'), '1990-01-01') AS segment_start, coalesce(p.p.d, 'none') AS segment_class, CASE WHEN p.p IS NULL THEN 'config' ELSE 'plan' END AS origin FROM customer c LEFT JOIN p ON c.c_custkey = p.c_custkey""")
def planned_segments(spark, sf_dir):
    """Settings of each customer from its first planned row, else as configured."""
    plan = G.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("segment_start"), F.col("o_orderpriority").alias("segment_class"))
    return review.planned(G.table(spark, sf_dir, "customer").select("c_custkey"), plan, "c_custkey", {"segment_start": "1990-01-01", "segment_class": "none"})


_PASS = """a AS (SELECT l_orderkey, l_linenumber AS n, (l_quantity)::DOUBLE AS score, l_returnflag AS label FROM lineitem WHERE l_linenumber <= 2),
b AS (SELECT x.l_orderkey, x.score AS s1, y.score AS s2, x.label AS l1, y.label AS l2 FROM a x JOIN a y ON x.l_orderkey = y.l_orderkey AND x.n = 1 AND y.n = 2)"""


def _passes(spark, sf_dir):
    return G.table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("double").alias("score"), F.col("l_returnflag").alias("label"))


@query("recoded_pairs", "WITH " + _PASS + " SELECT l_orderkey, s1 AS score_p1, s2 AS score_p2, l1 AS label_p1, l2 AS label_p2 FROM b")
def recoded_pairs(spark, sf_dir):
    """First and second coding side by side."""
    return review.passes(_passes(spark, sf_dir), "l_orderkey", "n", ["score", "label"])


@query("rater_ceiling", "WITH " + _PASS + """, g AS (SELECT count(*)::DOUBLE AS n, avg((s1 + s2) / 2) AS m, avg(s1) AS m1, avg(s2) AS m2 FROM b),
t AS (SELECT n, 2 * sum(((s1 + s2) / 2 - m) ^ 2) AS ssr, n * ((any_value(m1) - any_value(m)) ^ 2 + (any_value(m2) - any_value(m)) ^ 2) AS ssc, sum((s1 - m) ^ 2 + (s2 - m) ^ 2) AS sst, avg((l1 = l2)::INT) AS exact FROM b, g GROUP BY n),
q AS (SELECT n, exact, ssr / (n - 1) AS r, ssc AS c, (sst - ssr - ssc) / (n - 1) AS e FROM t)
SELECT n::BIGINT AS n_recoded, round((r - e) / (r + e + 2 * (c - e) / n), 6) AS icc, round(exact, 6) AS exact FROM q""")
def rater_ceiling(spark, sf_dir):
    """How far a rater agrees with the own second pass: the ceiling of any comparison with that rater."""
    return rounded(review.rater_ceiling(_passes(spark, sf_dir), "l_orderkey", "n", "score", "label"))


@query("annotation_effort", X(G.TRK) + " SELECT video_id, s::DOUBLE AS seconds_per_box, round(n * s / 3600, 1) AS hours FROM (SELECT video_id, count(*)::DOUBLE AS n FROM trk GROUP BY 1), (VALUES (1.5), (2.5), (4.0)) v(s)")
def annotation_effort(spark, sf_dir):
    """Hours to annotate each series, for three speeds."""
    d = G.trk(spark, sf_dir).groupBy("video_id").agg(F.count("*").cast("double").alias("n"))
    return d.select("video_id", F.explode(review.effort(F.col("n"))).alias("e")).select("video_id", "e.*")
