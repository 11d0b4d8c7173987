"""Queries on agreement between raters, and statistics of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import stats as S
from tessera.operators import agreement as A
from tessera.plans import surrogates as G
from tessera.plans.events import MATCHES, matches
from tessera.plans.registry import query, rounded

_Z = repr(S.z_of())


def _wilson_sql(k: str, n: str) -> tuple[str, str, str]:
    p, d = f"({k} / {n}::DOUBLE)", f"(1 + {_Z} ^ 2 / {n})"
    c, h = f"(({p} + {_Z} ^ 2 / (2 * {n})) / {d})", f"({_Z} * sqrt({p} * (1 - {p}) / {n} + {_Z} ^ 2 / (4 * {n}::DOUBLE ^ 2)) / {d})"
    return p, f"greatest(0, {c} - {h})", f"least(1, {c} + {h})"


_P, _LO, _HI = _wilson_sql("k", "n")


@query("wilson_intervals", f"SELECT l_returnflag AS flag, k, n, round({_P}, 6) AS value, round({_LO}, 6) AS ci_low, round({_HI}, 6) AS ci_high FROM (SELECT l_returnflag, count(*) FILTER (l_quantity > 45) AS k, count(*) AS n FROM lineitem GROUP BY 1)")
def wilson_intervals(spark, sf_dir):
    d = G.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_if(F.col("l_quantity") > 45).alias("k"), F.count("*").alias("n"))
    return rounded(d.withColumns(S.wilson("k", "n")))


_RATERS = "r AS (SELECT l_partkey AS part, any_value(p_retailprice) AS a, avg(l_extendedprice / l_quantity) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


def raters(spark, sf_dir):
    b = G.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("b"))
    return b.join(G.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("a")), "part")


@query("icc_2_1", f"""WITH {_RATERS}, g AS (SELECT count(*) AS n, (avg(a) + avg(b)) / 2 AS g, avg(a) AS ma, avg(b) AS mb FROM r),
m AS (SELECT any_value(n) AS n, 2 * sum(((a + b) / 2 - g) ^ 2) / (any_value(n) - 1) AS r, any_value(n * ((ma - g) ^ 2 + (mb - g) ^ 2)) AS c, sum((a - g) ^ 2 + (b - g) ^ 2) AS t FROM r, g), e AS (SELECT *, (t - r * (n - 1) - c) / (n - 1) AS e FROM m)
SELECT n, round((r - e) / (r + e + 2 * (c - e) / n), 6) AS icc FROM e""")
def icc(spark, sf_dir):
    return rounded(A.icc(raters(spark, sf_dir), ["a", "b"]).select("n", "icc"))


@query("bland_altman", f"""WITH {_RATERS}, d AS (SELECT a - b AS d, (a + b) / 2 AS m FROM r)
SELECT count(*) AS n, round(avg(d), 4) AS bias, round(stddev_samp(d), 4) AS sd, round(avg(d) - 1.96 * stddev_samp(d), 4) AS loa_low, round(avg(d) + 1.96 * stddev_samp(d), 4) AS loa_high, round(regr_slope(d, m), 4) AS slope FROM d""")
def bland_altman(spark, sf_dir):
    return rounded(A.bland_altman(raters(spark, sf_dir), "a", "b").select("n", "bias", "sd", "loa_low", "loa_high", "slope"), 4)


@query("icc_ci")
def icc_ci(spark, sf_dir):
    """ICC(2,1) with its exact interval: one row of mean squares comes to the driver for the quantiles."""
    row = A.icc(raters(spark, sf_dir), ["a", "b"]).first().asDict()
    lo, hi = A.icc_interval(row)
    return rounded(spark.createDataFrame([(row["n"], row["icc"], lo, hi)], "n long, icc double, ci_low double, ci_high double"))


@query("bland_altman_ci")
def bland_altman_ci(spark, sf_dir):
    row = A.bland_altman(raters(spark, sf_dir), "a", "b").first().asDict()
    return rounded(spark.createDataFrame([{k: float(v) for k, v in ({"bias": row["bias"]} | A.bland_altman_intervals(row)).items()}]))


_K = """WITH t AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d FROM labels),
p AS (SELECT *, (a + b + c + d)::DOUBLE AS n FROM t), q AS (SELECT *, (a + d) / n AS po, ((a + b) * (a + c) + (c + d) * (b + d)) / (n * n) AS pe FROM p)"""


@query("kappa_binary", _K + f" SELECT round(po, 6) AS agreement, round(pe, 6) AS chance, round((po - pe) / (1 - pe), 6) AS kappa, round((po - pe) / (1 - pe) - {_Z} * sqrt(po * (1 - po) / (n * (1 - pe) ^ 2)), 6) AS ci_low, round((po - pe) / (1 - pe) + {_Z} * sqrt(po * (1 - po) / (n * (1 - pe) ^ 2)), 6) AS ci_high, round((a + b) / n, 6) AS prevalence FROM q")
def kappa_binary(spark, sf_dir):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    d = G.table(spark, sf_dir, "labels").agg(F.count_if(q & t).alias("a"), F.count_if(q & ~t).alias("b"), F.count_if(~q & t).alias("c"), F.count_if(~q & ~t).alias("d"))
    return rounded(d.select(*[c.alias(n) for n, c in S.kappa("a", "b", "c", "d").items()]))


_BANDS = "o AS (SELECT CASE WHEN o_totalprice < 100000 THEN '1' WHEN o_totalprice < 200000 THEN '2' WHEN o_totalprice < 300000 THEN '3' WHEN o_totalprice < 400000 THEN '4' ELSE '5' END AS a, substr(o_orderpriority, 1, 1) AS b FROM orders)"


def _bands(spark, sf_dir):
    p = F.col("o_totalprice")
    a = F.when(p < 100000, "1").when(p < 200000, "2").when(p < 300000, "3").when(p < 400000, "4").otherwise("5")
    return G.table(spark, sf_dir, "orders").select(a.alias("a"), F.substring("o_orderpriority", 1, 1).alias("b"))


@query("weighted_kappa", f"""WITH {_BANDS}, n AS (SELECT count(*)::DOUBLE AS n FROM o), ra AS (SELECT a, count(*) AS c FROM o GROUP BY 1), rb AS (SELECT b, count(*) AS c FROM o GROUP BY 1),
e AS (SELECT sum((abs(a::INT - b::INT) / 4.0::DOUBLE) ^ 2 * ra.c * rb.c) AS e FROM ra, rb) SELECT count(*) AS n, round(1 - (sum((abs(a::INT - b::INT) / 4.0::DOUBLE) ^ 2) / any_value(n)) / (any_value(e) / any_value(n) ^ 2), 6) AS kappa FROM o, n, e""")
def weighted_kappa(spark, sf_dir):
    return rounded(A.weighted_kappa(_bands(spark, sf_dir), "a", "b", ["1", "2", "3", "4", "5"], 2))


@query("confusion_dense", f"WITH {_BANDS}, l AS (SELECT a AS l FROM o UNION SELECT b FROM o) SELECT x.l AS label_a, y.l AS label_b, count(o.a) AS n FROM l x CROSS JOIN l y LEFT JOIN o ON o.a = x.l AND o.b = y.l GROUP BY 1, 2")
def confusion_dense(spark, sf_dir):
    return A.confusion(_bands(spark, sf_dir), "a", "b")


@query("nominal_agreement", f"""WITH {_BANDS}, n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b) AS s FROM o), e AS (SELECT sum(x.c * y.c)::DOUBLE AS e FROM (SELECT a AS l, count(*) AS c FROM o GROUP BY 1) x JOIN (SELECT b AS l, count(*) AS c FROM o GROUP BY 1) y ON x.l = y.l)
SELECT n::BIGINT AS n, round(s / n, 6) AS exact, round(e / n ^ 2, 6) AS chance, round((s / n - e / n ^ 2) / (1 - e / n ^ 2), 6) AS kappa FROM n, e""")
def nominal_agreement(spark, sf_dir):
    return rounded(A.nominal(_bands(spark, sf_dir), "a", "b"))


@query("exact_and_near", f"WITH {_BANDS} SELECT count(*) AS n, round(avg((a = b)::INT), 6) AS exact, round(avg((abs(a::INT - b::INT) <= 1)::INT), 6) AS within_one, round(avg(abs(a::INT - b::INT)), 6) AS mae FROM o")
def exact_and_near(spark, sf_dir):
    far = F.abs(F.col("a").cast("int") - F.col("b").cast("int"))
    return rounded(_bands(spark, sf_dir).agg(F.count("*").alias("n"), F.avg((far == 0).cast("double")).alias("exact"), F.avg((far <= 1).cast("double")).alias("within_one"), F.avg(far).alias("mae")))


@query("rate_ratio", f"""SELECT round(72 / 153::DOUBLE / (141 / 447::DOUBLE), 6) AS ratio, round(72 / 153::DOUBLE / (141 / 447::DOUBLE) * exp(-{_Z} * sqrt(1 / 72::DOUBLE + 1 / 141::DOUBLE)), 6) AS ci_low, round(72 / 153::DOUBLE / (141 / 447::DOUBLE) * exp({_Z} * sqrt(1 / 72::DOUBLE + 1 / 141::DOUBLE)), 6) AS ci_high""")
def rate_ratio(spark, sf_dir):
    d = spark.createDataFrame([(72, 153, 141, 447)], "a long, b long, c long, d long")
    return rounded(d.select(*[c.alias(n) for n, c in S.rate_ratio("a", "b", "c", "d").items()]))


@query("cause_crosstab", "SELECT o_orderpriority AS cause, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders WHERE length(o_orderpriority) > 0 GROUP BY 1")
def cause_crosstab(spark, sf_dir):
    d = G.table(spark, sf_dir, "orders").where(F.length("o_orderpriority") > 0)
    return d.groupBy(F.col("o_orderpriority").alias("cause")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderstatus")).na.fill(0)


@query("bootstrap_f1")
def bootstrap_f1(spark, sf_dir):
    return rounded(A.bootstrap_f1(matches(spark, sf_dir)))


@query("ceiling_ratio", G.with_(MATCHES) + ", c AS (SELECT grp, count(*) FILTER (kind = 'TP') AS tp, count(*) FILTER (kind <> 'TP') AS other FROM matches GROUP BY 1) SELECT grp, round(tp / nullif(other, 0)::DOUBLE, 6) AS ratio FROM c")
def ceiling_ratio(spark, sf_dir):
    d = matches(spark, sf_dir).groupBy("grp").agg(F.count_if(F.col("kind") == "TP").alias("tp"), F.count_if(F.col("kind") != "TP").alias("other"))
    return rounded(d.select("grp", A.ceiling_ratio(F.col("tp"), F.col("other").cast("double")).alias("ratio")))
