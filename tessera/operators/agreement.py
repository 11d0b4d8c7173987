"""Agreement statistics between raters, and between predictions and truth."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import stats as S


def confusion(df: DataFrame, a: str, b: str, labels: list[str] | None = None) -> DataFrame:
    """The dense square of counts over all labels that either column has (or those given); rows with a null or unlisted label are left out."""
    if labels is None:
        axis = df.select(F.col(a).alias("l")).unionByName(df.select(F.col(b).alias("l"))).where("l IS NOT NULL").distinct()
    else:
        axis = df.sparkSession.createDataFrame([(x,) for x in labels], f"l {df.schema[a].dataType.simpleString()}")
    counts = df.groupBy(F.col(a).alias("label_a"), F.col(b).alias("label_b")).count()
    grid = axis.select(F.col("l").alias("label_a")).crossJoin(axis.select(F.col("l").alias("label_b")))  # labels squared
    return grid.join(counts, ["label_a", "label_b"], "left").select("label_a", "label_b", F.coalesce("count", F.lit(0)).alias("n"))


def nominal(df: DataFrame, a: str, b: str, labels: list[str] | None = None) -> DataFrame:
    """Exact agreement, chance agreement and Cohen's kappa over all labels."""
    m = confusion(df, a, b, labels)
    rows, cols = m.groupBy("label_a").agg(F.sum("n").alias("ra")), m.groupBy(F.col("label_b").alias("label_a")).agg(F.sum("n").alias("rb"))
    t = m.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n"))).alias("same"))
    e = rows.join(cols, "label_a").agg(F.sum(F.col("ra") * F.col("rb")).alias("e"))
    po, pe = F.col("same") / F.nullif(F.col("n"), F.lit(0)), F.col("e") / F.nullif(F.col("n") * F.col("n"), F.lit(0))
    return t.crossJoin(e).select("n", po.alias("exact"), pe.alias("chance"), ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def weighted_kappa(df: DataFrame, a: str, b: str, order: list[str], power: int = 1) -> DataFrame:
    """Kappa of ordered categories with linear (power 1) or quadratic (2) weights; unlisted labels are left out."""
    k = max(len(order) - 1, 1)
    rank = lambda c: F.array_position(F.array(*map(F.lit, order)), F.col(c)) - 1
    d = df.where(F.col(a).isin(order) & F.col(b).isin(order)).select(rank(a).alias("i"), rank(b).alias("j"))
    o = d.groupBy("i", "j").count()
    far = F.pow(F.abs(F.col("i") - F.col("j")) / k, F.lit(power))
    seen = o.agg(F.sum(far * F.col("count")).alias("wo"), F.sum("count").alias("n"))
    e = d.groupBy("i").agg(F.count("*").alias("a")).crossJoin(d.groupBy("j").agg(F.count("*").alias("b"))).agg(F.sum(far * F.col("a") * F.col("b")).alias("we"))
    return seen.crossJoin(e).select("n", (1 - (F.col("wo") / F.col("n")) / F.nullif(F.col("we") / (F.col("n") * F.col("n")), F.lit(0.0))).alias("kappa"))


def icc_terms(df: DataFrame, raters: list[str]) -> DataFrame:
    """Mean squares of a two-way layout; rows with any null or NaN are left out."""
    k = len(raters)
    d = df.select(*[F.col(r).cast("double").alias(r) for r in raters])
    ok = F.lit(True)
    for r in raters:
        ok = ok & F.col(r).isNotNull() & ~F.isnan(r)
    d = d.where(ok)
    # centred on the grand mean, which is one number
    g = d.agg((sum((F.sum(r) for r in raters), F.lit(0.0)) / F.nullif(k * F.count("*"), F.lit(0))).alias("g"))
    c = d.crossJoin(F.broadcast(g)).select(*[(F.col(r) - F.col("g")).alias(r) for r in raters])  # one row
    total = sum((F.col(r) for r in raters), F.lit(0.0))
    t = c.agg(F.count("*").alias("n"), F.sum(total * total).alias("rows"), F.array(*[F.sum(r) for r in raters]).alias("cols"), F.sum(sum((F.col(r) * F.col(r) for r in raters), F.lit(0.0))).alias("sst"))
    t = t.withColumn("ssc", F.expr("aggregate(cols, 0D, (a, x) -> a + x * x)") / F.nullif(F.col("n"), F.lit(0)))
    ssr = F.col("rows") / k
    less = F.nullif(F.col("n") - 1, F.lit(0))
    return t.select("n", F.lit(k).alias("k"), (ssr / less).alias("ms_rows"), (F.col("ssc") / max(k - 1, 1)).alias("ms_cols"), ((F.col("sst") - ssr - F.col("ssc")) / (less * max(k - 1, 1))).alias("ms_error"))


def icc(df: DataFrame, raters: list[str]) -> DataFrame:
    """ICC(2,1): agreement of single raters; 1 where raters agree throughout (a constant bias isn't that), null with fewer than two rows."""
    r, c, n, k = (F.col(x) for x in ("ms_rows", "ms_cols", "n", "k"))
    e, tiny = F.greatest(F.col("ms_error"), F.lit(0.0)), 1e-12 * F.greatest(F.col("ms_rows"), F.lit(1e-300))
    value = (r - e) / (r + (k - 1) * e + k * (c - e) / n)
    return icc_terms(df, raters).withColumn("icc", F.when(n < 2, None).when((e <= tiny) & (c <= tiny), 1.0).otherwise(value))


def icc_interval(row: dict, level: float = 0.95) -> tuple[float, float]:
    """The exact F interval of a row of icc()."""
    n, k, r, c, e, icc_ = (row[x] for x in ("n", "k", "ms_rows", "ms_cols", "ms_error", "icc"))
    if icc_ is None or n < 2:
        return math.nan, math.nan
    tiny = 1e-12 * max(r, 1e-300)
    if e <= tiny and c <= tiny:
        return 1.0, 1.0
    e = max(e, tiny)
    f, a = c / e, (1 - level) / 2
    top = n * (1 + (k - 1) * icc_) - k * icc_
    v = (k - 1) * (n - 1) * (k * icc_ * f + top) ** 2 / ((n - 1) * k * k * icc_ * icc_ * f * f + top * top)
    low, high = S.f_quantile(1 - a, n - 1, v), S.f_quantile(1 - a, v, n - 1)
    lo = n * (r - low * e) / (low * (k * c + (k * n - k - n) * e) + n * r)
    hi = n * (high * r - e) / (k * c + (k * n - k - n) * e + n * high * r)
    return max(-1.0, lo), min(1.0, hi)


def bland_altman(df: DataFrame, model: str, human: str, level: float = 0.95) -> DataFrame:
    """Bias of model - human, limits of agreement, and the regression of the difference on the mean. Interval columns need the count: see bland_altman_intervals."""
    d = df.select((F.col(model) - F.col(human)).cast("double").alias("d"), ((F.col(model) + F.col(human)) / 2).cast("double").alias("m")).where("d IS NOT NULL AND NOT isnan(d)")
    s, b = F.col("sd"), F.col("bias")
    out = d.agg(F.count("*").alias("n"), F.avg("d").alias("bias"), F.stddev_samp("d").alias("sd"), F.regr_slope("d", "m").alias("slope"), F.regr_r2("d", "m").alias("r2"))
    return out.withColumns({"loa_low": b - 1.96 * s, "loa_high": b + 1.96 * s, "se_bias": s / F.sqrt("n"), "se_loa": F.sqrt((1 / F.col("n") + 1.96**2 / (2 * F.nullif(F.col("n") - 1, F.lit(0)))) * s * s)})


def bland_altman_intervals(row: dict, level: float = 0.95) -> dict[str, float]:
    """t intervals of bias and limits, and the p value of the slope, of a row of bland_altman()."""
    t = S.t_quantile(0.5 + level / 2, row["n"] - 1)
    out = {f"{name}_{side}": row[name] + sign * t * row[se] for name, se in (("bias", "se_bias"), ("loa_low", "se_loa"), ("loa_high", "se_loa")) for side, sign in (("ci_low", -1), ("ci_high", 1))}
    df, r2 = row["n"] - 2, row["r2"]
    out["slope_p"] = 1.0 if not r2 else 0.0 if r2 >= 1 else S.beta_cdf(df / (df + r2 * df / (1 - r2)), df / 2, 0.5)
    return out


def bootstrap_f1(matches: DataFrame, resamples: int = 10_000, seed: int = 1729, level: float = 0.95) -> DataFrame:
    """F1 of match kinds with a percentile interval over resampled events.

    Events enter by their counts alone: a resample of n of them is one multinomial draw of
    three counts, so neither the events nor their order meet in one task, and the cost doesn't grow with them.
    """
    counts = matches.groupBy("kind").count().groupBy().pivot("kind", ["TP", "FP", "FN"]).agg(F.sum("count"))

    def draw(batches):
        for t in batches:
            for r in t.to_dict("records"):
                k = np.array([r[c] if r[c] == r[c] else 0 for c in ("TP", "FP", "FN")], dtype=float)
                n = int(k.sum())
                f1 = lambda x: 2 * x[..., 0] / np.maximum(2 * x[..., 0] + x[..., 1] + x[..., 2], 1)
                sims = f1(np.random.default_rng(seed).multinomial(n, k / n, size=resamples)) if n else np.array([np.nan])
                lo, hi = np.quantile(sims, [(1 - level) / 2, (1 + level) / 2])
                yield pd.DataFrame({"n": [n], "f1": [float(f1(k)) if n else np.nan], "ci_low": [lo], "ci_high": [hi]})

    return counts.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("TP", "FP", "FN")]).mapInPandas(draw, "n long, f1 double, ci_low double, ci_high double")


def bootstrap(df: DataFrame, terms: dict[str, Column], statistic: Column, resamples: int = 10_000, seed: int = 1729, level: float = 0.95) -> DataFrame:
    """(n, value, ci_low, ci_high) of any statistic that is an expression of sums of `terms` over the rows, with a percentile interval.

    Rows of equal terms are one cell, and each resample takes a Poisson number of it around its
    count, drawn from the cell's own hash: cells are spread over tasks, a task that runs again draws
    the same, and what meets at the end are `resamples` rows of sums. Null terms add nothing;
    resamples without a finite statistic are left out, as is the interval of no rows.
    """
    names = list(terms)
    cells = df.select(*[c.cast("double").alias(n) for n, c in terms.items()]).groupBy(*names).agg(F.count("*").alias("__n")).withColumn("__key", F.xxhash64(*names))

    def draw(batches):
        total = np.zeros((resamples, len(names) + 1))
        for t in batches:
            values = np.column_stack([np.nan_to_num(t[names].to_numpy(dtype=float)), np.ones(len(t))])
            for row, count, key in zip(values, t["__n"], t["__key"], strict=True):
                total += np.random.default_rng([seed, int(key) % 2**63]).poisson(count, resamples)[:, None] * row
        yield pd.DataFrame({"resample": np.arange(resamples)} | {n: total[:, i] for i, n in enumerate([*names, "__n"])})

    kinds = "resample long, " + ", ".join(f"`{n}` double" for n in [*names, "__n"])
    sums = cells.mapInPandas(draw, kinds).groupBy("resample").agg(*[F.sum(n).alias(n) for n in [*names, "__n"]]).where(F.col("__n") > 0).select(statistic.cast("double").alias("s"))
    ends = sums.where(F.abs("s") < float("inf")).agg(F.percentile("s", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("q"))
    whole = cells.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), *[F.sum(F.col(n) * F.col("__n")).alias(n) for n in names])
    return whole.crossJoin(ends).select("n", statistic.cast("double").alias("value"), F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))  # one row and one row


def weighted_kappa_interval(df: DataFrame, a: str, b: str, order: list[str], power: int = 1, resamples: int = 2000, seed: int = 1729, level: float = 0.95) -> DataFrame:
    """weighted_kappa() with a percentile interval: every cell of the square is a term."""
    k, places = max(len(order) - 1, 1), range(len(order))
    at = {(i, j): f"c{i}_{j}" for i in places for j in places}
    terms = {name: ((F.col(a) == order[i]) & (F.col(b) == order[j])).cast("int") for (i, j), name in at.items()}
    total = lambda cells: sum((F.col(c) for c in cells), F.lit(0.0))
    n, far = total(at.values()), {x: (abs(x[0] - x[1]) / k) ** power for x in at}
    rows, cols = [total(at[i, j] for j in places) for i in places], [total(at[i, j] for i in places) for j in places]
    seen = sum((far[x] * F.col(c) for x, c in at.items() if far[x]), F.lit(0.0))
    chance = sum((far[i, j] * rows[i] * cols[j] for i, j in at if far[i, j]), F.lit(0.0))
    d = bootstrap(df.where(F.col(a).isin(order) & F.col(b).isin(order)), terms, 1 - seen * n / F.nullif(chance, F.lit(0.0)), resamples, seed, level)
    return d.withColumnRenamed("value", "kappa")


def class_recall(df: DataFrame, truth: str, other: str) -> DataFrame:
    """Per label of either column: how many rows have it as truth, and the share of these that the other column agrees on (null for none). Rows with a null are left out."""
    m = confusion(df, truth, other).groupBy(F.col("label_a").alias("label")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)).alias("same"))
    return m.select("label", "n", (F.col("same") / F.nullif(F.col("n"), F.lit(0))).alias("recall"))


def count_agreement(df: DataFrame, pred: str, truth: str, uncertainty: str, level: float = 0.95) -> DataFrame:
    """Counts compared: shares that are equal and that are at most one apart, both with Wilson intervals, the mean distance, and the median of the counts' uncertainty."""
    far = F.abs(F.col(pred) - F.col(truth))
    d = df.where(far.isNotNull()).agg(F.count("*").alias("n"), F.count_if(far == 0).alias("k0"), F.count_if(far <= 1).alias("k1"), F.avg(far).alias("mae"), F.median(uncertainty).alias("median_uncertainty"))
    shares = {f"{name}_{part}": c for name, k in (("exact", "k0"), ("within_one", "k1")) for part, c in S.wilson(k, "n", level).items()}
    return d.select("n", *[c.alias(x) for x, c in shares.items()], "mae", "median_uncertainty")


def binary_agreement(df: DataFrame, pred: str, truth: str, positive: str, level: float = 0.95) -> DataFrame:
    """Kappa, precision, recall and F1 of "is `positive`"; a null is not."""
    p, t = F.col(pred).eqNullSafe(F.lit(positive)), F.col(truth).eqNullSafe(F.lit(positive))
    d = df.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    kappa = {("kappa" if k == "kappa" else f"kappa_{k}"): c for k, c in S.kappa("tp", "fp", "fn", "tn", level).items()}
    return d.select("tp", "fp", "fn", "tn", *[c.alias(k) for k, c in (kappa | S.precision_recall("tp", "fp", "fn", level)).items()])


def ceiling_ratio(value: Column, ceiling: Column) -> Column:
    """value / ceiling; null where the ceiling is 0, infinite or no number."""
    return F.when((ceiling != 0) & (F.abs(ceiling) < float("inf")) & ~F.isnan(ceiling), value / ceiling)


def offsets(matches: DataFrame, pred: str, gt: str) -> DataFrame:
    """How far matched peaks lie apart."""
    d = matches.where(F.col(pred).isNotNull() & F.col(gt).isNotNull()).select((F.col(pred) - F.col(gt)).alias("d"))
    return d.agg(F.count("*").alias("n"), F.avg(F.abs("d")).alias("mean_abs"), F.median(F.abs("d")).alias("median_abs"), F.avg("d").alias("mean_signed"), F.percentile(F.abs("d"), F.lit(0.95)).alias("p95_abs"))


def error_class(kind: str = "kind", tiou: str = "tiou") -> Column:
    """FN, FP or boundary (a false positive that touches a truth); null for a hit."""
    return F.when(F.col(kind) == "FN", "FN").when((F.col(kind) == "FP") & (F.col(tiou) > 0.1), "boundary").when(F.col(kind) == "FP", "FP")
