"""Learned scores and groupings: labels of windows, time-blocked cross-validation with purged borders, two-colour clustering."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.boxes import interval_iou
from tessera.operators.joins import overlapping


def label_windows(windows: DataFrame, truth: DataFrame, by: list[str], key: str, ends: tuple[str, str], gt_ends: tuple[str, str], width: float, threshold: float = 0.5) -> DataFrame:
    """windows with `label`: 1 if some true event's IoU with it reaches the threshold."""
    pairs = overlapping(windows.select(*by, key, *ends), truth.select(*by, *gt_ends), ends, gt_ends, width, by)
    best = pairs.groupBy(*by, key).agg(F.max(interval_iou(*ends, *gt_ends)).alias("__t"))
    return windows.join(best, [*by, key], "left").withColumn("label", (F.coalesce("__t", F.lit(0.0)) >= threshold).cast("int")).drop("__t")


def blocked_scores(rows: DataFrame, by: list[str], key: str, at: str, features: list[str], folds: int = 5, gap: float = 5.0) -> DataFrame:
    """(by, key, score): each contiguous block of time scored by a balanced logistic regression on the others, rows within gap of the block left out.

    A fold whose training rows are of one kind gives their base rate. Missing features count as 0.
    """
    d = rows.withColumn("__fold", F.ntile(folds).over(W.partitionBy(*by).orderBy(at, key)))
    d = VectorAssembler(inputCols=[f"__f_{f}" for f in features], outputCol="__x").transform(d.withColumns({f"__f_{f}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}))
    spans = d.groupBy(*by, "__fold").agg(F.min(at).alias("__a"), F.max(at).alias("__b"))
    out: list[DataFrame] = []
    for k in range(1, folds + 1):
        held = d.where(F.col("__fold") == k)
        span = spans.where(F.col("__fold") == k).drop("__fold")
        train = d.where(F.col("__fold") != k).join(F.broadcast(span), by, "left").where(F.col("__a").isNull() | (F.col(at) < F.col("__a") - gap) | (F.col(at) > F.col("__b") + gap))  # one row a series
        n = train.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
        if not n.n or n.p in (0, n.n):
            out.append(held.select(*by, key, F.lit(float(n.p or 0) / n.n if n.n else 0.0).alias("score")))
            continue
        weight = F.when(F.col("label") == 1, n.n / (2.0 * n.p)).otherwise(n.n / (2.0 * (n.n - n.p)))
        model = LogisticRegression(featuresCol="__x", labelCol="label", weightCol="__w", regParam=0.01, maxIter=50).fit(train.withColumn("__w", weight))
        out.append(model.transform(held).select(*by, key, vector_to_array("probability")[1].alias("score")))
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total


def colour_distances(crops: DataFrame, vector: str, seed: int = 1729) -> DataFrame:
    """crops with d0 and d1, the distances of their vectors (arrays) to two centres; the centre that is less in its first differing place comes first."""
    d = crops.withColumn("__x", array_to_vector(F.col(vector).cast("array<double>")))
    centres = sorted(tuple(float(v) for v in c) for c in KMeans(k=2, seed=seed, featuresCol="__x").fit(d).clusterCenters())
    far = lambda c: F.sqrt(F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    return d.drop("__x").withColumns({"d0": far(centres[0]), "d1": far(centres[-1])})
