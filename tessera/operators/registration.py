"""Registration of shots: a homography for each from its clicked landmarks, validated on some that are held out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import pitch

FITTED = "n_landmarks long, n_inliers long, rmse_fit_m double, rmse_holdout_m double, max_holdout_m double, n_holdout long, validated byte, h array<array<double>>"


def hold_out(keypoints: DataFrame, key: list[str], n: int = 2, least: int = 4) -> DataFrame:
    """keypoints with use_for_fit: n landmarks of each shot (by the hash of their names) are held out, if least + n are there."""
    w = W.partitionBy(*key)
    rank = F.row_number().over(w.orderBy(F.xxhash64("landmark"), "landmark"))
    return keypoints.withColumn("use_for_fit", F.when((F.count("*").over(w) >= least + n) & (rank <= n), 0).otherwise(1).cast("byte"))


def fit_shots(keypoints: DataFrame, key: list[str], reach: float = 6.0, max_rmse: float = 2.0) -> DataFrame:
    """(key, FITTED): shots of under four fitting landmarks have no matrix; without held-out landmarks, or with a larger error on them than max_rmse, they aren't validated.

    A shot has a few dozen landmarks at most, so each is one small group.
    """

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("landmark", kind="stable")
        points = lambda d: (d[["img_x", "img_y"]].to_numpy(float), d[["pitch_x", "pitch_y"]].to_numpy(float))
        use, held = g[g["use_for_fit"] == 1], g[g["use_for_fit"] == 0]
        row = {**{k: g[k].iloc[0] for k in key}, "n_landmarks": len(g), "n_inliers": 0, "rmse_fit_m": None, "rmse_holdout_m": None, "max_holdout_m": None, "n_holdout": len(held), "validated": 0, "h": None}
        if len(use) >= 4:
            h, inliers = pitch.fit(*points(use), reach=reach)
            row |= {"n_inliers": int(inliers.sum()), "rmse_fit_m": pitch.errors(h, *(p[inliers] for p in points(use)))["rmse_m"], "h": np.asarray(h).tolist()}
            if len(held):
                e = pitch.errors(h, *points(held))
                row |= {"rmse_holdout_m": e["rmse_m"], "max_holdout_m": e["max_m"], "validated": int(e["rmse_m"] <= max_rmse)}
        return pd.DataFrame([row])

    kinds = ", ".join(f"{c} {keypoints.schema[c].dataType.simpleString()}" for c in key)
    return keypoints.groupBy(*key).applyInPandas(fit, f"{kinds}, {FITTED}")


def landmark_table(keypoints: DataFrame) -> DataFrame:
    """keypoints (landmark, img_x, img_y, ...) with each landmark's place on the field."""
    dim = keypoints.sparkSession.createDataFrame(pitch.landmarks(), "landmark string, pitch_x double, pitch_y double")
    return keypoints.join(F.broadcast(dim), "landmark")  # 31 rows
