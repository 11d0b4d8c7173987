"""Functions that SQL may call by name once `register` has run: scalars as SQL expressions, an aggregate, and a table function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import stats as S

_Z = repr(S.z_of())
#: Scalars stay expressions, so they are planned with the rest of the query.
SCALARS = {
    "interval_iou": ("a0 DOUBLE, a1 DOUBLE, b0 DOUBLE, b1 DOUBLE", "DOUBLE", "greatest(least(a1, b1) - greatest(a0, b0), 0D) / nullif((a1 - a0) + (b1 - b0) - greatest(least(a1, b1) - greatest(a0, b0), 0D), 0D)"),
    "wilson_low": ("k DOUBLE, n DOUBLE", "DOUBLE", f"greatest(0D, (k / n + pow({_Z}D, 2) / (2 * n) - {_Z}D * sqrt(k / n * (1 - k / n) / n + pow({_Z}D, 2) / (4 * n * n))) / (1 + pow({_Z}D, 2) / n))"),
}


@F.pandas_udf(T.DoubleType())
def weighted_median(value: pd.Series, weight: pd.Series) -> float:
    """The least value at which half of the weight is reached; null without weight. A group is one task's: for frames and events, not for whole series."""
    known = value.notna() & (weight > 0)
    v, w = value[known].to_numpy(dtype=float), weight[known].to_numpy(dtype=float)
    if not len(v):
        return None
    order = np.argsort(v, kind="stable")
    reached = np.cumsum(w[order])
    return float(v[order][np.searchsorted(reached, reached[-1] / 2)])


@F.udtf(returnType=T.StructType([T.StructField("w_start", T.LongType()), T.StructField("w_end", T.LongType())]))
class WindowStarts:
    """Window starts over a series of n frames: every `step` frames, the last one a full window; one window for a series shorter than it."""

    def eval(self, n: int, length: int, step: int) -> Iterator[tuple[int, int]]:
        if n is not None:
            for start in range(0, max(n - length, 0) + 1, step):
                yield start, start + length - 1


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; returns their names."""
    for name, (takes, gives, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    spark.udf.register("weighted_median", weighted_median)
    spark.udtf.register("window_starts", WindowStarts)
    return [*SCALARS, "weighted_median", "window_starts"]
