"""Exact nearest vectors: all pairs of queries and vectors, block by block in matrices; no pair is a row but those that may be among the nearest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Vectors in a block of queries, and of the others: bounds of a task's matrices.
QUERIES, OTHERS = 1024, 4096


def _blocks(df: DataFrame, key: str, v: str, size: int, name: str) -> DataFrame:
    """Rows packed: ids, and vectors end to end; a block has vectors of one length without missing values."""
    kind = df.schema[key].dataType.simpleString()

    def pack(batches):
        ids, rows = {}, {}
        for t in batches:
            for i, x in zip(t.column(0).to_pylist(), t.column(1), strict=True):
                if i is None or not x.is_valid:
                    continue
                x = np.asarray(x.values, dtype=float) if not x.values.null_count else None
                if x is None:
                    continue
                ids.setdefault(len(x), []).append(i)
                rows.setdefault(len(x), []).append(x)
                if len(rows[len(x)]) == size:
                    yield out(len(x), ids.pop(len(x)), rows.pop(len(x)))
        for n in list(ids):
            yield out(n, ids[n], rows[n])

    def out(n, i, x):
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([i], pa.list_(kinds)), pa.array([np.concatenate(x).tobytes()], pa.binary())], [f"{name}_n", f"{name}_ids", f"{name}_v"])

    kinds = to_arrow_type(df.schema[key].dataType)
    return df.select(key, v).mapInArrow(pack, f"{name}_n int, {name}_ids array<{kind}>, {name}_v binary")


def nearest(queries: DataFrame, others: DataFrame, key: str, v: str, k: int, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, distance) of the k others of other ids that are nearest to each query by the rounded Euclidean distance, then by id; vectors of another length, or with missing values, have no distance."""
    q, o = _blocks(queries, key, v, QUERIES, "q"), _blocks(others, key, v, OTHERS, "o")
    kind = queries.schema[key].dataType.simpleString()
    margin = 10.0**-digits

    def best(batches):
        for t in batches:
            for r in range(t.num_rows):
                if t.column("q_n")[r] != t.column("o_n")[r]:
                    continue
                qi, oi = (np.array(t.column(c)[r].as_py()) for c in ("q_ids", "o_ids"))
                qv, ov = (np.frombuffer(t.column(c)[r].as_py()).reshape(len(ids), -1) for c, ids in (("q_v", qi), ("o_v", oi)))
                qq, oo = (qv * qv).sum(axis=1), (ov * ov).sum(axis=1)
                d2 = qq[:, None] + oo[None] - 2 * (qv @ ov.T)
                d2[qi[:, None] == oi[None]] = np.inf
                # the product may be off by a rounding error, and ranks are by rounded distances: what may be among the first k is computed again
                m = min(k, len(oi))
                slack = 1e-12 * (qq + oo.max())
                kth = np.sqrt(np.maximum(np.partition(d2, m - 1, axis=1)[:, m - 1], 0.0) + slack)
                a, b = np.nonzero(d2 <= ((kth + 2 * margin) ** 2 + slack)[:, None])
                a, b = (x[np.isfinite(d2[a, b])] for x in (a, b))
                total = np.zeros(len(a))
                for c in range(qv.shape[1]):
                    total += (qv[a, c] - ov[b, c]) ** 2
                yield pa.RecordBatch.from_arrays([pa.array(qi[a].tolist(), kinds), pa.array(oi[b].tolist(), kinds), pa.array(np.sqrt(total))], ["query_id", "vec_id", "distance"])

    kinds = to_arrow_type(queries.schema[key].dataType)
    pairs = o.repartition(2 * queries.sparkSession.sparkContext.defaultParallelism).crossJoin(q)  # a row a block
    near = pairs.mapInArrow(best, f"query_id {kind}, vec_id {kind}, distance double").withColumn("distance", F.round("distance", digits))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
    return near.withColumn("r", rank).where(F.col("r") <= k).drop("r")
