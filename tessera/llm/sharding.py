"""Sharding by Karmarkar-Karp differencing.

Groups of equal texts are indivisible. A partial partition is a set of groups
dealt to k bins, known by its k bin sums; at first each group is one, with all
its bytes in one bin. The two of largest spread (largest less smallest sum) are
combined again and again, oppositely ordered: the fullest bin of one with the
emptiest of the other. What is left at the end is the partition.

A combination needs sums alone, so it works at any scale in levels: groups are
dealt to nodes of about `fan_in` children by a hash of their key, each node is
differenced in a task of its own to one partial partition, and those are the
children of the next level, until one is left. Each child keeps where each of its bins went
(`place`); following the places down from the root gives every group its shard.

Law `bytes`: shard sizes are near equal. Slots are gapless from 0 in a shard:
rows are counted by (shard, sub-bucket of the row, so that equal rows are dealt out too), and a row's slot is the
number of rows in the sub-buckets before its own plus its place there, so no
task sorts a whole shard.

Defined results: a null text has size 1 and checksum 0, and forms a group apart
from empty texts, which have those too; repeated rows each get a slot; other
columns are ignored. A group of over 1/k of all bytes has a shard with little else.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

SHARDS = 8
#: Children of one node: what one task differences.
FAN_IN = 4096
#: Rows of a shard that one task numbers, about.
SLOT_ROWS = 2000


def difference(sums: Sequence[Sequence[int]], k: int) -> tuple[list[list[int]], list[int]]:
    """Combine partial partitions to one: (for each the final bin of each of its bins, the final sums).

    Equal spreads are taken in the order given, so the result depends on the input order alone.
    """
    nodes: list[tuple] = []  # (left, right, order): bin i of a node holds bin order[i] of left and bin k - 1 - order[i] of right
    heap, first = [], []
    for i, s in enumerate(sums):
        order = sorted(range(k), key=lambda b: (-s[b], b))
        first.append(order)
        ranked = tuple(s[b] for b in order)
        heap.append((ranked[-1] - ranked[0], i, ranked))
        nodes.append(())
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heap[0]
        both = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(k), key=lambda i: (-both[i], i))
        ranked = tuple(both[i] for i in order)
        heapq.heapreplace(heap, (ranked[-1] - ranked[0], len(nodes), ranked))
        nodes.append((a, b, order))
    if not heap:
        return [], [0] * k
    root = heap[0][1]
    at: list = [None] * len(nodes)
    at[root] = list(range(k))
    for n in range(root, -1, -1):
        if nodes[n]:
            a, b, order = nodes[n]
            at[a], at[b] = [0] * k, [0] * k
            for i, where in enumerate(at[n]):
                at[a][order[i]] = where
                at[b][k - 1 - order[i]] = where
    places = []
    for i, order in enumerate(first):
        place = [0] * k
        for rank, b in enumerate(order):
            place[b] = at[i][rank]
        places.append(place)
    return places, list(heap[0][2])


def _level(children: DataFrame, k: int) -> DataFrame:
    """(node, child, sums) -> (node, child, place), and a row with a null child and the node's sums for each node."""

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("child", kind="stable")
        places, total = difference([list(map(int, s)) for s in rows["sums"]], k)
        node = int(rows["node"].iloc[0])
        return pd.DataFrame({"node": node, "child": [*rows["child"], None], "place": [*places, total]})

    return children.groupBy("node").applyInPandas(combine, f"node long, child {children.schema['child'].dataType.simpleString()}, place array<long>")


def partition(groups: DataFrame, k: int = SHARDS, fan_in: int = FAN_IN) -> DataFrame:
    """(key, bytes) with distinct keys -> (key, shard)."""
    empty = [F.lit(0).cast("long")] * (k - 1)
    nodes = max(1, -(-groups.count() // fan_in))
    children = groups.select(F.pmod(F.xxhash64("key"), F.lit(nodes)).alias("node"), F.col("key").alias("child"), F.array(F.col("bytes").cast("long"), *empty).alias("sums"))
    level = cut(_level(children, k))
    found = level.where(F.col("child").isNotNull()).select(F.col("child").alias("key"), "node", F.col("place")[0].alias("bin"))
    while nodes > 1:
        sums = level.where(F.col("child").isNull()).select(F.col("node").alias("child"), F.col("place").alias("sums"))
        nodes = -(-nodes // fan_in)
        level = cut(_level(sums.select(F.pmod("child", F.lit(nodes)).alias("node"), "child", "sums"), k))
        up = level.where(F.col("child").isNotNull()).select(F.col("child").alias("node"), F.col("node").alias("above"), "place")
        found = found.join(up, "node").select("key", F.col("above").alias("node"), F.element_at("place", (F.col("bin") + 1).cast("int")).alias("bin"))
    return found.select("key", F.col("bin").cast("int").alias("shard"))


def shard(docs: DataFrame, k: int = SHARDS, fan_in: int = FAN_IN, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Per row of docs (doc_id, text): size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.when(F.col("text").isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2("text", 256)))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), key.alias("key"), F.monotonically_increasing_id().alias("rid")))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    # both sides are read from the shared folder, so a key that many rows share is a skewed join that AQE splits
    placed = rows.join(cut(partition(groups, k, fan_in)), "key")
    subs = max(1, -(-rows.count() // (k * slot_rows)))
    placed = cut(placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("rid"), F.lit(subs)).alias("sub")))
    before = W.partitionBy("shard").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "sub").count().select("shard", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = W.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32")
    numbered = placed.withColumn("at", F.row_number().over(own) - 1).join(offsets, ["shard", "sub"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
