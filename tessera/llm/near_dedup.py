"""Near-duplicate removal by SetSketch registers.

A document's set: the distinct shingles of SHINGLE words of its whole text (all its words, if they
are fewer). Documents with equal sets form a class; classes whose sets A, B have
100 |A and B| >= 75 |A or B| are linked; components of links are groups.

Registers: register i of a set is floor(1 - log_b x), x the least of its elements'
exponential variates under hash i, truncated to 16 bits: the register of a union is
the larger of two, and equal registers are about as likely as the sets are similar.

Search: BANDS bands of ROWS registers; classes that agree in a band share its
bucket (a pair of similarity 0.75 misses all 32 with a chance of 5e-6). Buckets are never expanded
into all pairs:

1. every member is compared with its bucket's leader (the least), once for all buckets of
   that leader;
2. members that these links don't connect with the leader (strays) are compared with the
   other members of all its buckets, in blocks of BLOCK x BLOCK rows, so that no group is
   torn and no task gets a whole bucket; pairs that are connected already are passed over.

Comparison: similarity is first estimated by maximum likelihood from both
register vectors and the exact set sizes; pairs within SIGMAS standard errors of
the threshold or above it are verified on the full sets (64-bit shingle hashes).

Components: large-star and small-star steps until nothing changes, each written
to a table that is read again and removed after the next. All of it is joins and grouped minima; what travels is ids, but for
the sets of classes that share a bucket, computed again from their texts.

Defined results: a text without words, or null, has an empty set and is linked with
nothing; rows with a null doc_id take part, but name no component and aren't
kept; repeated rows are copies of each other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import NONSPACE, Block, blocks, cut, free, gram_hashes, mix, scope, stash, table

SHINGLE = 5
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
BASE, RATE, LARGEST = 1.001, 20.0, 65_535
BLOCK = 192
SIGMAS = 5.0
#: Up to so many classes' row keys travel to the tasks that read texts (32 bytes each).
MAP_SIDE_KEYS = 1_000_000

_RNG = np.random.default_rng(7)
_HASHES = _RNG.integers(0, 2**64, REGISTERS, dtype=np.uint64) | np.uint64(1)
_FLOOR = 0.75 - SIGMAS * (0.75 * 0.25 / REGISTERS) ** 0.5


def sets_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, starts): the distinct shingles of each text, sorted; text i has starts[i] to starts[i + 1]."""
    h, counts = block.word_hashes(), block.counts()
    g = gram_hashes(h, SHINGLE)
    rows = np.repeat(np.arange(len(block)), counts)
    whole = np.arange(len(g)) + SHINGLE <= block.first[1:][rows[: len(g)]]
    values, owner = [g[whole]], [rows[: len(g)][whole]]
    for n in range(1, SHINGLE):
        at = np.flatnonzero(counts == n)
        if len(at):
            values.append(gram_hashes(h, n)[block.first[at]] ^ np.uint64(n))
            owner.append(at)
    v, o = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((v, o))
    v, o = v[order], o[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[new], o[new]
    return v, np.searchsorted(o, np.arange(len(block) + 1))


def registers_of(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SetSketch registers of non-empty sets: truncated logarithms of the least exponential variates."""
    out = np.empty((len(starts) - 1, REGISTERS), dtype=np.uint16)
    for i, a in enumerate(_HASHES):
        least = np.minimum.reduceat(values * a, starts[:-1]).astype(np.float64)
        x = -np.log1p(-(least + 0.5) / 2.0**64 * (1 - 2.0**-53)) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LARGEST)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def bands_of(registers: np.ndarray) -> np.ndarray:
    """A hash of each band's registers; bands never meet each other."""
    r = registers.astype(np.uint64).reshape(-1, BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), r.shape[:2]).copy()
    for j in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + r[:, :, j] + np.uint64(1))
    return out


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def estimate(larger: np.ndarray, smaller: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs, from how many registers of the first are larger or smaller and both sizes."""
    u = n / (n + m)
    v = 1 - u
    equal = REGISTERS - larger - smaller
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def value(j: np.ndarray) -> np.ndarray:
        a, b = np.maximum(_p(u - v * j), 1e-12), np.maximum(_p(v - u * j), 1e-12)
        return larger * np.log(a) + smaller * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))

    for _ in range(24):  # the logarithm of the likelihood is concave
        third = (high - low) / 3
        left = value(low + third) < value(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def pack(values: np.ndarray) -> bytes:
    """A set's hashes, sorted."""
    return np.sort(values).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _by_text(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, first row, rows, set starts, values, rows with a set, their registers)."""
    for batch in batches:
        for a, b, block in blocks(batch.column(column), NONSPACE):
            values, starts = sets_of(block)
            some = np.flatnonzero(np.diff(starts))
            registers = registers_of(values, np.append(starts[some], len(values))) if len(some) else np.empty((0, REGISTERS), dtype=np.uint16)
            yield batch, a, b - a, starts, values, some, registers


def _keys(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 128-bit key of each set, as two longs: sums over its elements."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values * np.uint64(c)), dtype=np.uint64)]) for c in (0xD6E8FEB86659FD93, 0xA5A5A5A5A5A5A5A5 | 1)]
    return np.stack([np.diff(s[starts]) for s in sums]).view(np.int64)


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, k1, k2, n, bands) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, n, starts, values, some, registers in _by_text(batches, 2):
            key, size = _keys(values, starts), np.diff(starts)
            per = np.zeros(n + 1, dtype=np.int32)
            per[1:][some] = BANDS
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(per, dtype=np.int32)), pa.array(bands_of(registers).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(key[0]), pa.array(key[1]), pa.array(size.astype(np.int64)), bands], ["doc_id", "row_key", "k1", "k2", "n", "bands"])

    return docs.mapInArrow(run, "doc_id long, row_key string, k1 long, k2 long, n long, bands array<long>")


def _payload(docs: DataFrame) -> DataFrame:
    """(k1, k2, registers, elements) of each row: what comparisons need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, starts, values, some, registers in _by_text(batches, 0):
            key = _keys(values, starts)[:, some]
            sets = [pack(values[starts[i] : starts[i + 1]]) for i in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(key[0]), pa.array(key[1]), pa.array([r.tobytes() for r in registers], pa.binary()), pa.array(sets, pa.binary())], ["k1", "k2", "registers", "elements"])

    return docs.select("text").mapInArrow(run, "k1 long, k2 long, registers binary, elements binary")


def _compare(table_: pa.Table) -> pa.Table:
    """Links of one block: its left rows against its right rows.

    A pair of strays is left and right in two blocks; it counts where the smaller id is left.
    """
    left, right = (table_.filter(pa.compute.equal(table_["side"], s)) for s in (0, 1))
    out: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        (li, lr, ls), (ri, rr, rs) = ((t["node"].to_numpy(), np.frombuffer(b"".join(t["registers"].to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS), t["elements"].to_pylist()) for t in (left, right))
        ln, rn = (np.array([len(x) // 8 for x in s]) for s in (ls, rs))
        stray, lroot, rroot = right["stray"].to_numpy(), left["root"].to_numpy(), right["root"].to_numpy()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = x = parent.get(y, y)
            return x

        # all pairs of the block at once: those that may reach the threshold
        equal = np.zeros((len(li), len(ri)), dtype=np.uint8)
        for k in range(REGISTERS):
            equal += lr[:, k, None] == rr[None, :, k]
        close = (equal >= REGISTERS * (_FLOOR - 0.1)) & (4 * np.minimum(ln[:, None], rn) >= 3 * np.maximum(ln[:, None], rn)) & (lroot[:, None] != rroot) & ~(stray & (ri < li[:, None]))
        i, j = np.nonzero(close)
        if len(i):
            more, less = (rr[j] < lr[i]).sum(axis=1), (rr[j] > lr[i]).sum(axis=1)
            likely = estimate(more, less, ln[i].astype(float), rn[j].astype(float))
            order = np.argsort(-likely, kind="stable")  # the surest first: what they connect needs no comparison any more
            order = order[likely[order] >= _FLOOR]
            i, j = i[order], j[order]
        whole: dict[int, np.ndarray] = {}
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = int(li[x]), int(ri[y])
            if root(int(lroot[x])) == root(int(rroot[y])):
                continue
            for k, s in ((a, ls[x]), (b, rs[y])):
                if k not in whole:
                    whole[k] = unpack(s)
            if similar(whole[a], whole[b]):
                parent[root(int(lroot[x]))] = root(int(rroot[y]))
                out.append((a, b))
    return pa.table({"u": pa.array([a for a, _ in out], pa.int64()), "v": pa.array([b for _, b in out], pa.int64())})


def _links(tasks: DataFrame, payload: DataFrame) -> DataFrame:
    """tasks (task, side, stray, node, root): the links (u, v) of each task's block; nodes of one root are connected already."""
    return stash(tasks.join(payload, "node").groupBy("task").applyInArrow(_compare, "u long, v long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(u, v) -> (node, root) of every linked node: large-star and small-star steps until the links are stars.

    Each step reads the table that the last one wrote, which then goes: neither plans nor files grow with the rounds."""
    e = stash(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "star")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stash(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        small = stash(star.where("u > v").distinct(), "star")
        free(e, large)
        e, now = small, tuple(small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    found = stash(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
    free(e)
    return found


def find_links(rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes with their node ids, links between nodes)."""
    classes = rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("least_id"), F.min("row_key").alias("row_key"), F.first("bands").alias("bands"))
    classes = stash(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # the numbers are written with the rows
    banded = classes.select("node", F.posexplode("bands").alias("band", "b"))
    buckets = cut(banded.groupBy("b").agg(F.count("*").alias("size"), F.min("node").alias("leader")).where("size > 1").select("b", "leader"))
    pairs = cut(banded.join(buckets, "b").where(F.col("node") != F.col("leader")).select("leader", "node").distinct())

    nodes = pairs.select("node").unionByName(pairs.select(F.col("leader").alias("node"))).distinct()
    wanted = cut(classes.select("node", "k1", "k2", "row_key").join(nodes, "node"))
    keys = wanted.select("row_key").distinct()
    few = wanted.count() <= MAP_SIDE_KEYS
    texts = docs.join(F.broadcast(keys) if few else keys, "row_key", "left_semi")
    payload = stash(_payload(texts).dropDuplicates(["k1", "k2"]).join(wanted.drop("row_key"), ["k1", "k2"]).select("node", "registers", "elements"), "sets")

    # first: members against leaders
    many = cut(pairs.groupBy("leader").agg(F.count("*").alias("members")))
    tasks = pairs.join(many, "leader").select(F.xxhash64("leader", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK))).alias("task"), "leader", "node")
    side = lambda n, stray: [F.lit(n).alias("side"), (F.lit(stray) if isinstance(stray, bool) else F.col(stray)).alias("stray")]
    left = tasks.select("task", *side(0, False), F.col("leader").alias("node"), F.col("leader").alias("root")).distinct()
    first = _links(left.unionByName(tasks.select("task", *side(1, False), "node", F.col("node").alias("root"))), payload)

    # second: strays against the other members of their leader; what links so far connect needs no comparison
    roots = components(first)
    of_leader = roots.select(F.col("node").alias("leader"), F.col("root").alias("leader_root"))
    rest = pairs.join(roots, "node", "left").join(of_leader, "leader", "left").withColumn("root", F.coalesce("root", "node"))
    rest = cut(rest.withColumn("stray", F.col("root") != F.coalesce("leader_root", "leader")).drop("leader_root"))
    strays = cut(rest.groupBy("leader").agg(F.count("*").alias("members"), F.count_if("stray").alias("strays")).where("strays > 0 AND members > 1"))
    rest = rest.join(strays, "leader").withColumns({"lefts": F.ceil(F.col("strays") / BLOCK), "rights": F.ceil(F.col("members") / BLOCK)})
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rest.where("stray").select("*", F.pmod(F.xxhash64("node"), F.col("lefts")).alias("l"), each("rights").alias("r")).select("leader", "l", "r", *side(0, "stray"), "node", "root")
    right = rest.select("*", each("lefts").alias("l"), F.pmod(F.xxhash64("node"), F.col("rights")).alias("r")).select("leader", "l", "r", *side(1, "stray"), "node", "root")
    tasks = left.unionByName(right).select(F.xxhash64("leader", "l", "r").alias("task"), "side", "stray", "node", "root")
    return classes, first.unionByName(_links(tasks, payload))


def row_key() -> Column:
    """A key of a row's id and text."""
    return common.row_key("doc_id", "text")


def near_dedup(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, row_key (a hash of id and text) and group (null for an empty set)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.col("text").cast("string").alias("text"))
    with scope(docs.sparkSession) as kept:
        rows = stash(_sketched(docs), "sketches")
        classes, links = find_links(rows, docs)
        of = cut(classes.select("k1", "k2", "node", "least_id").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")))
        least = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
        found = cut(of.join(least, "root").select("k1", "k2", "component_id", F.col("root").alias("group")))
        rows = cut(rows.drop("bands"))
        kept += [rows, found]
    own = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "row_key", F.lit(None).cast("long").alias("group"))
    all_rows = rows.where("n > 0").join(found, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "row_key", "group").unionByName(own)
    return all_rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "row_key", "group")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).drop("row_key", "group")


def survivors(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row keys of docs that go (distinct), and row keys that stay but stand for several equal rows: one document of each group stays, that of the least id."""
    with scope(docs.sparkSession) as kept:
        found = cut(near_dedup(docs).select("doc_id", "row_key", "group"))
        first = found.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row_key")).alias("first"))
        first = cut(first.select("group", F.col("first.row_key").alias("first")))
        rows = found.join(first, "group")
        gone = cut(rows.where("row_key <> first").select("row_key").distinct())
        repeated = cut(rows.where("row_key = first").groupBy("row_key").count().where("count > 1").select("row_key"))
        kept += [gone, repeated]
    return gone, repeated


SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT rid, sh FROM (
  SELECT rid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.rid < b.rid GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(rid, other) AS (SELECT rid, rid FROM w UNION SELECT r.rid, l.y FROM reach r JOIN links l ON r.other = l.x),
c AS (SELECT r.rid, min(o.doc_id) AS component_id FROM reach r JOIN w o ON o.rid = r.other GROUP BY r.rid)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, coalesce(w.doc_id = component_id, false) AS kept
FROM w LEFT JOIN n ON w.rid = n.rid JOIN c ON w.rid = c.rid
"""
