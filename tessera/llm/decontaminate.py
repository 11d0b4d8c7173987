"""Benchmark decontamination by winnowing.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z were lower-cased. A
benchmark item is cut into windows of WINDOW consecutive words; an item of
fewer words is one window of its own length.

Fingerprints: of each text the hashes of its k-grams, and of every run of w
consecutive k-grams the least one (the rightmost of equals). With
k + w - 1 = WINDOW every shared span of WINDOW words holds one whole run in both
texts, so both keep the same fingerprint: no occurrence is missed. Items
shorter than WINDOW use k = their length and w = 1. Texts that share a
fingerprint with an item are hit candidates; their hits are extended and
confirmed on the words themselves, so a hash collision adds nothing.

The join of the two sides' fingerprints: while the benchmark's texts are below
`map_side_bytes` (their size is measured first) its fingerprints travel to the
tasks that read documents, and nothing is shuffled. Beyond that both sides'
fingerprints are joined by a shuffle, and candidates alone are confirmed.

Defined results: a null or empty text has no words and is not contaminated; an
item without words has no window; equal items each count; repeated document
rows each give a row; a null item_id counts as the string "null"; other columns
are ignored. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import ALNUM, Block, blocks, cut, gram_hashes, row_key, table

WINDOW = 10
GRAM = 6
#: Benchmarks of up to so many bytes of text travel to the tasks that read documents (in a worker they take about 75 times as much: 150 MB).
MAP_SIDE_BYTES = 2 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "replace").translate(_LOWER))


def windows_of(words: list[bytes]) -> list[bytes]:
    """An item's windows, as words joined by a space (no word holds one)."""
    if not words:
        return []
    n = min(WINDOW, len(words))
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def winnow(grams: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Places of the least gram of each run of w (the rightmost of equals). valid: whether a whole run starts there."""
    n = len(grams) - w + 1
    if n <= 0 or not valid[:n].any():
        return np.empty(0, dtype=np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        here = grams[j : j + n]
        less = here <= best
        np.copyto(best, here, where=less)
        at[less] = np.flatnonzero(less) + j
    keep = np.zeros(len(grams), dtype=bool)
    keep[at[valid[:n]]] = True
    return np.flatnonzero(keep)


def fingerprints(block: Block, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row of the block) of the fingerprints kept, for grams of k words and runs of w grams."""
    h = block.word_hashes()
    grams = gram_hashes(h, k)
    if not len(grams):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    rows = np.repeat(np.arange(len(block)), block.counts())
    last = block.first[1:][rows[: len(grams)]]
    at = winnow(grams, np.arange(len(grams)) + k + w - 1 <= last, w)
    # grams of different k never meet
    return grams[at] ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1), rows[at]


def shapes(lengths: set[int]) -> list[tuple[int, int]]:
    """(k, w) that cover windows of these lengths."""
    return sorted((GRAM, WINDOW - GRAM + 1) if n == WINDOW else (n, 1) for n in lengths)


class Benchmark:
    """A benchmark's windows and fingerprints, for confirming and for map-side candidates."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.windows: dict[bytes, set[str]] = defaultdict(set)
        lengths: set[int] = set()
        texts: dict[str, None] = {}
        for item, text in items:
            words = words_of(text)
            if words:
                lengths.add(min(WINDOW, len(words)))
                texts[text] = None
            for x in windows_of(words):
                self.windows[x].add("null" if item is None else str(item))
        self.windows = dict(self.windows)
        self.lengths, self.shapes = sorted(lengths), shapes(lengths)
        column = pa.array(list(texts), pa.large_string())
        found = [fingerprints(b, k, w)[0] for k, w in self.shapes for _, _, b in blocks(column, ALNUM)]
        self.prints = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)
        bits = max(16, int(len(self.prints) * 16).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[(self.prints & self.mask).astype(np.int64)] = True

    def candidates(self, block: Block) -> np.ndarray:
        """Rows of the block that share a fingerprint with the benchmark."""
        out = []
        for k, w in self.shapes:
            h, rows = fingerprints(block, k, w)
            maybe = np.flatnonzero(self.table[(h & self.mask).astype(np.int64)])
            out.append(rows[maybe[np.isin(h[maybe], self.prints)]])
        return np.unique(np.concatenate(out)) if out else np.empty(0, dtype=np.int64)

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items that occur: confirmed on the words."""
        hit, items = np.zeros(len(words), dtype=bool), set()
        for n in self.lengths:
            for i in range(len(words) - n + 1):
                if (found := self.windows.get(b" ".join(words[i : i + n]))) is not None:
                    hit[i : i + n] = True
                    items |= found
        return hit, items


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_NONE = hashlib.sha256(b"").hexdigest()


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _map_side(docs: DataFrame, items: list) -> DataFrame:
    bench = docs.sparkSession.sparkContext.broadcast(items)
    kept: list[Benchmark] = []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Benchmark(bench.value))
        own = kept[0]
        for batch in batches:
            for a, b, block in blocks(batch.column(1), ALNUM):
                n = b - a
                n_hit, n_items, sha = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), [_NONE] * n
                for i in own.candidates(block).tolist():
                    hit, found = own.hits(block.words(i))
                    n_hit[i], n_items[i], sha[i] = hit.sum(), len(found), digest(found)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(block.counts().astype(np.int64)), pa.array(n_hit), pa.array(n_items), pa.array(sha, pa.string()), pa.array(n_hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.mapInArrow(scan, f"doc_id {_id_type(docs)}, {_RESULT}")


def _prints_of(df: DataFrame, lengths: DataFrame | list[int]) -> DataFrame:
    """(key, fp): the fingerprints of each row of (key, text)."""
    made = shapes(set(lengths))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, block in blocks(batch.column(1), ALNUM):
                for k, w in made:
                    h, rows = fingerprints(block, k, w)
                    pairs = np.unique(np.stack([rows.astype(np.uint64), h]), axis=1) if len(h) else np.empty((2, 0), dtype=np.uint64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[0].astype(np.int64) + a)), pa.array(pairs[1].view(np.int64))], ["key", "fp"])

    return df.mapInArrow(scan, T.StructType([df.schema[0], T.StructField("fp", T.LongType())]))


def _shuffled(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The way for benchmarks of any size: fingerprints meet in a shuffle, candidates' texts are fetched and confirmed."""
    docs = docs.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    texts = docs.select("key", "text")
    items = benchmark.select(row_key("item_id", "text").alias("item"), "item_id", "text")

    def lengths_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in blocks(batch.column(0), ALNUM):
                n = np.unique(np.minimum(block.counts(), WINDOW))
                yield pa.RecordBatch.from_arrays([pa.array(n[n > 0].astype(np.int32))], ["n"])

    lengths = [r.n for r in benchmark.select("text").mapInArrow(lengths_of, "n int").distinct().collect()]  # WINDOW values at most
    pairs = _prints_of(texts, lengths).join(_prints_of(items.select("item", "text"), lengths).withColumnRenamed("key", "item"), "fp").select("key", "item").distinct()
    pairs = pairs.join(texts.dropDuplicates(["key"]).withColumnRenamed("text", "doc_text"), "key").join(items.dropDuplicates(["item"]), "item")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"key": [], "item": [], "places": []}
            for key, doc, item, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_text", "item_id", "text")), strict=True):
                hit, found = Benchmark([(item, text)]).hits(words_of(doc))
                if found:
                    for k, v in zip(rows, (key, *found, np.flatnonzero(hit).tolist()), strict=True):
                        rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("key", pa.string()), ("item", pa.string()), ("places", pa.list_(pa.int32()))]))

    hits = pairs.select("key", "doc_text", "item_id", "text").mapInArrow(confirm, "key string, item string, places array<int>")
    # one document's items and places: no more than its own words allow
    hits = hits.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, block in blocks(batch.column(1), ALNUM):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(block.counts().astype(np.int64))], ["doc_id", "key", "n_words"])

    counted = docs.mapInArrow(count, f"doc_id {_id_type(docs)}, key string, n_words long")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return counted.join(hits, "key", "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, map_side_bytes: int = MAP_SIDE_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text): words, hit words, items that occur, and whether it is contaminated."""
    docs = docs.select("doc_id", "text")
    benchmark = benchmark.select("item_id", "text")
    size = benchmark.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size <= map_side_bytes:
        return _map_side(docs, [tuple(r) for r in benchmark.collect()])
    return _shuffled(docs, cut(benchmark))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bn AS (SELECT item_id, w, least(10, len(w)) AS m FROM bw WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win
         FROM (SELECT item_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM bn)),
lens AS (SELECT DISTINCT m FROM bn),
dwin AS (SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
         FROM (SELECT rid, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM dw, lens WHERE len(w) >= m)),
hit AS (SELECT d.rid, d.i, d.m, b.item_id FROM dwin d JOIN bwin b ON d.m = b.m AND d.win = b.win),
places AS (SELECT rid, count(DISTINCT p) AS n_hit
           FROM (SELECT rid, unnest(generate_series(i, i + m - 1)) AS p FROM (SELECT DISTINCT rid, i, m FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT rid, coalesce(CAST(item_id AS VARCHAR), 'null') AS s FROM hit) GROUP BY rid)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN places USING (rid) LEFT JOIN its USING (rid)
"""
