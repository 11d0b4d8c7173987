"""Token counts kept by deltas.

Totals of documents and tokens by source, language and tokenizer version are
sums of signed changes: an insert adds a document and its tokens, a delete takes
both away, a revision takes the old count and adds the new one. Sums are
additive, so a batch is first summed by its keys on the map side (one hot source
costs each task one row) and only those sums are stored.

A store is a folder of batches, `batch=<id>`. A batch is written beside it and
renamed, so it is there whole or not at all, and of two drivers that apply the
same one the first wins (where the file system renames atomically). A batch that
is there is never applied again, whatever it then holds; ids may come in any order.
`compact` sums all batches to `snapshot=<n>-<tag>`, which lists the ids of the batches
it holds; readers take the newest whole one and all batches that it doesn't list, so
compacting can be repeated, or die, without a count changing. Sums are kept as
they are: a delete may come before its insert, and a compaction between them.

Defined results: null source or language is a group of its own; a null text has
no tokens; repeated rows count each; a null count in a change counts as 0 tokens;
an unknown kind of change raises ValueError when it is applied; keys whose
documents have all gone are left out of the totals that are read, not of what is
stored; other columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, path_exists, remove_path, scratch_path, table

KEYS = ("source", "lang", "tokenizer")
_STORED = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

_loaded: dict[str, object] = {}


def vocabulary(name: str) -> str:
    """The place of a vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, data: bytes | None = None):
    """The byte-level BPE of a .tiktoken file (or of its bytes, known by its path); a worker makes it once."""
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        if data is None:
            with open(path, "rb") as f:
                data = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _loaded[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(docs: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Per row of docs (doc_id, source, lang, text): its token count under each version (name -> vocabulary file on the driver's machine)."""
    files = {}
    for p in versions.values():
        with open(p, "rb") as f:
            files[p] = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(files)  # about 1 MB each

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [encoder(p, sent.value[p]) for p in versions.values()]
        for batch in batches:
            n = np.zeros((len(versions), batch.num_rows), dtype=np.int64)
            for i, text in enumerate(batch.column(3)):
                if t := text.as_py():
                    for j, e in enumerate(encoders):
                        n[j, i] = len(e.encode_ordinary(t))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, n)], ["doc_id", "source", "lang", *versions])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(count, "doc_id long, source string, lang string, " + ", ".join(f"`{v}` long" for v in versions))


def deltas(changes: DataFrame) -> DataFrame:
    """changes (kind, source, lang, tokenizer, old_tokens, new_tokens) as signed sums by key."""
    kind = F.col("kind")
    known = F.when(kind.isin("insert", "delete", "revise"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null")))))
    sign = F.when(known == "insert", 1).when(known == "delete", -1).otherwise(0)
    new = F.when(kind == "delete", 0).otherwise(F.coalesce("new_tokens", F.lit(0)))
    old = F.when(kind == "insert", 0).otherwise(F.coalesce("old_tokens", F.lit(0)))
    return changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("n_docs"), F.sum(new - old).cast("long").alias("n_tokens"))


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, kind: str) -> list[str]:
        """Names of the whole batches or snapshots, in order of their numbers."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = [n for n in (s.getPath().getName() for s in fs.listStatus(top)) if n.startswith(f"{kind}=")]
        mark = "_SUCCESS" if kind == "batch" else "sums/_SUCCESS"
        whole = [n for n in names if path_exists(self.spark, f"{self.path}/{n}/{mark}")]
        return sorted(whole, key=lambda n: (int(n.partition("=")[2].partition("-")[0]), n))

    def _stored(self) -> tuple[str | None, set[int], list[int]]:
        """The newest snapshot, the ids it holds, and the ids of the batches beside it."""
        snapshot = next(reversed(self._names("snapshot")), None)
        held = {r.id for r in self.spark.read.schema("id long").parquet(f"{self.path}/{snapshot}/ids").collect()} if snapshot else set()
        return snapshot, held, [i for i in (int(n.partition("=")[2]) for n in self._names("batch")) if i not in held]

    def _rename(self, path: str, to: str) -> bool:
        """False if `to` is there already."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        fs, target = jvm.org.apache.hadoop.fs, jvm.org.apache.hadoop.fs.Path(to)
        none = gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.Path(path), target, none)
        except Exception:
            if path_exists(self.spark, f"{to}/_SUCCESS"):
                return False
            raise
        return True

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch; False if it was applied before."""
        _, held, beside = self._stored()
        if batch in held or batch in beside:
            return False
        to = f"{self.path}/batch={batch}"
        attempt = f"{self.path}/attempt={batch}-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(attempt)
        if path_exists(self.spark, to) and not path_exists(self.spark, f"{to}/_SUCCESS"):
            remove_path(self.spark, to)  # what a job left that died
        done = self._rename(attempt, to)
        if not done:
            remove_path(self.spark, attempt)
        return done

    def _sums(self) -> DataFrame:
        snapshot, _, beside = self._stored()
        paths = [f"{self.path}/{snapshot}/sums"] * (snapshot is not None) + [f"{self.path}/batch={i}" for i in beside]
        stored = self.spark.read.schema(_STORED).parquet(*paths) if paths else self.spark.createDataFrame([], _STORED)
        return stored.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of keys that have documents."""
        return self._sums().where(F.col("n_docs") != 0)

    def compact(self) -> None:
        """Sum all batches so far to one table, which lists their ids."""
        snapshot, held, beside = self._stored()
        if beside:
            last = int(snapshot.partition("=")[2].partition("-")[0]) if snapshot else 0
            to = f"{self.path}/snapshot={last + 1}-{uuid.uuid4().hex}"
            ids = sorted(held.union(beside))
            self.spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.parquet(f"{to}/ids")
            self._sums().where("n_docs <> 0 OR n_tokens <> 0").write.parquet(f"{to}/sums")  # its mark makes the snapshot whole


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in under one tokenizer; those labelled good move to another; those labelled bad are withdrawn; then batches are sent again."""
    versions = {"byte_bpe_50k": vocabulary("byte_bpe_50k.tiktoken"), "byte_bpe_multi_50k": vocabulary("byte_bpe_multi_50k.tiktoken")}
    first, second = versions
    counts = cut(count_tokens(table(spark, sf_dir, "documents"), versions))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = cut(counts.join(labels, "doc_id"))

    def change(rows: DataFrame, kind: str, tokenizer: str, old: str | None, new: str | None) -> DataFrame:
        n = lambda c: F.col(c) if c else F.lit(None).cast("long")
        return rows.select(F.lit(kind).alias("kind"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), n(old).alias("old_tokens"), n(new).alias("new_tokens"))

    good, bad = labelled.where("quality = 1"), labelled.where("quality = 0")
    rollup = Rollup(spark, scratch_path(spark, "rollup"))
    moved = change(good, "delete", first, first, None).unionByName(change(good, "insert", second, None, second))
    everything = change(counts, "insert", first, None, first)
    rollup.commit(1, everything)
    rollup.commit(2, moved)
    rollup.compact()
    rollup.commit(3, change(bad, "delete", first, first, None))
    rollup.commit(2, moved)
    rollup.commit(3, everything)
    return rollup.totals()
