"""Language identification by Bayesian evidence fusion.

log P(z | row) = text + declaration + suffix + log P(z | host) + constant, over
the languages z and one more class, "und", for text that fits none:

- text: log likelihoods of byte trigrams, hashed to BUCKETS. The models are counted from
  all rows that declare a language (grouped sums, smoothed); "und" is uniform.
  Trigrams overlap and depend on each other, so at most EFFECTIVE of them count: the mean
  log likelihood is taken so many times, or as often as there are trigrams.
- declaration and suffix: P(declared | z) and P(suffix | z), from sums of the
  text posteriors over all rows, smoothed. A row without one has no such evidence.
- host: sums of text posteriors by host, smoothed towards those of its suffix,
  and these towards those of all rows (HOST_ROWS and SUFFIX_ROWS pseudo-rows). A row's own
  posterior is taken out of its host's sums, so that nothing counts twice.

One pass over the texts counts the models, a second scores them; all that
follows works on a checkpointed row of a few numbers each. A table of one row a
host is joined with them; it is checkpointed too, so that a host with a third of
all rows makes a skewed join that AQE splits. Models are BUCKETS numbers for each language
that MIN_DECLARED rows declare, however many these are; texts are scored in blocks of MAX_LANGUAGES of them.

Verdict (`kept`): the language is not "und" and its posterior is at least
MIN_CONFIDENCE. Defined results: a row without text (null, or under 3 bytes) has
only its other evidence, and isn't kept; a null host is a host of its own; with no
language declared on MIN_DECLARED rows everything is "und"; repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, cut, table, text_buffers

BUCKETS = 1 << 14
MAX_LANGUAGES = 64
MIN_DECLARED = 5
EFFECTIVE = 60
HOST_ROWS = 20.0
SUFFIX_ROWS = 50.0
MIN_CONFIDENCE = 0.5
UNKNOWN = "und"

_BLOCK = 1 << 19
_INPUT = ("id", "text", "declared", "host", "suffix")


def _trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, buckets of the trigrams, for each row where its trigrams start, with the end)."""
    data, offsets = text_buffers(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + _BLOCK, side="right")) - 1))
        low = LOWER[data[offsets[a] : offsets[b]]].astype(np.uint32)
        at = offsets[a : b + 1] - offsets[a]
        if len(low) >= 3:
            h = (low[:-2] * np.uint32(65599 * 65599 & 0xFFFFFFFF) + low[1:-1] * np.uint32(65599) + low[2:]) * np.uint32(2654435761)
            keep = np.ones(len(h), dtype=bool)
            ends = at[1:][at[1:] < len(low)]
            for back in (1, 2):  # trigrams over a text's end
                over = ends - back
                keep[over[over < len(h)]] = False
                keep[over[over < 0]] = True
            counted = np.concatenate([[0], np.cumsum(keep)])
            yield a, b, (h >> np.uint32(18))[keep].astype(np.int64), counted[np.minimum(at, len(h))]
        else:
            yield a, b, np.empty(0, dtype=np.int64), np.zeros(b - a + 1, dtype=np.int64)
        a = b


def train(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Log probabilities of the buckets under each language and, last, under none: counted over all rows that declare one of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(languages)}
        sums: dict[int, np.ndarray] = {}  # of the languages that occur here
        for batch in batches:
            z = np.array([place.get(x, -1) for x in batch.column(1).to_pylist()], dtype=np.int64)
            for a, b, buckets, starts in _trigrams(batch.column(0)):
                owner = np.repeat(z[a:b], np.diff(starts))
                for i in np.unique(z[a:b]).tolist():
                    if i >= 0:
                        sums[i] = sums.get(i, 0) + np.bincount(buckets[owner == i], minlength=BUCKETS)
        for i, n in sums.items():
            bucket = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), i, dtype=np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n[bucket].astype(np.int64))], ["z", "bucket", "n"])

    found = rows.where(F.col("declared").isin(languages)).select("text", "declared").mapInArrow(count, "z int, bucket int, n long").groupBy("z", "bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows a language at most
    sums = np.zeros((len(languages) + 1, BUCKETS))
    sums[found["z"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    sums[:-1] += 0.5
    sums[-1] = 1.0
    return np.log(sums / sums.sum(axis=1, keepdims=True))


def _score(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """(id, declared, host, suffix, n, text): n trigrams, and the text's log evidence for each class."""
    sent = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = sent.value
        for batch in batches:
            out, counts = np.zeros((batch.num_rows, tab.shape[1])), np.zeros(batch.num_rows, dtype=np.int64)
            for a, b, buckets, starts in _trigrams(batch.column(1)):
                n = np.diff(starts)
                some = np.flatnonzero(n)
                if len(some):
                    for z in range(0, tab.shape[1], MAX_LANGUAGES + 1):
                        sums = np.add.reduceat(tab[buckets, z : z + MAX_LANGUAGES + 1], starts[:-1][some], axis=0)
                        out[a + some, z : z + MAX_LANGUAGES + 1] = sums * (np.minimum(n[some], EFFECTIVE) / n[some])[:, None]
                counts[a:b] = n
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tab.shape[1], dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.select(["id", "declared", "host", "suffix"]).columns, pa.array(counts), lists], ["id", "declared", "host", "suffix", "n", "text"])

    ddl = f"id {rows.schema['id'].dataType.simpleString()}, declared string, host string, suffix string, n long, text array<double>"
    return rows.select(*_INPUT).mapInArrow(score, ddl)


def _softmax(x: str) -> Column:
    e = f"transform({x}, v -> exp(v - array_max({x})))"
    return F.expr(f"transform({e}, v -> v / aggregate({e}, 0D, (a, b) -> a + b))")


def _sums(rows: DataFrame, by: list[Column | str], k: int, name: str) -> DataFrame:
    """Sums of the posteriors p, by class, as an array of k; beyond one block of languages a class is a row meanwhile."""
    if k <= MAX_LANGUAGES + 1:
        return rows.groupBy(*by).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(k)]).alias(name))
    each = rows.select(*by, F.posexplode("p").alias("z", "v"))
    names = each.columns[:-2]
    each = each.groupBy(*names, "z").agg(F.sum("v").alias("v"))
    return each.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("z", "v"))).alias("zv")).select(*names, F.col("zv.v").alias(name))


def identify(rows: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(id, text, declared, host, suffix) -> (id, language, confidence, kept)."""
    rows = rows.select("id", *[F.col(c).cast("string").alias(c) for c in _INPUT[1:]])
    counted = rows.where(F.col("declared").isNotNull()).groupBy("declared").count().where(F.col("count") >= MIN_DECLARED)
    languages = sorted(r.declared for r in counted.collect())
    k = len(languages) + 1
    classes = [*languages, UNKNOWN]
    scored = cut(_score(rows, train(rows, languages) if languages else np.zeros((1, BUCKETS))))
    # posteriors by the text alone; a row without text says nothing
    scored = scored.withColumn("p", F.when(F.col("n") > 0, _softmax("text")).otherwise(F.expr(f"array_repeat(0D, {k})")))
    total = _sums(scored, [], k, "s").first()
    every = [x or 0.0 for x in total.s] if total else [0.0] * k
    prior = F.array(*[F.lit((x + 1.0) / (sum(every) + k)) for x in every])

    def evidence(name: str, prefix: str) -> DataFrame:
        """log P(value | z) for each value of a column."""
        by = _sums(scored.where(F.col(name).isNotNull()), [name], k, "s")
        totals = F.array(*[F.lit(x + 1.0) for x in every])
        return by.select(name, F.zip_with("s", totals, lambda a, b: F.log((a + 0.5) / b)).alias(prefix))

    declared, suffix = evidence("declared", "by_declared"), evidence("suffix", "by_suffix")
    # hierarchy: all rows, suffix, host
    of_suffix = _sums(scored.where(F.col("suffix").isNotNull()), ["suffix"], k, "ss")
    own = F.coalesce("host", F.lit("\x00"))
    hosts = _sums(scored, [own.alias("h"), "suffix"], k, "hs").join(of_suffix, "suffix", "left")
    total = "aggregate({0}, 0D, (a, b) -> a + b)".format
    smoothed = F.expr(f"zip_with(ss, prior, (s, g) -> (s + {SUFFIX_ROWS}D * g) / ({total('ss')} + {SUFFIX_ROWS}D))")
    hosts = hosts.withColumn("prior", prior).withColumn("sp", F.coalesce(smoothed, F.col("prior")))
    hosts = cut(hosts.select("h", F.coalesce("suffix", F.lit("\x00")).alias("s"), "hs", "sp"))
    d = scored.withColumns({"h": own, "s": F.coalesce("suffix", F.lit("\x00"))}).join(hosts, ["h", "s"]).join(declared, "declared", "left").join(suffix, "suffix", "left")
    host = F.expr(f"transform(zip_with(zip_with(hs, p, (a, b) -> greatest(a - b, 0D)), sp, (a, g) -> a + {HOST_ROWS}D * g), x -> ln(x))")
    add = lambda a, b: F.expr(f"zip_with({a}, coalesce({b}, array_repeat(0D, {k})), (x, y) -> x + y)")
    d = d.withColumn("e", host).withColumn("e", add("e", "text")).withColumn("e", add("e", "by_declared")).withColumn("e", add("e", "by_suffix")).withColumn("q", _softmax("e"))
    best = F.array_position("q", F.array_max("q")).cast("int")
    names = F.array(*map(F.lit, classes))
    d = d.select("id", F.element_at(names, best).alias("language"), F.array_max("q").alias("confidence"), "n")
    return d.select("id", "language", F.round("confidence", 6).alias("confidence"), ((F.col("n") > 0) & (F.col("language") != UNKNOWN) & (F.col("confidence") >= min_confidence)).alias("kept"))


def of_documents(docs: DataFrame, id_column: Column | None = None) -> DataFrame:
    """Documents as rows to identify: their source is the host, their language label the declaration."""
    return docs.select((F.col("doc_id").cast("long") if id_column is None else id_column).alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Web pages as rows to identify: text without markup, the html element's lang, and host and suffix of the address."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    declared = F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    return pages.select(F.col("page_id").cast("long").alias("id"), text.alias("text"), declared.alias("declared"), host.alias("host"), F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit("")).alias("suffix"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(of_documents(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(of_pages(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")
