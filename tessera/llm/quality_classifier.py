"""Quality classifier: hierarchical empirical Bayes.

Evidence of a document: a logistic regression on FEATURES of its text, fitted on at most
`train_rows` labelled documents (those with the smallest hash of their id: the
one sample here, bounded whatever the input's size). One feature is the mean log odds of the text's
words and word pairs, hashed to GRAMS buckets, from their counts in the sample's good and bad documents (naive
Bayes); while the regression is fitted, each half of the sample gets those of the other
half. The regression's log odds less those of the sample's base rate are the document's Bayes factor.

Priors come from all documents. With p = the label where there is one, else the
classifier's probability, sums of p and p squared by (host, path) give

    global mean m
    host mean   (k_host m + sum p of the host) / (k_host + n)
    path mean   (k_path host mean + sum p of the path) / (k_path + n)

so that sparse sites shrink towards their host, and sparse hosts towards all. A strength k is the variance
within sites over that between them, both from the same grouped sums by unbiased moments: within,
pooled over all sites with a divisor of n - 1 each; between, the squared deviations of
group means, weighted by n, less what sampling explains of them. A document's own p is
left out of its path's and host's sums. Posterior log odds = Bayes factor + log
odds of its path mean; `kept` if they are at least 0.

Texts are read once to measure them, those of the sample twice. Everything after it works on checkpointed rows of a few
numbers. Hot hosts: sums are pre-aggregated on the map side, and the table of one
row a (host, path) is checkpointed before it is joined, so that AQE can split a skewed join.

Defined results: null texts count as empty; null hosts and paths are groups of their own;
a document with labels 0 and 1 has the lower; with no labels (or of one kind only)
the evidence is 0 and the base rate 1/2; labels of unknown documents do nothing;
repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import NONSPACE, Block, cut, mix, table, text_buffers

TRAIN_ROWS = 20_000
SURFACE = ("log_words", "word_bytes", "upper", "symbol", "bar", "mark", "digit", "high", "line", "distinct", "distinct_pairs")
FEATURES = (*SURFACE, "grams")
GRAMS = 1 << 14
#: A strength's bounds: of a prior that says nearly nothing, and of groups that don't differ.
WEAKEST, STRONGEST = 0.01, 1e6
_BLOCK = 1 << 20

# byte classes: 0 other, 1 upper, 2 symbol, 3 bar, 4 mark, 5 digit, 6 non-ASCII, 7 line end
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91] = 1
_CLASS[list(b"#*$%&<>@^_~=+/\\{}[]")] = 2
_CLASS[ord("|")] = 3
_CLASS[list(b".,;:!?'\"()-")] = 4
_CLASS[48:58] = 5
_CLASS[128:] = 6
_CLASS[10] = 7


def _distinct(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each row."""
    if not len(values):
        return np.zeros(n)
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=n).astype(float)


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, Block]]:
    """(bytes, offsets, words) of runs of texts."""
    data, offsets = text_buffers(column)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + _BLOCK, side="right")) - 1))
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        yield part, at, Block(part, at, NONSPACE)
        a = b


def _words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, rows) of words and of pairs of words."""
    h, rows = block.word_hashes(), np.repeat(np.arange(len(block)), block.counts())
    inner = rows[1:] == rows[:-1] if len(rows) > 1 else np.zeros(0, dtype=bool)
    pairs = mix(h[:-1] * np.uint64(3) + h[1:])[inner] if len(h) > 1 else h[:0]
    return h, rows, pairs, rows[1:][inner] if len(h) > 1 else rows[:0]


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - GRAMS.bit_length() + 1)).astype(np.int64)


def features_of(column: pa.Array, odds: list[np.ndarray]) -> np.ndarray:
    """A row for each text: of SURFACE, and of the means of these log odds by bucket."""
    out = []
    for part, at, block in _blocks(column):
        n = len(block)
        words, size = block.counts().astype(float), np.diff(at).astype(float)
        cls = _CLASS[part]
        share = []
        for c in range(1, 8):
            sums = np.concatenate([[0], np.cumsum(cls == c)])
            share.append(np.diff(sums[at]) / np.maximum(size, 1))
        h, rows, pairs, pair_rows = _words(block)
        distinct = _distinct(h, rows, n) / np.maximum(words, 1)
        distinct_pairs = _distinct(pairs, pair_rows, n) / np.maximum(words - 1, 1)
        spans = np.bincount(rows, weights=block.end - block.start, minlength=n)
        bucket, owner = np.concatenate([_buckets(h), _buckets(pairs)]), np.concatenate([rows, pair_rows])
        grams = [np.bincount(owner, weights=x[bucket], minlength=n) / np.maximum(2 * words - 1, 1) for x in odds]
        out.append(np.column_stack([np.log1p(words), np.minimum(spans / np.maximum(words, 1), 50) / 10, *share, distinct, distinct_pairs, *grams]))
    return np.concatenate(out) if out else np.zeros((0, len(SURFACE) + len(odds)))


def gram_odds(sample: DataFrame) -> list[np.ndarray]:
    """Log odds of the buckets in good against bad documents of sample (text, y, half): of half 0, of half 1, of both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, GRAMS))
        for batch in batches:
            kind, a = (batch.column(1).to_numpy() + 2 * batch.column(2).to_numpy()).astype(np.int64), 0
            for _, _, block in _blocks(batch.column(0)):
                h, rows, pairs, pair_rows = _words(block)
                own = kind[a : a + len(block)]
                for k in np.unique(own).tolist():
                    sums[k] += np.bincount(_buckets(h[own[rows] == k]), minlength=GRAMS) + np.bincount(_buckets(pairs[own[pair_rows] == k]), minlength=GRAMS)
                a += len(block)
        k, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[k, bucket])], ["k", "bucket", "n"])

    found = sample.select("text", F.col("y").cast("int").alias("y"), "half").mapInArrow(count, "k int, bucket int, n double").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()  # 4 GRAMS rows at most
    sums = np.zeros((4, GRAMS))
    sums[found["k"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    share = lambda x: np.log((x + 1) / (x.sum() + GRAMS))
    return [share(good) - share(bad) for good, bad in ((sums[1], sums[0]), (sums[3], sums[2]), (sums[1] + sums[3], sums[0] + sums[2]))]


class Logistic:
    """Logistic regression on standardised features and their squares, by Newton's method with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.base = float(y.mean()) if len(y) else 0.5
        self.mean, self.sd = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(y) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
        self.w = np.zeros(2 * len(FEATURES) + 1)
        if not 0 < self.base < 1:
            self.base = 0.5
            return
        d = self._design(x)
        penalty = np.full(d.shape[1], ridge)
        penalty[0] = 0
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(d @ self.w, -30, 30)))
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag(penalty + 1e-9), d.T @ (y - p) - penalty * self.w)
            self.w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        return np.column_stack([np.ones(len(z)), z, z * z])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.w, -12, 12) if np.any(self.w) else np.zeros(len(x))


def strengths(paths: DataFrame) -> tuple[float, float, float]:
    """(mean, k_host, k_path) from (host, path, ps, pn, pq): sums of p, of rows and of p squared by site."""
    hosts = paths.groupBy("host").agg(F.sum("ps").alias("hs"), F.sum("pn").alias("hn"), F.sum(F.col("pn") * F.col("pn")).alias("hnn"))
    h = hosts.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n"), F.count("*").alias("groups"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("ss"), F.sum(F.col("hn") * F.col("hn")).alias("nn"), F.sum(F.col("hnn") / F.col("hn")).alias("inner")).first()
    p = paths.agg(F.count("*").alias("groups"), F.sum(F.col("ps") * F.col("ps") / F.col("pn")).alias("ss"), F.sum("pq").alias("q")).first()
    if not h.n:
        return 0.5, 1.0, 1.0
    mean = h.s / h.n
    free = h.n - p.groups
    within = max((p.q - p.ss) / free if free > 0 else mean * (1 - mean), 1e-9)

    def strength(deviation: float, groups: int, rows: float) -> float:
        """From the weighted squared deviations of group means, which are groups * within + rows * between on average."""
        between = (deviation - groups * within) / rows if rows > 0 else 0.0
        return float(np.clip(within / max(between, 1e-12), WEAKEST, STRONGEST))

    k_path = strength(p.ss - h.ss, p.groups - h.groups, h.n - h.inner)
    # hosts differ beyond what their sites do: these add to the spread of host means as well
    sites = within / k_path if k_path < STRONGEST else 0.0
    deviation = h.ss - h.s * h.s / h.n - sites * (h.inner - (h.nn and paths.agg(F.sum(F.col("pn") * F.col("pn")).alias("x")).first().x / h.n))
    return float(np.clip(mean, 1e-3, 1 - 1e-3)), strength(deviation, h.groups - 1, h.n - h.nn / h.n), k_path


def classify(docs: DataFrame, labels: DataFrame, host: str | Column = "source", path: str | Column = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row of docs (doc_id, text, host, path): doc_id, evidence, prior, quality (posterior probability) and kept. labels: (doc_id, quality)."""
    as_text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("+"), as_text(host)), F.lit("-")).alias("host"), F.coalesce(F.concat(F.lit("+"), as_text(path)), F.lit("-")).alias("path"), F.col("text").cast("string").alias("text"))
    known = cut(labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("y")))
    rank = F.xxhash64("doc_id")
    few = F.pmod(rank, F.lit(1 << 32)) < int(min(1.0, 2 * train_rows / max(known.count(), 1)) * (1 << 32))  # so that tasks send few rows
    chosen = cut(known.where(few).orderBy(rank, "doc_id").limit(train_rows).withColumn("half", F.pmod(F.shiftright(rank, 40), F.lit(2)).cast("int")))  # train_rows at most
    odds = gram_odds(rows.join(F.broadcast(chosen), "doc_id"))
    sent = docs.sparkSession.sparkContext.broadcast(odds)
    width = len(SURFACE) + len(odds)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features_of(batch.column(3), sent.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["doc_id", "host", "path", "x"])

    rows = cut(rows.mapInArrow(measure, "doc_id long, host string, path string, x array<double>"))
    sample = rows.join(F.broadcast(chosen), "doc_id").orderBy(rank, "doc_id", "host", "path").select("x", "y", "half").limit(train_rows).collect()
    x = np.array([r.x for r in sample]).reshape(-1, width)
    other = np.array([1 - r.half for r in sample], dtype=int)
    m = len(SURFACE)
    fit = Logistic(np.column_stack([x[:, :m], x[np.arange(len(x)), m + other]]), np.array([r.y for r in sample]))

    # the fitted model as an expression, so that the rows stay in the JVM
    value = [F.col("x")[i] for i in range(m)] + [F.col("x")[m + 2]]
    z = [F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (v - float(fit.mean[i])) / float(fit.sd[i]))) for i, v in enumerate(value)]
    odds = sum((z[i] * float(fit.w[1 + i]) + z[i] * z[i] * float(fit.w[1 + len(z) + i]) for i in range(len(z))), F.lit(float(fit.w[0])))
    odds = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), odds))
    # a null doc_id has no label, so it needs no partner
    judged = rows.select("doc_id", "host", "path", odds.alias("odds"))
    with_id = judged.where("doc_id IS NOT NULL").join(known, "doc_id", "left")
    rows = cut(with_id.unionByName(judged.where("doc_id IS NULL").withColumn("y", F.lit(None).cast("double"))))
    p = F.coalesce("y", 1 / (1 + F.exp(-F.col("odds"))))
    rows = rows.withColumns({"p": p, "e": F.col("odds") - float(np.log(fit.base / (1 - fit.base)))})

    paths = cut(rows.groupBy("host", "path").agg(F.sum("p").alias("ps"), F.count("*").alias("pn"), F.sum(F.col("p") * F.col("p")).alias("pq")))
    mean, k_host, k_path = strengths(paths)
    hosts = paths.groupBy("host").agg(F.sum("ps").alias("hs"), F.sum("pn").alias("hn"))
    sites = cut(paths.join(hosts, "host"))
    d = rows.join(sites, ["host", "path"])
    host_mean = (k_host * mean + F.col("hs") - F.col("p")) / (k_host + F.col("hn") - 1)
    prior = (k_path * host_mean + F.col("ps") - F.col("p")) / (k_path + F.col("pn") - 1)
    prior = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), prior))
    d = d.withColumn("prior", prior).withColumn("post", F.col("e") + F.log(F.col("prior") / (1 - F.col("prior"))))
    return d.select("doc_id", F.round("e", 4).alias("evidence"), F.round("prior", 4).alias("prior"), F.round(1 / (1 + F.exp(-F.col("post"))), 6).alias("quality"), (F.col("post") >= 0).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
