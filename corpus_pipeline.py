"""The corpus pipeline: five stages over `documents`, each by one of the training-data operators.

quality rules -> language ID -> MinHash near-dedup -> benchmark decontamination -> SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The
first four return the rows of docs that stay, with all columns of docs, whatever
their names; the last returns a row of token counts for each.

A stage decides on rows known by a 128-bit key of their values, so that null or
repeated ids do no harm. What goes is taken off by an anti-join with the keys of
the rejected rows: while those are few (their number is counted first) they travel to the
tasks that read texts, and no text is shuffled; otherwise both sides are.
Repeated rows share their fate, but near-dedup leaves one of them. Empty tables
pass through. A stage leaves nothing in the shared folder but its rejected keys;
run() removes these, and each stage's input, once its output is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_id, near_dedup, quality_rules, sentencepiece_scan
from tessera.llm.common import free, row_key, scope, stash, table

#: Rejected keys up to this number (32 bytes each) travel to the tasks.
MAP_SIDE_KEYS = 1_000_000


def _keyed(docs: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """docs with a key of each row, and the key's name, which no column of docs has."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, row_key(*columns)), name


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= MAP_SIDE_KEYS else keys


def _without(docs: DataFrame, name: str, keys: DataFrame) -> DataFrame:
    """Rows of docs (with a key of that name) whose key isn't among keys (one column, stashed)."""
    return docs.join(_few(keys.toDF(name)), name, "left_anti").drop(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose histograms fit their language."""
    keyed, name = _keyed(docs, "doc_id", "text", "lang")
    with scope(spark) as kept:
        verdict = quality_rules.quality_rules(keyed.select(F.col(name).alias("doc_id"), "text", "lang"))
        gone = stash(verdict.where(~F.col("kept")).select("doc_id").distinct(), "gone")
        kept.append(gone)
    return _without(keyed, name, gone)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus knows, beyond doubt."""
    keyed, name = _keyed(docs, "doc_id", "text", "lang", "source")
    with scope(spark) as kept:
        verdict = language_id.identify(language_id.of_documents(keyed, F.col(name)))
        gone = stash(verdict.where(~F.col("kept")).select("id").distinct(), "gone")
        kept.append(gone)
    return _without(keyed, name, gone)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id."""
    gone, repeated = near_dedup.survivors(docs)
    keyed, name = _keyed(docs, "doc_id", "text")
    if not repeated.isEmpty():  # of equal rows one stays; only they are shuffled
        few = _few(repeated.toDF(name))
        keyed = keyed.join(few, name, "left_anti").unionByName(keyed.join(few, name, "left_semi").dropDuplicates([name]))
    return _without(keyed, name, gone)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    keyed, name = _keyed(docs, "doc_id", "text")
    with scope(spark) as kept:
        verdict = decontaminate.decontaminate(keyed.select(F.col(name).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
        gone = stash(verdict.where("contaminated").select("doc_id").distinct(), "gone")
        kept.append(gone)
    return _without(keyed, name, gone)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_chunks, id_digest and round_trip of each document."""
    return sentencepiece_scan.round_trip(docs, sentencepiece_scan.default_model())


STAGES = [("quality rules", quality), ("language ID", language), ("near-dedup", dedup), ("decontamination", clean), ("SentencePiece", tokens)]

#: Language models, near-duplicate groups and SentencePiece cannot be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scope(spark) as kept:
            docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(docs)
        if last is not None:
            free(last)
        last = docs
    return docs
