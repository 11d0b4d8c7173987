"""Event streams: tumbling and sliding windows, sessions, and keyed state. Each builder takes an unbounded (or bounded) frame of events (ts, key columns)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import shared_dir

LATE = "1 day"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path, reader = f"{sf_dir}/events.parquet", spark.readStream.schema(schema)
    stream = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())


def tumbling(events: DataFrame, width: str = "30 minutes") -> DataFrame:
    g = events.withWatermark("at", LATE).groupBy(F.window("at", width), "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sliding(events: DataFrame, width: str = "3 hours", step: str = "30 minutes") -> DataFrame:
    g = events.withWatermark("at", LATE).groupBy(F.window("at", width, step), "event_type")
    return g.agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    g = events.withWatermark("at", LATE).groupBy(F.session_window("at", gap).alias("window"), "user_id")
    return g.agg(F.count("*").alias("n"))


def streaks(events: DataFrame, step_s: int = 6 * 3600) -> DataFrame:
    """Keyed state in the manner of a tracker: per user the events seen, the last time, and how many gaps over step_s; one row for each key and batch."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        n, last, gaps = state.get if state.exists else (0, None, 0)
        times = sorted(t for f in frames for t in f["s"])
        for t in times:
            gaps += last is not None and t - last > step_s
            n, last = n + 1, t if last is None else max(last, t)
        state.update((n, last, gaps))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_s": [last], "gaps": [int(gaps)]})

    d = events.select("user_id", F.floor(F.unix_micros("at") / 1000000).alias("s"))
    return d.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, last_s long, gaps long", "n long, last long, gaps long", "update", "NoTimeout")


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what there is now; its rows as a table of files in the shared folder. Rows never meet in the driver.

    In complete mode each batch replaces the one before; otherwise batches add up. State that a join, a session or a window keeps is on
    the executors' disks (RocksDB), unless the session names a provider.
    """
    spark = stream.sparkSession
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    last = [-1]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/batch={number}")
        last[0] = number

    provider = "spark.sql.streaming.stateStore.providerClass"
    own = provider in spark.conf.getAll
    if not own:
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream.writeStream.outputMode(mode).queryName(name).foreachBatch(write).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if not own:
            spark.conf.unset(provider)
    if last[0] < 0:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{where}/batch={last[0]}" if mode == "complete" else f"{where}/batch=*")
