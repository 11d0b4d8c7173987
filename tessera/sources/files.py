"""Files the engine reads and writes besides contract tables, and the run they belong to."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.timebase import clock_seconds
from tessera.sources.contracts import schema_of

#: The views of a run: name -> file; only files that exist become views.
VIEWS = {"detections": "detections.parquet", "tracks": "tracks.parquet", "features": "features.parquet", "events_pred": "events_pred.csv", "event_matches": "event_matches.csv"}
MATCHES = "kind string, pred_id string, gt_id string, confidence double, tiou double, t_peak_pred double, t_peak_gt double, dur_pred double, dur_gt double, n_pred double, n_gt double"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def register_run(spark: SparkSession, folder: str) -> list[str]:
    """Make a temporary view of each file of a run; the names of those that were there."""
    made = []
    for name, file in VIEWS.items():
        path = f"{folder.rstrip('/')}/{file}"
        if not exists(spark, path):
            continue
        df = spark.read.parquet(path) if file.endswith(".parquet") else spark.read.schema(schema_of(name) if name != "event_matches" else MATCHES).option("header", True).csv(path)
        df.createOrReplaceTempView(name)
        made.append(name)
    return made


def sql(spark: SparkSession, text: str, limit: int | None = None) -> DataFrame:
    """Any SQL over the views; the limit is part of the plan."""
    df = spark.sql(text)
    return df if limit is None else df.limit(limit)


def read_mot(spark: SparkSession, path: str, block_from_folder: bool = False) -> DataFrame:
    """Headerless box labels: corners and area; rows of confidence 0 go if any confidence is given. With block_from_folder each file's folder names its block."""
    df = spark.read.schema(schema_of("gt_boxes")).csv(path)
    if block_from_folder:
        df = df.withColumn("block_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
        df = df.withColumn("gid", F.concat_ws("_", "block_id", "id"))
    given = df.agg(F.count("conf").alias("n")).first().n > 0
    if given:
        df = df.where(F.col("conf") > 0)
    return df.withColumns({"x1": F.col("bb_left"), "y1": F.col("bb_top"), "x2": F.col("bb_left") + F.col("bb_width"), "y2": F.col("bb_top") + F.col("bb_height"), "area": F.col("bb_width") * F.col("bb_height")})


def frame_base(frames: DataFrame, expected: DataFrame | None, column: str = "frame") -> int:
    """Whether frame numbers start at 1 or 0: 1 if more of them less one are expected than of them as they are, and 1 if nothing is expected."""
    if expected is None:
        return 1
    f, e = frames.select(F.col(column).alias("f")).distinct(), expected.select(F.col(expected.columns[0]).alias("e")).distinct()
    one, zero = (f.join(e, F.col("f") - shift == F.col("e"), "left_semi").count() for shift in (1, 0))
    return int(one > zero)


def read_times(spark: SparkSession, path: str) -> DataFrame:
    """Times that people noted: comments go, lists are split at commas, numbering is stripped; (seconds) of what is a time."""
    lines = spark.read.text(path).select(F.explode(F.split(F.regexp_replace("value", "#.*$", ""), ",")).alias("t"))
    return lines.select(clock_seconds(F.regexp_replace("t", r"^\s*\d+[.)]\s+", "")).alias("seconds")).where(F.col("seconds").isNotNull())


def content_hash(content: Column, n_bytes: int | None = None) -> Column:
    """SHA-256 of a binary column, or of its first n_bytes."""
    return F.sha2(content if n_bytes is None else F.substring(content, 1, n_bytes), 256)


def probe_row(json_column: str) -> dict[str, Column]:
    """Width, height, codec, duration and frame rate ("a/b", 4 decimals) from a media probe's JSON."""
    get = lambda p: F.get_json_object(json_column, p)
    rate = F.split(get("$.streams[0].avg_frame_rate"), "/")
    a, b = F.get(rate, F.lit(0)).try_cast("double"), F.coalesce(F.get(rate, F.lit(1)).try_cast("double"), F.lit(1.0))
    return {"src_width": get("$.streams[0].width").cast("long"), "src_height": get("$.streams[0].height").cast("long"), "codec": get("$.streams[0].codec_name"), "duration_s": get("$.format.duration").cast("double"), "src_fps": F.round(F.try_divide(a, b), 4)}


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def frame_manifest(spark: SparkSession, n_frames: int, fps: float, folder: str, video_id: str, width: int = 1280, height: int = 720) -> DataFrame:
    i = F.col("id")
    return spark.range(n_frames).select(i.alias("frame_idx"), (i / F.lit(float(fps))).alias("timestamp_s"), F.concat(F.lit(folder.rstrip("/") + "/"), F.format_string("%06d.jpg", i)).alias("path"), F.lit(width).cast("long").alias("width"), F.lit(height).cast("long").alias("height"), F.lit(video_id).alias("video_id"))


def write_once(df: DataFrame, path: str, force: bool = False) -> None:
    """Write a CSV, but not over one that is there (its extra columns, added by hand, are named)."""
    spark = df.sparkSession
    if exists(spark, path) and not force:
        added = [c for c in spark.read.option("header", True).csv(path).columns if c not in df.columns]
        raise FileExistsError(f"{path} is there" + (f", with columns added by hand: {', '.join(added)}" if added else ""))
    df.write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def refuse(ids: DataFrame, held_out: list[str], column: str = "video_id") -> DataFrame:
    """ids, or PermissionError if a held-out one is among them."""
    bad = [r[0] for r in ids.where(F.col(column).isin(held_out)).select(column).distinct().collect()]
    if bad:
        raise PermissionError("held out: " + ", ".join(sorted(bad)))
    return ids


def metrics_json(df: DataFrame) -> list[dict[str, Any]]:
    """A small result as plain records for a JSON file."""
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, in whatever store the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(df: DataFrame, path: str) -> None:
    """A small result as one JSON file: a list of records."""
    write_text(df.sparkSession, path, json.dumps(metrics_json(df), indent=1))


def write_provenance(spark: SparkSession, output: str, stage: str, config: dict[str, Any], **extra: Any) -> str:
    """Put provenance() beside an output: its path with .provenance.json behind; returns that."""
    path = output.rstrip("/") + ".provenance.json"
    write_text(spark, path, provenance(stage, config, **extra))
    return path


def merge_json(texts: dict[str, str | None]) -> dict[str, Any]:
    """Named JSON documents as one; a missing one is {}."""
    return {k: json.loads(v) if v else {} for k, v in texts.items()}


def markdown(df: DataFrame, digits: int = 3) -> str:
    """A small result as a markdown table."""
    cell = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    lines = [df.columns, ["---"] * len(df.columns), *([cell(x) for x in r] for r in df.collect())]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def run_id(config: dict[str, Any], parts: tuple[str, ...] = ("video", "detect", "track", "features", "events")) -> str:
    """Eight hex digits of the configuration that a run depends on."""
    return hashlib.sha256(json.dumps({k: config.get(k) for k in parts}, sort_keys=True).encode()).hexdigest()[:8]


def provenance(stage: str, config: dict[str, Any], **extra: Any) -> str:
    """What a stage ran with, as JSON to keep beside its output."""
    return json.dumps({"stage": stage, "run_id": run_id(config), "utc": datetime.now(UTC).isoformat(timespec="seconds"), "config": config, **extra}, sort_keys=True, indent=1)


def run_folder(top: str, config: dict[str, Any]) -> str:
    return str(PurePosixPath(top) / f"run_{run_id(config)}")


def suffixed(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str], how: str = "inner") -> DataFrame:
    """A join in which only columns that both sides have get a suffix."""
    both = [c for c in left.columns if c in right.columns and c not in on]
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    return a.join(right.withColumnsRenamed({c: c + suffixes[1] for c in both}), on, how)


