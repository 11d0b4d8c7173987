"""Frames and seconds, and times as people write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.boxes import Name, col


def frame_time(frame: Name, fps: float) -> Column:
    return col(frame) / F.lit(float(fps))


def time_frame(seconds: Name, fps: float) -> Column:
    """The nearest frame, halves to even."""
    return F.rint(col(seconds) * fps).cast("long")


def clock_seconds(text: Name) -> Column:
    """Seconds of h:mm:ss, m:ss or s; what follows the first blank and a trailing comma is dropped; null if it is no time."""
    t = F.regexp_replace(F.split_part(F.trim(col(text)), F.lit(" "), F.lit(1)), ",$", "")
    ok = t.rlike(r"^\d+(:\d+){0,2}(\.\d+)?$")
    parts = F.split(t, ":")
    return F.when(ok, F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p.try_cast("double")))


def seconds_clock(seconds: Name) -> Column:
    """hh:mm:ss.mmm"""
    s = col(seconds)
    return F.format_string("%02d:%02d:%06.3f", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
