"""Joins on time: intervals, ranges, nearness.

Spark plans a pure range condition as a nested loop. Here both sides get the
time buckets they touch and meet on them, so the join is hashed or sort-merged and
scales with the matches; a pair that shares several buckets counts in its first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_B = "__bucket"
#: So many rows at most of equal times meet the other side as one.
PIECE = 128


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def points_in_intervals(intervals: DataFrame, points: DataFrame, start: str, end: str, at: str, width: float, by: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Rows of intervals with the points in them (ends included). by: columns that both share and that must agree."""
    by = by or []
    left = intervals.where(F.col(start) <= F.col(end)) if how == "inner" else intervals
    left = left.withColumn(_B, _buckets(F.col(start), F.greatest(F.col(start), F.col(end)), width))
    right = points.withColumn(_B, F.floor(F.col(at) / width))
    return left.join(right, [*by, _B], how).where(F.col(at).between(F.col(start), F.col(end))).drop(_B)


def points_outside(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Points in no interval."""
    by = by or []
    left = points.withColumn(_B, F.floor(F.col(at) / width))
    right = intervals.select(*by, F.col(start).alias("__s"), F.col(end).alias("__e"), _buckets(F.col(start), F.greatest(F.col(start), F.col(end)), width).alias("__b2"))
    on = [left[c] == right[c] for c in by] + [left[_B] == right["__b2"], left[at].between(right["__s"], right["__e"])]
    return left.join(right, on, "left_anti").drop(_B)


def points_near(points: DataFrame, centres: DataFrame, at: str, centre: str, pad: float, by: list[str] | None = None) -> DataFrame:
    """Points within pad of any centre."""
    by = by or []
    left = points.withColumn(_B, F.floor(F.col(at) / pad))
    right = centres.select(*by, F.col(centre).alias("__c"), F.explode(F.sequence(F.floor((F.col(centre) - pad) / pad), F.floor((F.col(centre) + pad) / pad))).alias("__b2"))
    on = [left[c] == right[c] for c in by] + [left[_B] == right["__b2"], F.abs(left[at] - right["__c"]) <= pad]
    return left.join(right, on, "left_semi").drop(_B)


def overlapping(a: DataFrame, b: DataFrame, a_ends: tuple[str, str], b_ends: tuple[str, str], width: float, by: list[str] | None = None) -> DataFrame:
    """Pairs of intervals that share more than a point. Column names of both sides must differ but for `by`."""
    by = by or []
    left = a.withColumn(_B, _buckets(F.col(a_ends[0]), F.greatest(F.col(a_ends[0]), F.col(a_ends[1])), width))
    right = b.withColumn(_B, _buckets(F.col(b_ends[0]), F.greatest(F.col(b_ends[0]), F.col(b_ends[1])), width))
    first = F.floor(F.greatest(F.col(a_ends[0]), F.col(b_ends[0])) / width)
    meet = F.least(F.col(a_ends[1]), F.col(b_ends[1])) > F.greatest(F.col(a_ends[0]), F.col(b_ends[0]))
    return left.join(right, [*by, _B]).where(meet & (F.col(_B) == first)).drop(_B)


def _pieces(d: DataFrame, keys: list[str], rest: str) -> DataFrame:
    """(keys, rest): rows of equal keys as arrays of their other columns (one at least), PIECE rows at most each."""
    others = [c for c in d.columns if c not in keys]
    # in a whole order, so that a task that runs again makes the same pieces
    d = d.withColumn("__piece", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(*others)) - 1) / PIECE))
    return d.groupBy(*keys, "__piece").agg(F.collect_list(F.struct(*others)).alias(rest)).drop("__piece")


def _dealt(d: DataFrame, keys: list[str]) -> DataFrame:
    """d by keys in all shuffle partitions: few rows here make many pairs, which must not gather in few tasks."""
    return d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _unfolded(d: DataFrame, *sides: tuple[str, DataFrame, list[str]]) -> DataFrame:
    """d with the rows that its arrays hold; sides: (the array, the rows it was made of, their keys)."""
    for rest, made_of, keys in sides:
        others = [c for c in made_of.columns if c not in keys]
        kept = [c for c in d.columns if c != rest]
        # one column goes as an array of its own, which is read faster than one of structs
        d = d.select(*kept, F.explode(F.col(rest)[others[0]]).alias(others[0]) if len(others) == 1 else F.inline(rest))
    return d


def every_point_in_intervals(intervals: DataFrame, points: DataFrame, start: str, end: str, at: str, width: float, by: list[str], **more: Column) -> DataFrame:
    """points_in_intervals() where pairs outnumber the rows by far: rows of equal times meet as one and are unfolded after, so a pair costs no comparison.

    more: columns made of times alone, worked out once for all pairs of equal times.
    """
    spans, times = [*by, start, end], [*by, at]
    left = _pieces(intervals.where(F.col(start) <= F.col(end)), spans, "__left").withColumn(_B, _buckets(F.col(start), F.col(end), width))
    right = _pieces(points, times, "__right").withColumn(_B, F.floor(F.col(at) / width))
    d = _dealt(left, [*by, _B]).join(_dealt(right, [*by, _B]), [*by, _B]).where(F.col(at).between(F.col(start), F.col(end)))
    d = d.select(*by, start, end, at, *[c.alias(n) for n, c in more.items()], "__left", "__right")
    return _unfolded(d, ("__left", intervals, spans), ("__right", points, times))


def every_overlapping(a: DataFrame, b: DataFrame, a_ends: tuple[str, str], b_ends: tuple[str, str], width: float, by: list[str], **more: Column) -> DataFrame:
    """overlapping() where pairs outnumber the rows by far: intervals of equal ends meet as one and are unfolded after.

    more: columns made of both sides' ends alone, worked out once for all pairs of equal ends.
    """
    of_a, of_b = [*by, *a_ends], [*by, *b_ends]
    left = _pieces(a, of_a, "__left").withColumn(_B, _buckets(F.col(a_ends[0]), F.greatest(*a_ends), width))
    right = _pieces(b, of_b, "__right").withColumn(_B, _buckets(F.col(b_ends[0]), F.greatest(*b_ends), width))
    low, high = F.greatest(a_ends[0], b_ends[0]), F.least(a_ends[1], b_ends[1])
    d = _dealt(left, [*by, _B]).join(_dealt(right, [*by, _B]), [*by, _B]).where((high > low) & (F.col(_B) == F.floor(low / width)))
    d = d.select(*by, *a_ends, *b_ends, *[c.alias(n) for n, c in more.items()], "__left", "__right")
    return _unfolded(d, ("__left", a, of_a), ("__right", b, of_b))


def boxes_meeting(a: DataFrame, b: DataFrame, a_prefix: str, b_prefix: str, cell: tuple[float, float], by: list[str]) -> DataFrame:
    """Pairs of boxes (<prefix>x1 .. y2) of the same `by` that share an area: both sides go to the cells they touch, and a pair counts in the first cell it shares."""
    axes = (("x", cell[0]), ("y", cell[1]))

    def placed(d: DataFrame, p: str) -> DataFrame:
        d = d.where((F.col(f"{p}x1") < F.col(f"{p}x2")) & (F.col(f"{p}y1") < F.col(f"{p}y2")))
        for axis, width in axes:
            d = d.withColumn(f"{_B}_{axis}", _buckets(F.col(f"{p}{axis}1"), F.col(f"{p}{axis}2"), width))
        return d

    d = placed(a, a_prefix).join(placed(b, b_prefix), [*by, *[f"{_B}_{axis}" for axis, _ in axes]])
    for axis, width in axes:
        low, high = F.greatest(f"{a_prefix}{axis}1", f"{b_prefix}{axis}1"), F.least(f"{a_prefix}{axis}2", f"{b_prefix}{axis}2")
        d = d.where((low < high) & (F.col(f"{_B}_{axis}") == F.floor(low / width)))
    return d.drop(*[f"{_B}_{axis}" for axis, _ in axes])


def range_lookup(rows: DataFrame, ranges: DataFrame, at: str, start: str, end: str, value: str, width: int, by: list[str] | None = None, default: int = -1) -> DataFrame:
    """The value of the range that a row's position lies in, the range that starts last if several; default if none."""
    by = by or []
    r = ranges.select(*by, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(value).alias("__v"), _buckets(F.col(start), F.col(end), width).alias(_B))
    positions = rows.select(*by, at).distinct().withColumn(_B, F.floor(F.col(at) / width))
    hit = positions.join(r, [*by, _B]).where(F.col(at).between(F.col("__s"), F.col("__e")))
    best = hit.groupBy(*by, at).agg(F.max_by("__v", F.struct("__s", "__v")).alias(value))
    return rows.join(best, [*by, at], "left").withColumn(value, F.coalesce(value, F.lit(default)))


def covered_length(a: DataFrame, b: DataFrame, key: list[str], a_ends: tuple[str, str], b_ends: tuple[str, str], width: float, by: list[str] | None = None) -> DataFrame:
    """key -> the summed length that b's intervals share with a's; 0 where none does."""
    pairs = overlapping(a, b, a_ends, b_ends, width, by)
    shared = F.least(F.col(a_ends[1]), F.col(b_ends[1])) - F.greatest(F.col(a_ends[0]), F.col(b_ends[0]))
    sums = pairs.groupBy(*key).agg(F.sum(shared).alias("covered"))
    return a.select(*key).join(sums, key, "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))
