"""What a review of annotations asks: clean track ids, rates near confirmed times, plans that override settings, second passes, effort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import agreement, greedy, joins
from tessera.operators.sampling import unit


def track_ids(boxes: DataFrame, by: list[str], track: str, shape_id: int = -1) -> DataFrame:
    """Per group: rows, rows that are shapes without a track, distinct tracks, their first and last id, and how many ids between these are missing."""
    real = F.when(F.col(track) != shape_id, F.col(track))
    d = boxes.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(F.col(track) == shape_id).alias("n_shapes"), F.count_distinct(real).alias("n_tracks"), F.min(real).alias("first_id"), F.max(real).alias("last_id"))
    return d.withColumn("n_missing", F.coalesce(F.col("last_id") - F.col("first_id") + 1 - F.col("n_tracks"), F.lit(0)).cast("long"))


def rates_near(frames: DataFrame, times: DataFrame, by: list[str], t: str, at: str, hits: str, pad: float = 1.0) -> DataFrame:
    """Hits (a count of each frame) per frame within `pad` of a confirmed time, and elsewhere, within the blocks whose range holds one of the times alone.

    Blocks without such a time are left out: to pool them would compare one scene with another.
    """
    span = frames.groupBy(*by).agg(F.min(t).alias("__from"), F.max(t).alias("__to"))
    inside = times.join(span, by).where(F.col(at).between(F.col("__from"), F.col("__to"))).select(*by).distinct()
    own = frames.join(inside, by, "left_semi")
    near = joins.points_near(own.select(*by, t), times.select(*by, at), t, at, pad, by).select(*by, t).distinct().withColumn("near", F.lit(True))
    d = own.join(near, [*by, t], "left").groupBy(*by, F.coalesce("near", F.lit(False)).alias("near")).agg(F.sum(hits).cast("long").alias("n_hits"), F.count("*").alias("n_frames"))
    return d.withColumn("rate", F.col("n_hits") / F.greatest(F.col("n_frames"), F.lit(1)))


def planned(items: DataFrame, plan: DataFrame | None, key: str, settings: dict[str, object], origin: tuple[str, str] = ("plan", "config")) -> DataFrame:
    """items with each setting from the plan's row of that key (the first, if there are several), else as configured, and which of the two it was."""
    if plan is None:
        return items.withColumns({c: F.lit(v) for c, v in settings.items()} | {"origin": F.lit(origin[1])})
    first = plan.groupBy(key).agg(F.min(F.struct(*settings)).alias("__p"))
    d = items.join(first, key, "left")
    return d.withColumns({c: F.coalesce(F.col("__p")[c], F.lit(v)) for c, v in settings.items()} | {"origin": F.when(F.col("__p").isNotNull(), origin[0]).otherwise(origin[1])}).drop("__p")


def passes(coded: DataFrame, key: str, number: str, values: list[str]) -> DataFrame:
    """The first and the second coding of each event side by side: values with _p1 and _p2."""
    side = lambda n: coded.where(F.col(number) == n).select(key, *[F.col(v).alias(f"{v}_p{n}") for v in values])
    return side(1).join(side(2), key)


def rater_ceiling(coded: DataFrame, key: str, number: str, score: str, label: str, least: int = 3) -> DataFrame:
    """(n_recoded, icc, exact): how far one rater agrees with the same rater's second pass; both are null below `least` events."""
    both = passes(coded, key, number, [score, label])
    value = agreement.icc(both, [f"{score}_p1", f"{score}_p2"]).select(F.col("icc"))
    same = both.agg(F.count("*").alias("n_recoded"), F.avg((F.col(f"{label}_p1").eqNullSafe(F.col(f"{label}_p2")) & F.col(f"{label}_p1").isNotNull()).cast("double")).alias("exact"))
    enough = F.col("n_recoded") >= least
    return same.crossJoin(value).select("n_recoded", F.when(enough, F.col("icc")).alias("icc"), F.when(enough, F.col("exact")).alias("exact"))  # one row and one row


def effort(boxes: Column, seconds: tuple[float, ...] = (1.5, 2.5, 4.0)) -> Column:
    """Hours to draw so many boxes, for each of these seconds a box."""
    return F.array(*[F.struct(F.lit(s).alias("seconds_per_box"), F.round(boxes * s / 3600, 1).alias("hours")) for s in seconds])


def in_kind_order(matches: DataFrame, kind: str = "kind", order: tuple[str, ...] = ("TP", "FP", "FN"), within: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a place that puts all of one kind behind all of the kind before: by kind, then `within`. Rows of other kinds go."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(kind)).cast("int")
    return matches.withColumn("kind_rank", rank).where("kind_rank > 0").select("*", F.struct("kind_rank", *within).alias("place"))


def with_team(tracks: DataFrame, teams: DataFrame, key: list[str], none: str = "unassigned") -> DataFrame:
    """tracks with the team of their key, or `none` where there is no row or no team for it."""
    return tracks.join(teams.select(*key, "team"), key, "left").withColumn("team", F.coalesce("team", F.lit(none)))


def box_summary(boxes: DataFrame, by: list[str], area: str, conf: str, small: float = 0.333) -> DataFrame:
    """Per frame: boxes, those smaller than the given quantile of all areas, their share, the median area, and the mean confidence."""
    q = boxes.agg(F.percentile(area, F.lit(small)).alias("__q"))
    d = boxes.crossJoin(F.broadcast(q)).groupBy(*by)  # one row
    d = d.agg(F.count("*").alias("n_boxes"), F.count_if(F.col(area) < F.col("__q")).alias("n_small"), F.median(area).alias("median_area"), F.avg(conf).alias("mean_conf"))
    return d.withColumn("small_frac", F.col("n_small") / F.col("n_boxes"))


def tightness(truth: DataFrame, found: DataFrame, by: list[str], aspect: Column, found_aspect: Column, least: float = 0.75) -> DataFrame:
    """Median height by width of true and of found boxes of each group, and whether the true ones are drawn too wide."""
    a, b = truth.groupBy(*by).agg(F.median(aspect).alias("true_aspect")), found.groupBy(*by).agg(F.median(found_aspect).alias("found_aspect"))
    return a.join(b, by, "full").withColumn("too_wide", F.col("true_aspect") < least * F.col("found_aspect"))


def pick_segments(matches: DataFrame, by: list[str], at: str, key: list[str], total: float, pad: float = 6.0, most: int = 4) -> DataFrame:
    """Per group the stretches around the two surest hits, the surest false alarm and the first miss, in order of time, `most` of them at most."""
    rank = F.row_number().over(W.partitionBy(*by, "kind").orderBy(F.desc("confidence"), *key))
    d = matches.withColumn("__r", rank).where("__r <= 2").where(F.col("__r") <= F.when(F.col("kind") == "TP", 2).otherwise(1))
    d = d.select(*by, "kind", F.greatest(F.col(at) - pad, F.lit(0.0)).alias("start_s"), F.least(F.col(at) + pad, F.lit(float(total))).alias("end_s"))
    place = F.row_number().over(W.partitionBy(*by).orderBy("start_s", "end_s", "kind"))
    return d.withColumn("place", place.cast("long")).where(F.col("place") <= most)


def recode_blocks(series: DataFrame, by: list[str], duration: str, block_s: float, share: float = 0.25, seed: int = 1729) -> DataFrame:
    """Blocks of each series to be coded a second time: round(share x blocks) of them, at least one, by a hashed order."""
    n = F.ceil(F.col(duration) / block_s)
    d = series.withColumn("__n", n).where("__n > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    r = F.row_number().over(W.partitionBy(*by).orderBy(unit("block", seed), "block"))
    d = d.withColumn("__r", r).where(F.col("__r") <= F.greatest(F.lit(1), F.bround(F.col("__n") * share)))
    return d.select(*by, "block", (F.col("block") * block_s).alias("start_s"), F.least((F.col("block") + 1) * block_s, F.col(duration)).alias("end_s"))


def annotation_blocks(candidates: DataFrame, events: DataFrame, excluded: DataFrame, by: list[str], at: str, ends: tuple[str, str], width: float, most: int) -> DataFrame:
    """Blocks (t_start_s, t_end_s) with an event at least and no overlap with what is excluded; those with the most events first, none overlapping another."""
    near = joins.points_in_intervals(candidates, events.select(*by, at), "t_start_s", "t_end_s", at, width, by).groupBy(*by, "t_start_s", "t_end_s").agg(F.count("*").alias("n_events"))
    barred = joins.overlapping(candidates, excluded.select(*by, *ends), ("t_start_s", "t_end_s"), ends, width, by).select(*by, "t_start_s", "t_end_s").distinct()
    free = near.join(barred, [*by, "t_start_s", "t_end_s"], "left_anti")
    return greedy.choose_blocks(free.withColumn("rank", -F.col("n_events")), by, most)
