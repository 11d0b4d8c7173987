"""Coding of events from projected trajectories: who defends, how many, how closely, where the ball is received.

What cannot be determined is said, with its first reason, and never filtered.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.functions.pitch import line_x
from tessera.operators.joins import points_in_intervals
from tessera.operators.lineage import settled
from tessera.operators.matching import nearest, nearest_others

#: Bands of defender counts: label, least, greatest.
BANDS = (("0-4", 0, 4), ("5-7", 5, 7), ("8-10", 8, 10), ("11+", 11, None))
UNASSIGNED = "unassigned"


def band(n: str | Column) -> Column:
    c = F.col(n) if isinstance(n, str) else n
    out = F.lit(None).cast("string")
    for label, low, high in reversed(BANDS):
        out = F.when((c >= low) & (c <= high if high is not None else F.lit(True)), label).otherwise(out)
    return out


def strategy(n_defenders: Column, nearest: Column, concede: int = 4, close: float = 1.5) -> Column:
    """Few defenders concede; close ones mark players; others hold zones; without a distance it is unclear."""
    return F.when(n_defenders <= concede, "concede").when(nearest.isNull(), "unclear").when(nearest <= close, "player_to_player").otherwise("zonal")


def keeper_gap(setup: DataFrame, key: list[str]) -> DataFrame:
    """Per event: the team of the deepest player, and how far that player stands from the team's 10 % (or 90 %) quantile of depth."""
    depth = F.col("sign") * F.col("pitch_x")
    known = setup.where(F.col("team") != UNASSIGNED).withColumn("depth", depth)
    deepest = known.groupBy(*key).agg(F.min_by("team", F.struct("depth", "track_id", "frame_idx")).alias("team"), F.min("depth").alias("deep"))
    q = known.join(deepest, [*key, "team"]).groupBy(*key, "team").agg(F.abs(F.first("deep") - F.percentile("depth", F.lit(0.1))).alias("keeper_gap_m"))
    return q.withColumnRenamed("team", "kicking_team")


def counts_inside(setup: DataFrame, key: list[str], distance_m: float = 65.0) -> DataFrame:
    """Per event and team: the median over frames of the players at or beyond the line. A frame with any row counts, with 0 for teams that have none there."""
    inside = (F.col("sign") * F.col("pitch_x") >= line_x(distance_m)).cast("long")
    frames, teams = setup.select(*key, "frame_idx").distinct(), setup.select(*key, "team").distinct()
    n = setup.groupBy(*key, "frame_idx", "team").agg(F.sum(inside).alias("n"))
    grid = frames.join(teams, key).join(n, [*key, "frame_idx", "team"], "left")
    return grid.groupBy(*key, "team").agg(F.bround(F.median(F.coalesce("n", F.lit(0)))).cast("long").alias("n_inside"))


def nearest_opponent(setup: DataFrame, key: list[str], attackers: DataFrame, distance_m: float = 65.0, least: int = 3) -> DataFrame:
    """Per event: the median over frames of the median distance of defenders inside the line to their nearest attacker; frames with under `least` of either are left out. attackers: (key, kicking_team)."""
    d = setup.where(F.col("team") != UNASSIGNED).join(attackers, key)
    side = [*key, "frame_idx"]
    inside = F.col("sign") * F.col("pitch_x") >= line_x(distance_m)
    place = [F.col("pitch_x").cast("double").alias("__x"), F.col("pitch_y").cast("double").alias("__y")]
    d = d.where(reduce(and_, [F.col(c).isNotNull() for c in side]))
    a = d.where(F.col("team") == F.col("kicking_team")).select(*[F.col(c).alias(f"__of_{c}") for c in side], *place)
    b = d.where((F.col("team") != F.col("kicking_team")) & inside).select(*side, "track_id", *place)
    schema = StructType([*[StructField(c, d.schema[c].dataType) for c in side], StructField("d", DoubleType())])
    arrow = to_arrow_schema(schema)

    def middle(b: pa.Table, a: pa.Table) -> pa.Table:
        if len(a) < least or len(b) < least:
            return arrow.empty_table()
        ids = pc.dictionary_encode(b["track_id"].combine_chunks(), null_encoding="encode").indices.to_numpy()
        best = np.full(ids.max() + 1, np.inf)
        np.minimum.at(best, ids, _nearest_of(b, a))
        best = best[np.isfinite(best)]
        return pa.table([*[b[c].slice(0, 1) for c in side], pa.array([float(np.median(best)) if len(best) else None], pa.float64())], names=arrow.names).cast(arrow)

    # players of a frame meet in one task; pairs of them are never rows
    near = b.groupBy(*side).cogroup(a.groupBy(*[f"__of_{c}" for c in side])).applyInArrow(middle, schema)
    return near.groupBy(*key).agg(F.median("d").alias("nn_opponent_m"))


def _nearest_of(b: pa.Table, a: pa.Table) -> np.ndarray:
    """Of each row of b the distance to the nearest of a; infinite where there is none."""
    (x, y), (ax, ay) = [(t["__x"].to_numpy(), t["__y"].to_numpy()) for t in (b, a)]
    here, there, out = np.isfinite(x) & np.isfinite(y), np.isfinite(ax) & np.isfinite(ay), np.full(len(x), np.inf)
    out[here] = nearest(x[here], y[here], ax[there], ay[there], 1)[0][:, 0]
    return out


def reception(peak: DataFrame, key: list[str], k: int = 3, contested_m: float = 2.0, line: float = 45.0) -> DataFrame:
    """Per event with two tracks or more at its peak: mean x of the k tightest tracks, short or long, and whether any two are within contested_m."""
    m = peak.groupBy(*key, "track_id").agg(F.median("pitch_x").alias("x"), F.median("pitch_y").alias("y"), F.first("sign").alias("sign"))
    m = m.where(reduce(and_, [F.col(c).isNotNull() for c in [*key, "track_id"]])).withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    schema = StructType([StructField(f.name, f.dataType) for f in m.drop("y").schema] + [StructField("d", DoubleType())])
    arrow = to_arrow_schema(schema)

    def others(t: pa.Table) -> pa.Table:
        if len(t) < 2:
            return arrow.empty_table()
        x, y = t["x"].to_numpy(), t["y"].to_numpy()
        real, d = np.isfinite(x) & np.isfinite(y), np.full(len(t), np.nan)
        d[real] = nearest_others(x[real], y[real], 1)
        return t.drop_columns(["y"]).append_column("d", pa.array(d, from_pandas=True)).cast(arrow)

    near = m.groupBy(*key).applyInArrow(others, schema)
    tight = near.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy("d", "track_id")))
    g = tight.groupBy(*key).agg(F.avg(F.when(F.col("r") <= k, F.col("x"))).alias("receive_x_m"), F.min("d").alias("least"), F.first("sign").alias("sign"))
    return g.select(*key, "receive_x_m", F.when(F.col("sign") * F.col("receive_x_m") < line_x(line), "short").otherwise("long").alias("distance_class"), F.when(F.col("least") <= contested_m, "contested").otherwise("uncontested").alias("contested_proxy"))


def code_events(events: DataFrame, positions: DataFrame, key: list[str], setup_s: float = 1.5, peak_s: float = 0.5, gap_m: float = 12.0, concede: int = 4, close: float = 1.5, source: str = "ground_truth") -> DataFrame:
    """A coded row for each event. events: (key, t_start_s, t_peak_s[, kicking_team]); positions: (key's series columns joined already: key, frame_idx, timestamp_s, track_id, team, pitch_x, pitch_y, sign)."""
    given = "kicking_team" in events.columns
    ev = events.select(*key, "t_start_s", "t_peak_s", *([F.col("kicking_team").alias("given_team")] if given else []))
    p = positions.where(F.col("pitch_x").isNotNull()).join(ev.select(*key, F.col("t_start_s").alias("__s"), F.col("t_peak_s").alias("__p")), key)
    in_setup, in_peak = F.col("timestamp_s").between(F.col("__s") - setup_s, F.col("__s")), F.col("timestamp_s").between(F.col("__p") - peak_s, F.col("__p") + peak_s)
    # the rows of both windows are read by seven later steps, so they are made once
    rows = settled(p.withColumns({"__setup": in_setup, "__peak": in_peak}).where("__setup OR __peak").select(*key, "frame_idx", "track_id", "team", "pitch_x", "pitch_y", "sign", "__setup", "__peak"))
    setup, peak = rows.where("__setup").drop("__setup", "__peak"), rows.where("__peak").drop("__setup", "__peak")
    teams = setup.groupBy(*key).agg(F.count_distinct("track_id").alias("n_registered_setup"), F.array_sort(F.collect_set(F.when(F.col("team") != UNASSIGNED, F.col("team")))).alias("known"))
    d = ev.join(teams, key, "left").join(keeper_gap(setup, key), key, "left")
    own = F.when(F.array_contains("known", F.col("given_team")), F.col("given_team")) if given else F.lit(None).cast("string")
    d = d.withColumn("__own", own)
    d = d.withColumns({"team_source": F.when(F.col("__own").isNotNull(), "metadata").when(F.size("known") >= 2, "inferred_deepest"), "kicking_team": F.coalesce("__own", F.when(F.size("known") >= 2, F.col("kicking_team")))})
    d = d.withColumn("defending_team", F.get(F.expr("filter(known, x -> x <> kicking_team)"), F.lit(0)))
    inferred = F.col("team_source") == "inferred_deepest"
    reason = F.coalesce(
        F.when(F.col("known").isNull(), "no registered tracks in setup window"), F.when(F.size("known") == 0, "all tracks unassigned"),
        F.when(F.col("team_source").isNull(), "only one team assigned in setup window"), F.when(inferred & (F.col("keeper_gap_m") < gap_m), F.format_string("deepest player only %.1f m behind team", F.col("keeper_gap_m"))),
        F.when(F.col("defending_team").isNull(), "only the kicking team was assigned"))
    d = d.withColumn("reason_not_codeable", reason).withColumn("ok", F.col("reason_not_codeable").isNull())
    n = counts_inside(setup, key)
    d = d.join(n.select(*key, F.col("team").alias("defending_team"), F.col("n_inside").alias("n_defenders_in_65")), [*key, "defending_team"], "left")
    d = d.join(n.where(F.col("team") == UNASSIGNED).select(*key, F.col("n_inside").alias("n_unassigned_in_65")), key, "left").withColumn("n_unassigned_in_65", F.coalesce("n_unassigned_in_65", F.lit(0).cast("long")))
    kicking = d.where("ok").select(*key, "kicking_team")
    d = d.join(nearest_opponent(setup, key, kicking), key, "left").join(reception(peak, key), key, "left")
    only = lambda c: F.when(F.col("ok"), c if isinstance(c, Column) else F.col(c))
    failed = inferred & (F.col("keeper_gap_m") < gap_m)
    return d.select(
        *key, "t_start_s", "t_peak_s", F.col("ok").cast("byte").alias("codeable"), "reason_not_codeable", only("defending_team").alias("defending_team"), only("kicking_team").alias("kicking_team"),
        F.when(F.col("ok") | failed, F.col("team_source")).alias("team_source"), F.when((F.col("ok") | failed) & inferred, F.col("keeper_gap_m")).alias("keeper_gap_m"),
        only("n_defenders_in_65").alias("n_defenders_in_65"), only(band("n_defenders_in_65")).alias("n_defenders_band"), only("n_unassigned_in_65").alias("n_unassigned_in_65"), only("n_unassigned_in_65").alias("count_uncertainty"),
        only("nn_opponent_m").alias("nn_opponent_m"), only(strategy(F.col("n_defenders_in_65"), F.col("nn_opponent_m"), concede, close)).alias("defensive_strategy"), only("receive_x_m").alias("receive_x_m"),
        only(F.coalesce("distance_class", F.lit("unclear"))).alias("distance_class"), only(F.coalesce("contested_proxy", F.lit("unclear"))).alias("contested_proxy"), only("n_registered_setup").alias("n_registered_setup"), F.lit(source).alias("detector_source"))


def code_series(events: DataFrame, positions: DataFrame, by: list[str], width: float, setup_s: float = 1.5, peak_s: float = 0.5, **limits: float) -> DataFrame:
    """code_events for events (by, t_start_s, t_peak_s[, kicking_team], any id) over whole series of positions (by, frame_idx, timestamp_s, ...), with all columns of events.

    Everything that is coded follows from the windows, so events of a series that share their times are coded once: work grows with
    the positions and the different windows, not with events times positions. width: of the time buckets that windows and positions meet in.
    """
    same = [*by, *[c for c in ("t_start_s", "t_peak_s", "kicking_team") if c in events.columns]]
    spans = events.select(*same).distinct()
    key = {c: f"__of_{c}" for c in same}
    spans = spans.withColumns({name: F.col(c) for c, name in key.items()}).withColumns({"__a": F.least(F.col("t_start_s") - setup_s, F.col("t_peak_s") - peak_s), "__b": F.greatest("t_start_s", F.col("t_peak_s") + peak_s)})
    p = positions.select(*by, "frame_idx", "timestamp_s", "track_id", "team", "pitch_x", "pitch_y", "sign").where(F.col("pitch_x").isNotNull())
    near = points_in_intervals(spans.select(*by, *key.values(), "__a", "__b"), p, "__a", "__b", "timestamp_s", width, by).drop(*by, "__a", "__b")
    coded = code_events(spans.drop("__a", "__b", *by), near, list(key.values()), setup_s=setup_s, peak_s=peak_s, **limits).drop("t_start_s", "t_peak_s", *(["kicking_team"] if "kicking_team" in events.columns else []))
    return events.join(coded, reduce(and_, [F.col(c).eqNullSafe(F.col(name)) for c, name in key.items()]), "left").drop(*key.values())


def team_labels(crops: DataFrame, key: list[str], margin: float = 0.12, least: int = 5) -> DataFrame:
    """Team of each track from its crops' distances d0, d1 to two colour centres: the nearer, unless the margin is thin or crops are few."""
    m = F.abs(F.col("d0") - F.col("d1")) / (F.col("d0") + F.col("d1") + 1e-9)
    g = crops.groupBy(*key).agg(F.count("*").alias("n_crops"), F.avg(m).alias("confidence"), F.avg((F.col("d0") < F.col("d1")).cast("double")).alias("a"))
    sure = (F.col("confidence") >= margin) & (F.col("n_crops") >= least)
    return g.select(*key, F.when(~sure, UNASSIGNED).when(F.col("a") >= 0.5, "team_a").otherwise("team_b").alias("team"), "confidence", "n_crops", F.lit("hsv_torso_kmeans").alias("method"))
