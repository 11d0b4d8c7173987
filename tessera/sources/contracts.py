"""Table contracts: columns and types, primary keys, ranges and enumerations; validated reads and writes.

Validation is one aggregation for all ranges and enumerations and one grouped
count for the key, whatever the number of rules. Types are enforced by a cast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table breaks its contract."""


@dataclass(frozen=True)
class Contract:
    key: tuple[str, ...]
    format: str
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    enums: dict[str, tuple] = field(default_factory=dict)


# The tables' formats, primary keys, columns and types (Spark DDL).
_TABLES = {
    "video_registry": ("csv", "video_id", "video_id string, sha256 string, filename string, bytes long, duration_s double, src_fps double, src_width long, src_height long, codec string, competition string, round_or_stage string, match_date string, broadcaster string, capture_source string, rights_status string, ingest_utc string, notes string"),
    "frame_manifest": ("csv", "frame_idx", "frame_idx long, timestamp_s double, path string, width long, height long, video_id string"),
    "detections": ("parquet", "frame_idx, det_idx", "frame_idx long, det_idx long, timestamp_s double, x1 float, y1 float, x2 float, y2 float, conf float, class_id short"),
    "tracks": ("parquet", "track_id, frame_idx", "track_id long, frame_idx long, timestamp_s double, x1 float, y1 float, x2 float, y2 float, cx float, cy float, bbox_h float, bbox_area float, conf float"),
    "features_image": ("parquet", "frame_idx", "frame_idx long, timestamp_s double, n_tracks long, max_bbox_height float, mean_bbox_height float, cluster_density_px float, centroid_spread_px float, mean_vertical_velocity float, max_vertical_velocity float, scene_change_flag byte, valid_frame byte, is_repeat_frame byte"),
    "segment_map": ("csv", "video_id", "segment_id long, video_id string, source_id string, source_start_s double, source_end_s double, duration_s double, n_frames long, fps long, width long, height long, n_kickouts long, merged_windows long, src_width long, src_height long"),
    "annotation_blocks": ("csv", "block_id", "block_id string, t_start_s double, t_end_s double, split string, n_kickouts long, kickout_times string, excl_overlap_s double, churn_flags long, n_frames_with_boxes long, mean_boxes_per_frame double, mean_small_frac double, reason string"),
    "annotation_keyframes": ("csv", "frame_idx", "block_id string, split string, frame_idx long, t_s double, n_boxes long, small_frac double, is_keyframe long"),
    "features": ("parquet", "frame_idx", "frame_idx long, timestamp_s double, n_tracks long, max_bbox_height float, mean_bbox_height float, cluster_density float, centroid_spread float, mean_vertical_velocity float, max_vertical_velocity float, scene_change_flag byte, valid_frame byte, is_repeat_frame byte, feature_space string"),
    "pitch_keypoints": ("csv", "shot_id, landmark", "video_id string, shot_id long, frame_idx long, landmark string, img_x double, img_y double, pitch_x double, pitch_y double, use_for_fit byte"),
    "homographies": ("csv", "shot_id", "shot_id long, n_landmarks long, n_inliers long, rmse_fit_m double, rmse_holdout_m double, max_holdout_m double, n_holdout long, validated byte"),
    "track_teams": ("csv", "track_id", "track_id long, team string, confidence double, n_crops long, method string"),
    "features_pitch": ("parquet", "frame_idx", "frame_idx long, timestamp_s double, shot_id long, n_players_registered long, n_inside_65 long, n_inside_45 long, mean_x_m float, spread_x_m float, spread_y_m float, width_used_m float, depth_used_m float, nn_distance_m float, cluster_density_m float, mean_speed_ms float, max_speed_ms float, frac_above_sprint float"),
    "events_pred": ("csv", "event_id", "event_id string, t_start_s double, t_end_s double, t_peak_s double, duration_s double, confidence double, n_players_in_contest long, detector_mode string"),
    "gt_events": ("csv", "event_id, coding_pass", "event_id string, t_start_s double, t_end_s double, t_peak_s double, n_players_in_contest long, outcome string, restart_type string, coder_id string, coding_pass byte, visibility string, notes string"),
    "gt_boxes": ("csv", "frame, id", "frame long, id long, bb_left double, bb_top double, bb_width double, bb_height double, conf double, class long, visibility double"),
    "failure_audit": ("csv", "case_id", "case_id string, error_type string, t_center_s double, clip_path string, cause string, secondary_cause string, reviewer_note string"),
    "review_log": ("csv", "review_id", "review_id string, event_id string, model_confidence double, analyst_verdict string, seconds_to_judge double, adjusted_t_peak_s double, condition string"),
    "kickout_coding_pred": ("csv", "event_id", "event_id string, t_start_s double, t_peak_s double, codeable byte, reason_not_codeable string, defending_team string, kicking_team string, team_source string, keeper_gap_m double, n_defenders_in_65 long, n_defenders_band string, n_unassigned_in_65 long, count_uncertainty long, nn_opponent_m double, defensive_strategy string, strategy_evidence string, receive_x_m double, distance_class string, contested_proxy string, n_registered_setup long, detector_source string"),
    "gt_coding": ("csv", "event_id, coding_pass", "event_id string, n_defenders_in_65 long, n_defenders_band string, defensive_strategy string, distance_class string, contested_proxy string, kickout_won string, coder_id string, coding_pass byte, confidence string, notes string"),
}

# Inclusive ranges and enumerations.
_RANGES = {"detections": {"conf": (0, 1)}, "track_teams": {"confidence": (0, 1)}, "features_pitch": {"frac_above_sprint": (0, 1)}, "events_pred": {"confidence": (0, 1)}}
_ENUMS = {
    "video_registry": {"capture_source": ("broadcast", "club_fixed_cam", "handheld", "other"), "rights_status": ("personal_local_only", "licensed", "public_domain", "unknown")},
    "features_image": {"scene_change_flag": (0, 1), "valid_frame": (0, 1), "is_repeat_frame": (0, 1)},
    "annotation_blocks": {"split": ("train", "val")},
    "annotation_keyframes": {"is_keyframe": (1,)},
    "features": {"feature_space": ("pixel", "pitch")},
    "track_teams": {"team": ("team_a", "team_b", "unassigned"), "method": ("hsv_torso_kmeans", "no_usable_crop", "manual")},
    "events_pred": {"detector_mode": ("rule", "learned")},
    "gt_events": {"outcome": ("own_clean", "own_break", "opp_clean", "opp_break", "out_of_play", "unclear"), "restart_type": ("short", "medium", "long", "unclear"), "coding_pass": (1, 2), "visibility": ("full", "partial_cut", "partial_occluded", "off_camera")},
    "failure_audit": {"error_type": ("FP", "FN", "boundary")},
    "review_log": {"analyst_verdict": ("accept", "reject", "adjust"), "condition": ("manual_from_scratch", "model_assisted")},
    "kickout_coding_pred": {"codeable": (0, 1), "defensive_strategy": ("zonal", "player_to_player", "concede", "unclear"), "distance_class": ("short", "long", "unclear"), "contested_proxy": ("contested", "uncontested", "unclear")},
    "gt_coding": {"confidence": ("high", "medium", "low")},
}

CONTRACTS = {name: Contract(tuple(key.split(", ")), fmt, _RANGES.get(name, {}), _ENUMS.get(name, {})) for name, (fmt, key, _) in _TABLES.items()}


def schema_of(name: str) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "byte": T.ByteType(), "short": T.ShortType()}
    return T.StructType([T.StructField(c, kinds[k]) for c, k in (x.split(" ") for x in _TABLES[name][2].split(", "))])


def violations(df: DataFrame, name: str, extra_key: tuple[str, ...] = ()) -> DataFrame:
    """One row for each rule: (rule, column, violations). Missing and extra columns, duplicate keys, ranges, enumerations."""
    c, own, spark = CONTRACTS[name], schema_of(name).names, df.sparkSession
    rows = [("missing", x, 1) for x in own if x not in df.columns] + [("extra", x, 1) for x in df.columns if x not in own and x not in extra_key]
    checks = {("range", x): ~F.col(x).between(*r) & ~F.isnan(F.col(x).cast("double")) for x, r in c.ranges.items() if x in df.columns}
    checks |= {("enum", x): F.col(x).isNotNull() & ~F.col(x).isin(*e) for x, e in c.enums.items() if x in df.columns}
    fixed = spark.createDataFrame(rows, "rule string, column string, violations long")
    key = [*extra_key, *c.key]
    if not {"missing"} & {r[0] for r in rows if r[1] in key}:
        again = df.groupBy(*key).count().agg(F.coalesce(F.sum((F.col("count") - 1)), F.lit(0)).alias("violations"))
        fixed = fixed.unionByName(again.select(F.lit("key").alias("rule"), F.lit(", ".join(key)).alias("column"), "violations"))
    if checks:
        one = df.agg(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(x).alias("column"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("violations")) for (rule, x), bad in checks.items()]).alias("a"))
        fixed = fixed.unionByName(one.select(F.explode("a").alias("x")).select("x.*"))
    return fixed


def validate(df: DataFrame, name: str, strict: bool = True, extra_key: tuple[str, ...] = ()) -> DataFrame:
    """df in the contract's column order and types, or ContractError. Extra columns are an error if strict, and dropped if not."""
    if name not in _TABLES:
        raise ContractError(f"unknown table {name}")
    found = [r for r in violations(df, name, extra_key).collect() if r.violations and (strict or r.rule != "extra")]  # a row for each rule
    if found:
        raise ContractError(f"{name}: " + "; ".join(f"{r.rule} {r.column} ({r.violations})" for r in found))
    return df.select(*extra_key, *[F.col(f.name).cast(f.dataType) for f in schema_of(name)])


def write_table(df: DataFrame, name: str, path: str, strict: bool = True, partition_by: tuple[str, ...] = ()) -> None:
    """Validate and write; each video (or other partition) has its own folder."""
    out = validate(df, name, strict, partition_by).write.mode("overwrite").partitionBy(*partition_by)
    out.parquet(path) if CONTRACTS[name].format == "parquet" else out.option("header", True).csv(path)


def read_table(spark: SparkSession, name: str, path: str, strict: bool = True, partition_by: tuple[str, ...] = ()) -> DataFrame:
    schema = schema_of(name)
    for p in partition_by:
        schema = schema.add(p, T.StringType())
    df = spark.read.parquet(path) if CONTRACTS[name].format == "parquet" else spark.read.schema(schema).option("header", True).csv(path)
    return validate(df, name, strict, partition_by)
