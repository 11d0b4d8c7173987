"""A scenario with known truth: restarts from the own end against a defence of known strategy, seen as trajectories."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.functions.pitch import LENGTH, WIDTH, line_x

# Shares of the strategies, players on either side.
STRATEGIES = (("zonal", 0.53), ("player_to_player", 0.43), ("concede", 0.04))
DEFENDERS, ATTACKERS = 15, 13


def scenario(spark: SparkSession, n_events: int = 16, fps: int = 25, every_s: float = 35.0, setup_s: float = 1.5, hold_s: float = 2.0, noise: float = 0.4, drop: float = 0.05, unassigned: float = 0.10, seed: int = 1729) -> dict[str, DataFrame]:
    """tracks (on the field), teams, events and coding. With noise, drop and unassigned at 0 the coding is exact.

    A test fixture of a few thousand rows, made on the driver.
    """
    rng = np.random.default_rng(seed)
    tracks: list[tuple[Any, ...]] = []
    teams, events, coding, n_tracks = [], [], [], 0
    own, far = -LENGTH / 2, line_x(65.0)
    for e in range(n_events):
        start = every_s * (e + 1)
        kind = rng.choice([s for s, _ in STRATEGIES], p=[p for _, p in STRATEGIES])
        attack = np.column_stack([rng.uniform(far + 1, LENGTH / 2 - 1, ATTACKERS), rng.uniform(-WIDTH / 2, WIDTH / 2, ATTACKERS)])
        inside = 3 if kind == "concede" else int(rng.integers(6, 13))
        depth = np.where(np.arange(DEFENDERS) < inside, rng.uniform(far + 1, LENGTH / 2 - 1, DEFENDERS), rng.uniform(own + 40, far - 1, DEFENDERS))
        defend = np.column_stack([depth, rng.uniform(-WIDTH / 2, WIDTH / 2, DEFENDERS)])
        if kind == "player_to_player":
            n = min(inside, ATTACKERS)
            defend[:n] = attack[:n] + [0.0, 1.0]
        places = [("team_a", own + 4.0, 0.0), *(("team_a", *p) for p in attack), *(("team_b", *p) for p in defend)]
        for team, x, y in places:
            hidden = rng.random() < unassigned * (1 + noise)
            teams.append((n_tracks, "unassigned" if hidden else team))
            for f in range(int((start - setup_s) * fps), int((start + hold_s) * fps) + 1):
                if rng.random() >= drop * (1 + noise):
                    tracks.append((0, n_tracks, f, f / fps, float(x + noise * rng.normal()), float(y + noise * rng.normal())))
            n_tracks += 1
        events.append((f"ko_{e:03d}", start, start + hold_s, start + hold_s / 2))
        coding.append((f"ko_{e:03d}", int((defend[:, 0] >= far).sum()), str(kind)))
    return {
        "tracks": spark.createDataFrame(tracks, "video_id int, track_id long, frame_idx long, timestamp_s double, pitch_x double, pitch_y double"),
        "teams": spark.createDataFrame(teams, "track_id long, team string"),
        "events": spark.createDataFrame(events, "event_id string, t_start_s double, t_end_s double, t_peak_s double"),
        "coding": spark.createDataFrame(coding, "event_id string, n_defenders_in_65 long, defensive_strategy string"),
    }
