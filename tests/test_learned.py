"""Registration, learned scores, clustering, and the coding of a scenario with known truth."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import pitch
from tessera.operators import coding, joins, learned, registration
from tessera.sources import synthetic


def test_shots_are_fitted_and_validated(spark):
    h = np.linalg.inv(np.array([[0.12, 0.01, -75.0], [0.0, 0.16, -50.0], [0.0, 0.0003, 1.0]]))
    rows = []
    for shot, n in ((0, 12), (1, 5), (2, 3)):
        for name, x, y in pitch.landmarks()[:n]:
            u, v = pitch.apply(h, np.array([[x, y]]))[0]
            rows.append((shot, name, float(u), float(v)))
    k = registration.landmark_table(spark.createDataFrame(rows, "shot_id long, landmark string, img_x double, img_y double"))
    got = {r.shot_id: r for r in registration.fit_shots(registration.hold_out(k, ["shot_id"]), ["shot_id"]).collect()}
    assert got[0].validated == 1 and got[0].n_holdout == 2 and got[0].rmse_holdout_m < 1e-5
    assert got[1].validated == 0 and got[1].n_holdout == 0 and got[1].h is not None and got[2].h is None


def test_blocked_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(0, i, float(i), float(i), float(i) + 3.0, float(x)) for i, x in enumerate(rng.normal(size=100))]
    w = spark.createDataFrame(rows, "v int, w long, t double, a double, b double, x double")
    gt = spark.createDataFrame([(0, r[3], r[4]) for r in rows if r[5] > 0.8], "v int, g0 double, g1 double")
    labelled = learned.label_windows(w, gt, ["v"], "w", ("a", "b"), ("g0", "g1"), 5.0, 0.9)
    assert labelled.where("label = 1").count() == gt.count()
    s = learned.blocked_scores(labelled, ["v"], "w", "t", ["x"], 3, 2.0).join(labelled, ["v", "w"]).groupBy("label").agg(F.avg("score").alias("s")).collect()
    by = {r.label: r.s for r in s}
    assert by[1] > by[0] + 0.2
    one_kind = labelled.withColumn("label", F.lit(1))
    assert {r.score for r in learned.blocked_scores(one_kind, ["v"], "w", "t", ["x"], 2).collect()} == {1.0}


def test_teams_by_colour(spark):
    rows = [(t, [0.0 + 0.01 * i, 1.0] if t % 2 else [1.0, 0.01 * i]) for t in range(6) for i in range(6)] + [(9, [0.5, 0.5])]
    d = learned.colour_distances(spark.createDataFrame(rows, "track_id long, c array<double>"), "c")
    got = {r.track_id: r.team for r in coding.team_labels(d, ["track_id"]).collect()}
    assert {got[1], got[3], got[5]} == {"team_a"} and {got[0], got[2], got[4]} == {"team_b"} and got[9] == "unassigned"


def test_scenario_is_coded_exactly(spark):
    s = synthetic.scenario(spark, n_events=5, fps=5, noise=0.0, drop=0.0, unassigned=0.0)
    p = s["tracks"].join(s["teams"], "track_id").withColumn("sign", F.lit(1.0))
    ev = s["events"]
    near = joins.points_in_intervals(ev.select("event_id", (F.col("t_start_s") - 1.5).alias("a"), (F.col("t_peak_s") + 0.5).alias("b")), p, "a", "b", "timestamp_s", 10.0)
    got = {r.event_id: r for r in coding.code_events(ev, near, ["event_id"]).collect()}
    for t in s["coding"].collect():
        g = got[t.event_id]
        assert g.codeable == 1 and g.kicking_team == "team_a" and g.n_defenders_in_65 == t.n_defenders_in_65
        assert t.defensive_strategy == "zonal" or g.defensive_strategy == t.defensive_strategy
