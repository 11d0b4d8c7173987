"""Known answers and defined corner cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import boxes, pitch, stats, timebase
from tessera.operators import agreement, coding, features, greedy, joins, lineage, mot, sampling, series, windows
from tessera.sources import contracts, files


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_precision_recall_and_wilson(spark):
    d = spark.createDataFrame([(8, 2, 4), (1701, 4563, 4075), (0, 0, 0)], "tp long, fp long, fn long")
    a, b, c = d.select(*[x.alias(n) for n, x in stats.precision_recall("tp", "fp", "fn").items()]).collect()
    assert a.precision_value == pytest.approx(0.8) and a.recall_value == pytest.approx(8 / 12)
    assert [round(x, 3) for x in (b.precision_ci_low, b.precision_ci_high, b.recall_ci_low, b.recall_ci_high, b.f1_value, b.f1_ci_low, b.f1_ci_high)] == [0.261, 0.283, 0.283, 0.306, 0.283, 0.271, 0.294]
    assert c.precision_value is None and c.f1_value is None
    w = spark.createDataFrame([(15, 15), (0, 12)], "k long, n long").select(*[x.alias(n) for n, x in stats.wilson("k", "n").items()]).collect()
    assert w[0].ci_high <= 1 and w[1].ci_low >= 0


def test_rate_ratio_and_exact_p(spark):
    r = one(spark, **stats.rate_ratio(F.lit(72), F.lit(153), F.lit(141), F.lit(447)))
    assert [round(x, 3) for x in r] == [1.492, 1.123, 1.982]
    assert stats.binomial_p(72, 213, 153 / 600) == pytest.approx(0.00734, abs=1e-5)


def test_quantiles():
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5) and stats.t_quantile(0.025, 10) == pytest.approx(-2.228139, abs=1e-5)
    assert stats.f_quantile(0.95, 3, 10) == pytest.approx(3.708265, abs=1e-5) and stats.z_of() == pytest.approx(1.959964, abs=1e-6)


def test_kappa(spark):
    r = one(spark, **stats.kappa(F.lit(15), F.lit(5), F.lit(5), F.lit(75)))
    assert (r.agreement, r.chance, r.kappa) == pytest.approx((0.90, 0.68, 0.6875))


def test_interval_and_box_iou(spark):
    d = spark.createDataFrame([(0.0, 10.0, 5.0, 15.0), (0.0, 1.0, 8.0, 9.0), (1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    assert [r[0] for r in d.select(boxes.interval_iou("a", "b", "c", "d")).collect()] == pytest.approx([1 / 3, 0, 0])
    f = one(spark, **boxes.foot(F.lit(100.0), F.lit(140.0), F.lit(300.0)))
    assert tuple(f) == (120.0, 300.0)


def test_match_events_one_to_one(spark):
    p = spark.createDataFrame([(0, "p1", 10.0, 14.0, 0.9), (0, "p2", 10.2, 14.1, 0.8)], "g int, pred_id string, p_start double, p_end double, confidence double")
    t = spark.createDataFrame([(0, "g1", 10.0, 14.0)], "g int, gt_id string, g_start double, g_end double")
    got = {r.pred_id: (r.kind, r.gt_id, round(r.tiou, 3)) for r in greedy.match_events(p, t, ["g"], 0.5, 5.0).collect()}
    assert got == {"p1": ("TP", "g1", 1.0), "p2": ("FP", None, round(3.8 / 4.1, 3))}
    left = greedy.match_events(p.limit(0), t, ["g"], 0.5, 5.0).collect()
    assert [(r.kind, r.gt_id, r.tiou) for r in left] == [("FN", "g1", 0.0)]


def test_nms(spark):
    d = spark.createDataFrame([(0, 1, 10.0, 0.9), (0, 2, 12.0, 0.8), (0, 3, 17.0, 0.7), (0, 4, 16.5, 0.75), (0, 5, 40.0, 0.01)], "v int, w_frame long, t_peak_s double, score double")
    assert sorted(r.t_peak_s for r in greedy.nms_time(d, ["v"], 6.0).collect()) == [10.0, 16.5]


def test_presence_bins(spark):
    e = spark.createDataFrame([(0, 0.0, 4.0), (0, 20.0, 26.0)], "v int, s double, e double")
    t = spark.createDataFrame([(0, 30.0)], "v int, total_s double")
    assert [r.present for r in windows.presence_bins(e, t, ["v"], "s", "e").orderBy("bin").collect()] == [1, 0, 0, 0, 1, 1]


def test_average_precision(spark):
    d = spark.createDataFrame([(0, 0.9, 1, "a", 3), (0, 0.8, 1, "b", 3), (0, 0.7, 1, "c", 3)], "s int, confidence double, hit long, key string, n_gt long")
    assert greedy.average_precision(d, ["s"]).first().ap == pytest.approx(1.0)


def test_precision_recall_over_ranges(spark):
    """Groups that spread over several ranges, ties of confidence, a null group and one without truths, against a plain loop."""
    rng = np.random.default_rng(11)
    rows = [(g, float(rng.integers(0, 8)) / 8, int(rng.random() < 0.4), i, n) for g, n in ((0, 300), (1, 5), (None, 40), (2, 0)) for i in range(400 if g == 0 else 30)]
    d = spark.createDataFrame(rows, "s int, confidence double, hit long, key long, n_gt long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        parts = len(lineage.settled(d.repartitionByRange("s", F.desc("confidence"), "key")).select("s", F.spark_partition_id()).distinct().collect())
        got = {(r.s, r.key): r for r in greedy.sequence_matches(d, ["s"]).collect()}
        ap = {r.s: r.ap for r in greedy.average_precision(d, ["s"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows) and parts > 4
    for s in (0, 1, None, 2):
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (-r[1], r[3]))
        hits = np.cumsum([r[2] for r in mine])
        precision = hits / np.arange(1, len(mine) + 1)
        envelope = np.maximum.accumulate(precision[::-1])[::-1]
        n = mine[0][4]
        for i, r in enumerate(mine):
            g = got[s, r[3]]
            assert (g.tp, g.n) == (hits[i], i + 1) and g.envelope == pytest.approx(envelope[i]) and g.precision == pytest.approx(precision[i])
            assert g.recall == (pytest.approx(hits[i] / n) if n else None)
        assert ap[s] == (pytest.approx(sum(r[2] / n * e for r, e in zip(mine, envelope, strict=True))) if n else None)


def test_precision_recall_in_linear_time(spark):
    """One range of many rows: no window over them may run to its end, which Spark computes anew for every row."""
    n = 20_000
    d = spark.range(n, numPartitions=1).selectExpr("0 AS s", "CAST(id * 7919 % 500 AS double) AS confidence", "CAST(id * 31 % 7 < 3 AS long) AS hit", "id AS key", "9000L AS n_gt")
    got = greedy.sequence_matches(d, ["s"])
    to_the_end = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "unboundedfollowing" in x]
    assert all("max(__top" in x for x in to_the_end)  # of a row a range
    rows = {r.key: r.envelope for r in got.collect()}
    i = np.arange(n)
    order = np.lexsort((i, -(i * 7919 % 500)))
    precision = np.cumsum(i[order] * 31 % 7 < 3) / np.arange(1, n + 1)
    assert [rows[k] for k in order] == pytest.approx(np.maximum.accumulate(precision[::-1])[::-1].tolist())


def test_icc(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(10, 3, 40)
    rows = lambda y: spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double")
    assert agreement.icc(rows(x), ["a", "b"]).first().icc == pytest.approx(1.0)
    shifted = agreement.icc(rows(x + 2), ["a", "b"]).first()
    assert shifted.icc < 1
    noisy = agreement.icc(rows(x + rng.normal(0, 1, 40)), ["a", "b"]).first().asDict()
    lo, hi = agreement.icc_interval(noisy)
    assert -1 <= lo < noisy["icc"] < hi <= 1


def test_bland_altman(spark):
    d = spark.createDataFrame([(float(i + i % 3), float(i)) for i in range(30)], "m double, h double")
    r = agreement.bland_altman(d, "m", "h").first().asDict()
    assert r["loa_low"] < r["bias"] < r["loa_high"] and r["bias"] == pytest.approx(1.0)
    i = agreement.bland_altman_intervals(r)
    assert i["bias_ci_low"] < 1 < i["bias_ci_high"] and 0 <= i["slope_p"] <= 1


def test_weighted_kappa(spark):
    order = ["0-4", "5-7", "8-10", "11+"]
    rows = lambda p: spark.createDataFrame(p, "a string, b string")
    k = lambda p, w=1: agreement.weighted_kappa(rows(p), "a", "b", order, w).first().kappa
    same = [(x, x) for x in order] * 5
    near, far = same + [("0-4", "5-7")] * 4, same + [("0-4", "11+")] * 4
    assert k(same) == pytest.approx(1.0) and k(near) > k(far)
    assert k(same + [("0-4", "unknown")]) == pytest.approx(1.0)


def test_pitch(spark):
    assert (pitch.line_x(65.0), pitch.line_x(65.0, False)) == (7.5, -7.5)
    assert len(pitch.landmarks()) == 31
    img = np.array([[60.0, 640], [1220, 640], [980, 300], [300, 300]])
    world = np.array([[-72.5, -44.0], [72.5, -44], [72.5, 44], [-72.5, 44]])
    h, inliers = pitch.fit(img, world)
    assert inliers.all() and np.abs(pitch.apply(h, img) - world).max() < 1e-6
    five = np.vstack([img, [640, 430]]), np.vstack([world, [0, 0]])
    e = pitch.errors(pitch.fit(*five)[0], *five)
    assert e["n"] == 5 and e["rmse_m"] < 25
    r = one(spark, **pitch.project(F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in h]), F.lit(60.0), F.lit(640.0)))
    assert (r.pitch_x, r.pitch_y) == pytest.approx((-72.5, -44.0), abs=1e-6)
    z = spark.createDataFrame([(72.5, 44.0), (7.5, -44.0), (0.0, 0.0)], "x double, y double").select(pitch.zone("x", "y")).collect()
    assert [r[0] for r in z] == [9, 1, None]


# Times of events as noted, and the stretches they make (10 s before, 25 s after).
def test_segments_merge(spark):
    d = spark.createDataFrame([(0, t) for t in (5.0, 20.0, 100.0, 135.0, 300.0)], "v int, t_s double")
    got = [(r.start_s, r.end_s, r.n_events) for r in sampling.segments(d, ["v"]).orderBy("segment_id").collect()]
    assert got == [(0.0, 45.0, 2), (90.0, 125.0, 1), (125.0, 160.0, 1), (290.0, 325.0, 1)]
    touching = sampling.segments(d, ["v"], touching=True).orderBy("segment_id").collect()
    assert [(r.start_s, r.n_events) for r in touching] == [(0.0, 2), (90.0, 2), (290.0, 1)]


def test_window_cover(spark):
    d = spark.createDataFrame([(0, float(t)) for t in (100, 200, 300, 1000, 1100, 5000)], "v int, t_s double")
    got = [(r.start_s, r.end_s, r.covered) for r in greedy.cover_windows(d, ["v"], 720.0, 20.0, 2).orderBy("window").collect()]
    assert got == [(80.0, 800.0, 3), (980.0, 1700.0, 2)]


def test_sliding_window_grid(spark):
    n = spark.range(1).select(F.size(windows.starts(F.lit(18000), 75, windows.half_even(0.5 * 25)))).first()[0]
    assert n == 1494 and windows.half_even(12.5) == 12
    with pytest.raises(ValueError):
        windows.rule_score(spark.range(1), [], ("nothing",))


def test_series(spark):
    d = spark.createDataFrame([(0, i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])], "v int, frame_idx long, x double")
    assert [r.x for r in series.interpolate(d, "x", ["v"]).orderBy("frame_idx").collect()] == [1, 1, 2, 3, 3]
    s = spark.createDataFrame([(0, 0, []), (0, 1, []), (0, 2, [1, 2]), (0, 3, [2, 3])], "v int, frame_idx long, ids array<bigint>")
    churn = lambda compat: [r[0] for r in s.select("frame_idx", series.churn("ids", ["v"], compat=compat).alias("c")).orderBy("frame_idx").select("c").collect()]
    assert churn(True)[:2] == [None, 1.0] and churn(False)[1] == 0.0 and churn(True)[3] == pytest.approx(2 / 3)
    n = spark.createDataFrame([(0, 3)], "v int, n_frames long")
    assert series.dense(spark.createDataFrame([(0, 1, 5)], "v int, frame_idx long, x long"), n, ["v"]).count() == 3


def test_joins_agree_with_nested_loops(spark):
    rng = np.random.default_rng(5)
    e = spark.createDataFrame([(int(i % 2), int(i), float(a), float(a + d)) for i, (a, d) in enumerate(zip(rng.uniform(0, 100, 60), rng.uniform(0, 30, 60), strict=True))], "g int, id long, s double, e double")
    p = spark.createDataFrame([(int(i % 2), int(i), float(t)) for i, t in enumerate(rng.uniform(0, 130, 200))], "g int, pt long, t double")
    naive = e.join(p, "g").where("t BETWEEN s AND e").select("id", "pt")
    got = joins.points_in_intervals(e, p, "s", "e", "t", 10.0, ["g"]).select("id", "pt")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, naive.collect()))
    outside = {r.pt for r in joins.points_outside(p, e, "t", "s", "e", 10.0, ["g"]).collect()}
    assert outside == {r.pt for r in p.collect()} - {r.pt for r in naive.collect()}


def test_assignment_and_mot(spark):
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = (int(x) for x in rng.integers(1, 6, 2))
        c = rng.random((n, m))
        best = min(sum(c[i, q[i]] for i in range(n)) for q in itertools.permutations(range(m), n)) if n <= m else min(sum(c[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert sum(c[i, j] for i, j in mot.assignment(c)) == pytest.approx(best)
    cols = "b int, frame_idx long, {0}_id long, {1}_x1 double, {1}_y1 double, {1}_x2 double, {1}_y2 double"
    box = lambda f, i: (0, f, i, 10.0 * i, 0.0, 10.0 * i + 8, 8.0)
    gt = spark.createDataFrame([box(f, i) for f in range(3) for i in (1, 2)], cols.format("gt", "g"))
    perfect = mot.mot_scores(spark.createDataFrame([box(f, i) for f in range(3) for i in (1, 2)], cols.format("pred", "p")), gt, ["b"]).first()
    assert perfect.mota == 1 and perfect.idf1 == 1 and perfect.switches == 0
    swapped = [(b, f, 3 - i if f == 2 else i, *rest) for b, f, i, *rest in (box(f, i) for f in range(3) for i in (1, 2))]
    r = mot.mot_scores(spark.createDataFrame(swapped, cols.format("pred", "p")), gt, ["b"]).first()
    assert r.switches == 2 and r.mota == pytest.approx(1 - 2 / 6) and r.idf1 == pytest.approx(4 / 6)


def test_contracts(spark, tmp_path):
    ok = spark.createDataFrame([(0, "unassigned", 0.5, 3, "manual")], "track_id long, team string, confidence double, n_crops long, method string")
    assert contracts.validate(ok, "track_teams").columns == contracts.schema_of("track_teams").names
    bad = {
        "range": ok.withColumn("confidence", F.lit(1.5)), "enum": ok.withColumn("team", F.lit("team_c")), "key": ok.unionByName(ok),
        "missing": ok.drop("team"), "extra": ok.withColumn("more", F.lit(1)),
    }
    for rule, df in bad.items():
        with pytest.raises(contracts.ContractError, match=rule):
            contracts.validate(df, "track_teams")
    assert "more" not in contracts.validate(bad["extra"], "track_teams", strict=False).columns
    with pytest.raises(contracts.ContractError):
        contracts.validate(ok, "nothing")
    contracts.write_table(ok, "track_teams", str(tmp_path / "t"))
    assert contracts.read_table(spark, "track_teams", str(tmp_path / "t")).collect() == contracts.validate(ok, "track_teams").collect()
    assert all(contracts.schema_of(n) for n in contracts.CONTRACTS) and len(contracts.CONTRACTS) == 20


def test_files(spark, tmp_path):
    (tmp_path / "b1").mkdir()
    (tmp_path / "b1" / "gt.txt").write_text("1,7,10,20,5,6,1,1,1\n2,8,10,20,5,6,0,1,1\n")
    r = files.read_mot(spark, str(tmp_path / "b1" / "gt.txt"), True).collect()
    assert [(x.block_id, x.gid, x.x2, x.y2, x.area) for x in r] == [("b1", "b1_7", 15.0, 26.0, 30.0)]
    frames = spark.createDataFrame([(1,), (2,), (3,)], "frame long")
    assert files.frame_base(frames, spark.range(0, 3)) == 1 and files.frame_base(frames, spark.range(1, 4)) == 0 and files.frame_base(frames, None) == 1
    (tmp_path / "times.txt").write_text("# noted\n1. 1:05\n2) 0:10, 1:00:00\nnothing\n")
    assert sorted(x.seconds for x in files.read_times(spark, str(tmp_path / "times.txt")).collect()) == [10.0, 65.0, 3600.0]
    m = files.frame_manifest(spark, 3, 25.0, "f", "v").orderBy("frame_idx").collect()
    assert [x.path for x in m] == ["f/000000.jpg", "f/000001.jpg", "f/000002.jpg"] and m[1].timestamp_s == 0.04
    files.write_once(frames, str(tmp_path / "once"))
    with pytest.raises(FileExistsError):
        files.write_once(frames, str(tmp_path / "once"))
    files.append_log(frames, str(tmp_path / "once"))
    assert spark.read.option("header", True).csv(str(tmp_path / "once")).count() == 6
    with pytest.raises(PermissionError):
        files.refuse(spark.createDataFrame([("held",)], "video_id string"), ["held"])
    assert files.run_id({"video": 1}) == files.run_id({"video": 1, "pitch": 2}) != files.run_id({"video": 2})
    assert files.markdown(frames.limit(1)).startswith("| frame |") and files.merge_json({"a": None, "b": '{"x": 1}'}) == {"a": {}, "b": {"x": 1}}
    probe = spark.createDataFrame([('{"streams": [{"width": 1280, "height": 720, "codec_name": "h264", "avg_frame_rate": "30000/1001"}], "format": {"duration": "12.5"}}',)], "j string")
    assert tuple(probe.select(*[c.alias(n) for n, c in files.probe_row("j").items()]).first()) == (1280, 720, "h264", 12.5, 29.97)
    contracts.write_table(spark.createDataFrame([("e", 0.0, 1.0, 0.5, 1.0, 0.5, 3, "rule")], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in contracts.schema_of("events_pred"))), "events_pred", str(tmp_path / "events_pred.csv"))
    assert files.register_run(spark, str(tmp_path)) == ["events_pred"]
    assert files.sql(spark, "SELECT * FROM events_pred", 1).count() == 1


def test_clock(spark):
    d = spark.createDataFrame([("1:02:03",), ("2:03,",), ("45 kick",), ("x",), (None,)], "t string")
    assert [r[0] for r in d.select(timebase.clock_seconds("t")).collect()] == [3723.0, 123.0, 45.0, None, None]
    assert one(spark, c=timebase.seconds_clock(F.lit(3723.5))).c == "01:02:03.500"


def test_coding_reports_why(spark):
    ev = spark.createDataFrame([("a", 10.0, 12.0), ("b", 10.0, 12.0), ("c", 99.0, 100.0)], "event_id string, t_start_s double, t_peak_s double")
    rows = [("a", 1, 9.5, t, team, x, y, 1.0) for t, team, x, y in [(1, "team_a", -60.0, 0.0), *[(10 + i, "team_a", 10.0 + i, 0.0) for i in range(4)], *[(20 + i, "team_b", 10.0 + i, 0.5) for i in range(5)]]]
    rows += [("a", 2, 12.0, t, team, x, y, 1.0) for t, team, x, y in [(10, "team_a", 30.0, 0.0), (20, "team_b", 30.0, 1.0), (21, "team_b", 40.0, 1.0)]]
    rows += [("b", 1, 9.5, 1, "unassigned", 0.0, 0.0, 1.0)]
    p = spark.createDataFrame(rows, "event_id string, frame_idx long, timestamp_s double, track_id long, team string, pitch_x double, pitch_y double, sign double")
    got = {r.event_id: r for r in coding.code_events(ev, p, ["event_id"]).collect()}
    a = got["a"]
    assert (a.codeable, a.kicking_team, a.defending_team, a.n_defenders_in_65, a.n_defenders_band) == (1, "team_a", "team_b", 5, "5-7")
    assert (a.defensive_strategy, a.contested_proxy, a.distance_class) == ("player_to_player", "contested", "long")
    assert (got["b"].codeable, got["b"].reason_not_codeable) == (0, "all tracks unassigned")
    assert got["c"].reason_not_codeable == "no registered tracks in setup window"


def test_image_features(spark):
    t = spark.createDataFrame([(0, i, f, 10.0 * i, 5.0 * f, 20.0) for i in range(5) for f in range(12)], "v int, track_id long, frame_idx long, cx double, cy double, bbox_h double")
    n = spark.createDataFrame([(0, 14)], "v int, n_frames long")
    d = features.image_features(t, n, ["v"]).orderBy("frame_idx").collect()
    assert len(d) == 14 and d[0].n_tracks == 5 and d[13].n_tracks == 0 and d[13].scene_change_flag == 1 and d[5].valid_frame == 1
    assert d[10].mean_vertical_velocity == pytest.approx(-5.0 * 25) and math.isclose(d[0].centroid_spread_px, math.sqrt(200), rel_tol=1e-9)
    assert features.canonical(features.image_features(t, n, ["v"]), ["v"]).columns[-1] == "feature_space"


def test_bootstrap(spark):
    d = spark.createDataFrame([("TP",)] * 30 + [("FP",)] * 10 + [("FN",)] * 10, "kind string")
    r = agreement.bootstrap_f1(d).first()
    assert r.f1 == pytest.approx(0.75) and r.ci_low < 0.75 < r.ci_high


def test_cover_windows_start_at_zero_and_stop(spark):
    from tessera.operators import greedy

    t = spark.createDataFrame([(0, 5.0), (0, 25.0), (0, 30.0), (0, 200.0)], "g int, t_s double")
    got = greedy.cover_windows(t, ["g"], 60.0, 20.0, 3).collect()
    assert [(r.start_s, r.covered) for r in sorted(got, key=lambda r: r.window)] == [(0.0, 2), (180.0, 1)]  # a window from 0 covers from 20 s on; 5 s lies before that
    assert greedy.cover_windows(t, ["g"], 30.0, 20.0, 3).count() == 0


def test_f1_of_no_hits_is_zero(spark):
    from tessera.functions import stats

    r = spark.createDataFrame([(0, 3, 4)], "tp int, fp int, fn int").select(*[v.alias(k) for k, v in stats.precision_recall("tp", "fp", "fn").items()]).first()
    assert r.precision_value == 0.0 and r.recall_value == 0.0 and r.f1_value == 0.0


def test_track_ids_and_effort(spark):
    from tessera.operators import review

    b = spark.createDataFrame([(0, -1), (0, 3), (0, 5), (0, 5), (1, -1)], "g int, id int")
    got = {r.g: tuple(r)[1:] for r in review.track_ids(b, ["g"], "id").collect()}
    assert got == {0: (4, 1, 2, 3, 5, 1), 1: (1, 1, 0, None, None, 0)}
    hours = spark.range(1).select(review.effort(F.lit(3600.0)).alias("e")).first().e
    assert [(x.seconds_per_box, x.hours) for x in hours] == [(1.5, 1.5), (2.5, 2.5), (4.0, 4.0)]


def test_kinds_in_order(spark):
    from tessera.operators import review

    d = spark.createDataFrame([("FN", 1), ("TP", 2), ("FP", 3), ("TP", 1)], "kind string, k int")
    assert [(r.kind, r.k) for r in review.in_kind_order(d, within=("k",)).orderBy("place").collect()] == [("TP", 1), ("TP", 2), ("FP", 3), ("FN", 1)]


def test_bootstrap_of_any_statistic(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(1, 9, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    d = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    ratio = F.col("x") / F.nullif(F.col("y"), F.lit(0.0))
    r = agreement.bootstrap(d, {"x": F.col("x"), "y": F.col("y")}, ratio, 4000).first()
    draws = rng.integers(0, 300, (4000, 300))
    low, high = np.quantile(x[draws].sum(axis=1) / y[draws].sum(axis=1), [0.025, 0.975])
    assert r.n == 300 and r.value == pytest.approx(x.sum() / y.sum())
    assert r.ci_low == pytest.approx(low, abs=0.03) and r.ci_high == pytest.approx(high, abs=0.03)
    again = agreement.bootstrap(d.repartition(7), {"x": F.col("x"), "y": F.col("y")}, ratio, 4000).first()
    assert (again.ci_low, again.ci_high) == pytest.approx((r.ci_low, r.ci_high))  # the same draws, however rows are dealt
    none = agreement.bootstrap(d.limit(0), {"x": F.col("x"), "y": F.col("y")}, ratio, 50).first()
    assert tuple(none) == (0, None, None, None)


def test_weighted_kappa_interval(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 4, 200)
    b = np.clip(a + rng.integers(-1, 2, 200), 0, 3)
    d = spark.createDataFrame([(str(i), str(j)) for i, j in zip(a, b, strict=True)] + [("9", "1"), (None, "1")], "a string, b string")
    r = agreement.weighted_kappa_interval(d, "a", "b", ["0", "1", "2", "3"], 2).first()
    assert r.n == 200 and r.kappa == pytest.approx(agreement.weighted_kappa(d, "a", "b", ["0", "1", "2", "3"], 2).first().kappa)
    w = (np.subtract.outer(np.arange(4), np.arange(4)) / 3) ** 2

    def kappa(i, j):
        o = np.histogram2d(i, j, bins=[np.arange(5)] * 2)[0] / len(i)
        return 1 - (w * o).sum() / (w * np.outer(o.sum(axis=1), o.sum(axis=0))).sum()

    low, high = np.quantile([kappa(a[s], b[s]) for s in rng.integers(0, 200, (2000, 200))], [0.025, 0.975])
    assert r.ci_low == pytest.approx(low, abs=0.02) and r.ci_high == pytest.approx(high, abs=0.02)


def test_agreement_of_labels_and_counts(spark):
    d = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), (None, "y"), ("x", None)], "p string, t string")
    assert {r.label: (r.n, r.recall) for r in agreement.class_recall(d, "t", "p").collect()} == {"x": (1, 1.0), "y": (2, 0.5)}
    b = agreement.binary_agreement(d, "p", "t", "x").first()
    assert (b.tp, b.fp, b.fn, b.tn) == (1, 2, 0, 2) and b.recall_value == 1.0
    c = spark.createDataFrame([(5, 5, 0), (5, 6, 2), (5, 9, 4), (None, 1, 9)], "p int, t int, u int")
    r = agreement.count_agreement(c, "p", "t", "u").first()
    assert (r.n, r.mae, r.median_uncertainty) == (3, pytest.approx(5 / 3), 2.0) and r.exact_value == pytest.approx(1 / 3) and r.within_one_value == pytest.approx(2 / 3)


def test_choices_for_annotation(spark):
    from tessera.operators import review

    s = spark.createDataFrame([(0, 100.0), (1, 5.0), (2, 0.0)], "v int, duration double")
    got = review.recode_blocks(s, ["v"], "duration", 10.0).collect()
    assert sum(r.v == 0 for r in got) == 2 and [(r.block, r.end_s) for r in got if r.v == 1] == [(0, 5.0)] and not any(r.v == 2 for r in got)
    blocks = spark.createDataFrame([(0, 0.0, 10.0), (0, 5.0, 15.0), (0, 20.0, 30.0), (0, 40.0, 50.0)], "v int, t_start_s double, t_end_s double")
    events = spark.createDataFrame([(0, 6.0), (0, 7.0), (0, 12.0), (0, 25.0)], "v int, t double")
    barred = spark.createDataFrame([(0, 29.0, 33.0)], "v int, a double, b double")
    assert [(r.t_start_s, r.n_events) for r in review.annotation_blocks(blocks, events, barred, ["v"], "t", ("a", "b"), 10.0, 3).collect()] == [(5.0, 3)]
    m = spark.createDataFrame([(0, "TP", 0.9, 3.0, 1), (0, "TP", 0.8, 50.0, 2), (0, "TP", 0.7, 60.0, 3), (0, "FN", None, 20.0, 4), (0, "FP", 0.1, 98.0, 5)], "v int, kind string, confidence double, t double, k int")
    assert [(r.start_s, r.end_s, r.kind) for r in review.pick_segments(m, ["v"], "t", ["k"], 100.0).orderBy("place").collect()] == [(0.0, 9.0, "TP"), (14.0, 26.0, "FN"), (44.0, 56.0, "TP"), (92.0, 100.0, "FP")]


def test_sinks_write(spark, tmp_path):
    import json

    files.write_json(spark.createDataFrame([(1, None), (2, "é")], "a int, b string"), str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == [{"a": 1, "b": None}, {"a": 2, "b": "é"}]
    where = files.write_provenance(spark, str(tmp_path / "out.parquet") + "/", "s05", {"video": {"fps": 25}}, rows=3)
    told = json.loads((tmp_path / "out.parquet.provenance.json").read_text())
    assert where.endswith("out.parquet.provenance.json") and (told["stage"], told["rows"], told["run_id"]) == ("s05", 3, files.run_id({"video": {"fps": 25}}))


def test_callables(spark):
    from tessera.functions import callables

    callables.register(spark)
    callables.register(spark)  # again is no error
    r = spark.sql("SELECT interval_iou(0, 2, 1, 3) AS a, interval_iou(0, 1, 5, 6) AS b, interval_iou(1, 1, 1, 1) AS c, wilson_low(0, 10) AS d").first()
    assert r.a == pytest.approx(1 / 3) and r.b == 0.0 and r.c is None and r.d == pytest.approx(0.0, abs=1e-12)
    w = spark.sql("SELECT g, weighted_median(v, w) AS m FROM VALUES (0, 1D, 1D), (0, 5D, 3D), (1, 2D, 0D), (2, NULL, 1D) AS t(g, v, w) GROUP BY g").collect()
    assert {r.g: r.m for r in w} == {0: 5.0, 1: None, 2: None}
    s = spark.sql("SELECT t.w_start FROM VALUES (5L), (30L), (CAST(NULL AS BIGINT)) AS s(n), LATERAL window_starts(s.n, 10, 8) t").collect()
    assert sorted(x.w_start for x in s) == [0, 0, 8, 16]
