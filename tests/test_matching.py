"""Choices inside a group without its pairs, against plain loops over all of them."""

import numpy as np
import pytest

from tessera.operators import matching


def plain(s, e, order, gs, ge, rank, threshold):
    """The rule itself, over every pair."""
    inter = np.minimum(e[:, None], ge[None]) - np.maximum(s[:, None], gs[None])
    t = np.where(inter > 0, inter / np.where(inter > 0, (e - s)[:, None] + (ge - gs)[None] - inter, 1), 0.0)
    hit, best, left = np.full(len(s), -1), t.max(axis=1), np.ones(len(gs), dtype=bool)
    for p in order:
        ok = np.flatnonzero(left & (t[p] >= threshold) & (inter[p] > 0))
        if len(ok):
            g = min(ok, key=lambda j: (-t[p, j], rank[j]))
            hit[p], best[p], left[g] = g, t[p, g], False
    return hit, best


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("threshold", [0.01, 0.3, 0.5, 1.0])
def test_match_intervals(few, threshold):
    rng = np.random.default_rng(7)
    for n, m, span in ((1, 1, 5), (60, 50, 40), (300, 250, 60), (200, 400, 2000)):
        s, gs = rng.integers(0, span, n).astype(float), rng.integers(0, span, m).astype(float)
        e, ge = s + rng.integers(0, 9, n), gs + rng.integers(-1, 9, m)  # some empty, some inverted
        if not few:
            e, ge = e + rng.random(n), ge + rng.random(m)
        order, rank = rng.permutation(n), rng.permutation(m)
        got, want = matching.match_intervals(s, e, order, gs, ge, rank, threshold), plain(s, e, order, gs, ge, rank, threshold)
        assert (got[0] == want[0]).all() and got[1] == pytest.approx(want[1], abs=1e-12)


def test_dense_events_match_without_pairs(spark):
    """Half a billion overlapping pairs in one group: they must not be made."""
    from tessera.operators import greedy

    n = 20_000
    p = spark.range(n).selectExpr("0 AS g", "id AS pred_id", "CAST(id % 7200 AS double) AS p_start", "CAST(id % 7200 + 7200 * (1 + id % 3) AS double) AS p_end", "CAST(id * 7919 % 1000 AS double) AS confidence")
    t = spark.range(n + 500).selectExpr("0 AS g", "id AS gt_id", "CAST(id * 31 % 7200 AS double) AS g_start", "CAST(id * 31 % 7200 + 7200 * (1 + id % 3) AS double) AS g_end")
    from pyspark.sql import functions as F

    m = greedy.match_events(p, t, ["g"], 0.3, 7200.0)
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    got = {r.kind: (r.n, r.ids) for r in m.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("gt_id").alias("ids")).collect()}
    assert "Join" not in plan and "Generate" not in plan
    assert got["TP"][0] == got["TP"][1] and got["TP"][0] + got["FN"][0] == n + 500 and got["TP"][0] + got.get("FP", (0, 0))[0] == n


def test_null_groups_never_match(spark):
    from tessera.operators import greedy

    p = spark.createDataFrame([(None, 1, 0.0, 4.0, 0.5), (0, 2, 0.0, 4.0, None), (0, 3, None, 4.0, 0.1)], "g int, pred_id long, p_start double, p_end double, confidence double")
    t = spark.createDataFrame([(None, 7, 0.0, 4.0), (0, 8, 0.0, 4.0)], "g int, gt_id long, g_start double, g_end double")
    got = sorted((r.kind, r.pred_id, r.gt_id, r.confidence) for r in greedy.match_events(p, t, ["g"], 0.5, 5.0).collect() if r.kind != "FN")
    assert got == [("FP", 1, None, 0.5), ("FP", 3, None, 0.1), ("TP", 2, 8, None)]


@pytest.mark.parametrize("kind", ["spread", "grid", "line"])
def test_nearest_others(kind):
    rng = np.random.default_rng(3)
    for n in (2, 3, 50, 700):
        x, y = rng.random(n) * 100, rng.random(n) * 50
        if kind == "grid":
            x, y = np.floor(x / 5), np.floor(y / 5)
        if kind == "line":
            x[:] = 3.0
        d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
        np.fill_diagonal(d, np.inf)
        for k in (1, 6):
            assert matching.nearest_others(x, y, k) == pytest.approx(np.sort(d, axis=1)[:, : min(k, n - 1)].mean(axis=1), abs=1e-9)
    assert np.isnan(matching.nearest_others(np.zeros(1), np.zeros(1), 6)).all() and (matching.nearest(np.zeros(2), np.zeros(2), np.ones(1), np.zeros(1), 2)[0] == [[1, np.inf]] * 2).all()


def test_knn_mean_makes_no_pairs(spark):
    from tessera.operators import features

    d = spark.range(20_000).selectExpr("0 AS v", "id AS k", "CAST(id * 7919 % 20011 AS double) AS x", "CAST(id * 104729 % 20021 AS double) AS y")
    m = features.knn_mean(d, "x", "y", 6, ["v"], "k")
    assert "Join" not in m._jdf.queryExecution().optimizedPlan().toString() and m.count() == 1


def test_knn_mean_of_repeated_and_missing(spark):
    from tessera.operators import features

    rows = [(0, 1, 0.0, 0.0), (0, 1, 0.0, 9.0), (0, 2, 3.0, 0.0), (1, 1, 0.0, 0.0), (2, 1, 0.0, 0.0), (2, 2, 5.0, 0.0), (2, 3, None, 1.0), (None, 1, 0.0, 0.0), (None, 2, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "v int, k long, x double, y double")
    assert {r.v: r.knn_distance for r in features.knn_mean(d, "x", "y", 1, ["v"], "k").collect()} == {0: 3.0, 2: 5.0}


def test_equal_windows_are_coded_once(spark, monkeypatch):
    """A thousand events of two windows: two windows are coded, and each event gets its window's row; one without times is not coded, with its reason."""
    from tessera.operators import coding

    e = spark.range(1000).selectExpr("id AS event_id", "1 AS v", "CAST(id % 2 * 10 + 5 AS double) AS t_start_s", "CAST(id % 2 * 10 + 6 AS double) AS t_peak_s").unionAll(spark.sql("SELECT -1L, 1, CAST(NULL AS double), CAST(NULL AS double)"))
    p = spark.createDataFrame([(1, f, float(f), t, "team_a" if t % 2 else "team_b", float(20 + t * 3 + f), float(t), 1.0) for f in range(20) for t in range(12)], "v int, frame_idx long, timestamp_s double, track_id long, team string, pitch_x double, pitch_y double, sign double")
    seen, plain = [], coding.code_events
    monkeypatch.setattr(coding, "code_events", lambda events, *a, **k: (seen.append(events.count()), plain(events, *a, **k))[1])
    got = coding.code_series(e, p, ["v"], 4, gap_m=0.1).drop("v")
    assert seen == [3] and got.count() == 1001
    few = e.where("event_id < 2").drop("v")
    want = {r.event_id: r for r in plain(few, p.drop("v").crossJoin(few.select("event_id")), ["event_id"], gap_m=0.1).collect()}
    for r in got.where("event_id IN (0, 1, 2, 999, -1)").collect():
        if r.event_id < 0:
            assert (r.codeable, r.reason_not_codeable) == (0, "no registered tracks in setup window")
        else:
            assert r.codeable == 1 and r.asDict() == want[r.event_id % 2].asDict() | {"event_id": r.event_id}


def test_a_drained_stream_stays_out_of_the_driver(spark):
    """Its rows come from files, twice in a session too, and not from a table in memory."""
    from tessera.plans import streams
    from tests.conftest import DATA

    first, second = (streams.stream_session(spark, f"{DATA}/sf0.001") for _ in range(2))
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "MemoryPlan" not in plan and "LocalRelation" not in plan
    assert first.count() == second.count() > 0 and first.exceptAll(second).count() == 0


def test_box_pairs_and_their_matches():
    rng = np.random.default_rng(5)
    box = lambda n: np.column_stack([(lo := rng.integers(0, 40, (n, 2)).astype(float)), lo + rng.integers(-1, 25, (n, 2))])
    p, g = box(150), box(120)
    p[3, 1] = np.nan
    inter = np.clip(np.minimum(p[:, None, 2:], g[None, :, 2:]) - np.maximum(p[:, None, :2], g[None, :, :2]), 0, None).prod(axis=2)
    area = lambda b: (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    union = area(p)[:, None] + area(g)[None] - inter
    iou = np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)
    for least in (0.0, 0.2, 0.5):
        want = {(i, j): iou[i, j] for i in range(150) for j in range(120) if i != 3 and iou[i, j] >= least}
        for chunk in (7, 2_000_000):
            rows, cols, got = matching.box_pairs(p, g, least, chunk)
            assert {(i, j): x for i, j, x in zip(rows.tolist(), cols.tolist(), got.tolist(), strict=True)} == want
    own, other, taken, plain = rng.permutation(150), rng.permutation(120), set(), set()
    for i in sorted({i for i, _ in want}, key=lambda i: (-max(iou[i]), own[i])):
        free = [j for j in range(120) if (i, j) in want and j not in taken]
        if free:
            j = min(free, key=lambda j: (-iou[i, j], other[j]))
            taken.add(j)
            plain.add((i, j))
    m = matching.in_turn(rows, cols, got, own, other)
    m = m[matching.match_pairs(rows[m], cols[m])]
    assert set(zip(rows[m].tolist(), cols[m].tolist(), strict=True)) == plain


def test_boxes_of_a_frame_match_without_a_join(spark):
    from tessera.operators import greedy

    d = spark.range(4000).selectExpr("0 AS v", "id", "CAST(id * 7919 % 4001 AS double) AS x1", "CAST(id * 31 % 4001 AS double) AS y1")
    side = lambda p, key: d.selectExpr("v", f"id AS {key}", f"x1 AS {p}x1", f"y1 AS {p}y1", f"x1 + 20 AS {p}x2", f"y1 + 20 AS {p}y2")
    m = greedy.match_boxes(side("p_", "pred_id"), side("g_", "gt_id"), ["v"], (0.5, 0.9))
    assert "Join" not in m._jdf.queryExecution().optimizedPlan().toString()
    assert m.where("pred_id = gt_id AND iou = 1").groupBy("threshold").count().collect() and m.count() == 8000


def test_nearest_vectors(spark, monkeypatch):
    """Blocks of few rows, ties and equal vectors, against all pairs; vectors of another length or with a gap have no distance."""
    from tessera.operators import vectors

    monkeypatch.setattr(vectors, "QUERIES", 7)
    monkeypatch.setattr(vectors, "OTHERS", 11)
    rng = np.random.default_rng(2)
    v = rng.integers(0, 4, (90, 3)).astype(float) + 1000
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(200, [1.0]), (201, [None, 1.0, 2.0]), (202, None)]
    d = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    m = vectors.nearest(d.where("id % 3 = 0"), d, "id", "v", 5)
    want = {(q, i, round(float(np.sqrt(((v[q] - v[i]) ** 2).sum())), 6)) for q in range(0, 90, 3) for i in sorted((i for i in range(90) if i != q), key=lambda i: (round(float(np.sqrt(((v[q] - v[i]) ** 2).sum())), 6), i))[:5]}
    assert {tuple(r) for r in m.collect()} == want


def test_sparse_assignments():
    from tessera.operators import mot

    rng = np.random.default_rng(9)
    for n, m, share in ((1, 1, 1.0), (12, 9, 0.15), (30, 40, 0.1), (25, 25, 0.5)):
        pairs = [(i, j) for i in range(n) for j in range(m) if rng.random() < share] or [(0, 0)]
        cost = rng.random(len(pairs))
        whole = np.full((n, m), 1e6)
        for (i, j), c in zip(pairs, cost, strict=True):
            whole[i, j] = c
        want = [(i, j) for i, j in mot.assignment(whole) if whole[i, j] < 1e6]
        assert mot.sparse_assignment([i for i, _ in pairs], [j for _, j in pairs], cost.tolist()) == want
        for most in (1, 2, 7):
            gain = dict(zip(pairs, rng.integers(1, most + 1, len(pairs)).tolist(), strict=True))
            square = np.array([[gain.get((i, j), 0) for j in range(m)] for i in range(n)], dtype=float)
            assert mot.most_gain(gain) == int(sum(square[i, j] for i, j in mot.assignment(-square)))


def test_scores_of_a_crowded_block():
    """Three thousand boxes a frame, which one matrix a frame would take hours for."""
    from tessera.operators import mot

    n = 3000
    pairs = lambda f: [(float(i), float((i + d) % n), 0.9 - d / 4) for i in range(0, n, 2) for d in (0, 1)]
    got = mot.score_frames(([*map(float, range(n))], [*map(float, range(n))], pairs(f)) for f in range(4))
    assert (got["matches"], got["switches"], got["id_tp"], got["misses"]) == (4 * n // 2, 0, 4 * n // 2, 4 * n // 2)


def test_boxes_meet_in_cells(spark):
    """Each pair once, whatever cells it shares, and none through a join of whole frames."""
    from tessera.operators import joins

    rng = np.random.default_rng(4)
    side = lambda p, n: spark.createDataFrame([(i % 2, i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(rng.integers(-20, 40, (n, 4)).tolist())], f"v int, {p}id long, {p}x1 double, {p}y1 double, {p}x2 double, {p}y2 double")
    a, b = side("p_", 80), side("g_", 70)
    want = a.join(b, "v").where("least(p_x2, g_x2) > greatest(p_x1, g_x1) AND least(p_y2, g_y2) > greatest(p_y1, g_y1)").select("p_id", "g_id").collect()
    got = joins.boxes_meeting(a, b, "p_", "g_", (7.0, 11.0), ["v"])
    assert sorted(got.select("p_id", "g_id").collect()) == sorted(want) and want
    assert "__bucket_x" in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def dense(spark, monkeypatch):
    """Events of few different times, more of a time than a piece holds, one without an id or a start, some without a group."""
    from tessera.operators import joins

    monkeypatch.setattr(joins, "PIECE", 7)
    rng = np.random.default_rng(19)

    def some(n, *names):
        rows = [(int(i) % 3 or None, int(i), float(a), float(a + d)) for i, (a, d) in enumerate(zip(rng.integers(0, 6, n), rng.integers(-1, 7, n), strict=True))] + [(1, None, 0.0, 5.0), (1, -1, None, 5.0)]
        return spark.createDataFrame(rows, f"g int, {names[0]} long, {names[1]} double, {names[2]} double")

    return some(300, "pred_id", "p_start", "p_end"), some(280, "gt_id", "g_start", "g_end")


def _unfolds_last(df):
    """Whether pairs become rows above the join alone."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.index("Generate") < plan.index("Join")


def test_overlapping_events_of_equal_times_meet_once(dense):
    from tessera.operators import greedy

    p, g = dense
    got = greedy.candidate_pairs(p, g, ["g"], 2.5)
    assert set(got.columns) == {*p.columns, *g.columns, "tiou"} and _unfolds_last(got)
    ours = [(x, y) for x in p.collect() for y in g.collect() if x.g is not None and x.g == y.g and None not in (x.p_start, y.g_start)]
    share = {}
    for x, y in ours:
        inter = min(x.p_end, y.g_end) - max(x.p_start, y.g_start)
        if inter > 0:
            share.setdefault((x.g, x.pred_id, x.p_start, y.gt_id, y.g_end), []).append(inter / (x.p_end - x.p_start + y.g_end - y.g_start - inter))
    rows = {}
    for r in got.collect():
        rows.setdefault((r.g, r.pred_id, r.p_start, r.gt_id, r.g_end), []).append(r.tiou)
    assert rows.keys() == share.keys() and all(rows[k] == pytest.approx(share[k]) for k in rows)


def test_points_of_equal_times_meet_once(dense):
    from pyspark.sql import functions as F

    from tessera.operators import joins

    e, p = dense[0], dense[1].select("g", "gt_id", F.col("g_start").alias("t"))
    got = joins.every_point_in_intervals(e, p, "p_start", "p_end", "t", 2.0, ["g"], twice=F.col("t") * 2)
    assert _unfolds_last(got)
    want = e.join(p, "g").where("t BETWEEN p_start AND p_end").selectExpr("g", "pred_id", "gt_id", "t", "p_end", "t * 2 AS twice")
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())) and got.count() > 5_000


@pytest.mark.parametrize("name", ["temporal_iou_pairs", "interval_join"])
def test_pair_queries_unfold_last(spark, name):
    from tessera.plans import catalogue
    from tests.conftest import DATA

    assert _unfolds_last(catalogue.queries()[name](spark, f"{DATA}/sf0.001"))


def test_to_digits_rounds_like_sql(spark):
    import duckdb
    from pyspark.sql import functions as F

    from tessera.functions.stats import to_digits

    x = [i / d for d in (128, 640, 3600, 7200, 18000, 36000) for i in range(1, d, 1 + d // 900)] + [-1.5e-6, 2.5e-6, -0.123, 1e300, 0.0, None]
    got = [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").coalesce(1).orderBy("i").select(to_digits(F.col("x"), 6).alias("y")).collect()]
    assert got == [r[0] for r in duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [x]).fetchall()]
    assert np.isnan(spark.sql("SELECT double('NaN') AS x").select(to_digits(F.col("x"), 6).alias("y")).first().y)
