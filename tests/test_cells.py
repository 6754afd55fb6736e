"""Pairs by cells of blocks, held against brute force over several blocks."""

import itertools

import numpy as np
import pytest

from tracewell.functions import kernels, pairwise
from tracewell.operators import cells, matching, similarity

RNG = np.random.default_rng(5)
TRACES = {(r, i): RNG.gamma(1.0, 2.0, 12) for r, n in ((0, 23), (1, 9), (2, 1)) for i in RNG.permutation(200)[:n]}
TRACES[(1, 500)] = np.full(12, 3.0)


@pytest.fixture(scope="module")
def arrays(spark):
    return spark.createDataFrame([(r, int(i), [float(v) for v in x]) for (r, i), x in TRACES.items()], "recording_id int, roi_idx long, f array<double>")


def brute(f):
    return {(r, i, j): f(TRACES[r, i], TRACES[r, j]) for (r, i), (s, j) in itertools.product(TRACES, TRACES) if r == s and i < j}


def z(x):
    return (x - x.mean()) / x.std() if x.std() > 1e-8 else x * 0


def corr(x, y):
    return float(z(x) @ z(y) / len(x))


def lagged(x, y, most):
    a, b, n = z(x), z(y), len(x)
    return min(1.0, max(0.0, *[float(a[max(0, k) : n + min(0, k)] @ b[max(0, -k) : n - max(0, k)]) / (n - abs(k)) for k in range(-most, most + 1)]))


def weighted(x, y):
    w = np.maximum(np.abs(x), np.abs(y)) ** 2
    mean = lambda v: (w * v).sum() / w.sum()
    d = np.sqrt(max(0, mean(x * x) - mean(x) ** 2) * max(0, mean(y * y) - mean(y) ** 2))
    return (mean(x * y) - mean(x) * mean(y)) / d if d > 1e-12 else 0.0


MEASURES = {
    "pearson": (pairwise.Pearson(), corr, "value"), "lagged": (pairwise.CrossCorrelation(2), lambda x, y: lagged(x, y, 2), "value"),
    "weighted": (pairwise.WeightedPearson(), weighted, "value"), "distance": (pairwise.Distance(), lambda x, y: 1 - corr(x, y), "distance"),
    "warping": (pairwise.SoftWarping(), lambda x, y: kernels.soft_dtw(z(x), z(y)), "distance")}


@pytest.mark.parametrize("name", MEASURES)
def test_pairs_of_several_blocks_equal_brute_force(spark, arrays, name):
    measure, f, column = MEASURES[name]
    got = cells.all_pairs(arrays, ["recording_id"], "roi_idx", measure, f"{column} double", size=7).collect()
    want = brute(f)
    assert len(got) == len(want) and {(r["recording_id"], r["i"], r["j"]): r[column] for r in got} == pytest.approx(want, abs=1e-6)


def test_uneven_and_null_traces_have_no_value(spark):
    rows = spark.createDataFrame([(0, 1, [1.0, 2.0, 4.0]), (0, 2, [2.0, 1.0, 0.0]), (0, 3, [1.0, 2.0]), (0, 4, [1.0, None, 2.0]), (0, 5, None), (None, 6, [1.0, 2.0, 4.0])], "recording_id int, roi_idx int, f array<double>")
    got = {(r["i"], r["j"]): r["value"] for r in similarity.pearson_pairs(rows).collect()}
    assert len(got) == 10 and [k for k, v in got.items() if v is not None] == [(1, 2)]


def test_long_warping_is_done_in_logarithms():
    x, y = RNG.normal(size=(3, 90)), RNG.normal(size=(2, 90)) * 9
    m = pairwise.SoftWarping()
    got = m.matrix(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), 90)
    assert got == pytest.approx(np.array([[kernels.soft_dtw(a, b) for b in y] for a in x]))
    far = m.matrix(np.array([[0.0, 0.1]] * 9), np.array([[20.0, 0.2]] * 9), 9)  # exp(-3600) is 0
    assert far == pytest.approx(np.array([[kernels.soft_dtw(np.full(9, a), np.full(9, b)) for b in (20.0, 0.2)] for a in (0.0, 0.1)]))


def test_near_pairs_keep_the_rounded_threshold(spark, arrays):
    got = {(r["recording_id"], r["i"], r["j"]) for r in similarity.near_traces(arrays, 0.8, digits=6).collect()}
    assert got == {k for k, v in brute(lambda x, y: 1 - corr(x, y)).items() if round(v, 6) <= 0.8}


def test_significance_equals_the_incomplete_beta(spark, arrays):
    from tracewell.functions.special import student_two_sided

    for df in (1, 2, 3, 4, 9, 28, 57):
        t = np.array([0.0, 0.3, 1.7, 4.2, 9.0])
        assert pairwise.student_two_sided(t, df) == pytest.approx([student_two_sided(v, df) for v in t], abs=1e-12)
    got = similarity.significant_pairs(arrays).collect()
    assert len(got) == len(brute(corr)) and all(r["significant"] == (r["p"] < 0.05) for r in got)


def trains(n, most=9):
    return {i: np.sort(RNG.integers(0, 400, RNG.integers(1, most))) for i in range(n)}


def hits(a, b, dt):
    return sum(bool((np.abs(b - t) <= dt).any()) for t in a)


def test_coincidences_and_tiling_equal_brute_force(spark):
    t = trains(600, 4) | {700: np.array([5, 5, 390]), 701: np.arange(0, 400, 3)}
    times = spark.createDataFrame([(0, int(i), int(v)) for i, x in t.items() for v in x], "recording_id int, roi_idx long, t long")
    want = {(i, j): n for i in t for j in t if i != j and (n := hits(t[i], t[j], 4))}
    rows = matching.coincidence(times, 4).collect()
    assert len(rows) == len(want) and {(r["i"], r["j"]): r["hits"] for r in rows} == want and all(r["n_i"] == len(t[r["i"]]) for r in rows)
    few = times.filter("roi_idx % 20 = 0")
    tiled = {r["roi_idx"]: r["tiled"] for r in matching.tiled_fraction(few, 4, 0, 400, ["roi_idx"]).collect()}

    def sttc(i, j):
        half = lambda p, o: (p - o) / (1 - p * o) if p * o != 1 else 0.0
        return 0.5 * (half(hits(t[i], t[j], 4) / len(t[i]), tiled[j]) + half(hits(t[j], t[i], 4) / len(t[j]), tiled[i]))

    share = {(i, j): sttc(i, j) for i in tiled for j in tiled if i < j}
    rows = matching.trains(few, 4, 0, 400)
    got = cells.all_pairs(rows, ["recording_id"], "roi_idx", pairwise.SpikeTiling(4), size=7).collect()
    assert {(r["i"], r["j"]): r["value"] for r in got} == pytest.approx(share)


def test_coincidences_are_written_small(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = np.random.default_rng(43)
    rows = [(0, i, int(v)) for i in range(900) for v in rng.integers(0, 400, rng.integers(9, 20))]
    out = str(tmp_path / "out")
    matching.coincidence(spark.createDataFrame(rows, "recording_id int, roi_idx long, t long"), 4).write.parquet(out)
    parts = [pq.ParquetFile(p).metadata for p in (tmp_path / "out").glob("*.parquet")]
    groups = [m.row_group(g) for m in parts for g in range(m.num_row_groups)]
    n, most = sum(m.num_rows for m in parts), 900 * 899
    assert 0.95 * most < n < most  # so that pairs are missing here and there
    assert sum(g.column(c).total_compressed_size for g in groups for c in range(g.num_columns) if g.column(c).path_in_schema == "j") < 0.4 * n


def test_tiles_hold_every_nonzero_element_once():
    for shape in ((1, 1), (3, 8), (5, 255), (7, 256), (2, 257), (40, 700), (0, 9), (9, 0)):
        for share in (0, 0.3, 0.97, 1):
            x = (RNG.random(shape) < share) * RNG.integers(1, 9, shape)
            i, j = pairwise.nonzero_tiles(x, 256)
            assert len(i) == np.count_nonzero(x) and set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(x)), strict=True))


def test_equal_trains_stand_side_by_side():
    import pyarrow as pa

    times = [[3.0, 1.0], [], [5.0], [1.0, 3.0], [5.0], [2.0, 1.0, 9.0]]
    order = pairwise.Trains(pa.chunked_array([pa.array(times, pa.list_(pa.float64()))])).likeness()
    assert order.tolist() == [5, 0, 3, 2, 4, 1]


def test_running_counts_in_small_parts():
    import pyarrow as pa

    a, b = trains(40), trains(30, 20)
    sides = [pairwise.Trains(pa.chunked_array([pa.array([[float(v) for v in x] for x in s.values()])])) for s in (a, b)]
    want = np.array([[hits(x, y, 5) for y in b.values()] for x in a.values()])
    assert all((pairwise.near_counts(*sides, 5, most) == want).all() for most in (1, 50, 1 << 22))


def test_means_within_groups(spark, arrays):
    groups = arrays.selectExpr("recording_id", "roi_idx % 3 as group", "roi_idx as node")
    of = {}
    for (r, i, j), v in brute(corr).items():
        if i % 3 == j % 3:
            of.setdefault((r, i % 3), []).append(v)
    got = {(r["recording_id"], r["group"]): r["mean_similarity"] for r in similarity.mean_within_traces(groups, arrays, ["recording_id"]).collect()}
    assert set(got) == {(r, i % 3) for r, i in TRACES}
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: np.mean(v) for k, v in of.items()})


def masks(spark, seed):
    rng = np.random.default_rng(seed)
    sets = {(f, m): set(rng.integers(0, 90, rng.integers(1, 40)).tolist()) for f in (0, 1) for m in range(25)}
    rows = [(f, m, f"p{x}") for (f, m), s in sets.items() for x in s]
    return sets, spark.createDataFrame([*rows, *rows[:50], (0, None, "p1"), (0, 3, None)], "fov int, mask int, px string")


def test_mask_overlaps_equal_brute_force(spark, monkeypatch):
    (one, left), (two, right) = masks(spark, 1), masks(spark, 2)
    n = lambda k, s: len(s) + (k == (0, 3))  # noqa: E731  a null pixel counts, and meets none
    want = {(f, a, b): (c, round(c / (n((f, a), s) + n((f, b), u) - c), 6)) for (f, a), s in one.items() for (g, b), u in two.items() if f == g and (c := len(s & u))}
    monkeypatch.setattr(cells.across, "__defaults__", (7,))
    for dense in (0, 200):
        monkeypatch.setattr(pairwise, "DENSE", dense)
        got = matching.mask_iou(left, right, ["fov"], "mask", "px", digits=6).collect()
        assert len(got) == len(want) and {(r["fov"], r["a"], r["b"]): (r["common"], r["iou"]) for r in got} == want


def test_assigned_masks_equal_assigned_candidates(spark):
    left, right = masks(spark, 3)[1], masks(spark, 4)[1]
    got = matching.assign_masks(left, right, ["fov"], "mask", "px", 0.05)
    want = matching.assign(matching.mask_iou(left, right, ["fov"], "mask", "px"), ["fov"], "a", "b", "iou", 0.05)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() > 30


def test_linkage_by_chains_equals_greedy_merges(spark, arrays, monkeypatch):
    from tracewell.operators import graph

    for n in (2, 3, 40, 90):
        d = RNG.random((n, n))
        d = (d + d.T) / 2
        for most in (0.3, 0.45, 0.5):
            got = kernels.cut_merges(kernels.average_merges(d[np.triu_indices(n, 1)], n), n, most)
            assert (got == kernels.flat_clusters(kernels.linkage(d), n, most)).all()
    want = graph.hierarchical(similarity.max_crosscorr(arrays, 1), ["recording_id"], 0.6)
    monkeypatch.setattr(graph, "BLOCK", 5)
    got = graph.hierarchical_rows(arrays, ["recording_id"], "roi_idx", pairwise.CrossCorrelation(1, rows=3), 0.6)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == 33


def test_nearest_points_equal_brute_force(spark):
    from tracewell.operators import graph

    p = np.round(RNG.normal(size=(700, 2)) * 20)  # with ties and equal places
    for radius in (1.0, 6.0, 500.0):
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        want = {(i, j): d[i, j] for i in range(700) for j in sorted(set(range(700)) - {i}, key=lambda j: (d[i, j], j))[:3] if d[i, j] <= radius}
        i, j, far = kernels.nearest(p[:, 0], p[:, 1], 3, radius, rows=32)
        assert len(i) == len(want) and dict(zip(zip(i, j, strict=True), far, strict=True)) == want
    rows = spark.createDataFrame([(0, k + 5, float(x), float(y)) for k, (x, y) in enumerate(p)] + [(1, 1, 0.0, 0.0), (1, 2, None, 0.0)], "e int, node long, x double, y double")
    got = {(r["i"] - 5, r["j"] - 5): r["distance"] for r in graph.knn_edges(rows, ["e"], 3, 500.0).collect()}
    assert got == {(min(k), max(k)): v for k, v in want.items()}


def test_nearest_points_compare_few_points_each(monkeypatch):
    seen, real = [], np.partition
    monkeypatch.setattr(kernels.np, "partition", lambda d, *a, **k: seen.append(d.size) or real(d, *a, **k))
    x, y = RNG.normal(size=(2, 20_000)) * 125
    assert len(kernels.nearest(x, y, 3, 60.0)[0]) > 59_000 and sum(seen) < 1000 * len(x)
    seen.clear()
    x[:15_000], y[:15_000] = x[0], y[0]  # one place of many points
    i, j, d = kernels.nearest(x, y, 3, 60.0)
    here = i < 15_000
    assert here.sum() == 45_000 and (d[here] == 0).all() and j[here].max() == 3 and sum(seen) < 1000 * len(x)


def test_arrival_times_end_where_only_rounding_is_left():
    n = 40
    i, j = np.arange(n - 1), np.arange(1, n)
    t = np.cumsum(RNG.random(n))
    start = t + RNG.normal(size=n) * 1e-11
    got = kernels.sparse_arrivals(n, i, j, np.ones(n - 1), np.diff(t), np.zeros(n, dtype=int), start, lambda r: np.ones(n))
    assert got == pytest.approx(t - t[0], abs=1e-9)
    with pytest.raises(RuntimeError):
        kernels.sparse_arrivals(n, i, j, np.ones(n - 1), np.diff(t), np.zeros(n, dtype=int), np.zeros(n), lambda r: np.ones(n))


def test_arrival_times_along_edges_equal_the_matrix(monkeypatch):
    n = 900
    xy = RNG.normal(size=(n, 2))
    i, j, _ = kernels.nearest(xy[:, 0], xy[:, 1], 2, 10.0)  # several parts
    edges = np.unique(np.sort(np.column_stack([i, j]), axis=1), axis=0)
    lags, w = RNG.normal(size=len(edges)) * 3, RNG.random(len(edges))
    assert len(np.unique(kernels.parts(n, *edges.T))) > 5
    got = kernels.robust_arrivals(n, edges, lags, w)
    monkeypatch.setattr(kernels, "DENSE_NODES", n)
    for a, b in zip(got, kernels.robust_arrivals(n, edges, lags, w), strict=True):
        assert a == pytest.approx(b, abs=1e-7)


def test_a_graph_taken_apart_once_solves_any_lags_in_few_steps():
    n = 4000
    xy = RNG.normal(size=(n, 2))
    i, j, _ = kernels.nearest(xy[:, 0], xy[:, 1], 3, 10.0)
    edges = np.unique(np.sort(np.column_stack([i, j]), axis=1), axis=0)
    w = RNG.random(len(edges)) + 0.1
    graph = kernels.ArrivalGraph(n, edges, w)
    assert 1 < len(np.unique(graph.part)) < n / 100
    flow = w * RNG.normal(size=len(edges))
    right = np.bincount(edges[:, 1], flow, n) - np.bincount(edges[:, 0], flow, n)
    x = graph.solve(right)
    flow = w * (x[edges[:, 1]] - x[edges[:, 0]])
    assert np.bincount(edges[:, 1], flow, n) - np.bincount(edges[:, 0], flow, n) == pytest.approx(right, abs=1e-9)
    steps, solve = [0], graph.solve
    graph.solve = lambda r: steps.__setitem__(0, steps[0] + 1) or solve(r)
    lags = RNG.normal(size=len(edges)) * 3
    got = kernels.robust_arrivals(n, edges, lags, w, 3, graph)
    assert 0 < steps[0] < 150  # by the nodes' weights alone it takes hundreds for each of three systems
    graph.solve = None
    for a, b in zip(got, kernels.robust_arrivals(n, edges, lags, w, 3, graph), strict=True):
        assert a == pytest.approx(b, abs=1e-5)
    many = np.unique(np.sort(RNG.integers(0, 900, (40_000, 2)), axis=1), axis=0)
    assert kernels.ArrivalGraph(900, many, np.ones(len(many))).solve is None  # fills up, so it isn't taken apart


def test_lag_null_equals_plain_least_squares_and_keeps_its_tasks(spark):
    import zlib

    from tracewell.operators import imaging

    xy = RNG.normal(size=(2, 40, 2)) * 10
    rows = [(e, k, float(x), float(y)) for e in range(2) for k, (x, y) in enumerate(xy[e])]
    edges = [sorted({tuple(sorted(map(int, p))) for p in zip(*kernels.nearest(*xy[e].T, 3, 100.0)[:2], strict=True)}) for e in range(2)]
    lag = [[float(xy[e][b, 0] - xy[e][a, 0]) * 0.02 for a, b in edges[e]] for e in range(2)]  # too small to be weighed down
    coords = spark.createDataFrame(rows, "e int, node long, x double, y double")
    given = spark.createDataFrame([(e, a, b, v, 1.0) for e in range(2) for (a, b), v in zip(edges[e], lag[e], strict=True)], "e int, i long, j long, lag double, corr double")
    out = imaging.lag_null(given, coords, ["e"], 9)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
    for r in out.collect():
        e = r["e"]
        incidence = np.zeros((len(edges[e]), 40))
        for k, (a, b) in enumerate(edges[e]):
            incidence[k, a], incidence[k, b] = -1, 1

        def score(lags):
            t = np.linalg.lstsq(incidence, lags, rcond=None)[0]
            return max(kernels.linear_r2(np.column_stack([np.ones(40), xy[e]]), t), kernels.radial_scores(xy[e], t, 7)[0])

        part = kernels.parts(40, *np.array(edges[e]).T)
        if len(np.unique(part)) > 1:
            continue
        rng = np.random.default_rng(zlib.crc32(f"42|{(e,)}".encode()))
        null = [score(np.array(lag[e]) * rng.choice([-1.0, 1.0], len(lag[e]))) for _ in range(9)]
        s = score(np.array(lag[e]))
        assert r["score"] == pytest.approx(s, abs=1e-8) and r["p"] == pytest.approx((1 + sum(x >= s for x in null)) / 10)


def test_one_radial_grid_serves_many_values():
    xy = RNG.normal(size=(50, 2))
    around = kernels.radial_grid(xy)
    for values in RNG.normal(size=(3, 50)):
        (score, origin), (again, place) = kernels.radial_fit(around, values), kernels.radial_scores(xy, values)
        assert score == again and (origin == place).all()


#: Queries on pairs: no join makes rows of pairs that are compared by expressions, and no pairs are shuffled.
IN_CELLS = [
    "q45_sttc",
    "q48_ordinal_spearman",
    "q51_min_group_size",
    "q84_mean_within_groups",
    "q46_lagged_corr",
    "q49_combined_similarity",
    "q83_correlation_significance",
    "q43_coincidence",
    "q47_weighted_pearson",
    "q50_threshold_components",
    "q53_mask_iou",
    "q53b_assignment",
    "q52b_soft_dtw",
    "q52_average_linkage",
    "q101_recording_analysis",
]


@pytest.mark.parametrize("name", IN_CELLS)
def test_pairs_are_made_in_cells(spark, name):
    from tracewell.plans import spatial_queries, trace_queries  # noqa: F401
    from tracewell.plans.registry import QUERIES

    edges = name in ("q50_threshold_components", "q51_min_group_size")  # their rounds start from tables
    out = spatial_queries._distances(spark, "/root/testdata/sf0.001")[0] if edges else QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "zip_with" not in plan and "i#" not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_near_stars_connect_what_near_pairs_do_with_few_edges(spark):
    from pyspark.sql import functions as F

    from tracewell.operators import graph

    few = RNG.normal(size=(6, 5)).round(3)
    rows = [(k % 2, k, few[RNG.integers(6)].tolist()) for k in range(90)] + [(2, 90, [1.0] * 5)]
    arrays = spark.createDataFrame(rows, "recording_id long, roi_idx long, f array<double>")
    nodes = arrays.select("recording_id", F.col("roi_idx").alias("node"))
    pairs = similarity.near_traces(arrays, 0.3).selectExpr("recording_id", "i as a", "j as b")
    stars = similarity.near_stars(arrays, 0.3, size=16)
    label = [sorted(map(tuple, graph.components(nodes, e, ["recording_id"]).collect())) for e in (pairs, stars)]
    assert label[0] == label[1] and 0 < len({r[2] for r in label[0]}) < 30
    assert stars.count() < pairs.count()
