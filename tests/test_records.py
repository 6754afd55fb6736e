"""Plane files, bundles, cells over days, tests between days and graph fronts, on generated files and against brute force."""

from __future__ import annotations

import itertools
import math
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell import scratch
from tracewell.functions import kernels, special
from tracewell.operators import inference, longitudinal, matching, models, summary, wave_tables, waves
from tracewell.plans import workflows
from tracewell.sources import bundles, planes


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("recordings")
    for k, name in enumerate(("1-1_Day1", "1-1_Day3", "broken")):
        d = root / name / "suite2p" / "plane0"
        d.mkdir(parents=True)
        f = np.arange(12, dtype=np.float32).reshape(3, 4) + k
        np.save(d / "F.npy", f)
        if name != "broken":
            np.save(d / "iscell.npy", np.array([[1, 0.9], [0, 0.2], [1, 0.7]]))
        if k == 0:
            np.save(d / "Fneu.npy", f / 2)
            np.save(d / "spks.npy", f * 3)
        stat = np.array([{"ypix": np.array([1, 2]), "xpix": np.array([3, 4]), "med": [1.5, 3.5], "lam": np.array([0.5, 0.5])}, {"ypix": np.array([7]), "xpix": np.array([8])}], dtype=object)
        np.save(d / "stat.npy", stat, allow_pickle=True)
        np.save(d / "ops.npy", np.array({"Ly": 5, "Lx": 6, "regPC": np.zeros((4, 4)), **({"fs": 7.5, "meanImg": np.ones((5, 6))} if k else {})}, dtype=object), allow_pickle=True)
        (root / name / "a.ome.xml").write_text('<OME><Pixels PhysicalSizeX="0.65"><Plane DeltaT="0"/><Plane DeltaT="50"/><Plane DeltaT="100"/><Plane DeltaT="190"/></Pixels></OME>')
        (root / name / "0.xml").write_text("<other/>")
    return str(root)


def test_planes_are_read_whole(spark, root):
    got = {r["folder"].split("/")[-3]: r for r in planes.discover_planes(spark, root).collect()}
    assert [got[k]["complete"] for k in ("1-1_Day1", "1-1_Day3", "broken")] == [True, True, False] and got["broken"]["missing"] == ["iscell.npy"]
    with pytest.raises(FileNotFoundError, match="broken"):
        planes.discover_planes(spark, root, require_all=True)
    t = {(r["folder"].split("/")[-3], r["roi_idx"]): r for r in planes.read_traces(spark, root).collect()}
    assert len(t) == 6 and t["1-1_Day1", 1]["f"] == [4, 5, 6, 7] and t["1-1_Day1", 1]["fneu"] == [2, 2.5, 3, 3.5] and t["1-1_Day1", 1]["spks"] == [12, 15, 18, 21]
    assert t["1-1_Day3", 0]["fneu"] == [0, 0, 0, 0] and t["1-1_Day3", 0]["spks"] is None and [t["1-1_Day3", k]["is_cell"] for k in range(3)] == [True, False, True]
    m = planes.read_masks(spark, root).filter(F.col("folder").contains("Day1")).orderBy("roi_idx").collect()
    assert (m[0]["ypix"], m[0]["xpix"], m[0]["y"], m[0]["x"]) == ([1, 2], [3, 4], 1.5, 3.5) and (m[1]["y"], m[1]["x"], m[1]["lam"]) == (7, 8, [1.0])
    s = {r["folder"].split("/")[-3]: r for r in planes.read_settings(spark, root).collect()}
    assert (s["1-1_Day1"]["fs"], s["1-1_Day1"]["height"], s["1-1_Day1"]["mean_image"]) == (15.0, 5, None) and s["1-1_Day3"]["fs"] == 7.5 and len(s["1-1_Day3"]["mean_image"]) == 30
    ome = planes.read_ome(spark, root).collect()
    assert len(ome) == 3 and all((r["pixel_size_um"], r["fs"]) == (0.65, 20.0) for r in ome)


def test_array_files_run_no_code(tmp_path):
    class Evil:
        def __reduce__(self):
            return (print, ("run",))

    np.save(tmp_path / "x.npy", np.array([Evil()], dtype=object), allow_pickle=True)
    with pytest.raises(pickle.UnpicklingError, match="isn't allowed"):
        planes.load_array((tmp_path / "x.npy").read_bytes())


def test_labelled_entries_and_settings(spark, tmp_path):
    held = {"a": {"trace": [1.0, 2.0], "label": {"value": 1, "source": "manual"}, "features": {"snr": 2.5, "none": None}}, "b": {"label": 0}, "c": {"trace": None}}
    np.save(tmp_path / "labels.npy", np.array(held, dtype=object), allow_pickle=True)
    got = {r["key"]: r for r in planes.read_labelled(spark, str(tmp_path)).collect()}
    assert (got["a"]["trace"], got["a"]["label_value"], got["a"]["label_source"], got["a"]["features"]) == ([1, 2], 1, "manual", {"snr": 2.5})
    assert (got["b"]["label_value"], got["b"]["label_source"], got["c"]["label_value"]) == (0, "unknown", -1)
    text = "# settings\nfs: 15\ngrouping:\n  strategies: [combined, dtw]\n  deep:\n    kept: true # yes\nname: x y\n"
    assert planes.load_config(text) == planes._plain_yaml(text) == {"fs": 15, "grouping": {"strategies": ["combined", "dtw"], "deep": {"kept": True}}, "name": "x y"}
    with pytest.raises(ValueError, match="line 1"):
        planes._plain_yaml("- a")


def test_bundles_are_checked_before_use(spark, tmp_path):
    rows = spark.createDataFrame([(float(k), float(k % 5), int(k > 20)) for k in range(40)], "a double, b double, y int")
    model = models.fit(rows, ["a", "b"], "y", "LR")
    root = str(tmp_path / "bundle")
    entry = bundles.save_model(spark, root, "roi", model, {"roc_auc": 1.0})
    bundles.write_manifest(spark, root, {"roi": entry, "spike": bundles.save_model(spark, root, "spike", model, {}, "log")})
    loaded = bundles.load_bundle(spark, root)
    assert loaded["roi"][1]["roc_auc"] == 1.0 and loaded["spike"][1]["transform"] == "log" and models.feature_names(loaded["roi"][0]) == ["a", "b"]

    def broken(change, kinds=("roi",)):
        bundles.write_manifest(spark, root, {"roi": {k: v for k, v in {**entry, **change}.items() if v is not None}})
        return bundles.load_bundle(spark, root, kinds)

    for change, message in (({"sha256": "0"}, "digest"), ({"features": ["b", "a"]}, "features of the roi config"), ({"transform": "log"}, "transform"), ({"sha256": None}, "lacks models.roi.sha256"),
                            ({"config": "roi/other/results.json"}, "one iteration"), ({"model": "spike/x/model"}, "below roi"), ({"config": "roi/../x/results.json", "model": "roi/../x/model"}, "leaves")):
        with pytest.raises(ValueError, match=message):
            broken(change)
    with pytest.raises(ValueError, match="models.spike"):
        broken({}, ("spike",))
    with pytest.raises(FileNotFoundError):
        bundles.load_bundle(spark, str(tmp_path))
    kept, rates = models.gated_filter(rows.withColumn("video", F.lit("v")), ["video"], "a", loaded["roi"][0])
    assert rates.first()["n_total"] == 40 and [r["filtered_index"] for r in kept.orderBy("a").collect()] == list(range(rates.first()["n_kept"])) and kept.agg(F.min("a")).first()[0] > 15
    assert models.gated_filter(rows.withColumn("video", F.lit("v")), ["video"], "a", None)[1].first()["pass_rate"] == 1.0


def test_tables_are_saved_under_sheet_names(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "a int")
    paths = bundles.save_tables({"x/y": one, "x?y": one, "none": spark.range(0).select()}, str(tmp_path / "out"))
    assert sorted(p.rsplit("/", 1)[1] for p in paths.values()) == ["x_y", "x_y_1"] and spark.read.parquet(paths["x?y"]).count() == 1
    copy = bundles.backup(one, str(tmp_path / "t"))
    assert "_backup_" in copy and spark.read.parquet(copy).first()["a"] == 1


def test_small_samples_have_exact_p():
    for n, m in ((3, 5), (2, 9), (4, 4)):
        us = [sum(sum(x > y for y in set(range(n + m)) - set(c)) for x in c) for c in itertools.combinations(range(n + m), n)]
        for u in range(n * m + 1):
            big = max(u, n * m - u)
            assert special.mann_whitney_p(u, n, m) == pytest.approx(min(1.0, 2 * sum(v >= big for v in us) / len(us)))
    assert special.mann_whitney_p(20, 5, 20) == pytest.approx(0.0423, abs=1e-4)  # exact, as one side has at most 8
    for n, m in ((4, 6), (5, 5), (3, 7)):
        def distance(c):
            i = j = far = 0
            for k in range(n + m):
                i, j = (i + 1, j) if k in c else (i, j + 1)
                far = max(far, abs(i * m - j * n))
            return far

        all_d = [distance(set(c)) for c in itertools.combinations(range(n + m), n)]
        for d in sorted(set(all_d)):
            assert special.kolmogorov_p(d / (n * m), n, m) == pytest.approx(sum(x >= d for x in all_d) / len(all_d))
    assert special.kolmogorov_p(0.05, 3000, 2500) == pytest.approx(special.kolmogorov_p(0.05, 3001, 2500), rel=0.02)
    ranks = [1.5, 1.5, 3.0, 4.0]
    var = sum(r * r for r in ranks) / 4
    assert special.wilcoxon_p(0.0, 4, 6.0) == pytest.approx(2 * special.normal_sf((sum(ranks) / 2) / math.sqrt(var)))


def test_day_pair_tests(spark):
    rng = np.random.default_rng(4)
    rows = [("t", s, d, float(rng.normal() + (d == 3) * 2 + s)) for s in range(9) for d in (1, 2, 3)] + [("t", 99, 1, 5.0), ("u", 1, 1, 1.0), ("u", 1, 2, 1.0), ("u", 2, 1, 2.0), ("u", 2, 2, 2.0), ("u", 3, 1, 2.0), ("u", 3, 2, 2.0)]
    df = spark.createDataFrame(rows, "treatment string, recording int, day int, v double")
    got = {(r["treatment"], r["day_row"], r["day_col"]): r for r in inference.day_pair_tests(df, ["treatment"], "recording", "day", "v").collect()}
    assert set(got) == {("t", 1, 2), ("t", 1, 3), ("t", 2, 3), ("u", 1, 2)} and all(r["n_pairs"] in (9, 3) for r in got.values())
    assert (got["u", 1, 2]["statistic"], got["u", 1, 2]["p"]) == (0.0, 1.0)
    x = {(s, d): v for t, s, d, v in rows if t == "t"}
    d = np.array([x[s, 1] - x[s, 3] for s in range(9)])
    t = d.mean() / (d.std(ddof=1) / 3)
    assert got["t", 1, 3]["statistic"] == pytest.approx(t) and got["t", 1, 3]["p"] == pytest.approx(special.student_two_sided(abs(t), 8))
    p = sorted((r["p"], k) for k, r in got.items() if k[0] == "t")
    q = np.minimum.accumulate([p[k][0] * 3 / (k + 1) for k in (2, 1, 0)])[::-1]
    assert [got[k]["q"] for _, k in p] == pytest.approx(list(np.minimum(q, 1)))
    ranks = {(r["treatment"], r["day_row"], r["day_col"]): r for r in inference.day_pair_tests(df, ["treatment"], "recording", "day", "v", "wilcoxon").collect()}
    order = np.argsort(np.argsort(np.abs(d))) + 1
    w = min(order[d > 0].sum(), order[d < 0].sum())
    assert ranks["t", 1, 3]["statistic"] == w and ranks["t", 1, 3]["p"] == pytest.approx(special.wilcoxon_p(w, 9)) and ranks["u", 1, 2]["p"] == 1.0


def test_t_test_is_the_default(spark):
    a, b = [1.0, 2.0, 4.0, 7.0], [2.0, 6.0, 9.0]
    df = spark.createDataFrame([("k", "a", x) for x in a] + [("k", "b", x) for x in b], "k string, arm string, v double")
    pooled = (3 * np.var(a, ddof=1) + 2 * np.var(b, ddof=1)) / 5
    t = (np.mean(a) - np.mean(b)) / math.sqrt(pooled * (1 / 4 + 1 / 3))
    r = inference.compare_distributions(df, ["k"], "v", "arm", "a", "b").first()
    assert r["statistic"] == pytest.approx(t) and r["p"] == pytest.approx(special.student_two_sided(abs(t), 5))
    assert inference.compare_distributions(df, ["k"], "v", "arm", "a", "b", "ks").first()["p"] == pytest.approx(special.kolmogorov_p(5 / 12, 4, 3))
    with pytest.raises(ValueError):
        inference.compare_distributions(df, ["k"], "v", "arm", "a", "b", "other")


def test_variances_of_large_means_do_not_cancel(spark):
    rows = [("k", 1e9 + x, 0.25, 1.0) for x in (0.0, 1.0, 2.0)]
    r = summary.aggregate_children(spark.createDataFrame(rows, "k string, mean double, var_total double, w double"), ["k"]).first()
    assert r["var_between"] == pytest.approx(2 / 3, rel=1e-6) and r["var_within"] == 0.25 and r["mean"] == 1e9 + 1


def test_robust_arrivals_and_refined_origins():
    rng = np.random.default_rng(3)
    n = 40
    pair = np.array([(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.3])
    truth = rng.normal(size=n) * 5
    lag = truth[pair[:, 1]] - truth[pair[:, 0]]
    lag[:6] += 40  # outliers
    t, w, residual = kernels.robust_arrivals(n, pair, lag, np.ones(len(pair)), 30)
    plain = kernels.robust_arrivals(n, pair, lag, np.ones(len(pair)), 1)[0]
    off, plain_off = (np.abs(x - (truth - truth.mean())).max() for x in (t, plain))
    assert off < plain_off / 4 and w[:6].max() < 0.05 < 0.5 < w[6:].min() and np.abs(residual[:6]).min() > 30
    c = rng.random((60, 2)) * 100
    origin = np.array([63.0, 21.0])
    at, slope, r2 = kernels.refined_origin(c, 3 * np.hypot(*(c - origin).T) + 1, kernels.radial_scores(c, np.hypot(*(c - origin).T))[1])
    assert np.allclose(at, origin, atol=1e-3) and slope == pytest.approx(3, abs=1e-3) and r2 > 0.999999


def test_propagation_fit_names_source_and_coverage(spark):
    rng = np.random.default_rng(5)
    c = rng.random((70, 2)) * 100
    rows = [(0, k, float(x), float(y), float(np.hypot(x - 80, y - 10) * 0.5)) for k, (x, y) in enumerate(c)]
    rows += [(1, k, float(x) / 2, float(y) / 2, float(2 * x)) for k, (x, y) in enumerate(c)]
    df = spark.createDataFrame(rows, "e int, node int, x double, y double, onset double")
    got = {r["e"]: r for r in waves.fit_propagation(df, ["e"], 19).collect()}
    assert got[0]["model"] == "radial" and abs(got[0]["source_x"] - 80) < 0.1 and abs(got[0]["source_y"] - 10) < 0.1 and got[0]["speed"] == pytest.approx(2.0, rel=1e-3) and got[0]["direction"] is None
    assert got[1]["model"] == "planar" and got[1]["direction"] == pytest.approx(0.0, abs=1e-6) or got[1]["direction"] == pytest.approx(360.0, abs=1e-6)
    whole = kernels.hull_area(np.vstack([c, c / 2]))
    assert got[0]["coverage"] == pytest.approx(kernels.hull_area(c) / whole) and got[1]["coverage"] == pytest.approx(kernels.hull_area(c / 2) / whole)


def test_wide_grids_do_not_wrap(spark):
    v = spark.createDataFrame([(0, 0, 0, 999), (0, 0, 1, 0), (0, 0, 5, 1500), (0, 1, 6, 1501)], "rec int, frame int, by int, bx int")
    assert sorted(r["count"] for r in waves.flood_fill(v, ["rec"]).groupBy("component").count().collect()) == [1, 1, 2]


def test_graph_fronts_find_a_planted_plane(spark):
    rng = np.random.default_rng(6)
    c = rng.random((40, 2)) * 100
    t = c @ [0.05, 0.02]
    edges = [(e, i, j, float(round(t[j] - t[i], 2)) if e == 0 else float(rng.integers(-4, 5)), 0.9, 0.2) for e in (0, 1) for i in range(40) for j in range(i + 1, 40) if np.hypot(*(c[i] - c[j])) < 30]
    edges += [(2, 0, 1, 1.0, 0.9, 0.2), (0, 100, 101, 50.0, 0.9, 0.2), (0, 0, 1, 99.0, 0.1, 0.2)]
    coords = [(e, k, float(x), float(y)) for e in (0, 1, 2) for k, (x, y) in enumerate(c)] + [(0, 100, 0.0, 0.0), (0, 101, 1.0, 1.0)]
    e = spark.createDataFrame(edges, "episode int, i int, j int, lag double, corr double, sharpness double")
    p = spark.createDataFrame(coords, "episode int, node int, x double, y double")
    settings = wave_tables.GraphSettings(repeats=39)
    fronts = wave_tables.graph_fronts(e, p, ["episode"], settings).withColumn("recording", F.lit("r"))
    got = {r["episode"]: r for r in wave_tables.significant_fronts(fronts, ["recording"], settings).collect()}
    assert got[0]["status"] == "ok" and got[0]["n_nodes"] == 40 and got[0]["model"] == "planar" and got[0]["r2"] > 0.95 and got[0]["lag_permutation_p"] == 1 / 40 and got[0]["q"] == pytest.approx(2 / 40) and got[0]["significant"]
    assert not got[1]["significant"] and got[2]["status"] == "insufficient_connected_graph" and got[2]["q"] is None and len(got[0]["arrivals"]) == 40


def test_rates_are_each_recordings_own(spark):
    def course(n):
        f = np.zeros(n)
        f[5::7] = 1.0 + np.arange(len(f[5::7])) * 0.01
        return f

    rows = [(rec, roi, k, float(v)) for rec, n in ((0, 40), (1, 400)) for roi in (0, 1) for k, v in enumerate(course(n))]
    s = spark.createDataFrame(rows, "recording_id int, roi_idx int, frame int, v double")
    settings = workflows.Settings(fs=1.0, sigma=0.5, distance=3, pulses=(5, 12, 19), pulse_window=2, strategies=("light_evoked",))
    out = workflows.analyse_recordings(s, settings)
    got = {(r["recording_id"], r["roi_idx"]): (r["spike_count"], r["spike_freq"]) for r in out["neurons"].collect()}
    assert all(freq == pytest.approx(n / (40 if rec == 0 else 400)) for (rec, _), (n, freq) in got.items()) and got[0, 0][1] > 0.1
    assert out["light_evoked"].count() > 0
    assert matching.resolve_schedule("a", 30, {"a": [1]}) == [1] and matching.resolve_schedule("b", 30, {"a": [1]}, 5, 10) == [5, 15, 25] and matching.resolve_schedule("b", 30, given=[2]) == [2]
    with pytest.raises(ValueError):
        matching.resolve_schedule("b", 30)


def test_a_method_without_groups_has_none(spark):
    stats = spark.createDataFrame([("r", "combined", 1, [3, None, 3])], "rec string, method string, group_id int, neuron_indices array<int>")
    assert [tuple(r) for r in longitudinal.load_groups(stats, "combined", ["rec"]).collect()] == [("r", 1, 3)] and longitudinal.load_groups(stats, "dtw", ["rec"]).isEmpty()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"

        class _jsc:
            @staticmethod
            def sc():
                class Inner:
                    @staticmethod
                    def getCheckpointDir():
                        class Option:
                            @staticmethod
                            def isDefined():
                                return False

                        return Option

                return Inner

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)


def test_cluster_radius_is_the_traces_own_width(spark):
    from tracewell.operators import peaks

    x = np.zeros(120)
    for at, half in ((10, 4), (22, 4), (60, 4), (100, 4)):
        x[at - half : at + half + 1] += 1 - np.abs(np.arange(-half, half + 1)) / half
    x += np.linspace(0, 1e-3, 120)
    s = spark.createDataFrame([(0, r, k, float(v)) for r in (0, 1) for k, v in enumerate(x if r == 0 else np.sin(np.arange(120)))], "recording_id int, roi_idx int, frame int, v double")
    p = peaks.prominences(s)
    w = {(r["roi_idx"], r["frame"]): r["width"] for r in peaks.peak_widths(s, p).collect()}
    at = kernels.local_maxima(x)
    assert [w[0, int(a)] for a in at] == pytest.approx(list(kernels.widths(x, at))) and w[0, 60] == pytest.approx(4.0, abs=0.1)
    got = {(r["roi_idx"], r["frame"]): r for r in peaks.peak_hierarchy(peaks.with_radius(s, p)).collect()}
    assert got[0, 60]["radius"] == pytest.approx(1.5 * np.median(kernels.widths(x, at)))
    assert [got[0, int(a)]["cluster"] for a in at] == list(np.cumsum([0, *(np.diff(at) > got[0, 60]["radius"])]))
