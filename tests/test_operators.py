import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions.kernels import find_peaks, prominences
from tracewell.operators import graph, inference, labels, matching, models, peaks, ranking, similarity, summary, traces, validation, waves
from tracewell.sources import recordings
from tracewell.streaming import online


def _samples(spark, rows):
    return spark.createDataFrame([(0, r, t, float(v)) for r, f in enumerate(rows) for t, v in enumerate(f)], "recording_id int, roi_idx int, frame int, v double")


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(5)
    return np.round(rng.random((4, 60)) * 8)


def test_law_of_total_variance(spark):
    c = spark.createDataFrame([("p", 1.0, 10.0, 1.0), ("p", 3.0, 20.0, 3.0), ("p", 99.0, 1.0, 0.0)], "parent string, mean double, var_total double, w double")
    r = summary.aggregate_children(c, ["parent"]).first()
    assert (r["mean"], r["var_within"], r["var_between"], r["n_children"]) == (2.5, 17.5, 0.75, 2)


def test_weights_fall_back_to_one(spark):
    n = spark.createDataFrame([("a", "s", 1.0, 0.0, 0), ("a", "s", 3.0, 0.0, 0)], "k string, stat string, m double, v double, w int")
    got = {r["scheme"]: r["mean"] for r in summary.summarize_video(n, ["k"]).collect()}
    assert got == {"unweighted": 2.0, "weighted": 2.0}


def test_group_statistics_are_weighted_by_groups(spark):
    g = spark.createDataFrame([("k", 3.0, 2), ("k", 4.0, 4), ("k", 9.0, 0)], "key string, value double, n_groups int")
    assert summary.group_stats_rollup(g, ["key"]).first()["value"] == pytest.approx(22 / 6)


def test_peaks_match_the_kernel(spark, noise):
    s = _samples(spark, noise)
    got = {(r["roi_idx"], r["frame"]): (r["prominence"], r["left_base"], r["right_base"]) for r in peaks.prominences(s).collect()}
    want = {}
    for roi, f in enumerate(noise):
        at = find_peaks(f)
        for p, a, b, c in zip(at, *prominences(f, at), strict=True):
            want[roi, int(p)] = (a, int(b), int(c))
    assert got == want


def test_thinned_peaks_match_the_kernel(spark, noise):
    arrays = spark.createDataFrame([(0, r, f.tolist()) for r, f in enumerate(noise)], "recording_id int, roi_idx int, f array<double>")
    got = {(r["roi_idx"], r["frame"]) for r in peaks.peaks_min_distance(arrays, 5).collect()}
    assert got == {(r, int(p)) for r, f in enumerate(noise) for p in find_peaks(f, 5)}
    assert peaks.min_distance_frames(15.0) == 20 and peaks.min_distance_frames(1.0) == 3


@pytest.mark.parametrize("mode", ["reflect", "constant", "wrap"])
def test_convolution_matches_numpy(spark, noise, mode):
    w = traces.gaussian_weights(1.5)
    r = len(w) // 2
    arrays = spark.createDataFrame([(0, k, f.tolist()) for k, f in enumerate(noise)], "recording_id int, roi_idx int, f array<double>")
    got = {x["roi_idx"]: x["f"] for x in traces.convolve(arrays, w, mode).collect()}
    for k, f in enumerate(noise):
        padded = np.pad(f, r, {"reflect": "symmetric", "constant": "constant", "wrap": "wrap"}[mode])
        assert np.allclose(got[k], np.convolve(padded, w[::-1], "valid"))


def test_minmax_is_per_recording_and_constant_is_zero(spark):
    s = _samples(spark, [[0, 5], [10, 10]])
    assert sorted(r["v"] for r in traces.minmax(s).collect()) == [0.0, 0.5, 1.0, 1.0]
    assert sorted(r["v"] for r in traces.minmax(s, per_roi=True).collect()) == [0.0, 0.0, 0.0, 1.0]


def test_greedy_pulse_match_consumes_spikes(spark):
    s = spark.createDataFrame([(0, 10), (0, 12), (0, 40)], "n int, frame int")
    got = {r["frame"]: r["pulse"] for r in matching.pulse_match(s, [9, 10, 39], 5, ["n"]).collect()}
    assert got == {10: 9, 12: 10, 40: 39}
    assert {r["frame"]: r["pulse"] for r in matching.pulse_match(s, [9, 39], 5, ["n"]).collect()} == {10: 9, 12: None, 40: 39}
    assert matching.schedule(10, 30, 100) == [10, 40, 70] and matching.schedule(200, 30, 100) == []


def test_identical_trains_tile_perfectly(spark):
    t = spark.createDataFrame([(0, r, float(x)) for r in (1, 2) for x in (10, 50, 90)], "recording_id int, roi_idx int, t double")
    assert matching.sttc(t, 2.0, 0, 100).first()["sttc"] == pytest.approx(1.0)
    assert matching.tiled_fraction(t, 2.0, 0, 100, ["roi_idx"]).first()["tiled"] == pytest.approx(0.12)


def test_masks_overlap_shift_and_assignment(spark):
    square = lambda m, y, x: [(1, m, y + a, x + b, (y + a) * 100 + x + b) for a in range(4) for b in range(4)]
    left = spark.createDataFrame(square(0, 5, 5) + square(1, 20, 20), "f int, mask int, y int, x int, px int")
    right = spark.createDataFrame(square(0, 9, 2) + square(1, 24, 17), "f int, mask int, y int, x int, px int")
    s = matching.mask_shift(left, right, ["f"], 8).first()
    assert (s["dy"], s["dx"], s["overlap"]) == (-4, 3, 32)
    iou = matching.mask_iou(left, left, ["f"], "mask", "px")
    got = matching.assign(iou, ["f"], "a", "b", "iou").orderBy("a").collect()
    assert [(r["a"], r["b"], r["iou"], r["ambiguous"]) for r in got] == [(0, 0, 1.0, False), (1, 1, 1.0, False)]


def test_components_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(40)], "k int, node long")
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(39) if i != 19], "k int, a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(nodes, edges, ["k"]).collect()}
    assert got == {i: 0 if i < 20 else 20 for i in range(40)}


def test_corrections(spark):
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "id int, p double")
    q = {r["id"]: r["q"] for r in ranking.benjamini_hochberg(p, "p").collect()}
    assert q[1] == pytest.approx(0.03) and q[2] == pytest.approx(0.04) and q[3] == pytest.approx(0.04) and q[4] is None
    assert {r["id"]: r["q"] for r in ranking.bonferroni(p, "p").collect()}[2] == pytest.approx(0.12)


def test_rank_tests(spark):
    x = spark.createDataFrame([("k", "a", v) for v in (1.0, 2.0, 3.0)] + [("k", "b", v) for v in (4.0, 5.0, 6.0)], "k string, arm string, v double")
    u = inference.mann_whitney(x, ["k"], "v", "arm", "a", "b")
    r = u.withColumn("p", inference.mann_whitney_p("u", "n1", "n2", F.col("ties").cast("double"))).first()
    assert r["u"] == 0 and r["p"] == pytest.approx(0.1)
    e = inference.effect_sizes(x, ["k"], "v", "arm", "a", "b").first()
    assert e["cohen_d"] == pytest.approx(-3.0) and e["hedges_g"] == pytest.approx(-3.0 * (1 - 3 / 15))
    assert inference.kolmogorov_smirnov(x, ["k"], "v", "arm", "a", "b").first()["d"] == 1.0


def test_nulls_repeat_on_other_partitionings(spark):
    x = spark.createDataFrame([("k", "a" if i % 2 else "b", float(i % 7 + i % 2)) for i in range(40)], "k string, arm string, v double")
    one = inference.permutation_test(x, "k", "v", "arm", "a", 99).first()
    assert one == inference.permutation_test(x.repartition(7), "k", "v", "arm", "a", 99).first()
    assert inference.bootstrap_ci(x, "k", "v", 50).first() == inference.bootstrap_ci(x.repartition(5), "k", "v", 50).first()


def test_similarity_against_numpy(spark, noise):
    arrays = spark.createDataFrame([(0, r, f.tolist()) for r, f in enumerate(noise)], "recording_id int, roi_idx int, f array<double>")
    p = similarity.pairs(arrays)
    for r in p.select("i", "j", similarity.pearson(F.col("fa"), F.col("fb")).alias("r")).collect():
        assert r["r"] == pytest.approx(np.corrcoef(noise[r["i"]], noise[r["j"]])[0, 1])
    shifted = spark.createDataFrame([(0, 0, noise[0].tolist()), (0, 1, np.roll(noise[0], 3).tolist())], arrays.schema)
    edge = similarity.lagged_edges(spark.createDataFrame([(0, 0, 1)], "recording_id int, i int, j int"), shifted, 5, ["recording_id"]).first()
    assert edge["lag"] == 3 and edge["corr"] == pytest.approx(1.0)


def test_flood_fill_and_front(spark):
    v = spark.createDataFrame([(0, f, y, x) for f in range(3) for y in range(3) for x in range(3)] + [(0, 9, 9, 9)], "rec int, frame int, by int, bx int")
    got = waves.flood_fill(v, ["rec"]).groupBy("component").count().collect()
    assert sorted(r["count"] for r in got) == [1, 27]
    rng = np.random.default_rng(1)
    c = rng.random((80, 2)) * 100
    pts = spark.createDataFrame([(0, i, float(x), float(y), float(2 * x - y)) for i, (x, y) in enumerate(c)], "e int, node int, x double, y double, onset double")
    r = waves.fit_propagation(pts, ["e"], 49).first()
    assert r["model"] == "planar" and r["r2"] > 0.99 and r["p"] <= 0.05
    assert waves.planar_r2(pts, ["e"]).first()["r2"] == pytest.approx(1.0)


def test_labels_and_validation(spark):
    rows = spark.createDataFrame([("a", 1, "manual"), ("b", -1, "unknown"), ("a", 0, "auto")], "key string, value int, source string")
    assert labels.label_summary(rows, [], "value", "source").first().asDict() == {"total": 3, "good": 1, "bad": 1, "unlabeled": 1, "manual": 1, "auto": 1}
    with pytest.raises(ValueError):
        labels.matches_mode(F.col("value"), F.col("source"), True, True)
    assert {r["key"] for r in labels.deduplicated_keys(rows, "key", ["value"]).collect()} == {"a", "a_dup1", "b"}
    assert validation.duplicate_keys(rows, ["key"], "value").count() == 1
    m = spark.createDataFrame([("a", None, "x"), ("c", "y", "y")], "key string, t string, u string")
    got = validation.override_metadata(spark.createDataFrame([("a", "t0", "u0")], "key string, t string, u string"), m, "key", ["t", "u"]).first()
    assert (got["t"], got["u"]) == ("t0", "x")


def test_sources_round_trip(spark, tmp_path):
    d = tmp_path / "ctl" / "1-1_Day7" / "plane0"
    d.mkdir(parents=True)
    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    np.save(d / "F.npy", a)
    got = recordings.read_arrays(spark, str(tmp_path)).orderBy("roi_idx").collect()
    assert np.array_equal([r["f"] for r in got], a)
    rows = spark.createDataFrame([("v", 3, float("nan")), ("w", 4, 1.5)], "video string, n int, x double")
    recordings.write_summaries(rows, str(tmp_path / "s"))
    (tmp_path / "s" / "bad.json").write_text('{"artifact_kind": "other", "schema_version": 1}\n')
    ok, issues = recordings.read_summaries(spark, str(tmp_path / "s"), "video string, n int, x double")
    assert sorted(map(tuple, ok.collect()), key=str) == [("v", 3, None), ("w", 4, 1.5)] and issues.count() == 1
    names = spark.createDataFrame([("/e/t/tp/1-1_Day7",), ("x",)], "path string")
    got = {r["video"]: (r["treatment"], r["region"], r["day"]) for r in recordings.recording_metadata(names).collect()}
    assert got == {"1-1_Day7": ("t", "1-1", 7), "x": ("unknown", None, 1)}
    assert recordings.fingerprint({"b": 1, "a": 2}) == recordings.fingerprint({"a": 2, "b": 1}) and recordings.fingerprint(None) is None


def test_models(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, float(x), float(rng.random()), float(x > 0.5)) for i, x in enumerate(rng.random(300))], "id int, a double, b double, label double")
    train, test = models.split(rows, "id")
    m = models.fit(train, ["a", "b"], "label", "RF", numTrees=10)
    assert models.evaluate(m, test, ["a", "b"], "label") > 0.95 and models.importance(m)[0][0] == "a"
    with pytest.raises(ValueError):
        models.predict(m, rows.drop("b"))


def test_stream_equals_table(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-0{1 + i // 20} 0{i % 9}:00:00", i % 2, 1.0) for i in range(40)], "ts string, k int, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = online.windowed_rates(stream, "ts", "k", "value").writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, online.windowed_rates(rows, "ts", "k", "value").collect()))


def test_the_registry_works_without_the_text_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    show = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), 'pipeline' in q, 'op1_line_dedup' in q, all(n.startswith('q') for n in q))"
    whole, cut, bare = tmp_path / "whole", tmp_path / "cut", tmp_path / "bare"
    for to in (whole, cut, bare):
        to.mkdir()
        shutil.copytree(root / "tracewell", to / "tracewell")
        shutil.copy(root / "__spark_entry__.py", to)
        if (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", to)
    shutil.rmtree(cut / "tracewell" / "llm", ignore_errors=True)  # what the driver takes away
    (cut / "corpus_pipeline.py").unlink(missing_ok=True)
    (bare / "public_tokenizers.py").write_text("raise ImportError('no tokenizers here')")
    said = {}
    for to in (whole, cut, bare):
        got = subprocess.run([sys.executable, "-c", show], cwd=to, capture_output=True, text=True, timeout=120)
        said[to.name] = got.stdout.strip().split("\n")[-1].split()
    assert said["cut"][0] == said["bare"][0] and int(said["cut"][0]) > 80 and said["cut"][2:] == said["bare"][2:] == ["False", "False", "True"]
    if (root / "tracewell" / "llm").exists():
        assert said["whole"][2:4] == ["True", "True"] and int(said["whole"][0]) == int(said["cut"][0]) + 11
