"""Travelling activity: filters, null models, fronts in movies and voxels, and whole analyses, on planted cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import kernels as k
from tracewell.operators import features, graph, imaging, inference, traces, wave_tables, waves
from tracewell.plans import wave_workflows

KEY = "recording_id int, roi_idx int"


@pytest.mark.parametrize(("n", "window", "order"), [(9, 9, 3), (30, 11, 3), (12, 5, 2)])
def test_savgol_equals_polynomials_fitted_by_hand(spark, n, window, order):
    x = np.random.default_rng(n).random(n)
    want = []
    for i in range(n):
        start = min(max(i - window // 2, 0), n - window)
        want.append(np.polyval(np.polyfit(np.arange(window), x[start : start + window], order), i - start))
    got = traces.savgol(spark.createDataFrame([(0, 0, x.tolist())], f"{KEY}, f array<double>"), window, order).first()["f"]
    assert got == pytest.approx(want)


def test_savgol_of_a_short_trace_is_null(spark):
    assert traces.savgol(spark.createDataFrame([(0, 0, [1.0, 2.0])], f"{KEY}, f array<double>"), 5, 3).first()["f"] is None


def test_nearest_edges_repeat_the_last_sample(spark):
    a = spark.createDataFrame([(0, 0, [1.0, 2.0, 4.0])], f"{KEY}, f array<double>")
    assert traces.convolve(a, [1.0, 0.0, 0.0, 0.0, 1.0], "nearest").first()["f"] == [5.0, 5.0, 5.0]


def test_density_counts_a_train_once_and_loses_what_lies_outside(spark):
    e = spark.createDataFrame([(0, 1, 3), (0, 1, 3), (0, 2, 3), (0, 2, 0), (0, 2, 99)], "rec int, train int, frame int")
    got = {r["frame"]: r["v"] for r in waves.smoothed_density(e, ["rec"], "train", "frame", 8, 1.0).collect()}
    w = traces.gaussian_weights(1.0)
    counts = np.array([1, 0, 0, 2, 0, 0, 0, 0.0])
    padded = np.pad(counts, len(w) // 2)
    assert [got[i] for i in range(8)] == pytest.approx([float(np.dot(w, padded[i : i + len(w)])) for i in range(8)])


def test_shifted_nulls_wrap_and_repeat(spark):
    e = spark.createDataFrame([(0, t, f, 20) for t in range(4) for f in (2, 9)], "rec int, train int, frame int, n int")
    one = inference.circular_shift_null(e, "rec", "train", "frame", "n", 30, sigma=1.0).orderBy("repeat").collect()
    two = inference.circular_shift_null(e.repartition(7), "rec", "train", "frame", 20, 30, sigma=1.0).orderBy("repeat").collect()
    assert one == two and len(one) == 30
    assert all(0.39 < r["peak"] <= 4 * 0.4 + 0.01 for r in one)


@pytest.mark.parametrize("most", [1, 2, 3, 6, 9])
def test_maxclust_leaves_at_most_that_many(spark, most):
    x = np.array([0.0, 0.01, 0.03, 0.4, 0.41, 0.9])
    pairs = spark.createDataFrame([(0, i, j, float(1 - abs(x[i] - x[j]))) for i in range(6) for j in range(i + 1, 6)], "rec int, i int, j int, value double")
    got = graph.hierarchical(pairs, ["rec"], most, criterion="maxclust").select("cluster").distinct().count()
    assert got == min(most, 6)
    with pytest.raises(ValueError, match="criterion"):
        graph.hierarchical(pairs, ["rec"], 2, criterion="inconsistent")


def test_ties_are_merged_together(spark):
    merges = k.linkage(np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 1], [9, 9, 1, 0.0]]), "average")
    assert len(set(k.flat_clusters(merges, 4, k.cut_height(merges, 4, 3)).tolist())) == 2


def _ws(spark, y, pk=0):
    return spark.createDataFrame([(0, 0, 5, i, float(v), pk) for i, v in enumerate(y)], f"{KEY}, frame int, i int, y double, pk int")


def test_decay_of_an_exponential_is_straight(spark):
    r = features.decay_shape(_ws(spark, np.exp(-np.arange(12) / 4.0))).first()
    assert r["r2"] == pytest.approx(1) and r["linearity"] == pytest.approx(1, abs=1e-5) and r["biphasic"] == pytest.approx(1)


def test_decay_of_two_phases(spark):
    y = np.concatenate([np.exp(-np.arange(6) / 1.0), np.exp(-6.0) * np.exp(-np.arange(6) / 5.0)])
    assert features.decay_shape(_ws(spark, y)).first()["biphasic"] == pytest.approx(5, rel=0.05)
    short = features.decay_shape(_ws(spark, [1.0, 0.5, 0.2]))
    assert short.first()["biphasic"] is None and short.first()["curvature"] is None
    assert features.decay_shape(_ws(spark, [0.0, 0.5, 1.0, 0.2], 2)).count() == 0


def _movie(spark, rise, frames=40, height=16, width=16, seed=0):
    """A step that reaches block (y, x) at rise(y, x)."""
    rng = np.random.default_rng(seed)
    rows = [(0, f, y, x, float(100 + rng.random() + 80 / (1 + np.exp(-(f - rise(y, x)) * 2)))) for f in range(frames) for y in range(height) for x in range(width)]
    return spark.createDataFrame(rows, "recording_id int, frame int, by int, bx int, v double")


def test_a_front_in_a_movie_is_fitted_and_tested(spark):
    blocks = _movie(spark, lambda y, x: 12 + x * 0.8)
    centres = spark.createDataFrame([(0, 18)], "recording_id int, centre int")
    s = wave_tables.MovieSettings(pixels=1, fs=1.0, active_quantile=0.3, repeats=39, patch=4)
    gradient = imaging.temporal_gradient(blocks, ["recording_id"])
    r = wave_tables.movie_fits(gradient, centres, ["recording_id"], s).first()
    assert r["status"] == "ok" and r["p"] == pytest.approx(1 / 40) and r["r2"] > 0.9
    if r["model"] == "planar":
        assert min(r["direction"], 360 - r["direction"]) < 10 and r["speed"] == pytest.approx(1.25, rel=0.2)
    few = wave_tables.movie_fits(gradient, centres, ["recording_id"], wave_tables.MovieSettings(least_blocks=1000)).first()
    assert few["status"] == "insufficient_active_blocks" and few["p"] is None
    whole = wave_tables.movie_onset_fits(blocks, centres, ["recording_id"], repeats=39, fs=1.0, pixels=1).first()
    assert whole["p"] == pytest.approx(1 / 40) and whole["r2"] > 0.8


def test_standing_noise_is_no_front(spark):
    rng = np.random.default_rng(5)
    at = rng.permutation(256).reshape(16, 16) / 16
    r = wave_tables.movie_fits(
        imaging.temporal_gradient(_movie(spark, lambda y, x: 10 + at[y, x]), ["recording_id"]), spark.createDataFrame([(0, 18)], "recording_id int, centre int"), ["recording_id"],
        wave_tables.MovieSettings(pixels=1, active_quantile=0.3, repeats=19, patch=4)).first()
    assert r["p"] == 1.0 and r["selection_r2"] < 0.15


def test_movies_are_searched_by_their_gradient(spark):
    rng = np.random.default_rng(0)
    rows = [(0, f, y, x, float(100 + rng.random() + 80 * np.exp(-0.5 * ((f - 30 - x * 1.5) / 2) ** 2))) for f in range(90) for y in range(16) for x in range(24)]
    blocks = spark.createDataFrame(rows, "recording_id int, frame int, by int, bx int, v double")  # a pulse: each frame's median is taken off
    out = wave_workflows.analyse_movies(blocks, wave_tables.MovieSettings(pixels=1, fs=1.0, active_quantile=0.3, repeats=39, patch=4, spatial_sigma=0.5))
    best = max(out["episodes"].collect(), key=lambda r: r["r2"])
    assert best["significant"] and best["model"] == "planar" and best["r2"] > 0.95 and 30 <= best["centre"] <= 66
    assert best["speed"] == pytest.approx(1 / 1.5, rel=0.05) and min(best["direction"], 360 - best["direction"]) < 3
    assert out["metrics"].count() == 90
    early = wave_workflows.analyse_movies(blocks, wave_tables.MovieSettings(pixels=1, repeats=3), [(0, 20)])["episodes"]
    assert all(r["centre"] < 20 for r in early.collect())


def test_voxels_of_a_travelling_block(spark):
    rng = np.random.default_rng(2)
    rows = [(0, f, y, x, float(100 + rng.random() + (300 if 10 <= f < 30 and abs(x - (f - 10)) <= 1 and 2 <= y < 8 else 0))) for f in range(60) for y in range(10) for x in range(20)]
    blocks = spark.createDataFrame(rows, "recording_id int, frame int, by int, bx int, v double")
    s = wave_tables.PhasicSettings(pixels=1, pixel_um=10.0, fs=1.0, threshold=8.0, extent_um=100.0, separation=4, repeats=19)
    out = wave_workflows.analyse_phasic(blocks, s, 35.0, 0.0)
    r = max(out["components"].collect(), key=lambda c: c["n_voxels"])
    assert r["propagating"] and r["strict_front"] and r["arrival_span"] >= 15 and r["single_front"] == 1.0
    assert r["arrival_model"] is not None and r["arrival_r2"] > 0.9 and r["arrival_p"] == pytest.approx(0.05)
    assert r["speed"] == pytest.approx(10.0, rel=0.35)


def _recording(spark, rec, delay, seed):
    rng = np.random.default_rng(seed)
    xy = rng.random((60, 2)) * 400
    rows, places = [], []
    for i, (x, y) in enumerate(xy):
        v = rng.normal(0, 0.05, 300)
        for event in (80, 180):
            v[int(round(event + delay(x, y, rng))) :] += 1.0
        rows += [(rec, i, f, float(t)) for f, t in enumerate(v)]
        places.append((rec, i, float(x), float(y)))
    return rows, places


def test_waves_of_recordings(spark):
    one = _recording(spark, 0, lambda x, y, rng: x / 400 * 12, 1)
    two = _recording(spark, 1, lambda x, y, rng: rng.random() * 12, 2)
    samples = spark.createDataFrame(one[0] + two[0], f"{KEY}, frame int, v double")
    coords = spark.createDataFrame(one[1] + two[1], f"{KEY}, x double, y double")
    s = wave_workflows.WaveSettings(fs=15.0, fit_repeats=99, null_repeats=50, onset_quantile=0.98)
    recordings = spark.createDataFrame([(0, 14, "a"), (1, 14, "b"), (2, 15, "a")], "recording_id int, day int, treatment string")
    out = wave_workflows.analyse_wave_dataset(samples, coords, recordings, [14], None, s)
    found = out["episodes"].collect()
    strong = [r for r in found if r["significant"]]
    assert {r["recording_id"] for r in strong} == {0} and len(strong) == 2
    assert all(r["r2"] > 0.9 and r["coverage"] > 0.5 for r in strong)
    assert len({r["cluster"] for r in strong}) == 1 and strong[0]["cluster"] >= 0
    summary = {r["recording_id"]: r for r in out["summary"].collect()}
    assert set(summary) == {0, 1} and summary[0]["n_significant"] == 2 and summary[1]["n_significant"] == 0
    assert summary[0]["n_recurrent_clusters"] == 1 and summary[0]["n_neurons"] == 60


def test_recordings_without_events_stay_in_the_summary(spark):
    samples = spark.createDataFrame([(7, i, f, 1.0) for i in range(3) for f in range(50)], f"{KEY}, frame int, v double")
    coords = spark.createDataFrame([(7, i, float(i), 0.0) for i in range(3)], f"{KEY}, x double, y double")
    out = wave_workflows.analyse_waves(samples, coords, wave_workflows.WaveSettings(null_repeats=5, fit_repeats=5))
    assert out["episodes"].count() == 0
    r = out["summary"].first()
    assert r["n_tested"] == 0 and r["n_candidates"] == 0 and r["threshold"] is None
