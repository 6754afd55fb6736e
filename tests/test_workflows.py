import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import episodes, features, imaging, peaks, waves
from tracewell.plans import workflows


def _pixels(spark, a, key=0):
    return spark.createDataFrame([(key, y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "k int, y int, x int, v double")


def test_translation_is_found_and_its_overlap_correlates(spark):
    a = np.random.default_rng(1).random((40, 40))
    one, two = _pixels(spark, a), _pixels(spark, np.roll(a, (3, -2), (0, 1)))
    r = imaging.translations(one, two, ["k"], 40, 40, 6).first()
    assert (r["dy"], r["dx"]) == (-3, 2) and r["r"] > 0.99
    moved = imaging.shift_image(one, ["k"], 3, -2, 40, 40)
    assert imaging.correlation_for_shift(one, moved, ["k"], -3, 2).first()["r"] == pytest.approx(1.0)


def test_outline_and_front_of_a_square(spark):
    sq = spark.createDataFrame([(0, y, x) for y in range(3, 8) for x in range(3, 8)], "k int, y int, x int")
    got = {(r["y"], r["x"]) for r in imaging.outline(sq, ["k"], 20, 20).collect()}
    assert (4, 4) not in got and (3, 3) in got and (2, 5) in got and (2, 2) not in got
    v = spark.createDataFrame([(0, f, y, x) for f in (0, 2) for y in range(3 - f, 8 + f) for x in range(3 - f, 8 + f)], "k int, frame int, by int, bx int")
    assert imaging.front_boundary(v, ["k"]).filter("frame = 0").count() == 16
    assert imaging.leading_edge_speed(v, ["k"], 2).first()["speed"] == pytest.approx(1.0)
    assert imaging.single_front_fraction(v, ["k"]).first()["fraction"] == 1.0


def test_fronts_jump_any_distance(spark):
    v = spark.createDataFrame([(0, 0, 5, 5), (0, 2, 5, 45), (1, 0, 5, 5)], "k int, frame int, by int, bx int")
    assert {r["k"]: r["speed"] for r in imaging.leading_edge_speed(v, ["k"], 2).collect()} == {0: 20.0, 1: None}


def test_moving_bar_scores_above_rest(spark):
    rng = np.random.default_rng(0)
    rows = [(0, f, y, x, float(100 + rng.random() + (60 if 10 <= f < 20 and x == f - 10 else 0))) for f in range(30) for y in range(8) for x in range(10)]
    b = spark.createDataFrame(rows, "k int, frame int, by int, bx int, v double")
    s = {r["frame"]: r["score"] for r in imaging.gradient_metrics(imaging.relative_change(b, ["k"], 8.0), ["k"]).collect()}
    assert np.mean([s[f] for f in range(12, 18)]) > np.mean([s[f] for f in range(0, 8)])


def test_onsets_and_confirmed_episodes(spark):
    f = [0.0] * 20 + [1.0] * 20
    arrays = spark.createDataFrame([(0, 0, f)], "recording_id int, roi_idx int, f array<double>")
    assert abs(episodes.derivative_onsets(arrays, 1.5, 0.9).first()["frame"] - 20) <= 1
    e = spark.createDataFrame([(1, "planar", 10.0), (2, "planar", 10.0), (3, "radial", 0.0)], "id int, model string, direction double")
    m = spark.createDataFrame([(1, "planar", 0.01, 350.0), (2, "planar", 0.2, 10.0)], "id int, model string, p double, direction double")
    assert {r["id"]: r["confirmed"] for r in episodes.significant_episodes(e, m, ["id"]).collect()} == {1: True, 2: False, 3: False}


def test_radial_episodes_are_told_by_their_source(spark):
    rows = [(0, 1, 0.0, 0.0, None, "radial"), (0, 2, 9.0, 0.0, float("nan"), "radial"), (0, 3, 5.0, 0.0, 90.0, "planar"), (0, 4, 6.0, 0.0, 100.0, "planar"), (0, 5, 300.0, 0.0, None, "radial")]
    e = spark.createDataFrame(rows, "k int, node long, x double, y double, direction double, model string")
    assert {r["node"]: r["cluster"] for r in waves.recurrence_clusters(e, ["k"], 40.0, 45.0).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: -1}
    e = e.select(F.col("node").alias("id"), "model", "direction", F.col("x").alias("source_x"), F.col("y").alias("source_y"))
    m = e.withColumn("p", F.lit(0.01)).withColumn("source_x", F.col("source_x") + F.when(F.col("id") == 2, 900.0).otherwise(1.0))
    assert {r["id"]: r["confirmed"] for r in episodes.significant_episodes(e, m, ["id"]).collect()} == {1: True, 2: False, 3: True, 4: True, 5: True}


def test_decay_is_exponential(spark):
    rows = [(0, 0, t, float(np.exp(-max(0, t - 5) / 3) if t >= 5 else t / 5)) for t in range(30)] + [(0, 0, 30, 0.0)]
    s = spark.createDataFrame(rows, "recording_id int, roi_idx int, frame int, v double")
    ws = peaks.window_samples(s, peaks.valley_windows(s, peaks.local_maxima(s)))
    assert peaks.decay_tau(ws).first()["value"] == pytest.approx(3.0, abs=0.1)
    assert features.decay_shape(ws).first()["r2"] > 0.99
    assert features.area_asymmetry(ws).first()["value"] > 0


def test_settings_reject_unknown_strategies():
    assert workflows.Settings(strategies=("combined", "dtw"), disabled=("dtw",)).active() == ["combined"]
    with pytest.raises(ValueError):
        workflows.Settings(strategies=("corr",)).active()


def test_light_evoked_groups_by_answered_pulses(spark):
    rows = [("r", roi, t, max([math.exp(-((t - c) ** 2) / 8) for c in at])) for roi, at in ((0, (42, 102)), (1, (42, 75))) for t in range(150)]
    samples = spark.createDataFrame(rows, "recording_id string, roi_idx int, frame int, v double")
    out = workflows.analyse_recordings(samples, workflows.Settings(sigma=1.0, strategies=("light_evoked",), pulses=(40, 100), pulse_window=10))
    assert {r["roi_idx"]: r["n_responses"] for r in out["light_evoked"].collect()} == {0: 2, 1: 1}
    with pytest.raises(ValueError):
        workflows.Settings(strategies=("light_evoked",)).active()


def test_recording_analysis_groups_synchronous_traces(spark):
    rng = np.random.default_rng(3)
    base = np.zeros(120)
    base[10:120:15] = 10
    other = np.zeros(120)
    other[17:120:23] = 10
    rows = [(0, r, t, float(f[t] + rng.random() * 0.1)) for r, f in enumerate([base, base, other, other]) for t in range(120)]
    s = spark.createDataFrame(rows, "recording_id int, roi_idx int, frame int, v double")
    out = workflows.analyse_recordings(s, workflows.Settings(fs=1.0, sigma=1.0, distance=5, sttc_dt=3.0))
    c = {r["node"]: r["cluster"] for r in out["combined"].collect()}
    assert c[0] == c[1] and c[2] == c[3] and c[0] != c[2]
    assert out["neurons"].count() == 4 and out["summary"].count() == 2 and out["events"].count() > 0
    one = workflows.analyse_recordings(s.filter("roi_idx = 0"), workflows.Settings(fs=1.0, sigma=1.0, distance=5))
    assert one["combined"].count() == 0


def test_treatments_weigh_replicates_by_recordings(spark):
    r = spark.createDataFrame([("ctl", "a1", 1.0, 0.0, 10.0), ("ctl", "a2", 3.0, 0.0, 10.0), ("drug", "a3", 5.0, 0.0, 10.0), ("drug", "a4", 7.0, 0.0, 10.0), ("solo", "a5", 1.0, 0.0, 1.0)], "treatment string, animal string, mean double, var_total double, w double")
    out = workflows.treatment_comparison(r)
    assert {x["treatment"]: x["mean"] for x in out["treatments"].collect()} == {"ctl": 2.0, "drug": 6.0, "solo": 1.0}
    assert [x["grp"] for x in out["issues"].collect()] == ["solo"]
    days = spark.createDataFrame([("g", d, float(d), 0.0, 1.0) for d in (1, 2, 10)], "grp string, day int, mean double, var_total double, w double")
    assert [x["day"] for x in workflows.longitudinal_comparison(days).collect()] == ["1", "10", "2"]


def test_training_picks_a_useful_model(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, float(x), float(y), float(x > 0.5)) for i, (x, y) in enumerate(rng.random((200, 2)))], "id int, a double, b double, label double")
    out = workflows.train_classifier(rows.withColumn("a", F.when(F.col("id") == 0, float("nan")).otherwise(F.col("a"))), ["a", "b"], "label", "id", kinds=("LR",))
    assert out["roc_auc"] > 0.9 and out["importance"][0][0] == "a"
