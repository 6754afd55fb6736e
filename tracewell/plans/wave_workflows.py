"""Whole analyses of travelling activity: recordings by their events, movies by their gradients, movies by their active voxels, and datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import episodes, imaging, inference, matching, ranking, traces, wave_tables, waves
from tracewell.operators.wave_tables import MovieSettings, PhasicSettings
from tracewell.scratch import cut

REC = ["recording_id"]


@dataclass(frozen=True)
class WaveSettings:
    """What an analysis of recordings depends on."""

    fs: float = 15.0
    pixel_um: float = 1.0
    density_sigma: float = 4.0
    onset_quantile: float = 0.99
    onset_separation: int = 12
    onset_sigma: float = 2.0
    half_window: int = 18
    separation: int = 24
    least_participants: int = 20
    least_fraction: float = 0.05
    least_coverage: float = 0.10
    least_span: int = 3
    least_r2: float = 0.15
    null_repeats: int = 200
    fit_repeats: int = 499
    alpha: float = 0.05
    recurrence_um: float = 250.0
    recurrence_degrees: float = 45.0
    movie_pixels: int = 16
    movie_quantile: float = 0.5
    movie_repeats: int = 199
    seed: int = 1729


def analyse_waves(samples: DataFrame, coords: DataFrame, settings: WaveSettings = WaveSettings()) -> dict[str, DataFrame]:
    """All recordings of samples(recording_id, roi_idx, frame, v) with coords(recording_id, roi_idx, x, y) at once.

    episodes: population events whose neurons' onsets were tested for a front: participants, density and its p against shifted trains, the
    front, q over the recording's episodes, `significant`, and a recurrence cluster (-1 for none). summary: one row a recording, also for
    those without onsets or episodes. Onsets, shared by all later steps, are written once.
    """
    s = settings
    scored = traces.zscore(samples).withColumn("v", F.coalesce("v", F.lit(0.0)))
    sizes = samples.groupBy(*REC).agg((F.max("frame") + 1).alias("n_frames"), F.countDistinct("roi_idx").alias("n_neurons"))
    onsets = cut(episodes.derivative_onsets(traces.trace_arrays(scored), s.onset_sigma, s.onset_quantile, s.onset_separation).join(sizes, REC))
    density = waves.smoothed_density(onsets, REC, "roi_idx", "frame", "n_frames", s.density_sigma)
    null = inference.circular_shift_null(onsets, "recording_id", "roi_idx", "frame", "n_frames", s.null_repeats, s.seed, s.density_sigma)
    centres = episodes.candidate_episodes(density, null, "recording_id", s.alpha, s.separation).withColumnRenamed("frame", "centre")
    centres = cut(centres.withColumnRenamed("v", "density"))
    reached = centres.join(null, REC).groupBy(*REC, "centre").agg(((F.sum((F.col("peak") >= F.col("density")).cast("int")) + 1.0) / (F.count(F.lit(1)) + 1.0)).alias("population_p"))

    arrived = matching.nearest_arrivals(centres, onsets.select(*REC, F.col("roi_idx").alias("node"), F.col("frame").alias("onset")), REC, s.half_window)
    place = coords.select(*REC, F.col("roi_idx").alias("node"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    points = arrived.join(place, [*REC, "node"])
    found = points.groupBy(*REC, "centre").agg(F.count(F.lit(1)).alias("n_participants"), (F.max("onset") - F.min("onset")).alias("onset_span")).join(sizes, REC)
    enough = F.greatest(F.lit(s.least_participants), F.ceil(s.least_fraction * F.col("n_neurons")))
    found = found.filter((F.col("n_participants") >= enough) & (F.col("onset_span") >= s.least_span))
    fits = waves.fit_propagation(points.join(found.select(*REC, "centre"), [*REC, "centre"], "left_semi"), [*REC, "centre"], s.fit_repeats, s.fs, s.pixel_um, seed=s.seed, field=place)
    tested = found.join(fits, [*REC, "centre"]).filter(F.col("coverage") >= s.least_coverage).join(centres, [*REC, "centre"]).join(reached, [*REC, "centre"])
    ranked = ranking.benjamini_hochberg(tested, "p", REC, ["centre"])
    ranked = cut(ranked.withColumn("significant", (F.col("population_p") <= s.alpha) & (F.col("q") <= s.alpha) & (F.col("r2") >= s.least_r2)))

    strong = ranked.filter("significant").select(*REC, F.col("centre").cast("long").alias("node"), *[F.col(f"source_{a}").alias(a) for a in "xy"], "direction", "model")
    clusters = waves.recurrence_clusters(strong, REC, s.recurrence_um / s.pixel_um, s.recurrence_degrees).select(*REC, F.col("node").alias("centre"), "cluster")
    out = ranked.join(clusters, [*REC, "centre"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    out = out.select(
        *REC, "centre", (F.col("centre") / s.fs).alias("seconds"), "density", "population_p", "n_participants", (F.col("n_participants") / F.col("n_neurons")).alias("fraction"),
        "coverage", "onset_span", "model", "r2", "p", "q", "speed", "direction", "source_x", "source_y", "significant", "cluster")

    events = onsets.groupBy(*REC).agg(F.count(F.lit(1)).alias("n_onsets"))
    level = null.groupBy(*REC).agg(F.percentile("peak", 1 - s.alpha).alias("threshold"))
    counted = centres.groupBy(*REC).agg(F.count(F.lit(1)).alias("n_candidates"))
    recurs = F.col("cluster") >= 0
    judged = out.groupBy(*REC).agg(
        F.count(F.lit(1)).alias("n_tested"), F.sum(F.col("significant").cast("long")).alias("n_significant"),
        F.countDistinct(F.when(recurs, F.col("cluster"))).alias("n_recurrent_clusters"), F.sum(recurs.cast("long")).alias("n_recurrent"))
    summary = sizes.join(events, REC, "left").join(level, REC, "left").join(counted, REC, "left").join(judged, REC, "left")
    summary = summary.fillna(0, ["n_onsets", "n_candidates", "n_tested", "n_significant", "n_recurrent_clusters", "n_recurrent"])
    summary = summary.withColumns({"seconds": F.col("n_frames") / s.fs, "onsets_per_neuron": F.col("n_onsets") / F.col("n_neurons")}).drop("n_onsets")
    return {"episodes": out, "summary": summary}


def analyse_wave_dataset(samples: DataFrame, coords: DataFrame, recordings: DataFrame, days: list, blocks: DataFrame | None = None, settings: WaveSettings = WaveSettings()) -> dict[str, DataFrame]:
    """analyse_waves() of the recordings(recording_id, day, ..) on the given days, with their other columns. With blocks(recording_id, frame, by, bx, v),
    significant episodes are fitted again on the movie, `confirmed` where it agrees, and counted a recording (0 for none)."""
    s = settings
    chosen = recordings.filter(F.col("day").isin(days))
    parts = analyse_waves(samples.join(chosen.select(*REC), REC, "left_semi"), coords.join(chosen.select(*REC), REC, "left_semi"), s)
    found, summary = parts["episodes"], parts["summary"]
    if blocks is not None:
        found = cut(found)
        centres = found.filter("significant").select(*REC, "centre")
        fits = wave_tables.movie_onset_fits(blocks, centres, REC, s.half_window, s.onset_sigma, s.movie_quantile, s.movie_repeats, s.fs, s.pixel_um, s.movie_pixels, s.seed)
        found = episodes.significant_episodes(found, fits, [*REC, "centre"], s.alpha, s.recurrence_degrees, s.recurrence_um / s.pixel_um)
        found = found.withColumn("confirmed", F.col("confirmed") & F.col("significant"))
        counts = found.groupBy(*REC).agg(F.sum(F.col("confirmed").cast("long")).alias("n_confirmed"))
        summary = summary.join(counts, REC, "left").fillna(0, ["n_confirmed"])
    return {"episodes": chosen.join(found, REC), "summary": chosen.join(summary, REC)}


def analyse_movies(blocks: DataFrame, settings: MovieSettings = MovieSettings(), ranges: list[tuple[int, int]] | None = None) -> dict[str, DataFrame]:
    """Movies blocks(recording_id, frame, by, bx, v), found without traces: the frames' gradient scores, and their separated peaks (inside the half-open
    ranges, if given) with the front fitted to each, q over the movie's fitted ones, and `significant`."""
    s = settings
    change = cut(imaging.relative_change(blocks, REC, s.baseline_sigma, s.spatial_sigma))
    metrics = cut(imaging.gradient_metrics(change, REC, s.temporal_sigma))
    peaks = episodes.score_peaks(metrics.select(*REC, "frame", F.col("score").alias("v")), "recording_id", s.separation, s.prominence)
    peaks = episodes.overlapping_ranges(peaks, ranges) if ranges else peaks
    fits = wave_tables.movie_fits(imaging.temporal_gradient(change, REC, s.temporal_sigma), peaks.select(*REC, F.col("frame").alias("centre")), REC, s)
    ranked = ranking.benjamini_hochberg(fits, "p", REC, ["centre"])
    strong = F.coalesce((F.col("status") == "ok") & (F.col("q") <= s.alpha) & (F.col("r2") >= s.least_r2), F.lit(False))
    scored = metrics.withColumnRenamed("frame", "centre").withColumn("centre", F.col("centre").cast("int"))
    return {"metrics": metrics, "episodes": ranked.withColumn("significant", strong).join(scored, [*REC, "centre"])}


def analyse_phasic(blocks: DataFrame, settings: PhasicSettings = PhasicSettings(), baseline_sigma: float = 35.0, spatial_sigma: float = 0.8) -> dict[str, DataFrame]:
    """Movies blocks(recording_id, frame, by, bx, v) by their active voxels: the voxels with their components, and a row a component with the front through
    its places' first frames, null where there are too few."""
    s = settings
    change = imaging.relative_change(blocks, REC, baseline_sigma, spatial_sigma)
    filled = cut(waves.flood_fill(waves.phasic(change, REC, s.threshold, s.neighbours, s.mode), REC, s.least_voxels))
    fits = wave_tables.component_fits(filled, REC, s)
    own = [*REC, "component"]
    renamed = fits.select(*own, *[F.col(c).alias(f"arrival_{c}") for c in fits.columns if c not in own])
    return {"voxels": filled, "components": wave_tables.component_rows(filled, REC, s).join(renamed, own, "left")}
