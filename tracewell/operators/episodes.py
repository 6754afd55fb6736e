"""Onsets and candidate episodes of propagating activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.peaks import local_maxima, peaks_min_distance, prominences
from tracewell.operators.traces import KEY, convolve, derivative_weights, samples_of, trace_arrays


def derivative_onsets(arrays: DataFrame, sigma: float, quantile: float = 0.99, separation: int | None = None) -> DataFrame:
    """(key, frame, v): peaks of the smoothed derivative (edge samples repeated) that reach the trace's quantile, thinned from the highest down
    if a separation is given. Thinning first removes none that reach the quantile but by those that do."""
    sloped = convolve(arrays, derivative_weights(sigma), "nearest")
    d = samples_of(sloped)
    height = d.groupBy(*KEY).agg(F.percentile("v", quantile).alias("height"))
    found = local_maxima(d) if separation is None else peaks_min_distance(sloped, separation)
    return found.join(height, KEY).filter(F.col("v") >= F.col("height")).select(*KEY, "frame", "v")


def candidate_episodes(density: DataFrame, null_peaks: DataFrame, key: str, alpha: float = 0.05, separation: int | None = None) -> DataFrame:
    """(key, frame, v, threshold): peaks of density(key, frame, v) that reach the (1 - alpha) quantile of the nulls' peaks, with a prominence of at
    least a quarter, and a twentieth of the threshold; thinned from the highest down if a separation is given."""
    level = null_peaks.groupBy(F.col(key).alias("recording_id")).agg(F.percentile("peak", 1 - alpha).alias("threshold"))
    samples = density.select(F.col(key).alias("recording_id"), F.lit(0).alias("roi_idx"), "frame", "v")
    thinned = None if separation is None else peaks_min_distance(trace_arrays(samples), separation)
    found = prominences(samples, thinned).join(level, "recording_id")
    ok = found.filter((F.col("v") >= F.col("threshold")) & (F.col("prominence") >= F.greatest(F.lit(0.25), F.col("threshold") * 0.05)))
    return ok.select(F.col("recording_id").alias(key), "frame", "v", "threshold")


def score_peaks(scores: DataFrame, key: str, separation: int, least_prominence: float) -> DataFrame:
    """(key, frame, v) of the peaks of scores(key, frame, v), one row a frame, thinned from the highest down, with at least that prominence."""
    samples = scores.select(F.col(key).alias("recording_id"), F.lit(0).alias("roi_idx"), "frame", "v")
    found = prominences(samples, peaks_min_distance(trace_arrays(samples), separation))
    return found.filter(F.col("prominence") >= least_prominence).select(F.col("recording_id").alias(key), "frame", "v")


def significant_episodes(episodes: DataFrame, movies: DataFrame, keys: list[str], alpha: float = 0.05, turn: float = 45.0, radius: float = 250.0) -> DataFrame:
    """episodes with `confirmed`: the movie's fit has the same model, is significant, and points the same way within turn degrees, or, of radial
    ones, starts within radius (source_x, source_y of both; where a side lacks them, no radial one is confirmed)."""
    place = [c if c in movies.columns else None for c in ("source_x", "source_y")]
    m = movies.select(*keys, F.col("model").alias("movie_model"), F.col("p").alias("movie_p"), F.col("direction").alias("movie_direction"),
                      *[F.col(c).alias(f"movie_{c}") for c in place if c])
    angle = F.abs(F.pmod(F.col("direction") - F.col("movie_direction") + 180.0, F.lit(360.0)) - 180.0)
    agrees = angle <= turn
    near = F.lit(False)
    if all(place) and {"source_x", "source_y"} <= set(episodes.columns):
        near = F.hypot(F.col("source_x") - F.col("movie_source_x"), F.col("source_y") - F.col("movie_source_y")) <= radius
    agrees = F.when(F.col("model") == "radial", near).otherwise(agrees)
    ok = (F.col("movie_model") == F.col("model")) & (F.col("movie_p") <= alpha) & agrees
    return episodes.join(m, keys, "left").withColumn("confirmed", F.coalesce(ok, F.lit(False)))


def episode_counts(episodes: DataFrame, recordings: DataFrame, key: str) -> DataFrame:
    """Per recording: number of episodes, 0 for those without."""
    n = episodes.groupBy(key).agg(F.count(F.lit(1)).alias("n_episodes"))
    return recordings.select(key).join(n, key, "left").select(key, F.coalesce("n_episodes", F.lit(0)).alias("n_episodes"))


def overlapping_ranges(frames: DataFrame, ranges: list[tuple[int, int]], frame: str = "frame") -> DataFrame:
    """Rows whose frame lies in any half-open range."""
    ok = F.lit(False)
    for lo, hi in ranges:
        ok = ok | ((F.col(frame) >= lo) & (F.col(frame) < hi))
    return frames.filter(ok)


def first_of_run(events: DataFrame, keys: list[str], frame: str, gap: int) -> DataFrame:
    """Events with no other within `gap` frames before them."""
    w = Window.partitionBy(*keys).orderBy(frame)
    return events.withColumn("gap_", F.col(frame) - F.lag(frame).over(w)).filter(F.col("gap_").isNull() | (F.col("gap_") > gap)).drop("gap_")
