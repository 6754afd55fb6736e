"""Peaks in traces and their features, over long samples (recording_id, roi_idx, frame, v).

A peak is a strict local maximum; a plateau counts once, at its middle rounded down; edges are never peaks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import kernels
from tracewell.functions.kernels import find_peaks
from tracewell.operators.traces import KEY, in_order


def local_maxima(samples: DataFrame) -> DataFrame:
    """(key, frame, v) of each peak. Runs of equal samples are collapsed to one row first."""
    started = samples.withColumn("new", F.coalesce((F.col("v") != F.lag("v").over(in_order())).cast("int"), F.lit(1)))
    runs = started.withColumn("run", F.sum("new").over(in_order())).groupBy(*KEY, "run").agg(
        F.min("frame").alias("first"), F.max("frame").alias("last"), F.max("v").alias("v"))
    by_run = Window.partitionBy(*KEY).orderBy("run")
    sides = runs.withColumns({"before": F.lag("v").over(by_run), "after": F.lead("v").over(by_run)})
    peaks = sides.filter((F.col("v") > F.col("before")) & (F.col("v") > F.col("after")))
    return peaks.select(*KEY, F.floor((F.col("first") + F.col("last")) / 2).cast("int").alias("frame"), "v")


def _by_trace(samples: DataFrame, items: DataFrame, columns: list[str], work: Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray]], dict], out: str) -> DataFrame:
    """(key, out..) of work(frames, v, items' columns) for each trace that has items.

    A trace and its items meet once, as one row of arrays: both sides are grouped by the key, so the join adds no shuffle, and no
    sample is copied for each item.
    """
    arrays = samples.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("frame", "v"))).alias("s"))
    lists = items.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("t"))
    rows = arrays.join(lists, KEY).select(*KEY, *[F.col(f"s.{c}").alias(f"s_{c}") for c in ("frame", "v")], *[F.col(f"t.{c}").alias(f"t_{c}") for c in columns])
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema.fields}
    names = [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for r in pdf.itertuples(index=False):
                found = work(np.asarray(r.s_frame), np.asarray(r.s_v, dtype=float), {c: np.asarray(getattr(r, f"t_{c}")) for c in columns})
                parts.append(pd.DataFrame({KEY[0]: getattr(r, KEY[0]), KEY[1]: getattr(r, KEY[1]), **found}))
            yield pd.concat(parts)[[*KEY, *names]] if parts else pd.DataFrame({c: [] for c in [*KEY, *names]})

    return rows.mapInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in KEY], out]))


def prominences(samples: DataFrame, peaks: DataFrame | None = None) -> DataFrame:
    """(key, frame, v, left_base, right_base, prominence): a peak's height over the higher of its two bases.

    A base is the lowest sample between the peak and the next higher sample, or the trace's end; the nearest of equals.
    """
    peaks = local_maxima(samples) if peaks is None else peaks

    def work(frames, v, t):
        at = np.searchsorted(frames, t["frame"])
        height, left, right = kernels.prominences(v, at)
        return {"frame": t["frame"], "v": v[at], "left_base": frames[left], "right_base": frames[right], "prominence": height}

    return _by_trace(samples, peaks, ["frame"], work, "frame int, v double, left_base int, right_base int, prominence double")


def peak_widths(samples: DataFrame, peaks: DataFrame, level: float = 0.5) -> DataFrame:
    """(key, frame, width): each peak's width in samples at `level` of its prominence, interpolated."""

    def work(frames, v, t):
        return {"frame": t["frame"], "width": kernels.widths(v, np.searchsorted(frames, t["frame"]), level)}

    return _by_trace(samples, peaks, ["frame"], work, "frame int, width double")


def with_radius(samples: DataFrame, peaks: DataFrame, factor: float = 1.5) -> DataFrame:
    """peaks with `radius`: factor times the median width of their trace's peaks, for peak_clusters; factor itself where that is no number."""
    widths = peak_widths(samples, peaks).groupBy(*KEY).agg(F.median("width").alias("median_"))
    known = F.col("median_").isNotNull() & ~F.isnan("median_") & (F.col("median_") > 0)
    return peaks.join(widths, KEY).withColumn("radius", factor * F.when(known, F.col("median_")).otherwise(1.0)).drop("median_")


def peak_clusters(peaks: DataFrame, radius: float | None) -> DataFrame:
    """peaks with `cluster`: consecutive peaks at most `radius` frames apart share one, numbered from 0 in each trace. None: their own column
    radius, from with_radius()."""
    apart = F.col("radius") if radius is None else F.lit(radius)
    far = F.coalesce((F.col("frame") - F.lag("frame").over(in_order()) > apart).cast("int"), F.lit(0))
    return peaks.withColumn("far", far).withColumn("cluster", F.sum("far").over(in_order()).cast("int")).drop("far")


def peak_hierarchy(peaks: DataFrame, radius: float | None = None) -> DataFrame:
    """peaks(.., prominence) with cluster, parent_prominence (the cluster's largest) and dominance (its share of it)."""
    by_cluster = Window.partitionBy(*KEY, "cluster")
    out = peak_clusters(peaks, radius).withColumn("parent_prominence", F.max("prominence").over(by_cluster))
    return out.withColumn("dominance", F.col("prominence") / (F.col("parent_prominence") + 1e-9))


def valley_windows(samples: DataFrame, peaks: DataFrame) -> DataFrame:
    """(key, frame, lo, hi): half-open window from the lowest sample behind the previous peak to the lowest before the next one; the
    trace's first and last peak look to its ends. The lowest frame of equals."""

    def work(frames, v, t):
        at = np.searchsorted(frames, t["frame"])
        before, after = np.append(0, at[:-1]), np.append(at[1:], len(v))
        lo = [frames[a + np.argmin(v[a:b])] if b > a else frames[b] for a, b in zip(before, at, strict=True)]
        hi = [frames[a + np.argmin(v[a:b])] for a, b in zip(at, after, strict=True)]
        return {"frame": t["frame"], "lo": lo, "hi": hi}

    return _by_trace(samples, peaks, ["frame"], work, "frame int, lo int, hi int")


def window_samples(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, frame, i, y, pk): each window's samples, scaled to 0..1 by its extremes, i from 0, pk the peak's i.

    Windows shorter than 3 samples or flat within 1e-8 are left out. A window's samples are cut out of its trace's array.
    """

    def work(frames, v, t):
        lo, hi = np.searchsorted(frames, t["lo"]), np.searchsorted(frames, t["hi"])
        parts = []
        for f, first, a, b in zip(t["frame"], t["lo"], lo, hi, strict=True):
            x = v[a:b]
            if len(x) >= 3 and (height := x.max() - x.min()) > 1e-8:
                y = (x - x.min()) / height
                parts.append((np.full(len(x), f), frames[a:b] - first, y, np.full(len(x), frames[a + int(np.argmax(y))] - first)))
        empty = (np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0), np.zeros(0, dtype=int))
        return dict(zip(("frame", "i", "y", "pk"), map(np.concatenate, zip(*parts, strict=True)) if parts else empty, strict=True))

    return _by_trace(samples, windows, ["frame", "lo", "hi"], work, "frame int, i int, y double, pk int")


def rise_slope(ws: DataFrame, fs: float = 1.0) -> DataFrame:
    """(key, frame, value): slope of the line through the samples up to the peak against time; null for one sample."""
    up = ws.filter(F.col("i") <= F.col("pk"))
    return up.groupBy(*KEY, "frame").agg(F.when(F.count(F.lit(1)) >= 2, F.regr_slope("y", F.col("i") / fs)).alias("value"))


def decay_tau(ws: DataFrame, fs: float = 1.0) -> DataFrame:
    """(key, frame, value): time from the peak until y first is at most 1/e, interpolated; null if it never is."""
    w = Window.partitionBy(*KEY, "frame").orderBy("i")
    down = ws.filter(F.col("i") >= F.col("pk")).withColumn("before", F.lag("y").over(w)).withColumn("j", F.col("i") - F.col("pk"))
    e = F.exp(F.lit(-1.0))
    crossed = down.filter(F.col("y") <= e).groupBy(*KEY, "frame").agg(F.min(F.struct("j", "y", "before")).alias("c"))
    c = F.when(F.col("c.j") == 0, 0.0).otherwise(F.col("c.j") - 1 + (F.col("c.before") - e) / (F.col("c.before") - F.col("c.y")))
    return ws.select(*KEY, "frame").distinct().join(crossed, [*KEY, "frame"], "left").select(*KEY, "frame", (c / fs).alias("value"))


def half_max_width(ws: DataFrame, fs: float = 1.0, level: float = 0.5) -> DataFrame:
    """(key, frame, value): time between the crossings of `level` nearest to the peak, interpolated; null unless both exist."""
    w = Window.partitionBy(*KEY, "frame").orderBy("i")
    near = ws.withColumns({"before": F.lag("y").over(w), "after": F.lead("y").over(w)})
    low = near.filter(F.col("y") <= level)
    left = F.max(F.when(F.col("i") < F.col("pk"), F.struct("i", "y", "after"))).alias("l")
    right = F.min(F.when(F.col("i") > F.col("pk"), F.struct("i", "y", "before"))).alias("r")
    both = low.groupBy(*KEY, "frame").agg(left, right)
    a = F.col("l.i") + (level - F.col("l.y")) / (F.col("l.after") - F.col("l.y"))
    b = F.col("r.i") - 1 + (F.col("r.before") - level) / (F.col("r.before") - F.col("r.y"))
    return ws.select(*KEY, "frame").distinct().join(both, [*KEY, "frame"], "left").select(*KEY, "frame", ((b - a) / fs).alias("value"))


def min_distance_frames(fs: float) -> int:
    """20 frames at 15 Hz, at least 3; rounded half to even."""
    return max(3, round(20 * fs / 15))


def peaks_min_distance(arrays: DataFrame, distance: int) -> DataFrame:
    """(key, frame, v): peaks thinned from the highest down, each removing lower ones nearer than `distance`.

    The order makes it sequential, so it runs as vectorised Python on whole traces, batch by batch, without a shuffle.
    """
    def run(batches):
        for pdf in batches:
            out = []
            for rec, roi, f in zip(pdf["recording_id"], pdf["roi_idx"], pdf["f"], strict=True):
                x = np.asarray(f, dtype=float)
                if len(x) >= 3 and np.isfinite(x).all():
                    at = find_peaks(x, distance)
                    out.append(pd.DataFrame({"recording_id": rec, "roi_idx": roi, "frame": at, "v": x[at]}))
            yield pd.concat(out) if out else pd.DataFrame({"recording_id": [], "roi_idx": [], "frame": [], "v": []})

    kinds = {f.name: f.dataType.simpleString() for f in arrays.schema.fields}
    return arrays.select(*KEY, "f").mapInPandas(run, f"recording_id {kinds['recording_id']}, roi_idx {kinds['roi_idx']}, frame int, v double")


def neuron_summary(peaks: DataFrame, n_frames: int, fs: float = 1.0, stats: tuple[str, ...] = ("prominence",)) -> DataFrame:
    """One row a trace: spike_count, spike_freq, spike_indices, and mean_ and var_ (sample) of each statistic."""
    columns = [x for s in stats for x in (F.avg(s).alias(f"mean_{s}"), F.var_samp(s).alias(f"var_{s}"))]
    return peaks.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("spike_count"), (F.count(F.lit(1)) / (n_frames / fs)).alias("spike_freq"),
        F.array_sort(F.collect_list("frame")).alias("spike_indices"), *columns)


def section_summary(peaks: DataFrame, sections: dict[str, tuple[int, int]], fs: float = 1.0) -> DataFrame:
    """One row a trace and section [lo, hi): spike_count, spike_freq, active. Sections may overlap."""
    named = F.array(*[F.struct(F.lit(k).alias("section"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, (lo, hi) in sections.items()])
    rows = peaks.select(*KEY, "frame", F.explode(named).alias("s")).select(*KEY, "s.section", "s.lo", "s.hi", "frame")
    count = F.count(F.when((F.col("frame") >= F.col("lo")) & (F.col("frame") < F.col("hi")), 1))
    return rows.groupBy(*KEY, "section").agg(count.alias("spike_count"), (count / ((F.max("hi") - F.max("lo")) / fs)).alias("spike_freq"), (count > 0).alias("active"))


