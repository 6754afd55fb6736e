"""Whole analyses put together from the operators: one recording's, comparisons of treatments and days, and training a classifier."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import features, graph, matching, models, peaks, similarity, summary, traces, validation


@dataclass(frozen=True)
class Settings:
    """What an analysis depends on. Strategies that aren't known are an error, disabled ones are left out."""

    fs: float = 15.0
    sigma: float = 4.0
    distance: int | None = None
    cluster_radius: float | None = None  # 1.5 times the trace's median width
    max_lag: int = 3
    sttc_dt: float = 1.0
    threshold: float = 0.65
    pulses: tuple[int, ...] = ()
    pulse_window: int | None = None
    strategies: tuple[str, ...] = ("combined",)
    disabled: tuple[str, ...] = ()
    known: tuple[str, ...] = field(default=("combined", "dtw", "light_evoked"), repr=False)

    def active(self) -> list[str]:
        names = [s for s in self.strategies if s not in self.disabled]
        if unknown := [s for s in names if s not in self.known]:
            raise ValueError(f"unknown strategies {unknown}; known are {list(self.known)}")
        if "light_evoked" in names and (not self.pulses or self.pulse_window is None):
            raise ValueError("light_evoked needs pulses and pulse_window")
        return names


def analyse_recordings(samples: DataFrame, settings: Settings, accept: DataFrame | None = None) -> dict[str, DataFrame]:
    """All recordings of samples(recording_id, roi_idx, frame, v) at once: normalised and smoothed traces, events with features, a summary per neuron
    and recording, and groups by each strategy. accept(recording_id, roi_idx) keeps those traces only. Recordings
    without events or with one neuron flow through as empty results."""
    kept = samples if accept is None else samples.join(accept, ["recording_id", "roi_idx"], "left_semi")
    scaled = traces.minmax(kept)
    arrays = scaled.groupBy("recording_id", "roi_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "v"))), lambda x: x["v"]).alias("f"))
    smooth = traces.convolve(arrays, traces.gaussian_weights(settings.sigma))
    flat = traces.samples_of(smooth)
    thinned = peaks.peaks_min_distance(smooth, settings.distance or peaks.min_distance_frames(settings.fs))
    events = peaks.prominences(flat, thinned)
    events = peaks.peak_hierarchy(events if settings.cluster_radius is not None else peaks.with_radius(flat, events), settings.cluster_radius)
    windows = peaks.valley_windows(flat, thinned)
    n = samples.groupBy("recording_id").agg((F.max("frame") + 1).alias("n"))  # recordings differ in length
    neurons = peaks.neuron_summary(events, 1, 1.0).join(n, "recording_id").withColumn("spike_freq", F.col("spike_count") * settings.fs / F.col("n")).drop("n")
    tall = summary.stat_bases(neurons, ["recording_id", "roi_idx", "spike_count"]).withColumnRenamed("spike_count", "w")
    out = {"events": features.event_features(events, windows, flat), "neurons": neurons, "summary": summary.summarize_video(tall, ["recording_id"])}
    for strategy in settings.active():
        if strategy == "combined":
            trains = thinned.select("recording_id", "roi_idx", F.col("frame").cast("long").alias("t"))
            dt = settings.sttc_dt * settings.fs
            rows = smooth.select("recording_id", "roi_idx", "f").join(matching.trains(trains, dt, 0, 1 << 30), ["recording_id", "roi_idx"])
            out["combined"] = graph.hierarchical_rows(rows, ["recording_id"], "roi_idx", similarity.combined_measure(settings.max_lag, dt), settings.threshold)
        elif strategy == "dtw":
            d = similarity.soft_dtw_pairs(smooth)
            level = d.filter("distance > 0").groupBy("recording_id").agg(F.percentile("distance", 0.3).alias("most"))
            near = d.join(level, "recording_id").filter(F.col("distance") <= F.col("most")).select("recording_id", F.col("i").alias("a"), F.col("j").alias("b"))
            nodes = smooth.select("recording_id", F.col("roi_idx").alias("node"))
            out["dtw"] = graph.min_size_groups(graph.components(nodes, near, ["recording_id"]), ["recording_id"], "component", 2)
        elif strategy == "light_evoked":
            matched = matching.pulse_match(thinned.select("recording_id", "roi_idx", "frame"), list(settings.pulses), settings.pulse_window, ["recording_id", "roi_idx"])
            out["light_evoked"] = matching.response_groups(matched, ["recording_id", "roi_idx"])
        else:
            raise NotImplementedError(f"strategy {strategy}")
    return out


def recluster(pairs: DataFrame, groups: DataFrame, threshold: float, least_size: int = 2) -> DataFrame:
    """Groups cut again within themselves: (recording_id, group_id, node), sub-groups named {parent}_sub{k}. pairs(recording_id, i, j, value),
    groups(recording_id, group_id, node)."""
    a = groups.select("recording_id", "group_id", F.col("node").alias("i"))
    b = groups.select("recording_id", "group_id", F.col("node").alias("j"))
    inside = pairs.join(a, ["recording_id", "i"]).join(b, ["recording_id", "group_id", "j"])
    cut = graph.hierarchical(inside, ["recording_id", "group_id"], threshold)
    sized = graph.min_size_groups(cut.withColumnRenamed("group_id", "parent"), ["recording_id", "parent"], "cluster", least_size)
    return sized.select("recording_id", F.concat_ws("_sub", F.col("parent").cast("string"), F.col("group_id").cast("string")).alias("group_id"), "node")


def treatment_comparison(recordings: DataFrame, replicate: str = "animal", by_day: bool = False) -> dict[str, DataFrame]:
    """recordings(treatment, <replicate>, day, w, mean, var_total) to replicates, weighted by neurons, and treatments (and days), weighted by recordings;
    keys are compared as text. With the issues found: repeated recordings and treatments of fewer than two replicates."""
    keys = ["treatment", *(["day"] if by_day else [])]
    text = recordings.withColumns({k: F.col(k).cast("string") for k in {*keys, replicate}})
    replicates = summary.aggregate_children(text, [*keys, replicate])
    treatments = summary.aggregate_children(replicates.withColumn("w", F.col("n_children").cast("double")).drop("n_children"), keys)
    return {"replicates": replicates, "treatments": treatments, "issues": validation.low_replicates(text, "treatment", replicate)}


def longitudinal_comparison(recordings: DataFrame) -> DataFrame:
    """recordings(grp, day, w, mean, var_total) by group and day, days as text."""
    return summary.aggregate_children(recordings.withColumn("day", F.col("day").cast("string")), ["grp", "day"]).orderBy("grp", "day")


def train_classifier(labelled: DataFrame, columns: list[str], label: str, key: str, kinds: tuple[str, ...] = ("RF", "LR"), grid: dict[str, dict[str, list]] | None = None) -> dict:
    """The best of the model kinds on their best transform and features, tuned by cross-validation on the training part if a grid is given for its
    kind; scores are on the test part."""
    train, test = models.split(models.clean(labelled, columns), key)
    best: tuple | None = None
    for kind in kinds:
        transform, _ = models.best_transform(train, test, columns, label, kind)
        chosen, score = models.best_features(traces.transform_features(train, columns, transform), traces.transform_features(test, columns, transform), columns, label, kind)
        if best is None or score > best[0]:
            best = (score, kind, transform, chosen)
    score, kind, transform, chosen = best
    prepared = traces.transform_features(train, columns, transform)
    model = models.tune(prepared, chosen, label, kind, grid[kind]) if grid and kind in grid else models.fit(prepared, chosen, label, kind)
    return {"model": model, "kind": kind, "transform": transform, "features": chosen, "roc_auc": models.evaluate(model, traces.transform_features(test, columns, transform), chosen, label), "importance": models.importance(model)}
