"""Matching in time, space and identity: pulses, coincidences, masks, cells over days."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tracewell.functions.kernels import assignment
from tracewell.functions.pairwise import SpikeTiling, Trains, near_counts, nonzero_tiles, overlaps, rounded
from tracewell.operators.cells import across, all_pairs, fields, flat, in_cells

#: Trains of a cell's left side at once.
STRIP = 256


def schedule(start: int, interval: int, frames: int) -> list[int]:
    return list(range(start, frames, interval))


def resolve_schedule(recording: str, frames: int, overrides: dict[str, list[int]] | None = None, start: int | None = None, interval: int | None = None, given: list[int] | None = None) -> list[int]:
    """A recording's pulses: its own override, else every interval from start, else the given list; none of them is an error."""
    if overrides and recording in overrides:
        return list(overrides[recording])
    if start is not None and interval is not None:
        return schedule(start, interval, frames)
    if given:
        return list(given)
    raise ValueError("give start and interval, or a schedule")


def pulse_match(spikes: DataFrame, pulses: list[int], window: int, keys: list[str]) -> DataFrame:
    """spikes(keys.., frame) with pulse, the pulse that each answers, or null. Each pulse, in order, takes the nearest unused spike from
    0 to `window` frames behind it.

    With pulses more than `window` apart no spike can answer two, so it is one ranked join inside the JVM; else the greedy order
    matters, and each train is folded in vectorised Python.
    """
    times = sorted(pulses)
    if all(b - a > window for a, b in zip(times, times[1:], strict=False)):
        grid = F.array(*[F.lit(p) for p in times])
        near = F.filter(grid, lambda p: (F.col("frame") >= p) & (F.col("frame") <= p + window))
        found = spikes.withColumn("pulse", F.get(near, F.lit(0)))
        first = F.row_number().over(Window.partitionBy(*keys, "pulse").orderBy("frame"))
        return found.withColumn("pulse", F.when(first == 1, F.col("pulse")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame").reset_index(drop=True)
        answer = pd.Series([None] * len(pdf), dtype="Int64")
        for p in times:
            ok = pdf.index[(pdf["frame"] >= p) & (pdf["frame"] <= p + window) & answer.isna()]
            if len(ok):
                answer[ok[0]] = p
        return pdf.assign(pulse=answer)

    from pyspark.sql import types as T

    return spikes.groupBy(*keys).applyInPandas(run, T.StructType([*spikes.schema.fields, T.StructField("pulse", T.IntegerType())]))


def response_groups(matched: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., n_responses, group_id): trains by the number of pulses they answer."""
    n = matched.groupBy(*keys).agg(F.countDistinct("pulse").alias("n_responses"))
    return n.withColumn("group_id", F.when(F.col("n_responses") > 0, F.concat(F.lit("ON_"), F.col("n_responses").cast("string"), F.lit("_response(s)"))))


def stereotypy(matched: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per train with at least two evoked events: mean, sample deviation and their ratio (null for a mean of 0)."""
    evoked = matched.filter(F.col("pulse").isNotNull() & F.col(value).isNotNull())
    s = evoked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).filter("n >= 2")
    return s.withColumn("cv", F.try_divide(F.col("sd"), F.nullif(F.col("mean"), F.lit(0.0))))


def activations(samples: DataFrame, keys: list[str], bins: list[tuple[int, int]], threshold: float) -> DataFrame:
    """(keys.., bin, sign): per response bin [lo, hi) the direction of the larger step in it, +1 ON (on a tie) or -1 OFF, if at least
    `threshold`; trains that answer mostly in one direction keep only that one."""
    d = samples.withColumn("d", F.col("v") - F.lag("v").over(Window.partitionBy(*keys).orderBy("frame")))
    ranges = F.array(*[F.struct(F.lit(k).alias("bin"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, (lo, hi) in enumerate(bins)])
    inside = F.filter(ranges, lambda b: (F.col("frame") >= b["lo"]) & (F.col("frame") < b["hi"]))
    binned = d.select(*keys, "d", F.explode(inside).alias("b")).groupBy(*keys, F.col("b.bin").alias("bin")).agg(
        F.max(F.greatest("d", F.lit(0.0))).alias("up"), F.max(F.greatest(-F.col("d"), F.lit(0.0))).alias("down"))
    signed = binned.filter(F.greatest("up", "down") >= threshold).select(*keys, "bin", F.when(F.col("up") >= F.col("down"), 1).otherwise(-1).alias("sign"))
    net = F.sum("sign").over(Window.partitionBy(*keys))
    return signed.withColumn("net", net).filter((F.col("net") == 0) | (F.signum("net") == F.col("sign"))).drop("net")


def coincidence(times: DataFrame, dt: float, recording: str = "recording_id", train: str = "roi_idx", t: str = "t") -> DataFrame:
    """(recording, i, j, n_i, hits): for each ordered pair of trains of a recording, how many of i's events have one of j's within dt.

    Every row is an event. Trains meet in cells of two blocks, where running counts are looked up at the ends of each train's
    spans, so events are never paired. Pairs that never come near produce no row (they have 0 hits). Rows come in an order that
    Parquet writes small: by tiles, with like trains side by side.
    """
    kind = times.schema[train].dataType
    rows = times.filter(F.col(t).isNotNull()).groupBy(recording, train).agg(F.collect_list(F.col(t).cast("double")).alias("times"))
    rows = rows.join(times.groupBy(recording, train).agg(F.count(F.lit(1)).alias("n_i")), [recording, train])

    def run(a: pa.Table, b: pa.Table, same: bool) -> Iterator[dict]:
        a, b = (x.take(pa.array(Trains(x["times"]).likeness())).combine_chunks() for x in (a, b))
        right = Trains(b["times"])
        nodes, others = (flat(x[train]) for x in (a, b))
        sizes, their = (x["n_i"].to_numpy() for x in (a, b))
        for at in range(0, len(a), STRIP):
            strip = a.slice(at, STRIP).combine_chunks()
            left = Trains(strip["times"])
            hits = near_counts(left, right, dt)
            if same:
                hits[np.arange(len(strip)), np.arange(at, at + len(strip))] = 0
            i, j = nonzero_tiles(hits)
            yield {"i": nodes.take(pa.array(i + at)), "j": others.take(pa.array(j)), "n_i": sizes[i + at], "hits": hits[i, j]}
            if not same:
                hits = near_counts(right, left, dt)
                j, i = nonzero_tiles(hits)
                yield {"i": others.take(pa.array(j)), "j": nodes.take(pa.array(i + at)), "n_i": their[j], "hits": hits[j, i]}

    schema = StructType([StructField("i", kind), StructField("j", kind), *fields("hits long, n_i long").fields])
    return in_cells(rows, [recording], train, run, schema)


def tiled_fraction(times: DataFrame, dt: float, start: float, stop: float, keys: list[str], t: str = "t") -> DataFrame:
    """(keys.., tiled): share of [start, stop] that is within dt of an event, by merging overlapping intervals."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    spans = times.select(*keys, F.greatest(F.col(t) - dt, F.lit(start)).alias("lo"), F.least(F.col(t) + dt, F.lit(stop)).alias("hi")).filter("hi > lo")
    reached = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("add", F.greatest(F.col("hi") - F.greatest("lo", F.coalesce(reached, F.col("lo"))), F.lit(0)))
    return new.groupBy(*keys).agg((F.sum("add") / F.lit(float(stop - start))).alias("tiled"))


def trains(times: DataFrame, dt: float, start: float, stop: float, recording: str = "recording_id", train: str = "roi_idx", t: str = "t") -> DataFrame:
    """(recording, train, times, tiled): the events of each train and the share of [start, stop] that they tile."""
    events = times.filter(F.col(t).isNotNull()).groupBy(recording, train).agg(F.collect_list(F.col(t).cast("double")).alias("times"))
    return events.join(tiled_fraction(times, dt, start, stop, [recording, train], t), [recording, train])


def sttc(times: DataFrame, dt: float, start: float, stop: float, recording: str = "recording_id", train: str = "roi_idx", t: str = "t", digits: int | None = None) -> DataFrame:
    """(recording, i, j, sttc) with i < j for all pairs of trains that have events: the spike time tiling coefficient."""
    rows = trains(times, dt, start, stop, recording, train, t)
    return all_pairs(rows, [recording], train, SpikeTiling(dt, digits=digits)).withColumnRenamed("value", "sttc")


def mask_sets(rows: DataFrame, keys: list[str], mask: str, pixel: str) -> DataFrame:
    """(keys.., mask, px, n): each mask's distinct pixels in one row, and their number."""
    known = rows.dropna(subset=[*keys, mask])
    return known.groupBy(*keys, F.col(mask).alias("mask")).agg(F.collect_set(pixel).alias("px"), F.max(F.col(pixel).isNull().cast("long")).alias("n")).withColumn("n", F.col("n") + F.size("px"))


def mask_iou(left: DataFrame, right: DataFrame, keys: list[str], mask: str, pixel: str, digits: int | None = None) -> DataFrame:
    """(keys.., a, b, common, iou) of all overlapping masks of two sides; masks meet in cells, pixels don't travel in pairs. A mask fits a row."""
    sides = [mask_sets(rows, keys, mask, pixel) for rows in (left, right)]

    def run(a: pa.Table, b: pa.Table) -> Iterator[dict]:
        first, second, nb = flat(a["mask"]), flat(b["mask"]), b["n"].to_numpy()
        for at in range(0, len(a), STRIP):
            strip = a.slice(at, STRIP).combine_chunks()
            common = overlaps(strip["px"], b["px"])
            i, j = np.nonzero(common)
            c = common[i, j]
            iou = c / (strip["n"].to_numpy()[i] + nb[j] - c)
            yield {"a": first.take(pa.array(i + at)), "b": second.take(pa.array(j)), "common": c, "iou": rounded(iou, digits)}

    kinds = [rows.schema["mask"].dataType for rows in sides]
    schema = StructType([StructField("a", kinds[0]), StructField("b", kinds[1]), *fields("common long, iou double").fields])
    return across(*sides, keys, "mask", run, schema)


def near_pairs(left: DataFrame, right: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """(keys.., a, b, distance) of points within radius: a grid of cells as wide as the radius makes it an equi-join."""
    cx, cy = F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    l = left.select(*keys, F.col("node").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), cx.alias("cx"), cy.alias("cy"))  # noqa: E741
    r = right.select(*keys, F.col("node").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), cx.alias("bx"), cy.alias("by"))
    r = r.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).select(*keys, "b", "xb", "yb", (F.col("bx") + F.col("dx")).alias("cx"), (F.col("by") + F.col("dy")).alias("cy"))
    d = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    return l.join(r, [*keys, "cx", "cy"]).withColumn("distance", d).filter(F.col("distance") <= radius).select(*keys, "a", "b", "distance")


def mask_shift(left: DataFrame, right: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys.., dy, dx, overlap): the shift of right's pixels that overlaps left's most; of equals the smallest. Pixels meet in cells as
    wide as the largest shift."""
    cell = lambda c: F.floor(F.col(c) / most)
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    l = left.select(*keys, "y", "x").distinct().select(*keys, F.col("y").alias("ya"), F.col("x").alias("xa"), cell("y").alias("cy"), cell("x").alias("cx"))  # noqa: E741
    r = right.select(*keys, "y", "x").distinct().withColumn("ey", F.explode(around)).withColumn("ex", F.explode(around))
    r = r.select(*keys, F.col("y").alias("yb"), F.col("x").alias("xb"), (cell("y") + F.col("ey")).alias("cy"), (cell("x") + F.col("ex")).alias("cx"))
    d = l.join(r, [*keys, "cy", "cx"]).select(*keys, (F.col("ya") - F.col("yb")).alias("dy"), (F.col("xa") - F.col("xb")).alias("dx"))
    counts = d.filter((F.abs("dy") <= most) & (F.abs("dx") <= most)).groupBy(*keys, "dy", "dx").agg(F.count(F.lit(1)).alias("overlap"))
    best = F.min_by(F.struct("dy", "dx", "overlap"), F.struct((-F.col("overlap")).alias("o"), (F.abs("dy") + F.abs("dx")).alias("s"), "dy", "dx")).alias("b")
    return counts.groupBy(*keys).agg(best).select(*keys, "b.dy", "b.dx", "b.overlap")


def assign(candidates: DataFrame, keys: list[str], a: str, b: str, score: str, least: float = 0.0, margin: float = 0.1) -> DataFrame:
    """One-to-one matches of largest total score in each key, those of at least `least`, with `ambiguous`: its score is not
    `margin` above the anchor's second-ranked candidate. A key is one image pair, so its candidates are bounded."""
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = np.unique(pdf[a]), np.unique(pdf[b])
        s = np.zeros((len(left), len(right)))
        s[np.searchsorted(left, pdf[a]), np.searchsorted(right, pdf[b])] = pdf[score]
        i, j, unclear = _matched(s, least, margin)
        out = pd.DataFrame({a: left[i], b: right[j], score: s[i, j], "ambiguous": unclear})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, a, b, score, "ambiguous"]]

    schema = ", ".join([f"{c} {kinds[c]}" for c in (*keys, a, b)] + [f"{score} double", "ambiguous boolean"])
    return candidates.select(*keys, a, b, score).groupBy(*keys).applyInPandas(run, schema)


def _matched(s: np.ndarray, least: float, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = assignment(-s)
    second = np.partition(s, -2, axis=1)[:, -2] if s.shape[1] > 1 else np.zeros(len(s))
    ok = (s[i, j] > 0) & (s[i, j] >= least)
    i, j = i[ok], j[ok]
    return i, j, (second[i] > 0) & (s[i, j] - second[i] < margin)


def assign_masks(left: DataFrame, right: DataFrame, keys: list[str], mask: str, pixel: str, least: float = 0.0, margin: float = 0.1, digits: int | None = None) -> DataFrame:
    """(keys.., a, b, iou, ambiguous): assign() of mask_iou(), whose candidates are made where they are matched. A key is one image pair: its
    masks, and a matrix of their scores, fit a task."""
    sides = [mask_sets(rows, keys, mask, pixel) for rows in (left, right)]

    def run(a: pa.Table, b: pa.Table) -> Iterator[dict]:
        s = np.zeros((len(a), len(b)))
        a, b = a.sort_by("mask").combine_chunks(), b.sort_by("mask").combine_chunks()
        for at in range(0, len(a), STRIP):
            strip = a.slice(at, STRIP).combine_chunks()
            common = overlaps(strip["px"], b["px"])
            s[at : at + len(strip)] = common / (strip["n"].to_numpy()[:, None] + b["n"].to_numpy()[None, :] - common)
        met, meets = np.flatnonzero(s.any(axis=1)), np.flatnonzero(s.any(axis=0))
        if len(met):
            i, j, unclear = _matched(s[np.ix_(met, meets)], least, margin)
            i, j = met[i], meets[j]
            yield {"a": flat(a["mask"]).take(pa.array(i)), "b": flat(b["mask"]).take(pa.array(j)), "iou": rounded(s[i, j], digits), "ambiguous": unclear}

    kinds = [rows.schema["mask"].dataType for rows in sides]
    schema = StructType([StructField("a", kinds[0]), StructField("b", kinds[1]), *fields("iou double, ambiguous boolean").fields])
    return across(*sides, keys, "mask", run, schema, size=1 << 40)


def match_score(iou: Column, distance: Column, most: float) -> Column:
    return 0.75 * iou + 0.25 * F.exp(-0.5 * F.pow(distance / (most / 2), 2))


def first_days(history: DataFrame, cell: list[str], day: str, flags: dict[str, Column]) -> DataFrame:
    """Per cell: days seen, and for each flag the first day on which it holds."""
    return history.groupBy(*cell).agg(F.countDistinct(day).alias("n_days"), *[F.min(F.when(c, F.col(day))).alias(f"first_{n}_day") for n, c in flags.items()])


def dominant_overlap(a: DataFrame, b: DataFrame, keys: list[str], item: str) -> DataFrame:
    """For each group of a the group of b that shares most items: (keys.., ga, gb, n_common, jaccard); ties by jaccard, then id."""
    left, right = a.select(*keys, "ga", item).distinct(), b.select(*keys, "gb", item).distinct()
    common = left.join(right, [*keys, item]).groupBy(*keys, "ga", "gb").agg(F.count(F.lit(1)).alias("n_common"))
    na, nb = left.groupBy(*keys, "ga").agg(F.count(F.lit(1)).alias("na")), right.groupBy(*keys, "gb").agg(F.count(F.lit(1)).alias("nb"))
    scored = common.join(na, [*keys, "ga"]).join(nb, [*keys, "gb"]).withColumn("jaccard", F.col("n_common") / (F.col("na") + F.col("nb") - F.col("n_common")))
    w = Window.partitionBy(*keys, "ga").orderBy(F.desc("n_common"), F.desc("jaccard"), "gb")
    return scored.withColumn("r", F.row_number().over(w)).filter("r = 1").select(*keys, "ga", "gb", "n_common", "jaccard")


def nearest_arrivals(centres: DataFrame, onsets: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """(keys.., centre, node, onset): each node's onset nearest to the centre within radius, the earlier of equals. An as-of join on
    buckets of width radius."""
    bucket = lambda c: F.floor(F.col(c) / radius)
    c = centres.select(*keys, "centre", F.explode(F.array(bucket("centre") - 1, bucket("centre"), bucket("centre") + 1)).alias("bucket"))
    o = onsets.select(*keys, "node", "onset", bucket("onset").alias("bucket"))
    near = c.join(o, [*keys, "bucket"]).filter(F.abs(F.col("onset") - F.col("centre")) <= radius)
    return near.groupBy(*keys, "centre", "node").agg(F.min_by("onset", F.struct(F.abs(F.col("onset") - F.col("centre")).alias("d"), F.col("onset"))).alias("onset"))
