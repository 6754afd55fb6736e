"""Images and movies as rows (keys.., y, x, v): preparation, registration, front geometry and gradient metrics."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.kernels import phase_shift
from tracewell.operators.traces import convolve, derivative_weights, gaussian_weights


def _own(df: DataFrame) -> DataFrame:
    """df with columns of its own, so that a cogroup of two frames that come from one table can tell them apart."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def standardize(pixels: DataFrame, keys: list[str], height: int, width: int, taper: bool = True) -> DataFrame:
    """v clipped to its 1st and 99th percentile, z-scored, and tapered to 0 at the edges by a Hann window."""
    q = pixels.groupBy(*keys).agg(F.percentile("v", 0.01).alias("lo"), F.percentile("v", 0.99).alias("hi"))
    clipped = pixels.join(q, keys).withColumn("v", F.least(F.greatest("v", "lo"), "hi"))
    s = clipped.groupBy(*keys).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = F.coalesce((F.col("v") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)), F.lit(0.0))
    if taper:
        hann = lambda c, n: 0.5 - 0.5 * F.cos(2 * np.pi * F.col(c) / (n - 1))
        z = z * hann("y", height) * hann("x", width)
    return clipped.join(s, keys).select(*keys, "y", "x", z.alias("v"))


def stretch(pixels: DataFrame, keys: list[str], top: float = 180.0) -> DataFrame:
    """v from its 1st to its 99.5th percentile onto 0 to top."""
    q = pixels.groupBy(*keys).agg(F.percentile("v", 0.01).alias("lo"), F.percentile("v", 0.995).alias("hi"))
    scaled = (F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return pixels.join(q, keys).select(*keys, "y", "x", (F.least(F.greatest(F.coalesce(scaled, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * top).alias("v"))


def shift_image(pixels: DataFrame, keys: list[str], dy: int, dx: int, height: int, width: int) -> DataFrame:
    """Pixels moved by whole steps; what leaves the image is lost, what is uncovered has no row."""
    moved = pixels.select(*keys, (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), "v")
    return moved.filter((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))


def correlation_for_shift(anchor: DataFrame, moving: DataFrame, keys: list[str], dy: int, dx: int) -> DataFrame:
    """(keys.., r): correlation of the overlap when moving is shifted; 0 where either hardly varies."""
    m = moving.select(*keys, (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.col("v").alias("w"))
    both = anchor.join(m, [*keys, "y", "x"])
    return both.groupBy(*keys).agg(F.coalesce(F.covar_pop("v", "w") / F.nullif(F.stddev_pop("v") * F.stddev_pop("w"), F.lit(0.0)), F.lit(0.0)).alias("r"))


def translations(anchor: DataFrame, moving: DataFrame, keys: list[str], height: int, width: int, max_shift: int, log_highpass: float | None = None) -> DataFrame:
    """(keys.., dy, dx, r): the shift of each pair of images by phase correlation, with the overlap's correlation. A pair of images fits a task.

    log_highpass: take log(1 + v) and subtract a blur of that width first, as for snapshots of uneven brightness.
    """
    kinds = {f.name: f.dataType.simpleString() for f in anchor.schema.fields}

    def image(pdf: pd.DataFrame) -> np.ndarray:
        a = np.zeros((height, width))
        a[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf["v"].to_numpy()
        if log_highpass:
            a = np.log1p(np.maximum(a, 0))
            w = np.array(gaussian_weights(log_highpass))
            blur = a
            for axis in (0, 1):
                padded = np.pad(blur, [(len(w) // 2,) * 2 if k == axis else (0, 0) for k in (0, 1)], "symmetric")
                blur = np.apply_along_axis(lambda r: np.convolve(r, w, "valid"), axis, padded)
            a = a - blur
        s = a.std()
        return (a - a.mean()) / s if s > 0 else a * 0

    def run(key: tuple, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({**{k: [] for k in keys}, "dy": [], "dx": [], "r": []})
        a, b = image(one), image(two)
        taper = np.outer(np.hanning(height), np.hanning(width))
        dy, dx = phase_shift(a * taper, b * taper, max_shift)
        over = (slice(max(0, dy), height + min(0, dy)), slice(max(0, dx), width + min(0, dx)))
        under = (slice(max(0, -dy), height + min(0, -dy)), slice(max(0, -dx), width + min(0, -dx)))
        x, y = a[over].ravel(), b[under].ravel()
        r = float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 and y.std() > 0 else 0.0
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "dy": [dy], "dx": [dx], "r": [r]})

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys]) + ", dy int, dx int, r double"
    return _own(anchor).groupBy(*keys).cogroup(_own(moving).groupBy(*keys)).applyInPandas(run, schema)


def outline(pixels: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """(keys.., y, x) of a mask's outline: within one 4-neighbour step of it, but not inside it with all 4 neighbours."""
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    mask = pixels.select(*keys, "y", "x").distinct()
    votes = mask.select(*keys, "y", "x", F.explode(steps).alias("s")).select(*keys, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    n = votes.groupBy(*keys, "y", "x").agg(F.count(F.lit(1)).alias("n")).filter("n < 5")
    return n.filter((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)).select(*keys, "y", "x")


def front_boundary(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., frame, by, bx) of active blocks that lack one of their 8 neighbours in the frame."""
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    a = voxels.select(*keys, "frame", "by", "bx").distinct()
    votes = a.withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around)).select(*keys, "frame", (F.col("by") + F.col("dy")).alias("by"), (F.col("bx") + F.col("dx")).alias("bx"))
    full = votes.groupBy(*keys, "frame", "by", "bx").agg(F.count(F.lit(1)).alias("n")).filter("n = 9")
    return a.join(full, [*keys, "frame", "by", "bx"], "left_anti")


def leading_edge_speed(voxels: DataFrame, keys: list[str], separation: int, fs: float = 1.0, block_um: float = 1.0) -> DataFrame:
    """(keys.., speed, pairs): the distance from a front block to the nearest one `separation` frames before, its median over a frame's blocks and then over
    frames, as a speed, and the number of such frames; null and 0 where there are none. A frame's front meets the whole earlier one, however far."""
    front = front_boundary(voxels, keys)
    old = front.select(*keys, (F.col("frame") + separation).alias("frame"), F.col("by").alias("oy"), F.col("bx").alias("ox"))
    d = F.sqrt(F.pow(F.col("by") - F.col("oy"), 2) + F.pow(F.col("bx") - F.col("ox"), 2))
    near = front.join(old, [*keys, "frame"]).groupBy(*keys, "frame", "by", "bx").agg(F.min(d).alias("d"))
    by_frame = near.groupBy(*keys, "frame").agg(F.median("d").alias("d"))
    speed = by_frame.groupBy(*keys).agg((F.median("d") * block_um * fs / separation).alias("speed"), F.count(F.lit(1)).alias("pairs"))
    return voxels.select(*keys).distinct().join(speed, keys, "left").fillna(0, ["pairs"])


def single_front_fraction(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., fraction): share of active frames whose active blocks are one 8-connected part."""
    from tracewell.operators.graph import components

    frames = [*keys, "frame"]
    ids = voxels.select(*frames, "by", "bx").distinct().withColumn("node", (F.col("by") * 10_000 + F.col("bx")).cast("long"))
    ahead = ids.select(*frames, F.col("node").alias("a"), F.explode(F.array(*[F.col("node") + k for k in (1, 9_999, 10_000, 10_001)])).alias("b"))
    edges = ahead.join(ids.select(*frames, F.col("node").alias("b")), [*frames, "b"], "left_semi")
    parts = components(ids.select(*frames, "node"), edges, frames).groupBy(*frames).agg(F.countDistinct("component").alias("n"))
    return parts.groupBy(*keys).agg(F.avg((F.col("n") == 1).cast("double")).alias("fraction"))


def _time_courses(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., by, bx, frames, raw, f): one array a block, in frame order; f is raw, to be filtered."""
    course = blocks.groupBy(*keys, "by", "bx").agg(F.array_sort(F.collect_list(F.struct("frame", "v"))).alias("s"))
    raw = F.transform("s", lambda x: x["v"])
    return course.select(*keys, "by", "bx", F.transform("s", lambda x: x["frame"]).alias("frames"), raw.alias("raw"), raw.alias("f"))


def _smooth_along(blocks: DataFrame, keys: list[str], axis: str, other: str, sigma: float) -> DataFrame:
    """v smoothed along one axis of each frame, its edges repeated."""
    lines = blocks.groupBy(*keys, "frame", other).agg(F.array_sort(F.collect_list(F.struct(axis, "v"))).alias("s"))
    lines = lines.select(*keys, "frame", other, F.transform("s", lambda x: x[axis]).alias("at"), F.transform("s", lambda x: x["v"]).alias("f"))
    flat = convolve(lines, gaussian_weights(sigma), "nearest").select(*keys, "frame", other, F.explode(F.arrays_zip("at", "f")).alias("z"))
    return flat.select(*keys, "frame", other, F.col("z.at").alias(axis), F.col("z.f").alias("v"))


def relative_change(blocks: DataFrame, keys: list[str], sigma: float = 35.0, spatial: float = 0.0) -> DataFrame:
    """(keys.., frame, by, bx, v): (v - baseline) over the larger of baseline and floor, with the frame's median taken off, smoothed within
    frames if spatial is above 0. The baseline is a Gaussian over time with edges repeated, the floor 5 % of the baseline's median, 1 at
    least. Time courses travel as arrays, one a block."""
    course = convolve(_time_courses(blocks, keys), gaussian_weights(sigma), "nearest")
    ordered, n = F.array_sort("f"), F.size("f")
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    floored = course.withColumn("floor", F.greatest(middle * 0.05, F.lit(1.0)))
    change = F.zip_with("raw", "f", lambda v, b: (v - b) / F.greatest(b, F.col("floor")))
    flat = floored.select(*keys, "by", "bx", F.explode(F.arrays_zip("frames", change.alias("change"))).alias("c"))
    flat = flat.select(*keys, "by", "bx", F.col("c.frames").alias("frame"), F.col("c.change").alias("v"))
    flat = flat.withColumn("v", F.col("v") - F.median("v").over(Window.partitionBy(*keys, "frame"))).select(*keys, "frame", "by", "bx", "v")
    if spatial > 0:
        flat = _smooth_along(_smooth_along(flat, keys, "by", "bx", spatial), keys, "bx", "by", spatial)
    return flat.select(*keys, "frame", "by", "bx", "v")


def temporal_gradient(blocks: DataFrame, keys: list[str], sigma: float = 1.0) -> DataFrame:
    """(keys.., frame, by, bx, v, gt): gt is the Gaussian derivative over time, edges repeated."""
    sloped = convolve(_time_courses(blocks, keys), derivative_weights(sigma), "nearest")
    flat = sloped.select(*keys, "by", "bx", F.explode(F.arrays_zip("frames", "raw", "f")).alias("c"))
    return flat.select(*keys, F.col("c.frames").alias("frame"), "by", "bx", F.col("c.raw").alias("v"), F.col("c.f").alias("gt"))


def gradient_metrics(blocks: DataFrame, keys: list[str], sigma: float = 1.0) -> DataFrame:
    """(keys.., frame, energy, spatiality, coherence, divergence, score) as robust z-scores over frames: how much rises, how unevenly, how much of the
    flow across level lines goes one way, and how much spreads out. Differences in space are central, one-sided at the edges."""

    def slope(c: str, axis: str, others: list[str]):
        w = Window.partitionBy(*keys, "frame", *others).orderBy(axis)
        after, before = F.lead(c).over(w), F.lag(c).over(w)
        return F.coalesce((after - before) / 2, after - F.col(c), F.col(c) - before, F.lit(0.0))

    frame = Window.partitionBy(*keys, "frame")
    g = temporal_gradient(blocks, keys, sigma).withColumns({"gy": slope("v", "by", ["bx"]), "gx": slope("v", "bx", ["by"])})
    g = g.withColumn("steep", F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    g = g.withColumn("damp", F.greatest(F.percentile("steep", 0.75).over(frame) * 0.1, F.lit(1e-12)))
    g = g.withColumns({f"flow_{a}": -F.col("gt") * F.col(f"g{a}") / (F.col("steep") + F.col("damp")) for a in "xy"})
    size = F.sqrt(F.col("flow_x") * F.col("flow_x") + F.col("flow_y") * F.col("flow_y"))
    g = g.withColumns({"size": size, "rise": F.greatest("gt", F.lit(0.0)), "div": slope("flow_x", "bx", ["by"]) + slope("flow_y", "by", ["bx"])})
    weight = F.col("rise") * F.sqrt("steep")
    along = [F.coalesce(F.sum(F.when(F.col("size") > 0, weight * F.col(f"flow_{a}") / F.col("size"))) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(0.0)) for a in "xy"]
    frames = g.groupBy(*keys, "frame").agg(
        F.percentile("rise", 0.9).alias("energy"), (F.stddev_pop("gt") / (F.avg(F.abs("gt")) + 1e-12)).alias("spatiality"),
        F.sqrt(F.pow(along[0], 2) + F.pow(along[1], 2)).alias("coherence"), F.percentile(F.greatest("div", F.lit(0.0)), 0.95).alias("divergence"))
    w = Window.partitionBy(*keys)
    for c in ("energy", "spatiality", "coherence", "divergence"):
        frames = frames.withColumn("m_", F.median(c).over(w)).withColumn("d_", F.median(F.abs(F.col(c) - F.col("m_"))).over(w))
        frames = frames.withColumn(c, (F.col(c) - F.col("m_")) / F.greatest(F.col("d_") * 1.4826, F.lit(1e-12))).drop("m_", "d_")
    return frames.withColumn("score", F.col("energy") + 0.5 * F.col("spatiality") + 0.5 * F.greatest("coherence", "divergence"))


def lag_null(edges: DataFrame, coords: DataFrame, keys: list[str], repeats: int = 99, mode: str = "sign", strata: str | None = None, seed: int = 42) -> DataFrame:
    """(keys.., score, p) of the front that edges(keys.., i, j, lag, corr) draw over coords(keys.., node, x, y), against lags with random signs, or
    permuted within strata. An episode's graph fits a task, which takes it apart once for all repeats."""
    from tracewell.functions.kernels import ArrivalGraph, graph_arrivals, linear_r2, radial_fit, radial_grid

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def run(key: tuple, e: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(e) or not len(c):
            return pd.DataFrame({**{k: [] for k in keys}, "score": [], "p": []})
        e = e.sort_values(["i", "j"]).reset_index(drop=True)
        nodes = np.unique(np.concatenate([e["i"], e["j"]]))
        xy = c.set_index("node").loc[nodes, ["x", "y"]].to_numpy(float)
        pair = np.column_stack([np.searchsorted(nodes, e["i"]), np.searchsorted(nodes, e["j"])])
        lag, weight = e["lag"].to_numpy(float), np.maximum(e["corr"].to_numpy(float), 0)
        design = np.column_stack([np.ones(len(xy)), xy])
        graph, around = ArrivalGraph(len(nodes), pair, weight), radial_grid(xy, 7)

        def score(lags):
            t = graph_arrivals(len(nodes), pair, lags, weight, 3, graph)
            return max(linear_r2(design, t), radial_fit(around, t)[0])

        rng = np.random.default_rng(zlib.crc32(f"{seed}|{key}".encode()))
        groups = e.groupby(strata).indices.values() if strata else [np.arange(len(e))]
        null = []
        for _ in range(repeats):
            fake = lag.copy()
            if mode == "sign":
                fake *= rng.choice([-1.0, 1.0], len(fake))
            else:
                for g in groups:
                    fake[g] = lag[rng.permutation(g)]
            null.append(score(fake))
        s = score(lag)
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "score": [s], "p": [(1 + sum(x >= s for x in null)) / (1 + repeats)]})

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys]) + ", score double, p double"
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # else small partitions are put together, though their work isn't small
    one, other = (_own(x).repartition(tasks, *keys) for x in (edges, coords))
    return one.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInPandas(run, schema)
