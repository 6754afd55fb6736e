"""Propagating activity: event density, episodes, front fits, block movies and phasic components."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.kernels import graph_arrivals, hull, hull_area, linear_r2, radial_scores, refined_origin
from tracewell.operators.graph import components
from tracewell.operators.traces import gaussian_weights


def event_density(events: DataFrame, keys: list[str], frame: str, n_frames: int) -> DataFrame:
    """(keys.., frame, n) on a dense grid of frames."""
    counts = events.groupBy(*keys, frame).agg(F.count(F.lit(1)).alias("n"))
    by_key = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(frame).cast("int"), "n"))).alias("m"))
    grid = by_key.select(*keys, "m", F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1))).alias("frame"))
    return grid.select(*keys, "frame", F.coalesce(F.try_element_at("m", F.col("frame")), F.lit(0)).alias("n"))


def smoothed_density(events: DataFrame, keys: list[str], train: str, frame: str, n_frames: int | str, sigma: float) -> DataFrame:
    """(keys.., frame, v) on a dense grid of frames: trains with an event in the frame, smoothed by a Gaussian with nothing outside. Only frames with
    events are spread, by the kernel's offsets. n_frames is a number or a column of events that depends on the keys alone."""
    weights = gaussian_weights(sigma)
    offsets = F.array(*[F.struct(F.lit(k - len(weights) // 2).alias("o"), F.lit(w).alias("w")) for k, w in enumerate(weights)])
    own = events.withColumn("n_", F.lit(n_frames) if isinstance(n_frames, int) else F.col(n_frames).cast("int"))
    inside = own.filter((F.col(frame) >= 0) & (F.col(frame) < F.col("n_")))
    counts = inside.select(*keys, "n_", train, frame).distinct().groupBy(*keys, "n_", frame).agg(F.count(F.lit(1)).alias("n"))
    at = counts.select(*keys, "n_", "n", F.col(frame).cast("int").alias("f_"), F.explode(offsets).alias("k"))
    spread = at.select(*keys, "n_", (F.col("f_") + F.col("k.o")).alias("frame"), (F.col("n") * F.col("k.w")).alias("v"))
    grid = own.select(*keys, "n_").distinct().select(*keys, "n_", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)).alias("frame"), F.lit(0.0).alias("v"))
    both = spread.filter("frame >= 0 and frame < n_").unionByName(grid)
    return both.groupBy(*keys, "frame").agg(F.round(F.sum("v"), 12).alias("v"))


def planar_r2(points: DataFrame, keys: list[str], x: str = "x", y: str = "y", t: str = "onset") -> DataFrame:
    """(keys.., n, r2): R squared of the least-squares plane t ~ x + y, from second moments alone; 0 where they don't determine it."""
    m = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.covar_pop(a, b).alias(f"c_{k}") for k, (a, b) in {"xx": (x, x), "yy": (y, y), "tt": (t, t), "xy": (x, y), "xt": (x, t), "yt": (y, t)}.items()])
    det = F.col("c_xx") * F.col("c_yy") - F.col("c_xy") * F.col("c_xy")
    bx = (F.col("c_xt") * F.col("c_yy") - F.col("c_yt") * F.col("c_xy")) / F.nullif(det, F.lit(0.0))
    by = (F.col("c_yt") * F.col("c_xx") - F.col("c_xt") * F.col("c_xy")) / F.nullif(det, F.lit(0.0))
    r2 = (bx * F.col("c_xt") + by * F.col("c_yt")) / F.nullif(F.col("c_tt"), F.lit(0.0))
    return m.select(*keys, "n", F.coalesce(F.greatest(r2, F.lit(0.0)), F.lit(0.0)).alias("r2"))


def radial_score(points: DataFrame, keys: list[str], grid: int = 5, margin: float = 0.25, t: str = "onset") -> DataFrame:
    """(keys.., score): the largest squared positive correlation of t with the distance from a grid of origins around the points. Each point
    meets grid squared origins, a constant."""
    ends = points.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    steps = F.sequence(F.lit(0), F.lit(grid - 1))
    o = points.join(ends, keys).withColumn("gi", F.explode(steps)).withColumn("gj", F.explode(steps))

    def origin(lo: str, hi: str, k: str):
        return F.col(lo) - margin * (F.col(hi) - F.col(lo)) + (1 + 2 * margin) * (F.col(hi) - F.col(lo)) * F.col(k) / (grid - 1)

    d = F.sqrt(F.pow(F.col("x") - origin("x0", "x1", "gi"), 2) + F.pow(F.col("y") - origin("y0", "y1", "gj"), 2))
    r = o.withColumn("d", d).groupBy(*keys, "gi", "gj").agg((F.covar_pop("d", t) / F.nullif(F.stddev_pop("d") * F.stddev_pop(t), F.lit(0.0))).alias("r"))
    return r.groupBy(*keys).agg(F.max(F.pow(F.greatest(F.coalesce("r", F.lit(0.0)), F.lit(0.0)), 2)).alias("score"))


def hull_areas(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., area) of the points' convex hull, 0 below three points. A hull is one of its parts' hulls, so tasks take shares of the points
    and only the corners meet."""
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    own = ", ".join([*[f"{k} {kinds[k]}" for k in keys], ""])
    shares = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.pmod(F.xxhash64("x", "y"), F.lit(64)).alias("share"))

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(hull(pdf[["x", "y"]].to_numpy(float)), columns=["x", "y"])
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "x", "y"]]

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "area": [hull_area(pdf[["x", "y"]].to_numpy(float))]})

    parts = shares.groupBy(*keys, "share").applyInPandas(corners, f"{own}x double, y double")
    return parts.groupBy(*keys).applyInPandas(area, f"{own}area double")


def best_front(coords: np.ndarray, values: np.ndarray) -> tuple[str, float, np.ndarray | None]:
    """The better of a plane and a radial front on the grid of origins: model, r2, and the radial one's origin."""
    planar = linear_r2(np.column_stack([np.ones(len(coords)), coords]), values)
    radial, origin = radial_scores(coords, values)
    return ("planar", planar, None) if planar >= radial else ("radial", radial, origin)


def describe_front(coords: np.ndarray, values: np.ndarray, front: tuple[str, float, np.ndarray | None], fs: float, pixel_um: float) -> dict:
    """r2, speed, direction in degrees (planes) and source_x, source_y of best_front()'s front: a radial one's refined origin, or a plane's first point
    on its way (the points' middle, and no direction, if it is flat)."""
    model, r2, origin = front
    direction = None
    if model == "planar":
        way = np.linalg.lstsq(np.column_stack([np.ones(len(coords)), coords]), values, rcond=None)[0][1:]
        slope, source = float(np.hypot(*way)), coords.mean(axis=0)
        if slope > 0:
            direction, source = float(np.degrees(np.arctan2(way[1], way[0])) % 360), coords[int(np.argmin(coords @ way))]
    else:
        source, slope, r2 = refined_origin(coords, values, origin)
    speed = pixel_um * fs / slope if slope else float("nan")
    return {"r2": r2, "speed": speed, "direction": direction, "source_x": float(source[0]), "source_y": float(source[1])}


def fit_propagation(points: DataFrame, keys: list[str], repeats: int = 99, fs: float = 1.0, pixel_um: float = 1.0, t: str = "onset", seed: int = 42, field: DataFrame | None = None) -> DataFrame:
    """(keys.., model, r2, p, speed, direction, source_x, source_y, coverage) for each episode: the better of a plane and a radial front on the
    grid of origins, its permutation p, then the radial origin refined and r2 with it; speed, a plane's direction in degrees (null for radial
    fronts), the source (a plane's is its first point); and the share of the field's hull that the points' hull covers.

    field(x, y, and those of keys that tell fields apart) holds all places; without it the episodes' own points are the one field. An
    episode is one field of view, so it fits a task.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    field = points.select("x", "y") if field is None else field
    of = [k for k in keys if k in field.columns]
    names = ["model", "r2", "p", "speed", "direction", "source_x", "source_y", "area"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node") if "node" in pdf else pdf
        c, v = pdf[["x", "y"]].to_numpy(float), pdf[t].to_numpy(float)
        front = best_front(c, v)
        rng = np.random.default_rng(zlib.crc32(f"{seed}|{'|'.join(str(pdf[k].iloc[0]) for k in keys)}".encode()))
        reached = sum(best_front(c, rng.permutation(v))[1] >= front[1] for _ in range(repeats))
        row = {"model": front[0], "p": (1 + int(reached)) / (1 + repeats), "area": hull_area(c), **describe_front(c, v, front, fs, pixel_um)}
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, **{n: [row[n]] for n in names}})

    kind = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "model string", *[f"{n} double" for n in names[1:]]])
    fits = points.groupBy(*keys).applyInPandas(run, kind)
    whole = hull_areas(field, of) if of else hull_areas(field.withColumn("one_", F.lit(1)), ["one_"])
    whole = whole.withColumnRenamed("area", "field_area")
    joined = fits.join(whole, of) if of else fits.crossJoin(F.broadcast(whole.drop("one_")))  # one row
    share = F.coalesce(F.col("area") / F.nullif("field_area", F.lit(0.0)), F.lit(0.0))
    return joined.select(*keys, *names[:-1], share.alias("coverage"))


def arrivals(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., node, arrival) from edges(keys.., i, j, lag, corr): least-squares arrival times, weights the correlations."""
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([pdf["i"], pdf["j"]]))
        e = np.column_stack([np.searchsorted(nodes, pdf["i"]), np.searchsorted(nodes, pdf["j"])])
        out = pd.DataFrame({"node": nodes, "arrival": graph_arrivals(len(nodes), e, pdf["lag"].to_numpy(float), np.maximum(pdf["corr"].to_numpy(float), 0))})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "node", "arrival"]]

    return edges.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", node {kinds['i']}, arrival double")


def block_mean(pixels: DataFrame, keys: list[str], block: int, height: int, width: int) -> DataFrame:
    """(keys.., by, bx, v): means of whole blocks; what is left over at the edges is cropped."""
    whole = pixels.filter((F.col("y") < height // block * block) & (F.col("x") < width // block * block))
    return whole.groupBy(*keys, F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx")).agg(F.avg("v").alias("v"))


def phasic(blocks: DataFrame, keys: list[str], threshold: float, least_neighbours: int = 0, mode: str = "level") -> DataFrame:
    """(keys.., frame, by, bx): blocks whose robust z in their own time course is at least threshold, with enough of the 8 neighbours active in
    the same frame. mode: level, or derivative (central differences, one-sided at the ends). The neighbours are one equi-join on shifted places."""
    place = [*keys, "by", "bx"]
    if mode == "derivative":
        after, before = (f("v").over(Window.partitionBy(*place).orderBy("frame")) for f in (F.lead, F.lag))
        blocks = blocks.withColumn("v", F.coalesce((after - before) / 2, after - F.col("v"), F.col("v") - before, F.lit(0.0)))
    elif mode != "level":
        raise ValueError(f"unknown mode {mode!r}; level or derivative")
    w = Window.partitionBy(*place)
    m = blocks.withColumn("m", F.median("v").over(w))
    z = m.withColumn("mad", F.median(F.abs(F.col("v") - F.col("m"))).over(w)).withColumn("z", (F.col("v") - F.col("m")) / F.greatest(F.col("mad") * 1.4826, F.lit(1e-7)))
    active = z.filter(F.col("z") >= threshold).select(*keys, "frame", "by", "bx")
    if not least_neighbours:
        return active
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    moved = active.withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around)).filter("dy <> 0 or dx <> 0")
    votes = moved.select(*keys, "frame", (F.col("by") + F.col("dy")).alias("by"), (F.col("bx") + F.col("dx")).alias("bx")).groupBy(*keys, "frame", "by", "bx").agg(F.count(F.lit(1)).alias("n"))
    return active.join(votes.filter(F.col("n") >= least_neighbours), [*keys, "frame", "by", "bx"], "left_semi")


#: Stride of voxel ids.
SIDE = 1 << 20


def flood_fill(voxels: DataFrame, keys: list[str], least_size: int = 1) -> DataFrame:
    """voxels(keys.., frame, by, bx) with `component` (its first voxel's id) and component_size, 26-connected.

    An id is (frame * SIDE + by) * SIDE + bx, for grids of under SIDE - 1 blocks a side: a step over an edge meets no voxel.
    """
    ids = voxels.withColumn("node", (F.col("frame").cast("long") * SIDE + F.col("by")) * SIDE + F.col("bx"))
    offsets = F.array(*[F.lit((df * SIDE + dy) * SIDE + dx) for df in (0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (df, dy, dx) > (0, 0, 0)])
    ahead = ids.select(*keys, F.col("node").alias("a"), F.explode(F.transform(offsets, lambda o: F.col("node") + o)).alias("b"))
    edges = ahead.join(ids.select(*keys, F.col("node").alias("b")), [*keys, "b"], "left_semi")
    labels = components(ids.select(*keys, "node"), edges, keys)
    sized = ids.join(labels, [*keys, "node"]).withColumn("component_size", F.count(F.lit(1)).over(Window.partitionBy(*keys, "component")))
    return sized.filter(F.col("component_size") >= least_size)


def component_extent(filled: DataFrame, keys: list[str]) -> DataFrame:
    """Per component: size, duration, extent in blocks and active places."""
    return filled.groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("n_voxels"), (F.max("frame") - F.min("frame") + 1).alias("duration"), (F.max("by") - F.min("by") + 1).alias("height"),
        (F.max("bx") - F.min("bx") + 1).alias("width"), F.countDistinct("by", "bx").alias("n_places"))


def recurrence_clusters(episodes: DataFrame, keys: list[str], space: float, angle: float) -> DataFrame:
    """episodes(keys.., node, x, y, direction, and model if any) with `cluster`: components of episodes whose scaled distance in place and direction
    is at most 1; -1 for single ones. Pairs in which one has no direction (null or NaN) are 0 apart in it if both are radial, else 1."""
    from tracewell.operators.matching import near_pairs

    near = near_pairs(episodes, episodes, space, keys).filter("a < b")
    model = F.col("model") if "model" in episodes.columns else F.lit(None).cast("string")
    way = F.when(~F.isnan("direction"), F.col("direction"))
    d = [episodes.select(*keys, F.col("node").alias(e), way.alias(f"d{e}"), F.coalesce(model == "radial", F.lit(False)).alias(f"r{e}")) for e in "ab"]
    turn = F.abs(F.pmod(F.col("da") - F.col("db") + 180.0, F.lit(360.0)) - 180.0)
    term = F.coalesce(turn / angle, F.when(F.col("ra") & F.col("rb"), 0.0).otherwise(1.0))
    close = near.join(d[0], [*keys, "a"]).join(d[1], [*keys, "b"]).filter(F.pow(F.col("distance") / space, 2) + F.pow(term, 2) <= 1)
    labels = components(episodes.select(*keys, "node"), close, keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "component"))
    return episodes.join(labels, [*keys, "node"]).withColumn("cluster", F.when(n > 1, F.col("component")).otherwise(-1)).drop("component")
