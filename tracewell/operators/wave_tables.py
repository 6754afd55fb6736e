"""Propagation over graphs of neighbours, for whole tables of episodes: reliable parts, arrival times, their front, its nulls, and corrected tests."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.kernels import ArrivalGraph, linear_r2, radial_fit, radial_grid, robust_arrivals
from tracewell.operators.graph import components
from tracewell.operators.imaging import _own, leading_edge_speed, single_front_fraction
from tracewell.operators.ranking import benjamini_hochberg
from tracewell.operators.traces import derivative_weights
from tracewell.operators.waves import best_front, describe_front, fit_propagation


@dataclass(frozen=True)
class GraphSettings:
    """What an episode's graph must be, and how it is tested."""

    least_correlation: float = 0.20
    least_sharpness: float = 0.03
    least_nodes: int = 20
    iterations: int = 4
    repeats: int = 499
    distance_bins: int = 5
    reliability_bins: int = 3
    least_r2: float = 0.15
    alpha: float = 0.05
    seed: int = 2718


def reliable_component(edges: DataFrame, keys: list[str], least_correlation: float = 0.20, least_sharpness: float = 0.03) -> DataFrame:
    """edges(keys.., i, j, lag, corr, sharpness) that are reliable and lie in the key's largest connected part, by nodes; of equals the part with
    the smallest node."""
    good = edges.filter((F.col("corr") >= least_correlation) & (F.col("sharpness") >= least_sharpness))
    nodes = good.select(*keys, F.col("i").alias("node")).union(good.select(*keys, F.col("j").alias("node"))).distinct()
    labels = components(nodes, good.select(*keys, F.col("i").alias("a"), F.col("j").alias("b")), keys)
    sizes = labels.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("less"), "component")).alias("c")).select(*keys, F.col("c.component").alias("component"))
    inside = labels.join(largest, [*keys, "component"]).select(*keys, F.col("node").alias("i"))
    return good.join(inside, [*keys, "i"], "left_semi")


def edge_weight(corr, sharpness):
    return F.pow(F.greatest(corr, F.lit(0.0)), 2) * F.greatest(sharpness, F.lit(0.01))


OUT = "status string, n_nodes long, n_edges long, edge_r2 double, edge_rmse double, model string, r2 double, sign_flip_p double, lag_permutation_p double, arrivals map<long, double>"


def _bins(values: np.ndarray, n: int) -> np.ndarray:
    """Equally filled bins by rank of the quantiles."""
    return np.searchsorted(np.quantile(values, np.linspace(0, 1, n + 1)[1:-1]), values, side="right")


def graph_fronts(edges: DataFrame, coords: DataFrame, keys: list[str], settings: GraphSettings = GraphSettings()) -> DataFrame:
    """One row for each episode of coords(keys.., node, x, y): its reliable part's arrival times, how well they explain the edges' lags, the better
    of a plane and a radial front through them, and that front's p against lags with random signs, and permuted among edges of like length
    and weight. Status insufficient_connected_graph, and nulls, where the part is too small. An episode fits a task."""
    kinds = {f.name: f.dataType.simpleString() for f in coords.schema.fields}
    reliable = reliable_component(edges, keys, settings.least_correlation, settings.least_sharpness)
    rows = reliable.select(*keys, "i", "j", F.col("lag").cast("double").alias("lag"), edge_weight(F.col("corr"), F.col("sharpness")).alias("w"))

    def front(xy: np.ndarray, around: tuple, t: np.ndarray) -> tuple[str, float]:
        planar, radial = linear_r2(np.column_stack([np.ones(len(xy)), xy]), t), radial_fit(around, t)[0]
        return ("planar", planar) if planar >= radial else ("radial", radial)

    def run(key: tuple, c: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        own = dict(zip(keys, key, strict=True))
        if not len(c):
            return pd.DataFrame({**{k: [] for k in keys}, **{x.split()[0]: [] for x in OUT.split(", ") if " " in x}})
        e = e.sort_values(["i", "j"]).reset_index(drop=True)
        nodes = np.unique(np.concatenate([e["i"], e["j"]])).astype(int)
        out = {"status": "insufficient_connected_graph", "n_nodes": len(nodes), "n_edges": len(e), "edge_r2": None, "edge_rmse": None, "model": None, "r2": None, "sign_flip_p": None, "lag_permutation_p": None, "arrivals": None}
        if len(nodes) >= settings.least_nodes and len(e) >= len(nodes) - 1:
            xy = c.drop_duplicates("node").set_index("node").loc[nodes, ["x", "y"]].to_numpy(float)
            pair = np.column_stack([np.searchsorted(nodes, e["i"]), np.searchsorted(nodes, e["j"])])
            lag, w = e["lag"].to_numpy(float), e["w"].to_numpy(float)
            t, robust, residual = robust_arrivals(len(nodes), pair, lag, w, settings.iterations)
            around, again = radial_grid(xy), ArrivalGraph(len(nodes), pair, robust)  # one for all repeats
            model, r2 = front(xy, around, t)
            total = float((robust * (lag - np.average(lag, weights=robust)) ** 2).sum())
            left = float((robust * (lag - (t[pair[:, 1]] - t[pair[:, 0]])) ** 2).sum())
            rng = np.random.default_rng(zlib.crc32(f"{settings.seed}|{key}".encode()))
            length = np.hypot(*(xy[pair[:, 1]] - xy[pair[:, 0]]).T)
            strata = _bins(length, settings.distance_bins) * settings.reliability_bins + _bins(robust, settings.reliability_bins)
            alike = [np.flatnonzero(strata == s) for s in np.unique(strata)]

            def null(change) -> float:
                reached = sum(front(xy, around, robust_arrivals(len(nodes), pair, change(), robust, 1, again)[0])[1] >= r2 for _ in range(settings.repeats))
                return (1 + reached) / (1 + settings.repeats)

            def permuted() -> np.ndarray:
                fake = lag.copy()
                for g in alike:
                    fake[g] = lag[rng.permutation(g)]
                return fake

            out |= {
                "status": "ok", "model": model, "r2": r2, "edge_r2": max(0.0, 1 - left / total) if total > 0 else 0.0, "edge_rmse": float(np.sqrt(np.average(residual**2, weights=robust))),
                "sign_flip_p": null(lambda: lag * rng.choice([-1.0, 1.0], len(lag))), "lag_permutation_p": null(permuted), "arrivals": {int(n): float(x) for n, x in zip(nodes, t, strict=True)}}
        return pd.DataFrame([{**own, **out}])

    place = coords.select(*keys, "node", "x", "y")
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], OUT])
    return _own(place).groupBy(*keys).cogroup(_own(rows).groupBy(*keys)).applyInPandas(run, schema)


def significant_fronts(fronts: DataFrame, family: list[str], settings: GraphSettings = GraphSettings()) -> DataFrame:
    """fronts with q, the permutation p corrected within the family (treatment and recording) over episodes whose status is ok, and `significant`:
    q at most alpha and an r2 of at least least_r2."""
    p = F.when(F.col("status") == "ok", F.col("lag_permutation_p"))
    out = benjamini_hochberg(fronts.withColumn("p_", p), "p_", family, [c for c in fronts.columns if c in ("recording", "episode")]).drop("p_")
    return out.withColumn("significant", F.coalesce((F.col("status") == "ok") & (F.col("q") <= settings.alpha) & (F.col("r2") >= settings.least_r2), F.lit(False)))


@dataclass(frozen=True)
class PhasicSettings:
    """Which voxels are active, which components count, and what makes one a travelling front."""

    pixels: int = 16
    pixel_um: float = 1.242961138804478
    fs: float = 15.0
    mode: str = "level"
    threshold: float = 3.0
    neighbours: int = 1
    least_voxels: int = 12
    extent_um: float = 160.0
    least_span: int = 3
    single_front: float = 0.5
    separation: int = 15
    fit_places: int = 20
    repeats: int = 99
    seed: int = 8128

    @property
    def block_um(self) -> float:
        return self.pixels * self.pixel_um


def component_rows(filled: DataFrame, keys: list[str], settings: PhasicSettings = PhasicSettings()) -> DataFrame:
    """One row a component of flood_fill()'s voxels: frames, voxels, places, extent, the span of the places' first frames, the share of frames
    with a single front, the leading edge's speed, and whether it travels, and does so as one front."""
    own, um = [*keys, "component"], settings.block_um
    whole = filled.groupBy(*own).agg(
        F.min("frame").alias("start"), F.max("frame").alias("end"), F.bround(F.median("frame")).cast("int").alias("centre"), F.count(F.lit(1)).alias("n_voxels"),
        ((F.max("bx") - F.min("bx") + 1) * um).alias("extent_x_um"), ((F.max("by") - F.min("by") + 1) * um).alias("extent_y_um"))
    places = filled.groupBy(*own, "by", "bx").agg(F.min("frame").alias("first"))
    arrived = places.groupBy(*own).agg(F.count(F.lit(1)).alias("n_places"), (F.max("first") - F.min("first")).alias("arrival_span"))
    single = single_front_fraction(filled.withColumnRenamed("component", "whole"), [*keys, "whole"])  # frames' parts are components of their own
    single = single.withColumnRenamed("whole", "component").withColumnRenamed("fraction", "single_front")
    out = whole.join(arrived, own).join(single, own)
    out = out.join(leading_edge_speed(filled, own, settings.separation, settings.fs, um), own)
    travels = (F.greatest("extent_x_um", "extent_y_um") >= settings.extent_um) & (F.col("arrival_span") >= settings.least_span)
    return out.withColumns({
        "duration": F.col("end") - F.col("start") + 1, "area_um2": F.col("n_places") * um * um, "propagating": travels,
        "strict_front": travels & (F.col("single_front") >= settings.single_front)})


def component_fits(filled: DataFrame, keys: list[str], settings: PhasicSettings = PhasicSettings()) -> DataFrame:
    """fit_propagation() of the places' first frames, for components of enough places whose first frames differ. A component's places, not its
    voxels, meet in a task."""
    own = [*keys, "component"]
    places = filled.groupBy(*own, "by", "bx").agg(F.min("frame").alias("onset"))
    fit = places.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), (F.max("onset") - F.min("onset")).alias("span")).filter((F.col("n") >= settings.fit_places) & (F.col("span") > 0))
    points = places.join(fit.select(*own), own, "left_semi").select(
        *own, (F.col("by").cast("long") * (1 << 20) + F.col("bx")).alias("node"), ((F.col("bx") + 0.5) * settings.pixels).alias("x"), ((F.col("by") + 0.5) * settings.pixels).alias("y"), "onset")
    return fit_propagation(points, own, settings.repeats, settings.fs, settings.pixel_um, seed=settings.seed)


@dataclass(frozen=True)
class MovieSettings:
    """How a movie's own candidates are found, fitted and tested."""

    pixels: int = 16
    pixel_um: float = 1.0
    fs: float = 15.0
    baseline_sigma: float = 35.0
    temporal_sigma: float = 1.0
    spatial_sigma: float = 0.8
    separation: int = 12
    prominence: float = 0.45
    half_window: int = 12
    active_quantile: float = 0.70
    least_blocks: int = 80
    patch: int = 8
    repeats: int = 499
    alpha: float = 0.05
    least_r2: float = 0.15
    seed: int = 7341


FIT = "status string, n_blocks long, span double, model string, selection_r2 double, r2 double, p double, null_95 double, speed double, direction double, source_x double, source_y double"


def _windows(movie: DataFrame, centres: DataFrame, keys: list[str], value: str, half: int) -> DataFrame:
    """(keys.., centre, frame, by, bx, v): the frames around each centre, by an equi-join on frames."""
    at = centres.select(*keys, F.col("centre").cast("int").alias("centre"), F.explode(F.sequence(F.col("centre").cast("int") - half, F.col("centre").cast("int") + half)).alias("frame"))
    return movie.select(*keys, F.col("frame").cast("int").alias("frame"), "by", "bx", F.col(value).alias("v")).join(at, [*keys, "frame"])


def _cube(pdf: pd.DataFrame) -> tuple[int, np.ndarray]:
    """The first frame, and the values as frames x rows x columns; what is missing is 0."""
    start, by, bx = int(pdf["frame"].min()), pdf["by"].to_numpy(int), pdf["bx"].to_numpy(int)
    out = np.zeros((int(pdf["frame"].max()) - start + 1, by.max() + 1, bx.max() + 1))
    out[pdf["frame"].to_numpy(int) - start, by, bx] = pdf["v"].to_numpy(float)
    return start, out


def _tiles(height: int, width: int, most: int) -> np.ndarray:
    """Flat places of the largest square tiles, of at most `most` a side, that cover the grid: one row a tile."""
    side = next(k for k in range(min(most, height, width), 0, -1) if height % k == 0 and width % k == 0)
    y, x = np.indices((height, width)).reshape(2, -1)
    order = np.lexsort((x % side, y % side, x // side, y // side))
    return order.reshape(-1, side * side)


def movie_fits(gradients: DataFrame, centres: DataFrame, keys: list[str], settings: MovieSettings = MovieSettings()) -> DataFrame:
    """One row for each of centres(keys.., centre): the front through the times at which the most active blocks of temporal_gradient()'s movie rise
    fastest, and its p against movies whose square tiles change places (1, untested, below least_r2). Status insufficient_active_blocks,
    and nulls, where few blocks rise inside the window. A window of one field of view fits a task."""
    kinds = {f.name: f.dataType.simpleString() for f in centres.schema.fields}
    s = settings

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start, cube = _cube(pdf)
        rise = np.maximum(cube, 0.0)
        height, width = rise.shape[1:]
        amplitude, arrival = rise.max(axis=0).ravel(), rise.argmax(axis=0).ravel()
        y, x = np.indices((height, width)).reshape(2, -1)
        place = np.column_stack([(x + 0.5) * s.pixels, (y + 0.5) * s.pixels])
        ok = (amplitude >= np.quantile(amplitude, s.active_quantile)) & (arrival > 0) & (arrival < len(rise) - 1)
        out = dict.fromkeys(c.split()[0] for c in FIT.split(", "))
        out |= {"status": "insufficient_active_blocks", "n_blocks": int(ok.sum())}
        if ok.sum() >= s.least_blocks:
            at = arrival[ok].astype(float) + start
            front = best_front(place[ok], at)
            out |= {"status": "ok", "span": float(np.ptp(at)), "model": front[0], "selection_r2": front[1], "p": 1.0, **describe_front(place[ok], at, front, s.fs, s.pixel_um)}
            if front[1] >= s.least_r2:
                rng = np.random.default_rng(zlib.crc32(f"{s.seed}|{'|'.join(str(pdf[k].iloc[0]) for k in [*keys, 'centre'])}".encode()))
                tiles, null = _tiles(height, width, s.patch), np.empty(s.repeats)
                for r in range(s.repeats):
                    moved = np.empty(height * width, dtype=int)
                    moved[tiles] = tiles[rng.permutation(len(tiles))]
                    keep = ok[moved]
                    null[r] = best_front(place[keep], arrival[moved][keep].astype(float))[1]
                out |= {"p": (1 + int((null >= front[1]).sum())) / (1 + s.repeats), "null_95": float(np.quantile(null, 0.95))}
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "centre": int(pdf["centre"].iloc[0]), **out}])

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "centre int", FIT])
    return _windows(gradients, centres, keys, "gt", s.half_window).groupBy(*keys, "centre").applyInPandas(run, schema)


def movie_onset_fits(blocks: DataFrame, centres: DataFrame, keys: list[str], half_window: int = 18, sigma: float = 2.0, quantile: float = 0.5, repeats: int = 199, fs: float = 15.0, pixel_um: float = 1.0, pixels: int = 16, seed: int = 1729) -> DataFrame:
    """(keys.., centre, n_blocks, model, r2, p, speed, direction, source_x, source_y) for each of centres(keys.., centre): the front through the steepest rise of the
    block movie's z-scores (each frame's median taken off) around it, over the upper half of the blocks inside a narrow border, and its
    permutation p. One of two separate witnesses: it sees no trace or event."""
    kinds = {f.name: f.dataType.simpleString() for f in centres.schema.fields}
    weights = np.array(derivative_weights(sigma))
    names = ["n_blocks", "model", "r2", "p", "speed", "direction", "source_x", "source_y"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start, cube = _cube(pdf)
        sd = cube.std(axis=0)
        z = np.where(sd > 0, (cube - cube.mean(axis=0)) / np.where(sd > 0, sd, 1.0), 0.0)
        z -= np.median(z, axis=(1, 2), keepdims=True)
        r = len(weights) // 2
        padded = np.pad(z, ((r, r), (0, 0), (0, 0)), mode="edge")
        slope = sum(w * padded[k : k + len(z)] for k, w in enumerate(weights))
        top = slope.max(axis=0)
        edge = max(1, round(0.04 * min(top.shape)))
        inner = np.zeros(top.shape, dtype=bool)
        inner[edge:-edge, edge:-edge] = True
        y, x = np.nonzero(inner & (top >= np.quantile(top, quantile)))
        out = dict.fromkeys(names) | {"n_blocks": len(y)}
        if len(y) >= 3:
            place, at = np.column_stack([(x + 0.5) * pixels, (y + 0.5) * pixels]), start + slope.argmax(axis=0)[y, x].astype(float)
            front = best_front(place, at)
            rng = np.random.default_rng(zlib.crc32(f"{seed}|{'|'.join(str(pdf[k].iloc[0]) for k in [*keys, 'centre'])}".encode()))
            reached = sum(best_front(place, rng.permutation(at))[1] >= front[1] for _ in range(repeats))
            out |= {"model": front[0], "p": (1 + int(reached)) / (1 + repeats), **describe_front(place, at, front, fs, pixel_um)}
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "centre": int(pdf["centre"].iloc[0]), **out}])

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "centre int", "n_blocks long, model string", *[f"{n} double" for n in names[2:]]])
    return _windows(blocks, centres, keys, "v", half_window).groupBy(*keys, "centre").applyInPandas(run, schema)
