"""Pairwise similarity of traces given as arrays (recording_id, roi_idx, f). Pairs are of one recording, i < j."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tracewell.functions import pairwise
from tracewell.functions.kernels import parts
from tracewell.operators.cells import BLOCK, all_pairs, fields, flat, in_cells


def pairs(arrays: DataFrame, key: str = "recording_id", node: str = "roi_idx", f: str = "f") -> DataFrame:
    """(key, i, j, fa, fb): all pairs are the result here, n squared a recording; arrays of other recordings never meet."""
    a = arrays.select(key, F.col(node).alias("i"), F.col(f).alias("fa"))
    b = arrays.select(key, F.col(node).alias("j"), F.col(f).alias("fb"))
    return a.join(b, key).filter("i < j")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a * b))


def standardized(arrays: DataFrame, f: str = "f", least: float = 1e-8) -> DataFrame:
    """f as population z-scores; a trace whose deviation is below `least` becomes 0."""
    n = F.size(f)
    m = arrays.withColumn("m_", _sum(F.col(f)) / n)
    s = m.withColumn("s_", F.sqrt(_sum(F.transform(f, lambda v: F.pow(v - F.col("m_"), 2))) / n))
    z = F.transform(f, lambda v: F.when(F.col("s_") < least, 0.0).otherwise((v - F.col("m_")) / F.nullif(F.col("s_"), F.lit(0.0))))
    return s.withColumn(f, z).drop("m_", "s_")


def max_crosscorr(arrays: DataFrame, max_lag: int, clip_negative: bool = True, key: str = "recording_id", node: str = "roi_idx", digits: int | None = None) -> DataFrame:
    """(key, i, j, value): the largest mean product over lags, of traces standardised as a whole; cut to 0..1, or signed by the largest
    magnitude. Rounded if digits are given, as in all functions of pairs here: inside the cells that costs least."""
    return all_pairs(arrays, [key], node, pairwise.CrossCorrelation(max_lag, clip_negative, digits=digits))


def pearson_pairs(arrays: DataFrame, key: str = "recording_id", node: str = "roi_idx", digits: int | None = None) -> DataFrame:
    """(key, i, j, value): correlation; 0 where either trace hardly varies."""
    return all_pairs(arrays, [key], node, pairwise.Pearson(digits=digits))


def weighted_pearson_pairs(arrays: DataFrame, key: str = "recording_id", node: str = "roi_idx", digits: int | None = None) -> DataFrame:
    """(key, i, j, value): correlation weighted by max(|x|, |y|) squared, cut to -1..1."""
    return all_pairs(arrays, [key], node, pairwise.WeightedPearson(digits=digits))


def significant_pairs(arrays: DataFrame, alpha: float = 0.05, key: str = "recording_id", node: str = "roi_idx", digits: int | None = None) -> DataFrame:
    """(key, i, j, p, significant): Student's two-sided p of the correlation, and whether it is below alpha; null below three frames."""
    return all_pairs(arrays, [key], node, pairwise.Significance(alpha, digits=digits), "p double, significant boolean")


def near_traces(arrays: DataFrame, most: float, key: str = "recording_id", node: str = "roi_idx", digits: int | None = None) -> DataFrame:
    """(key, i, j, distance): the pairs whose distance, 1 less the mean product of standardised traces, is at most `most`."""
    return all_pairs(arrays, [key], node, pairwise.Distance(digits=digits), "distance double", lambda v: v["distance"] <= most)


def near_stars(arrays: DataFrame, most: float, key: str = "recording_id", node: str = "roi_idx", digits: int | None = None, size: int = BLOCK) -> DataFrame:
    """(key, a, b): edges that connect the same nodes as the pairs of near_traces() do. In each cell all its pairs are joined up, and each
    node that reaches a smaller one is tied to the smallest, so a cell leaves fewer edges than it has nodes, however many pairs are near."""
    measure, kind = pairwise.Distance(digits=digits), arrays.schema[node].dataType
    schema = StructType([StructField("a", kind), StructField("b", kind)])

    def run(a: pa.Table, b: pa.Table, same: bool) -> Iterator[dict]:
        right, first = measure.prepare(b), 0 if same else len(a)
        nodes = flat(a[node]) if same else pa.concat_arrays([flat(a[node]), flat(b[node])])
        label, tied = np.arange(len(nodes)), np.zeros(0, dtype=np.int64)
        for at in range(0, len(a), measure.rows):
            i, j = np.nonzero(measure(measure.prepare(a.slice(at, measure.rows).combine_chunks()), right)["distance"] <= most)
            label = parts(len(nodes), np.append(i + at, label[tied]), np.append(j + first, tied))
            tied = np.flatnonzero(label != np.arange(len(nodes)))
        yield {"a": nodes.take(pa.array(label[tied])), "b": nodes.take(pa.array(tied))}

    return in_cells(arrays, [key], node, run, schema, size)


def pearson(x: Column, y: Column, least: float = 1e-12) -> Column:
    """Correlation of two array columns; 0 where either hardly varies."""
    n = F.size(x)
    mx, my = _sum(x) / n, _sum(y) / n
    cov = dot(x, y) / n - mx * my
    var = F.sqrt(F.greatest(dot(x, x) / n - mx * mx, F.lit(0.0))) * F.sqrt(F.greatest(dot(y, y) / n - my * my, F.lit(0.0)))
    return F.when(var < least, 0.0).otherwise(cov / F.nullif(var, F.lit(0.0)))


def weighted_pearson(x: Column, y: Column, least: float = 1e-12) -> Column:
    """Correlation weighted by max(|x|, |y|) squared, cut to -1..1."""
    w = F.zip_with(x, y, lambda a, b: F.pow(F.greatest(F.abs(a), F.abs(b)), 2))
    total = _sum(w)

    def mean(*columns: Column) -> Column:
        product = w
        for c in columns:
            product = F.zip_with(product, c, lambda a, b: a * b)
        return _sum(product) / F.nullif(total, F.lit(0.0))

    mx, my = mean(x), mean(y)
    cov, vx, vy = mean(x, y) - mx * my, mean(x, x) - mx * mx, mean(y, y) - my * my
    d = F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
    return F.coalesce(F.when(d < least, 0.0).otherwise(F.least(F.greatest(cov / F.nullif(d, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))), F.lit(0.0))


def ordinal(x: Column) -> Column:
    """Ranks from 0 in the array's order of values, ties in the order of positions."""
    order = F.array_sort(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    placed = F.array_sort(F.transform(order, lambda s, r: F.struct(s["i"].alias("i"), r.alias("r"))))
    return F.transform(placed, lambda s: s["r"].cast("double"))


def combined(*similarities: DataFrame, keys: list[str]) -> DataFrame:
    """The product of similarities (keys.., i, j, value), each cut to 0..1, null as 0."""
    out = None
    for k, s in enumerate(similarities):
        cut = F.least(F.greatest(F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        one = s.select(*keys, "i", "j", cut.alias(f"v{k}"))
        out = one if out is None else out.join(one, [*keys, "i", "j"])
    value = F.lit(1.0)
    for k in range(len(similarities)):
        value = value * F.col(f"v{k}")
    return out.select(*keys, "i", "j", value.alias("value"))


def lagged_edges(edges: DataFrame, arrays: DataFrame, max_lag: int, keys: list[str], node: str = "roi_idx") -> DataFrame:
    """(keys.., i, j, lag, corr, sharpness) for edges: correlation centred on each overlap, the first best lag, and how far the best
    exceeds the median over lags. j lags behind i by `lag`."""
    a = arrays.select(*keys, F.col(node).alias("i"), F.col("f").alias("fa"))
    b = arrays.select(*keys, F.col(node).alias("j"), F.col("f").alias("fb"))
    rows = edges.select(*keys, "i", "j").join(a, [*keys, "i"]).join(b, [*keys, "j"]).withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))))
    n = F.size("fa")
    x = F.slice("fa", F.greatest(F.lit(1), 1 - F.col("lag")), n - F.abs("lag"))
    y = F.slice("fb", F.greatest(F.lit(1), 1 + F.col("lag")), n - F.abs("lag"))
    scored = rows.select(*keys, "i", "j", "lag", pearson(x, y).alias("c"))
    return scored.groupBy(*keys, "i", "j").agg(
        F.min_by("lag", F.struct((-F.round("c", 9)).alias("c"), "lag")).alias("lag"), F.max("c").alias("corr"), (F.max("c") - F.median("c")).alias("sharpness"))


def soft_dtw_pairs(arrays: DataFrame, downsample: int = 1, gamma: float = 1.0, key: str = "recording_id", node: str = "roi_idx", digits: int | None = None) -> DataFrame:
    """(key, i, j, distance): soft dynamic time warping of standardised, downsampled traces. The recursion is sequential, so pairs run as
    blocks whose recursions are made together."""
    return all_pairs(arrays, [key], node, pairwise.SoftWarping(downsample, gamma, digits=digits), "distance double")


def mean_within(groups: DataFrame, similarity: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of groups(keys.., group, node): mean similarity over its pairs i < j; null below two members."""
    a = groups.select(*keys, "group", F.col("node").alias("i"))
    b = groups.select(*keys, "group", F.col("node").alias("j"))
    inside = similarity.join(a, [*keys, "i"]).join(b, [*keys, "group", "j"]).groupBy(*keys, "group").agg(F.avg("value").alias("mean_similarity"))
    return groups.select(*keys, "group").distinct().join(inside, [*keys, "group"], "left")


def mean_within_traces(groups: DataFrame, arrays: DataFrame, keys: list[str], node: str = "roi_idx") -> DataFrame:
    """Per group of groups(keys.., group, node): mean correlation of its pairs of traces; null below two members. Only pairs within a group are
    made, and summed up in their cells."""
    members = groups.select(*keys, "group", "node").distinct().join(arrays.select(*keys, F.col(node).alias("node"), "f"), [*keys, "node"])
    measure = pairwise.Pearson()

    def run(a: pa.Table, b: pa.Table, same: bool) -> Iterator[dict]:
        right, total, count = measure.prepare(b), 0.0, 0
        for at in range(0, len(a), measure.rows):
            strip = a.slice(at, measure.rows).combine_chunks()
            v = measure(measure.prepare(strip), right)["value"]
            if same:
                v = np.where(np.arange(at, at + len(strip))[:, None] < np.arange(len(b))[None, :], v, np.nan)
            total, count = total + float(np.nansum(v)), count + int((~np.isnan(v)).sum())
        yield {"total": np.array([total]), "n": np.array([count])}

    sums = in_cells(members, [*keys, "group"], "node", run, fields("total double, n long"))
    inside = sums.groupBy(*keys, "group").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_similarity"))
    return groups.select(*keys, "group").distinct().join(inside, [*keys, "group"], "left")


def combined_pairs(arrays: DataFrame, trains: DataFrame, max_lag: int, dt: float, key: str = "recording_id", node: str = "roi_idx", digits: int | None = None) -> DataFrame:
    """(key, i, j, value): largest cross-correlation times spike time tiling, each cut to 0..1, of traces that have events. trains: matching.trains().
    Both are made in one cell, so that no pairs are joined."""
    rows = arrays.select(key, node, "f").join(trains, [key, node])
    return all_pairs(rows, [key], node, combined_measure(max_lag, dt, digits))


def combined_measure(max_lag: int, dt: float, digits: int | None = None) -> pairwise.Measure:
    return pairwise.Product(pairwise.CrossCorrelation(max_lag), pairwise.SpikeTiling(dt), digits=digits)
