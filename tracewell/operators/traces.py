"""Trace projections and per-trace features, over long samples (recording_id, roi_idx, frame, v).

Windows are partitioned by trace, whose length is bounded; statistics of a whole recording are aggregated and joined back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ["recording_id", "roi_idx"]


def by_trace() -> WindowSpec:
    return Window.partitionBy(*KEY)


def in_order() -> WindowSpec:
    return by_trace().orderBy("frame")


def minmax(samples: DataFrame, per_roi: bool = False) -> DataFrame:
    """v scaled by one minimum and maximum a recording (a trace, if per_roi); constant ones become 0."""
    keys = KEY if per_roi else ["recording_id"]
    ends = samples.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scaled = F.coalesce((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0))
    return samples.join(ends, keys).select(*KEY, "frame", scaled.alias("v"))


def zscore(samples: DataFrame, least: float = 0.0) -> DataFrame:
    """Population z-score a trace; null where the deviation is 0, and 0 where it is below `least`."""
    sd = F.stddev_pop("v").over(by_trace())
    z = (F.col("v") - F.avg("v").over(by_trace())) / F.nullif(sd, F.lit(0.0))
    return samples.select(*KEY, "frame", (F.when(sd < least, 0.0).otherwise(z) if least else z).alias("v"))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights at offsets -r to r, r = int(truncate * sigma + 0.5)."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def derivative_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights of a Gaussian's derivative, for a window read from left to right."""
    g = gaussian_weights(sigma, truncate)
    r = len(g) // 2
    return [w * (k - r) / (sigma * sigma) for k, w in enumerate(g)]


def savgol_weights(window: int, order: int) -> list[float]:
    """Weights of the least-squares polynomial's value at the middle of a window."""
    import numpy as np

    k = np.arange(window) - window // 2
    return np.linalg.pinv(np.vander(k, order + 1, increasing=True).astype(float))[0].tolist()


def savgol_matrix(window: int, order: int) -> list[list[float]]:
    """Row i holds the weights of the least-squares polynomial's value at place i of a window."""
    import numpy as np

    v = np.vander(np.arange(window) - window // 2, order + 1, increasing=True).astype(float)
    return (v @ np.linalg.pinv(v)).tolist()


def savgol(arrays: DataFrame, window: int = 51, order: int = 3) -> DataFrame:
    """(.., f) to (.., f): each sample on the polynomial fitted to the window around it; near the ends, on that of the first or last
    window. Null for traces shorter than the window. The weights are one folded literal, whatever the window."""
    flat = ",".join(repr(w) for row in savgol_matrix(window, order) for w in row)
    weights = F.split(F.lit(flat), ",").cast("array<double>")
    n = F.size("f")

    def at(i: Column) -> Column:
        start = F.least(F.greatest(i - window // 2, F.lit(0)), n - window)
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(window - 1)), F.lit(0.0),
            lambda a, j: a + F.get(weights, (i - start) * window + j) * F.get("f", start + j))

    return arrays.withColumn("f", F.when(n >= window, F.transform(F.sequence(F.lit(0), n - 1), at)))


def convolve(arrays: DataFrame, weights: list[float], mode: str = "reflect") -> DataFrame:
    """(.., f) to (.., f) filtered, inside the JVM. mode: reflect (the edge is repeated), nearest (its sample is), constant (0 outside), wrap,
    interior (null where the window leaves the trace)."""
    r = len(weights) // 2
    kernel = F.array(*[F.lit(float(w)) for w in weights])
    n = F.size("f")

    def index(i: Column) -> Column:
        if mode == "wrap":
            return F.pmod(i, n)
        if mode == "nearest":
            return F.least(F.greatest(i, F.lit(0)), n - 1)
        m = F.pmod(i, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)

    def at(i: Column) -> Column:
        def term(j: Column) -> Column:
            k = i + j
            inside = (k >= 0) & (k < n)
            v = F.get("f", index(k))
            return F.element_at(kernel, (j + r + 1).cast("int")) * (F.when(inside, v).otherwise(0.0) if mode == "constant" else v)

        total = F.aggregate(F.transform(F.sequence(F.lit(-r), F.lit(r)), term), F.lit(0.0), lambda a, x: a + x)
        return F.when((i >= r) & (i < n - r), total) if mode == "interior" else total

    return arrays.withColumn("f", F.transform(F.sequence(F.lit(0), n - 1), at))


def trace_arrays(samples: DataFrame) -> DataFrame:
    """(key, f): one array a trace, samples in frame order."""
    pairs = F.array_sort(F.collect_list(F.struct("frame", "v")))
    return samples.groupBy(*KEY).agg(F.transform(pairs, lambda x: x["v"]).alias("f"))


def samples_of(arrays: DataFrame) -> DataFrame:
    return arrays.select(*KEY, F.posexplode("f").alias("frame", "v"))


def rolling_variance_of_variance(samples: DataFrame, window: int = 30) -> DataFrame:
    """(key, value): population variance of the rolling population variance; null for traces under two windows."""
    last = in_order().rowsBetween(-(window - 1), 0)
    rolled = samples.select(
        *KEY, F.row_number().over(in_order()).alias("rn"), F.count(F.lit(1)).over(by_trace()).alias("n"),
        F.greatest(F.avg(F.col("v") * F.col("v")).over(last) - F.pow(F.avg("v").over(last), 2), F.lit(0.0)).alias("var"))
    return rolled.groupBy(*KEY).agg(F.when(F.max("n") >= 2 * window, F.var_pop(F.when(F.col("rn") >= window, F.col("var")))).alias("value"))


def autocorrelation(samples: DataFrame, *lags: int) -> DataFrame:
    """(key, rho_<lag>...): correlation with the shifted trace, centred globally, normed over the overlap."""
    c = samples.select(*KEY, "frame", (F.col("v") - F.avg("v").over(by_trace())).alias("x"))
    for k in lags:
        c = c.withColumn(f"y{k}", F.lag("x", k).over(in_order()))
    rho = [
        (F.sum(F.col("x") * F.col(f"y{k}")) / F.sqrt(F.sum(F.when(F.col(f"y{k}").isNotNull(), F.col("x") * F.col("x"))) * F.sum(F.col(f"y{k}") * F.col(f"y{k}")) + 1e-12)).alias(f"rho_{k}")
        for k in lags
    ]
    return c.groupBy(*KEY).agg(*rho)


def autocorr_decay(samples: DataFrame, first: int = 1, second: int = 5) -> DataFrame:
    rho = autocorrelation(samples, first, second)
    return rho.select(*KEY, (F.col(f"rho_{first}") - F.col(f"rho_{second}")).alias("value"))


def snr(samples: DataFrame) -> DataFrame:
    """(p95 - p20) / (1.4826 MAD + 1e-9), 0 where the MAD is 0; percentiles are exact, with linear interpolation."""
    mid = samples.withColumn("m", F.median("v").over(by_trace()))
    p = mid.groupBy(*KEY).agg(
        F.percentile("v", 0.95).alias("p95"), F.percentile("v", 0.20).alias("p20"), F.median(F.abs(F.col("v") - F.col("m"))).alias("mad"))
    return p.select(*KEY, F.when(F.col("mad") <= 0, 0.0).otherwise((F.col("p95") - F.col("p20")) / (F.col("mad") * 1.4826 + 1e-9)).alias("value"))


def derivative_features(samples: DataFrame) -> DataFrame:
    """(key, skew, asymmetry) of the differences: population skewness, 0 if constant; positive sum over absolute negative sum."""
    d = samples.select(*KEY, (F.col("v") - F.lag("v").over(in_order())).alias("d")).filter("d is not null")
    return d.groupBy(*KEY).agg(
        F.when(F.stddev_pop("d") > 0, F.skewness("d")).otherwise(0.0).alias("skew"),
        (F.sum(F.when(F.col("d") > 0, F.col("d")).otherwise(0.0)) / (F.sum(F.when(F.col("d") < 0, -F.col("d")).otherwise(0.0)) + 1e-9)).alias("asymmetry"))


def roi_features(samples: DataFrame, window: int = 30) -> DataFrame:
    """All per-trace features that need no peaks, one row a trace; window is that of the rolling variance."""
    out = rolling_variance_of_variance(samples, window).withColumnRenamed("value", "variance_of_variance")
    out = out.join(autocorr_decay(samples).withColumnRenamed("value", "autocorr_decay"), KEY)
    return out.join(snr(samples).withColumnRenamed("value", "snr"), KEY).join(derivative_features(samples), KEY)


def transform_features(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """raw, log (log1p of the absolute value), sqrt (of it) or square, on the given columns; another kind is an error."""
    kinds = {"raw": lambda c: c, "log": lambda c: F.log1p(F.abs(c)), "sqrt": lambda c: F.sqrt(F.abs(c)), "square": lambda c: c * c}
    if kind not in kinds:
        raise ValueError(f"unknown transform {kind!r}; one of {sorted(kinds)}")
    return df.withColumns({c: kinds[kind](F.col(c)) for c in columns})


def scale_sigma(sigma: float, fs: float, reference: float = 15.0) -> float:
    return max(0.5, sigma * fs / reference)


def resolve_savgol_window(n_frames: int, preferred: int = 51, order: int = 3) -> int | None:
    """The odd window of at most `preferred` and n_frames, longer than the order; None if there is none."""
    window = min(preferred, n_frames)
    window -= 1 - window % 2
    return window if window > order else None
