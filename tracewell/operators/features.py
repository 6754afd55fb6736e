"""Shape features of events and traces that peaks and windows give rise to."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.traces import KEY


def area_asymmetry(ws: DataFrame) -> DataFrame:
    """(key, frame, value) of windows(key, frame, i, y, pk): (right - left) / (right + left) of absolute sums around the peak; 0 if both are 0."""
    left, right = F.sum(F.when(F.col("i") < F.col("pk"), F.abs("y")).otherwise(0.0)), F.sum(F.when(F.col("i") > F.col("pk"), F.abs("y")).otherwise(0.0))
    return ws.groupBy(*KEY, "frame").agg(F.coalesce((right - left) / F.nullif(right + left, F.lit(0.0)), F.lit(0.0)).alias("value"))


def trapezoid_asymmetry(ws: DataFrame) -> DataFrame:
    """The same with trapezoids of the absolute samples on either side of the peak."""
    w = Window.partitionBy(*KEY, "frame").orderBy("i")
    area = (F.abs("y") + F.abs(F.lag("y").over(w))) / 2
    t = ws.withColumn("area", area)
    left, right = F.sum(F.when(F.col("i") <= F.col("pk"), F.col("area"))), F.sum(F.when(F.col("i") > F.col("pk"), F.col("area")))
    left, right = F.coalesce(left, F.lit(0.0)), F.coalesce(right, F.lit(0.0))
    return t.groupBy(*KEY, "frame").agg(F.coalesce((right - left) / F.nullif(right + left, F.lit(0.0)), F.lit(0.0)).alias("value"))


def decay_shape(ws: DataFrame, fs: float = 1.0) -> DataFrame:
    """(key, frame, r2, residual_sd, skewness, kurtosis, curvature, biphasic, linearity) of the samples from the peak on, for windows with three of them:
    the log-linear fit's R squared (0 if the logarithms are all equal) and residual deviation, moments of the samples (population, excess), the second
    difference in the middle times fs squared, the later half's time constant over the earlier's (1 unless both fall), and 1 over 1 plus the
    logarithms' deviation from a line. Only samples above 1e-6 have a logarithm; biphasic and linearity number these without gaps."""
    w = Window.partitionBy(*KEY, "frame")
    order = w.orderBy("i")
    positive = F.col("y") > 1e-6
    down = ws.filter(F.col("i") >= F.col("pk")).withColumns({
        "j": F.col("i") - F.col("pk"), "size": F.count(F.lit(1)).over(w), "t": F.when(positive, (F.col("i") - F.col("pk")) / fs), "ln": F.when(positive, F.log("y")),
        "c": F.sum(positive.cast("int")).over(order), "curve": F.lead("y").over(order) - 2 * F.col("y") + F.lag("y").over(order)})
    down = down.filter("size >= 3").withColumn("mid", F.floor(F.col("size") / 2))
    n, spread = F.count("ln"), F.var_pop("ln")
    r2 = F.when(n >= 2, F.when(spread > 0, F.regr_r2("ln", "t")).otherwise(0.0))
    straight = F.when(spread > 0, F.regr_r2("ln", "c")).otherwise(1.0)

    def half(inside):
        return F.regr_slope(F.when(inside, F.col("ln")), F.when(inside, F.col("c").cast("double")))

    first, second = F.col("j") < F.col("mid"), F.col("j") >= F.col("mid")
    enough = (F.max("size") >= 6) & (n >= 4) & (F.count(F.when(first, F.col("ln"))) >= 2) & (F.count(F.when(second, F.col("ln"))) >= 2)
    middle = (F.col("j") == F.col("mid")) & (F.col("mid") > 1) & (F.col("mid") < F.col("size") - 2)
    return down.groupBy(*KEY, "frame").agg(
        r2.alias("r2"), F.when(n >= 2, F.sqrt(F.greatest(spread * (1 - r2), F.lit(0.0)))).alias("residual_sd"), F.skewness("y").alias("skewness"), F.kurtosis("y").alias("kurtosis"),
        (F.max(F.when(middle, F.col("curve"))) * fs * fs).alias("curvature"),
        F.when(enough, F.when((half(first) < 0) & (half(second) < 0), half(first) / half(second)).otherwise(1.0)).alias("biphasic"),
        F.when(n >= 3, 1 / (1 + F.sqrt(F.greatest(spread * (1 - straight), F.lit(0.0))))).alias("linearity"))


def peak_density(peaks: DataFrame, samples: DataFrame) -> DataFrame:
    """(key, density, median_prominence, weighted_density, left_mean, left_skew): peaks a sample, their median prominence, prominences over the trace's
    range a sample, and mean and skewness of the heights over left bases."""
    base = samples.select(*KEY, F.col("frame").alias("left_base"), F.col("v").alias("base"))
    sized = samples.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), (F.max("v") - F.min("v")).alias("range"))
    p = peaks.join(base, [*KEY, "left_base"]).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("k"), F.median("prominence").alias("median_prominence"), F.sum("prominence").alias("total"),
        F.avg(F.col("v") - F.col("base")).alias("left_mean"), F.skewness(F.col("v") - F.col("base")).alias("left_skew"))
    out = sized.join(p, KEY, "left")
    return out.select(
        *KEY, (F.coalesce("k", F.lit(0)) / F.col("n")).alias("density"), F.coalesce("median_prominence", F.lit(0.0)).alias("median_prominence"),
        F.coalesce(F.col("total") / F.nullif("range", F.lit(0.0)) / F.col("n"), F.lit(0.0)).alias("weighted_density"), "left_mean", "left_skew")


def event_features(peaks: DataFrame, windows: DataFrame, samples: DataFrame) -> DataFrame:
    """Per peak of peak_hierarchy(): prominence over the trace's range, dominance, rise from the window's start over the range, and window length."""
    sized = samples.groupBy(*KEY).agg((F.max("v") - F.min("v")).alias("range"))
    inside = windows.join(samples.select(*KEY, F.col("frame").alias("at"), "v"), KEY).filter((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    rise = inside.groupBy(*KEY, "frame").agg((F.max("v") - F.min_by("v", "at")).alias("rise"), F.count(F.lit(1)).alias("distance"))
    rows = peaks.join(rise, [*KEY, "frame"]).join(sized, KEY)
    return rows.select(
        *KEY, "frame", (F.col("prominence") / (F.col("range") + 1e-9)).alias("spike_prom"), "dominance", (F.col("rise") / (F.col("range") + 1e-9)).alias("mini_prom"), "distance")


def cluster_radius(median_width: float | None, factor: float = 1.5) -> float:
    """How far apart peaks of one cluster may be; factor frames where there is no width."""
    return factor * (median_width if median_width and math.isfinite(median_width) else 1.0)


def quality_flags(features: DataFrame, columns: list[str]) -> DataFrame:
    """features with <column>_valid: not null and finite."""
    return features.withColumns({f"{c}_valid": F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in columns})


def auto_label(features: DataFrame, checks: list[str]) -> DataFrame:
    """features with label_value and label_source: (0, auto) where a check fails, (-1, unknown) else."""
    bad = F.lit(False)
    for c in checks:
        bad = bad | ~F.col(f"{c}_valid")
    return features.withColumns({"label_value": F.when(bad, 0).otherwise(-1), "label_source": F.when(bad, "auto").otherwise("unknown")})
