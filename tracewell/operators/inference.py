"""Tests, effect sizes and null models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tracewell.functions import special
from tracewell.operators.traces import gaussian_weights


def mann_whitney(df: DataFrame, keys: list[str], value: str, arm: str, first, second) -> DataFrame:
    """Per key: n1, n2, u of the first arm, ties (sum of t^3 - t), both medians and their difference."""
    rows = df.filter(F.col(arm).isin(first, second) & F.col(value).isNotNull())
    w = Window.partitionBy(*keys)
    same = Window.partitionBy(*keys, value)
    t = F.count(F.lit(1)).over(same)
    ranked = rows.withColumns({"r": F.rank().over(w.orderBy(value)) + (t - 1) / 2.0, "t": t})
    one = F.col(arm) == F.lit(first)
    n1, n2 = F.count(F.when(one, 1)), F.count(F.when(~one, 1))
    return ranked.groupBy(*keys).agg(
        n1.alias("n1"), n2.alias("n2"), (F.sum(F.when(one, F.col("r"))) - n1 * (n1 + 1) / 2.0).alias("u"), F.sum(F.col("t") * F.col("t") - 1).alias("ties"),
        F.median(F.when(one, F.col(value))).alias("median1"), F.median(F.when(~one, F.col(value))).alias("median2"),
    ).withColumn("median_difference", F.col("median1") - F.col("median2"))


@F.pandas_udf(DoubleType())
def mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([special.mann_whitney_p(a, int(n), int(m), t) if a == a else float("nan") for a, n, m, t in zip(u, n1, n2, ties, strict=True)])


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([special.student_two_sided(a, d) if a == a else float("nan") for a, d in zip(t, df, strict=True)])


@F.pandas_udf(DoubleType())
def wilcoxon_p(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([special.wilcoxon_p(a, int(k), float(t)) for a, k, t in zip(w, n, ties, strict=True)])


@F.pandas_udf(DoubleType())
def kolmogorov_p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([special.kolmogorov_p(a, int(i), int(j)) for a, i, j in zip(d, n, m, strict=True)])


def paired_t(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Per key, of rows with both: n, mean difference, t; below 3 pairs t is null, differences that are all 0 give 0."""
    d = df.select(*keys, (F.col(a) - F.col(b)).alias("d")).filter("d is not null")
    n, sd = F.count(F.lit(1)), F.stddev_samp("d")
    t = F.when(n < 3, None).when(F.max(F.abs("d")) == 0, 0.0).otherwise(F.try_divide(F.avg("d"), sd / F.sqrt(n)))
    return d.groupBy(*keys).agg(n.alias("n"), F.avg("d").alias("mean_difference"), t.alias("t"))


def wilcoxon(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Per key: the signed-rank sum w of positive differences, the number of non-zero ones, and whether ranks tie."""
    d = df.select(*keys, (F.col(a) - F.col(b)).alias("d")).filter("d <> 0")
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys, F.abs("d")))
    ranked = d.withColumns({"r": F.rank().over(Window.partitionBy(*keys).orderBy(F.abs("d"))) + (same - 1) / 2.0, "tied": same > 1})
    return ranked.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w"), F.count(F.lit(1)).alias("n"), F.max("tied").alias("ties"))


def signed_rank_p(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """wilcoxon() with `p`, and n and w; ties of absolute differences are corrected for."""
    d = df.select(*keys, F.abs(F.col(a) - F.col(b)).alias("d")).filter("d <> 0")
    t = d.groupBy(*keys, "d").agg(F.count(F.lit(1)).alias("t")).groupBy(*keys).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("tied"))
    out = wilcoxon(df, keys, a, b).join(t, keys)
    return out.select(*keys, "w", "n", wilcoxon_p("w", "n", "tied").alias("p"))


def independent_t(df: DataFrame, keys: list[str], value: str, arm: str, first, second) -> DataFrame:
    """Per key: n1, n2, t and its degrees of freedom, with the pooled variance; t is null where that is 0 or a side is empty."""
    x, y = F.when(F.col(arm) == F.lit(first), F.col(value)), F.when(F.col(arm) == F.lit(second), F.col(value))
    a = df.groupBy(*keys).agg(F.count(x).alias("n1"), F.count(y).alias("n2"), F.avg(x).alias("m1"), F.avg(y).alias("m2"), F.var_samp(x).alias("v1"), F.var_samp(y).alias("v2"))
    df_ = (F.col("n1") + F.col("n2") - 2).cast("double")
    pooled = F.try_divide(F.coalesce((F.col("n1") - 1) * F.col("v1"), F.lit(0.0)) + F.coalesce((F.col("n2") - 1) * F.col("v2"), F.lit(0.0)), F.when(df_ > 0, df_))
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (F.lit(1.0) / F.nullif("n1", F.lit(0)) + F.lit(1.0) / F.nullif("n2", F.lit(0)))))
    return a.select(*keys, "n1", "n2", t.alias("t"), df_.alias("df"))


def compare_distributions(df: DataFrame, keys: list[str], value: str, arm: str, first, second, test: str = "ttest") -> DataFrame:
    """(keys.., statistic, p) of the two arms: an independent t-test, the U test or the two-sample distance."""
    if test == "ttest":
        t = independent_t(df, keys, value, arm, first, second)
        return t.select(*keys, F.col("t").alias("statistic"), student_p(F.coalesce("t", F.lit(float("nan"))), "df").alias("p"))
    if test == "mannwhitneyu":
        u = mann_whitney(df, keys, value, arm, first, second)
        return u.select(*keys, F.col("u").alias("statistic"), mann_whitney_p("u", "n1", "n2", "ties").alias("p"))
    if test == "ks":
        d = kolmogorov_smirnov(df, keys, value, arm, first, second)
        return d.select(*keys, F.col("d").alias("statistic"), kolmogorov_p("d", "n1", "n2").alias("p"))
    raise ValueError(f"unknown test {test!r}; one of ttest, mannwhitneyu, ks")


def day_pairs(rows: DataFrame, keys: list[str], subject: str, day: str, value: str) -> DataFrame:
    """(keys.., day_row, day_col, n_pairs, mean_day_row, mean_day_col, change, statistic) for each two days: the paired t of the subjects
    seen on both, day_row - day_col; null below 3 of them, 0 where nothing changes. Days that no subject shares have no row.
    Pairs of days are the output; a subject's days meet in one join on the subject."""
    seen = rows.filter(F.col(value).isNotNull()).groupBy(*keys, subject, day).agg(F.avg(value).alias("v"))
    a = seen.select(*keys, subject, F.col(day).alias("day_row"), F.col("v").alias("x"))
    b = seen.select(*keys, subject, F.col(day).alias("day_col"), F.col("v").alias("y"))
    both = a.join(b, [*keys, subject]).filter("day_row < day_col")
    family = [*keys, "day_row", "day_col"]
    t = paired_t(both, family, "x", "y")
    means = both.groupBy(*family).agg(F.avg("x").alias("mean_day_row"), F.avg("y").alias("mean_day_col"))
    return means.join(t, family).select(
        *family, F.col("n").alias("n_pairs"), "mean_day_row", "mean_day_col", (-F.col("mean_difference")).alias("change"), F.col("t").alias("statistic"))


def day_pair_tests(rows: DataFrame, keys: list[str], subject: str, day: str, value: str, test: str = "paired_t", alpha: float = 0.05) -> DataFrame:
    """day_pairs() with p, its Benjamini-Hochberg q within keys (treatment and metric), stars, and whether q is below alpha. test: paired_t or
    wilcoxon, whose statistic is the smaller signed-rank sum."""
    from tracewell.operators.ranking import benjamini_hochberg, stars

    pairs = day_pairs(rows, keys, subject, day, value)
    family = [*keys, "day_row", "day_col"]
    if test == "paired_t":
        p = F.when(F.col("statistic").isNull(), None).when(F.col("statistic") == 0, 1.0).otherwise(student_p(F.abs("statistic"), (F.col("n_pairs") - 1).cast("double")))
        tested = pairs.withColumn("p", p)
    elif test == "wilcoxon":
        seen = rows.filter(F.col(value).isNotNull()).groupBy(*keys, subject, day).agg(F.avg(value).alias("v"))
        a = seen.select(*keys, subject, F.col(day).alias("day_row"), F.col("v").alias("x"))
        b = seen.select(*keys, subject, F.col(day).alias("day_col"), F.col("v").alias("y"))
        ranked = signed_rank_p(a.join(b, [*keys, subject]).filter("day_row < day_col"), family, "y", "x")
        least = F.least("w", F.col("n") * (F.col("n") + 1) / 2.0 - F.col("w"))
        tested = pairs.drop("statistic").join(ranked.select(*family, least.alias("s"), F.col("p").alias("p_")), family, "left")
        few, same = F.col("n_pairs") < 3, F.col("s").isNull()
        tested = tested.withColumns({"statistic": F.when(few, None).when(same, 0.0).otherwise(F.col("s")), "p": F.when(few, None).when(same, 1.0).otherwise(F.col("p_"))}).drop("s", "p_")
    else:
        raise ValueError(f"unknown test {test!r}; one of paired_t, wilcoxon")
    out = benjamini_hochberg(tested, "p", keys, ["day_row", "day_col"])
    return out.withColumns({"significance": F.coalesce(stars(F.col("q")), F.lit("")), "significant": F.coalesce(F.col("q") < alpha, F.lit(False))})


def effect_sizes(df: DataFrame, keys: list[str], value: str, arm: str, first, second) -> DataFrame:
    """Per key: Cohen's d with the pooled deviation (0 if that is 0), and Hedges' g."""
    one, two = F.col(arm) == F.lit(first), F.col(arm) == F.lit(second)
    x, y = F.when(one, F.col(value)), F.when(two, F.col(value))
    a = df.groupBy(*keys).agg(F.count(x).alias("n1"), F.count(y).alias("n2"), F.avg(x).alias("m1"), F.avg(y).alias("m2"), F.var_samp(x).alias("v1"), F.var_samp(y).alias("v2"))
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), (F.col("n1") + F.col("n2") - 2).cast("double")))
    d = F.when(pooled == 0, 0.0).otherwise((F.col("m1") - F.col("m2")) / F.nullif(pooled, F.lit(0.0)))
    out = a.withColumn("cohen_d", d)
    return out.select(*keys, "n1", "n2", "cohen_d", (F.col("cohen_d") * (1 - 3.0 / (4.0 * (F.col("n1") + F.col("n2")) - 9.0))).alias("hedges_g"))


def kolmogorov_smirnov(df: DataFrame, keys: list[str], value: str, arm: str, first, second) -> DataFrame:
    """Per key: n1, n2 and the largest distance between the two distribution functions."""
    rows = df.filter(F.col(arm).isin(first, second))
    one = F.when(F.col(arm) == F.lit(first), 1.0).otherwise(0.0)
    w = Window.partitionBy(*keys)
    upto = w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    d = rows.select(*keys, F.abs(F.sum(one).over(upto) / F.sum(one).over(w) - F.sum(1.0 - one).over(upto) / F.sum(1.0 - one).over(w)).alias("d"), one.alias("one"))
    return d.groupBy(*keys).agg(F.sum("one").cast("long").alias("n1"), (F.count(F.lit(1)) - F.sum("one")).cast("long").alias("n2"), F.max("d").alias("d"))


def outliers(df: DataFrame, keys: list[str], value: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """df with `outlier`: outside the quartiles by threshold times their range, or |z| above threshold."""
    if method == "iqr":
        q = df.groupBy(*keys).agg(F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.75).alias("q3"))
        lo, hi = F.col("q1") - threshold * (F.col("q3") - F.col("q1")), F.col("q3") + threshold * (F.col("q3") - F.col("q1"))
        return df.join(q, keys).withColumn("outlier", (F.col(value) < lo) | (F.col(value) > hi)).drop("q1", "q3")
    if method == "zscore":
        s = df.groupBy(*keys).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"))
        z = F.try_divide(F.abs(F.col(value) - F.col("m")), F.col("sd"))
        return df.join(s, keys).withColumn("outlier", F.coalesce(z > threshold, F.lit(False))).drop("m", "sd")
    raise ValueError(f"unknown method {method!r}")


def correlation_significance(df: DataFrame, r: str, n: str, alpha: float = 0.05) -> DataFrame:
    t = F.col(r) * F.sqrt((F.col(n) - 2) / (1 - F.col(r) * F.col(r) + 1e-10))
    return df.withColumn("t", t).withColumn("p", student_p(F.abs("t"), (F.col(n) - 2).cast("double"))).withColumn("significant", F.col("p") < alpha)


def _seed(*parts) -> int:
    import zlib

    return zlib.crc32("|".join(map(str, parts)).encode())


def permutation_test(df: DataFrame, key: str, value: str, arm: str, first, repeats: int = 999, seed: int = 42) -> DataFrame:
    """Per key: observed difference of means, and the share of label permutations at least as far from 0. One key is one task's group, so
    keys are to be bounded; the generator is seeded by the key, so results don't depend on partitions."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values([arm, value])[value].to_numpy(dtype=float)
        n1 = int((pdf[arm] == first).sum())
        one = np.sort(pdf[value][pdf[arm] == first].to_numpy(dtype=float))
        observed = one.mean() - (x.sum() - one.sum()) / max(1, len(x) - n1) if 0 < n1 < len(x) else float("nan")
        rng = np.random.default_rng(_seed(seed, pdf[key].iloc[0]))
        p = float("nan")
        if observed == observed:
            sums = np.array([x[rng.permutation(len(x))[:n1]].sum() for _ in range(repeats)])
            p = float(np.mean(np.abs(sums / n1 - (x.sum() - sums) / (len(x) - n1)) >= abs(observed) - 1e-12))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "observed": [observed], "p": [p]})

    return df.select(key, value, arm).groupBy(key).applyInPandas(run, f"{key} {kind}, observed double, p double")


def bootstrap_ci(df: DataFrame, key: str, value: str, repeats: int = 1000, level: float = 0.95, statistic: str = "mean", seed: int = 42) -> DataFrame:
    """Per key: the statistic and its percentile interval over resamples."""
    f = {"mean": np.mean, "median": np.median, "std": np.std}[statistic]
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[value].to_numpy(dtype=float))
        rng = np.random.default_rng(_seed(seed, pdf[key].iloc[0]))
        s = np.array([f(x[rng.integers(0, len(x), len(x))]) for _ in range(repeats)])
        lo, hi = np.quantile(s, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "estimate": [float(f(x))], "lo": [lo], "hi": [hi]})

    return df.select(key, value).groupBy(key).applyInPandas(run, f"{key} {kind}, estimate double, lo double, hi double")


def circular_shift_null(events: DataFrame, key: str, train: str, frame: str, n_frames: int | str, repeats: int = 200, seed: int = 42, sigma: float | None = None) -> DataFrame:
    """(key, repeat, peak): the most events in one frame, or with sigma the highest density (a Gaussian that wraps around), when each train is
    shifted around the recording by a random whole number of frames.

    The shift is a digest of (train, repeat, seed), so repeats run as plain aggregation over all tasks, and SQL can repeat them. n_frames is a
    number or a column of events that depends on the key alone.
    """
    n = F.lit(n_frames) if isinstance(n_frames, int) else F.col(n_frames)
    rows = events.select(key, train, frame, n.cast("long").alias("n_"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    digest = F.md5(F.concat_ws("|", F.col(train).cast("string"), F.col("repeat").cast("string"), F.lit(str(seed))))
    shift = F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.col("n_"))
    at = F.pmod(F.col(frame) + shift, F.col("n_")).alias("at")
    counts = rows.groupBy(key, "n_", "repeat", at).agg(F.count(F.lit(1)).alias("n"))
    if sigma is None:
        return counts.groupBy(key, "repeat").agg(F.max("n").alias("peak"))
    weights = gaussian_weights(sigma)
    offsets = F.array(*[F.struct(F.lit(k - len(weights) // 2).alias("o"), F.lit(w).alias("w")) for k, w in enumerate(weights)])
    spread = counts.select(key, "n_", "repeat", "at", "n", F.explode(offsets).alias("k"))
    density = spread.groupBy(key, "repeat", F.pmod(F.col("at") + F.col("k.o"), F.col("n_")).alias("at")).agg(F.sum(F.col("n") * F.col("k.w")).alias("v"))
    return density.groupBy(key, "repeat").agg(F.round(F.max("v"), 12).alias("peak"))
