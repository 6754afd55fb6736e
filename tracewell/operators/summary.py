"""Hierarchical roll-ups with a variance decomposition, comparison rows, and group statistics.

Statistics are rows (node, stat, ...), so that any number of them shares one plan. Everything is aggregates of
mergeable sums, so partial aggregation runs before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _decomposed(rows: DataFrame, keys: list[str], mean: str, var: str, w: str, *more: Column) -> DataFrame:
    """(keys.., mean, var_total, var_within, var_between, more..) by the law of total variance, weights w > 0.

    The part between is summed around the mean: a difference of large squares would cancel for means that are large against their spread.
    The mean comes from a window over the keys, and the aggregate runs on the same partitioning: one shuffle, and rows are computed once.
    A key's rows are one node's children.
    """
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # the root's children
    rows = rows.withColumn("centre_", F.sum(F.col(mean) * F.col(w)).over(over) / F.sum(w).over(over))
    apart = F.col(mean) - F.col("centre_")
    within, between = F.sum(F.col(var) * F.col(w)) / F.sum(w), F.sum(F.col(w) * apart * apart) / F.sum(w)
    return rows.groupBy(*keys).agg(
        F.first("centre_").alias("mean"), (within + between).alias("var_total"), within.alias("var_within"), between.alias("var_between"), *more)


def summarize_video(neurons: DataFrame, keys: list[str]) -> DataFrame:
    """neurons(keys.., stat, m, v, w): a neuron's mean and variance of a statistic, and its events as weight. Two rows a key and
    statistic: scheme unweighted and weighted; where no weight is positive all weigh 1. Null means are left out."""
    ok = neurons.filter("m is not null")
    any_weight = F.max(F.coalesce("w", F.lit(0))).over(Window.partitionBy(*keys, "stat")) > 0
    w = F.when(any_weight, F.coalesce(F.col("w"), F.lit(0)).cast("double")).otherwise(1.0)
    both = ok.withColumn("weight", w).select(
        *keys, "stat", "m", F.coalesce("v", F.lit(0.0)).alias("v"),
        F.explode(F.array(F.struct(F.lit("unweighted").alias("scheme"), F.lit(1.0).alias("w")), F.struct(F.lit("weighted").alias("scheme"), F.col("weight").alias("w")))).alias("s"))
    rows = both.select(*keys, "stat", "s.scheme", "m", "v", "s.w").filter("w > 0")
    return _decomposed(rows, [*keys, "stat", "scheme"], "m", "v", "w")


def aggregate_children(children: DataFrame, keys: list[str], mean: str = "mean", var: str = "var_total", weight: str = "w") -> DataFrame:
    """Parents by keys from children's means and total variances; children without positive weight are left out."""
    return _decomposed(children.filter(F.col(weight) > 0), keys, mean, var, weight, F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n_children"))


def tree_rollup(leaves: DataFrame, levels: list[str]) -> DataFrame:
    """leaves(levels.., mean, var, w) rolled up from the deepest level to the root, each level from the one below.

    (depth, node, mean, var_total, var_within, var_between, w, n_children): one loop round a level, whose number is small; no data
    reaches the driver. The weight is a child's own w at the leaves and its number of leaves above them.
    """
    below = leaves.withColumnRenamed("var", "var_total")
    out = None
    for depth in range(len(levels) - 1, -1, -1):
        keys = levels[:depth]
        level = aggregate_children(below, keys)
        node = F.concat_ws("/", F.lit("root"), *[F.col(k).cast("string") for k in keys])
        row = level.select(F.lit(depth).alias("depth"), node.alias("node"), "mean", "var_total", "var_within", "var_between", "n_children")
        out = row if out is None else out.unionByName(row)
        below = level.withColumn("w", F.col("n_children").cast("double")) if depth == len(levels) - 1 else level
    return out


def sibling_rows(children: DataFrame, parent: str, child: str) -> DataFrame:
    """children of parents with at least two of them, children compared as text."""
    n = F.count(F.lit(1)).over(Window.partitionBy(parent))
    return children.withColumn("n_siblings", n).filter("n_siblings >= 2").withColumn(child, F.col(child).cast("string"))


def comparison_columns(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """rows(keys.., stat, scheme, mean, var_total, var_within, var_between) to one wide row a key: <stat>_<kind>_<scheme>."""
    kinds = {"mean": "mean", "var": "var_total", "within": "var_within", "between": "var_between"}
    tall = rows.select(*keys, F.explode(F.array(*[
        F.struct(F.concat_ws("_", "stat", F.lit(k), "scheme").alias("name"), F.col(c).alias("value")) for k, c in kinds.items()])).alias("x"))
    return tall.select(*keys, "x.name", "x.value").groupBy(*keys).pivot("name", names).agg(F.first("value"))


def grouped_ungrouped(members: DataFrame, grouped: DataFrame, key: str, parent: str, value: str) -> DataFrame:
    """Per parent: how many members are in any group, how many in none, their share, and the mean of value in both."""
    flag = grouped.select(key).distinct().withColumn("in_group", F.lit(True))
    rows = members.join(flag, key, "left").withColumn("in_group", F.coalesce("in_group", F.lit(False)))
    n, k = F.count(F.lit(1)), F.count(F.when(F.col("in_group"), 1))
    return rows.groupBy(parent).agg(
        k.alias("n_grouped"), (n - k).alias("n_ungrouped"), F.coalesce(F.try_divide(k, n), F.lit(0.0)).alias("grouped_fraction"),
        F.avg(F.when(F.col("in_group"), F.col(value))).alias("mean_grouped"), F.avg(F.when(~F.col("in_group"), F.col(value))).alias("mean_ungrouped"))


def group_stats_rollup(stats: DataFrame, keys: list[str], weight: str = "n_groups") -> DataFrame:
    """stats(.., key, value, n_groups): every key averaged by the number of groups, counts and medians too."""
    ok = stats.filter(F.col(weight) > 0)
    return ok.groupBy(*keys).agg((F.sum(F.col("value") * F.col(weight)) / F.sum(weight)).alias("value"), F.sum(weight).alias(weight))


def group_sizes(members: DataFrame, group: str, member: str, values: dict[str, str]) -> DataFrame:
    """Per group: distinct members, and the mean of each named value column."""
    return members.groupBy(group).agg(F.countDistinct(member).alias("group_size"), *[F.avg(c).alias(n) for n, c in values.items()])


def recording_metrics(rows: DataFrame, key: str, value: str, active: Column) -> DataFrame:
    """Per recording: rows, active ones and their share, mean and median value, share of zero values, and active ones per 1000."""
    n, a = F.count(F.lit(1)), F.count(F.when(active, 1))
    return rows.groupBy(key).agg(
        n.alias("n_detected"), a.alias("n_active"), F.try_divide(a, n).alias("active_fraction"), F.avg(value).alias("mean_value"),
        F.median(value).alias("median_value"), F.try_divide(F.count(F.when(F.col(value) == 0, 1)), n).alias("zero_fraction"),
        (F.try_divide(a, n) * 1000).alias("active_per_1000"))


def stratified(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of each metric in each stratum, with the number of rows."""
    columns = [x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"))]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *columns)


def coverage(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Number of distinct items in each stratum, and their sorted list as text."""
    items = F.array_sort(F.collect_set(F.col(item).cast("string")))
    return rows.groupBy(*keys).agg(F.countDistinct(item).alias("n_items"), F.array_join(items, ",").alias("items"))


def stat_bases(df: DataFrame, keys: list[str]) -> DataFrame:
    """Unpivot each mean_<stat> column with its var_<stat>: (keys.., stat, m, v)."""
    names = [c[5:] for c in df.columns if c.startswith("mean_")]
    pairs = [F.struct(F.lit(s).alias("stat"), F.col(f"mean_{s}").alias("m"), (F.col(f"var_{s}") if f"var_{s}" in df.columns else F.lit(None).cast("double")).alias("v")) for s in names]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("x")).select(*keys, "x.stat", "x.m", "x.v")


def legend(names: DataFrame) -> DataFrame:
    """(name, description) for comparison columns, by prefix and suffix; unknown names have an empty description."""
    n = F.col("name")
    kinds = {"mean": "Mean of ", "var": "Total variance of ", "within": "Variance within parts of ", "between": "Variance between parts of "}
    out = F.when(n == "n_videos", "Number of recordings").when(n == "n_neurons", "Number of accepted neurons").when(
        n.startswith("n_groups_"), F.concat(F.lit("Number of groups, strategy "), F.expr("substring(name, 10)")))
    for k, text in kinds.items():
        pattern = rf"^(.*)_{k}_([a-z]+)$"
        out = out.when(n.rlike(pattern), F.concat(F.lit(text), F.regexp_extract(n, pattern, 1), F.lit(", "), F.regexp_extract(n, pattern, 2)))
    return names.select("name", out.otherwise("").alias("description"))
