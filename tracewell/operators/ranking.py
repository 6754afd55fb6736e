"""Ranking, multiple-comparison correction, and ordered selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _part(keys: list[str] | None):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str] | None = None, order: list[str] | None = None, monotone: bool = True) -> DataFrame:
    """df with `q`: p * n / rank within keys, made monotone from the right and cut at 1 unless monotone is False. Null p give null q
    and don't count. A family of tests is bounded in practice; give keys so that families are ranked apart."""
    w = _part(keys)
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    n = F.count(F.when(ok, 1)).over(w)
    ranked = df.withColumn("bh_rank", F.when(ok, F.row_number().over(w.orderBy(F.when(ok, F.col(p)).asc_nulls_last(), *(order or [])))))
    raw = F.col(p) * n / F.col("bh_rank")
    ranked = ranked.withColumn("bh_raw", F.when(F.col("bh_rank").isNotNull(), raw))
    if monotone:
        down = w.orderBy(F.desc_nulls_last("bh_rank")).rowsBetween(Window.unboundedPreceding, 0)
        q = F.least(F.min("bh_raw").over(down), F.lit(1.0))
    else:
        q = F.least(F.col("bh_raw"), F.lit(1.0))
    return ranked.withColumn("q", F.when(F.col("bh_rank").isNotNull(), q)).drop("bh_rank", "bh_raw")


def bh_rejected(df: DataFrame, p: str, alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """df with `rejected`: p at most the largest p that is at most alpha * rank / n."""
    w = _part(keys)
    rank = F.row_number().over(w.orderBy(p))
    marked = df.withColumn("bh_ok", F.when(F.col(p) <= rank * alpha / F.count(F.lit(1)).over(w), F.col(p)))
    return marked.withColumn("rejected", F.coalesce(F.col(p) <= F.max("bh_ok").over(w), F.lit(False))).drop("bh_ok")


def bonferroni(df: DataFrame, p: str, keys: list[str] | None = None) -> DataFrame:
    return df.withColumn("q", F.least(F.col(p) * F.count(p).over(_part(keys)), F.lit(1.0)))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def top_groups(df: DataFrame, size: str, order: str, fraction: float | None = None, top_n: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """The largest groups: the first top_n, or a fraction rounded up, at least one; ties by `order`."""
    w = _part(keys)
    rank = F.row_number().over(w.orderBy(F.desc(size), order))
    k = F.lit(top_n) if top_n is not None else F.greatest(F.ceil(F.count(F.lit(1)).over(w) * F.lit(fraction)), F.lit(1))
    return df.withColumns({"rank": rank, "keep": k}).filter("rank <= keep").drop("keep")


def rank_bins(df: DataFrame, value: str, order: str, bins: int, keys: list[str] | None = None) -> DataFrame:
    """df with `bin`: rank * bins div n from 0, by stable rank."""
    w = _part(keys)
    at = F.floor((F.row_number().over(w.orderBy(value, order)) - 1) * bins / F.count(F.lit(1)).over(w))
    return df.withColumn("bin", F.least(F.lit(bins - 1), at).cast("int"))


def ordinal_ranks(df: DataFrame, value: str, order: str, keys: list[str]) -> DataFrame:
    """df with `rank` from 0; ties are ranked in order, not averaged."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(value, order)) - 1)


def cumulative_shifts(adjacent: DataFrame, keys: list[str], day: str, anchor: int) -> DataFrame:
    """adjacent(keys.., day, dy, dx, corr): the shift of each day from the day before, composed towards the anchor day; and the
    least correlation on the way. Days behind the anchor count negatively."""
    w = Window.partitionBy(*keys)
    before = w.orderBy(day).rowsBetween(0, Window.unboundedFollowing)
    after = w.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    early = adjacent.filter(F.col(day) <= anchor).select(*keys, (F.col(day) - 1).alias(day), *[(F.bround(F.sum(c).over(before)) + F.lit(0.0)).alias(c) for c in ("dy", "dx")], F.min("corr").over(before).alias("corr"))
    late = adjacent.filter(F.col(day) > anchor).select(*keys, day, *[(F.lit(0.0) - F.bround(F.sum(c).over(after))).alias(c) for c in ("dy", "dx")], F.min("corr").over(after).alias("corr"))
    return early.unionByName(late)
