"""Validation: every check gives rows (severity, code, grp, message), so checks union into one report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _issue(df: DataFrame, severity: str, code: str, grp: Column, message: Column) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), grp.cast("string").alias("grp"), message.alias("message"))


def duplicate_keys(df: DataFrame, keys: list[str], order: str, code: str = "duplicate_key") -> DataFrame:
    """One issue for each row of a key from the second on."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    text = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return _issue(df.withColumn("rn_", rn).filter("rn_ > 1"), "error", code, text, F.concat(F.lit("row "), F.col(order).cast("string"), F.lit(" repeats a key")))


def small_groups(df: DataFrame, keys: list[str], minimum: int) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < minimum)
    return _issue(n, "error", "group_too_small", F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), F.concat(F.col("n").cast("string"), F.lit(f" of at least {minimum}")))


def low_replicates(df: DataFrame, group: str, replicate: str, minimum: int = 2) -> DataFrame:
    n = df.groupBy(group).agg(F.countDistinct(replicate).alias("n")).filter(F.col("n") < minimum)
    return _issue(n, "warning", "low_replicates", F.col(group), F.concat(F.col("n").cast("string"), F.lit(" replicates")))


def unmatched_metadata(metadata: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return _issue(metadata.select(key).distinct().join(rows.select(key), key, "left_anti"), "warning", "unmatched_metadata", F.col(key), F.lit("no recording has this key"))


def mixed_configs(rows: DataFrame, group: str, fingerprint: str) -> DataFrame:
    n = rows.groupBy(group).agg(F.countDistinct(fingerprint).alias("n")).filter("n > 1")
    return _issue(n, "warning", "mixed_configuration", F.col(group), F.concat(F.col("n").cast("string"), F.lit(" configurations")))


def accounting(rows: DataFrame, key: str, total: str, parts: list[str]) -> DataFrame:
    """(key, difference) where the parts don't add up to the total."""
    d = F.col(total) - reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0)) for p in parts])
    return rows.select(key, d.alias("difference")).filter("difference <> 0")


def override_metadata(inferred: DataFrame, metadata: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """inferred's fields, replaced where metadata has a value; the first metadata row of a key counts."""
    first = metadata.groupBy(key).agg(*[F.first(f, ignorenulls=True).alias(f"{f}_") for f in fields])
    return inferred.join(first, key, "left").select(key, *[F.coalesce(f"{f}_", f).alias(f) for f in fields])


def alignment_inputs(recordings: DataFrame, listed: DataFrame, key: str, required: tuple[str, ...] = ("ops.npy", "stat.npy"), snap: str = "_snap.tif") -> DataFrame:
    """Errors for recordings(key) that lack a required file, or any file that ends in `snap`, among listed(key, name)."""
    wanted = recordings.select(key).distinct().withColumn("need", F.explode(F.array(*[F.lit(n) for n in required])))
    have = listed.select(key, F.col("name").alias("need")).distinct()
    missing = _issue(wanted.join(have, [key, "need"], "left_anti"), "error", "missing_alignment_input", F.col(key), F.concat(F.lit("missing "), F.col("need")))
    seen = listed.filter(F.col("name").endswith(snap)).select(key).distinct()
    return missing.unionByName(_issue(recordings.select(key).distinct().join(seen, key, "left_anti"), "error", "missing_snap", F.col(key), F.lit("alignment needs a snapshot")))


def report(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)
