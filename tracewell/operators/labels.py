"""Labels: value (1 good, 0 bad, -1 none) with a source; selection, summaries, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized_label(value: Column, source: Column | None = None) -> Column:
    return F.struct(F.coalesce(value, F.lit(-1)).alias("value"), F.coalesce(source if source is not None else F.lit(None).cast("string"), F.lit("unknown")).alias("source"))


def label_text(value: Column) -> Column:
    return F.when(value == 1, "good").when(value == 0, "bad").otherwise("unlabeled")


def matches_mode(value: Column, source: Column, unlabeled_only: bool = False, labeled_only: bool = False, auto: bool = False) -> Column:
    """Rows that an annotator wants; both restrictions at once are an error."""
    if unlabeled_only and labeled_only:
        raise ValueError("unlabeled_only and labeled_only exclude each other")
    if auto:
        return (source == "auto") & (value != -1)
    if unlabeled_only:
        return value == -1
    return value != -1 if labeled_only else F.lit(True)


def label_summary(df: DataFrame, keys: list[str], value: str, source: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(v == 1).alias("good"), F.count_if(v == 0).alias("bad"), F.count_if(v == -1).alias("unlabeled"),
        F.count_if((v != -1) & (F.col(source) == "manual")).alias("manual"), F.count_if((v != -1) & (F.col(source) == "auto")).alias("auto"))


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "key") -> DataFrame:
    """n rows for annotation: those with the least hashes of the key, so the choice depends on no partitioning."""
    return df.withColumn("h_", F.xxhash64(F.col(key), F.lit(seed))).orderBy("h_", key).limit(n).drop("h_")


def spike_key(roi: Column, spike: Column) -> Column:
    return F.concat_ws("-", roi, spike.cast("string"))


def parse_spike_key(key: Column) -> Column:
    return F.struct(F.regexp_extract(key, r"^(.*)-(\d+)$", 1).alias("roi"), F.nullif(F.regexp_extract(key, r"^(.*)-(\d+)$", 2), F.lit("")).cast("int").alias("spike"))


def update_labels(labels: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """labels(key, value, source) with manual values from updates(key, value), and `changed`."""
    new = updates.select(key, F.col("value").alias("new_"))
    rows = labels.join(new, key, "left")
    return rows.select(
        key, F.coalesce("new_", "value").alias("value"), F.when(F.col("new_").isNotNull(), "manual").otherwise(F.col("source")).alias("source"),
        (F.col("new_").isNotNull() & ~F.col("new_").eqNullSafe(F.col("value"))).alias("changed"))


def preserve_labels(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """new(key, value) where old has no label, old's else."""
    before = old.filter("value <> -1").select(key, F.col("value").alias("old_"))
    return new.join(before, key, "left").withColumn("value", F.coalesce("old_", "value")).drop("old_")


def reset_labels(labels: DataFrame) -> DataFrame:
    return labels.withColumns({"changed": F.col("value") != -1, "value": F.lit(-1), "source": F.lit("unknown")})


def deduplicated_keys(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keys that repeat get _dup1, _dup2, ... behind the first."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn(key, F.when(rn > 1, F.concat(F.col(key), F.lit("_dup"), (rn - 1).cast("string"))).otherwise(F.col(key)))


def filtered_index(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Compact positions from 0 of the rows that are kept."""
    return df.withColumn("filtered_index", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
