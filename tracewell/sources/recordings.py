"""Readers and writers of recordings: array files, summary artifacts, metadata, names and trees. All go through Spark's readers, so any store works."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of the summary artifact's format, and its kind.
KIND, VERSION = "recording_summary", 1


def parse_day(name: Column) -> Column:
    """The number behind _Day at the end of a name, 1 without."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(?i)_Day(\d+)$", 1), F.lit("")).cast("int"), F.lit(1))


def parse_region(name: Column) -> Column:
    """The region n-m of a name n-m or n-m_DayN; null for others."""
    return F.nullif(F.regexp_extract(name, r"(?i)^(\d+-\d+)(_Day\d+)?$", 1), F.lit(""))


def path_part(path: Column, back: int) -> Column:
    """The back-th part of a path from its end, "unknown" where there is none."""
    return F.coalesce(F.nullif(F.try_element_at(F.split(path, "/"), F.lit(-back)), F.lit("")), F.lit("unknown"))


def recording_metadata(paths: DataFrame, path: str = "path") -> DataFrame:
    """paths with video, timepoint, treatment, experiment, region and day from their parts."""
    p = F.col(path)
    return paths.withColumns({"video": path_part(p, 1), "timepoint": path_part(p, 2), "treatment": path_part(p, 3), "experiment": path_part(p, 4), "region": parse_region(path_part(p, 1)), "day": parse_day(path_part(p, 1))})


def discover(spark: SparkSession, root: str, pattern: str = "F.npy") -> DataFrame:
    """(path, folder, modified) of the recordings' array files below root."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.col("modificationTime").alias("modified"))


def read_arrays(spark: SparkSession, root: str, pattern: str = "F.npy") -> DataFrame:
    """(recording, roi_idx, f) from two-dimensional .npy files below root: one row of the array a row, read as bytes by the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame({"recording": path.rsplit("/", 1)[0], "roi_idx": np.arange(len(a)), "f": list(np.atleast_2d(a).astype(float))})

    return files.select("path", "content").mapInPandas(load, "recording string, roi_idx int, f array<double>")


def tree_nodes(paths: DataFrame, path: str = "path") -> DataFrame:
    """(node, parent, name, depth, is_leaf) of the tree that the paths span; parents are prefixes."""
    parts = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.struct(F.array_join(F.slice("p", 1, k), "/").alias("node"), F.array_join(F.slice("p", 1, k - 1), "/").alias("parent"), F.element_at("p", k).alias("name"), k.alias("depth"), (k == F.size("p")).alias("leaf")))
    rows = paths.select(parts.alias("p")).filter(F.size("p") > 0).select(F.explode(prefixes).alias("n")).select("n.*")
    return rows.groupBy("node", "parent", "name", "depth").agg(F.min("leaf").alias("is_leaf"))


def fingerprint(config: dict | None) -> str | None:
    """SHA-256 of the configuration as sorted, compact JSON."""
    return None if config is None else hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def finite(c: Column) -> Column:
    """Null for NaN and infinite values: they are not estimable, and not 0."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def write_summaries(rows: DataFrame, path: str) -> None:
    """Versioned JSON artifacts, one line a recording; doubles that aren't finite become null."""
    safe = rows.select(*[finite(F.col(n)).alias(n) if k == "double" else F.col(n) for n, k in rows.dtypes])
    safe.select(F.lit(KIND).alias("artifact_kind"), F.lit(VERSION).alias("schema_version"), F.struct("*").alias("summary")).write.json(path)


def read_summaries(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(summaries, issues): artifacts of another kind or version, or that can't be read, become issue rows instead of errors."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = raw.withColumn("a", F.from_json("value", f"artifact_kind string, schema_version int, summary struct<{schema}>"))
    ok = F.col("a.artifact_kind").eqNullSafe(F.lit(KIND)) & F.col("a.schema_version").eqNullSafe(F.lit(VERSION))
    issues = parsed.filter(~ok).select(F.lit("error").alias("severity"), F.lit("bad_artifact").alias("code"), F.col("file").alias("grp"), F.lit("wrong kind or version").alias("message"))
    return parsed.filter(ok).select("a.summary.*"), issues


def read_metadata(spark: SparkSession, source) -> DataFrame:
    """Metadata from CSV, Parquet or JSON by suffix, or a list of dicts, all columns as text."""
    if isinstance(source, list):
        return spark.createDataFrame([{k: None if v is None else str(v) for k, v in r.items()} for r in source])
    readers = {"csv": lambda p: spark.read.csv(p, header=True), "parquet": spark.read.parquet, "json": spark.read.json}
    kind = source.rsplit(".", 1)[-1].lower()
    if kind not in readers:
        raise ValueError(f"metadata of kind {kind!r} isn't supported; one of {sorted(readers)}")
    df = readers[kind](source)
    return df.select(*[F.col(c).cast("string") for c in df.columns])


def parse_list(text: Column) -> Column:
    """Whole numbers from a list written as text; empty for null."""
    return F.coalesce(F.from_json(text, "array<int>"), F.array().cast("array<int>"))


def digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of the files below root, to check a model bundle against its manifest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"))
