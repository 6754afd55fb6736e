"""Model bundles: a folder a model kind with the model and a JSON side file, and a manifest that pins digests, features and transforms.

A bundle is read through Spark's file readers, so it may lie in any store that the session reads. Downloads from a model hub aren't part of this.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import PurePosixPath

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.models import feature_names

#: What an entry of the manifest has.
FIELDS = ("model", "config", "sha256", "features", "transform")
SIDE_FILE = "results.json"


def inside(root: str, relative: str, what: str) -> str:
    """root/relative; a path that leaves root is an error."""
    parts = PurePosixPath(relative).parts
    if PurePosixPath(relative).is_absolute() or ".." in parts:
        raise ValueError(f"the path of the {what} leaves the bundle: {relative}")
    return f"{root.rstrip('/')}/{relative}"


def model_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the digests of a model folder's files in order of their paths: it has parts whose names hold no random ids."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(~F.col("path").rlike(r"/[_.][^/]*$"))
    # a model's files: a few
    return found.select(F.sha2("content", 256).alias("d")).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("d"))), 256).alias("d")).first()["d"]


def _read_json(spark: SparkSession, path: str, what: str) -> dict:
    try:
        text = spark.read.text(path, wholetext=True).first()
    except Exception as error:
        raise FileNotFoundError(f"the {what} can't be read at {path}") from error
    try:
        value = json.loads(text["value"]) if text else None
    except json.JSONDecodeError as error:
        raise ValueError(f"the {what} at {path} isn't JSON: {error}") from error
    if not isinstance(value, dict):
        raise ValueError(f"the {what} at {path} must hold an object")
    return value


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def save_model(spark: SparkSession, root: str, which: str, model: PipelineModel, results: dict, transform: str = "raw", iteration: str = "iteration-001") -> dict:
    """Write a model and its results below root/which/iteration; the entry for a manifest."""
    folder = f"{which}/{iteration}"
    model.write().overwrite().save(inside(root, f"{folder}/model", f"{which} model"))
    features = feature_names(model)
    _write_text(spark, inside(root, f"{folder}/{SIDE_FILE}", f"{which} config"), json.dumps({**results, "features": features, "transform": transform}, sort_keys=True))
    return {"model": f"{folder}/model", "config": f"{folder}/{SIDE_FILE}", "sha256": model_digest(spark, inside(root, f"{folder}/model", "model")), "features": features, "transform": transform}


def write_manifest(spark: SparkSession, root: str, entries: dict[str, dict]) -> None:
    _write_text(spark, inside(root, "manifest.json", "manifest"), json.dumps({"models": entries}, sort_keys=True))


def load_bundle(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("roi", "spike")) -> dict[str, tuple[PipelineModel, dict]]:
    """{kind: (model, its side file)}, checked against the manifest first: every field there, model and side file in one iteration's folder of
    the kind, the digest, and equal features (of the manifest, the side file and the model) and transforms. What doesn't hold is an error."""
    models = _read_json(spark, inside(root, "manifest.json", "manifest"), "manifest").get("models", {})
    out = {}
    for which in kinds:
        entry = models.get(which)
        if not isinstance(entry, dict):
            raise ValueError(f"the manifest lacks models.{which}")
        if lacking := [f for f in FIELDS if f not in entry]:
            raise ValueError(f"the manifest lacks models.{which}.{lacking[0]}")
        for field in ("model", "config"):
            parts = PurePosixPath(entry[field]).parts
            if len(parts) < 3 or parts[0] != which:
                raise ValueError(f"models.{which}.{field} must lie in an iteration's folder below {which}/")
        if PurePosixPath(entry["model"]).parent != PurePosixPath(entry["config"]).parent:
            raise ValueError(f"the {which} model and its results must lie in one iteration's folder")
        path = inside(root, entry["model"], f"{which} model")
        side = _read_json(spark, inside(root, entry["config"], f"{which} config"), f"{which} config")
        if (found := model_digest(spark, path)) != entry["sha256"]:
            raise ValueError(f"the digest of the {which} model differs: {entry['sha256']} is expected, {found} found")
        model = PipelineModel.load(path)
        for what, features in (("config", side.get("features")), ("model", feature_names(model))):
            if features != list(entry["features"]):
                raise ValueError(f"the features of the {which} {what} differ: {entry['features']} are expected, {features} found")
        if side.get("transform") != entry["transform"]:
            raise ValueError(f"the transform of the {which} model differs: {entry['transform']!r} is expected, {side.get('transform')!r} found")
        out[which] = (model, side)
    return out


def backup(table: DataFrame, path: str, now: datetime | None = None) -> str:
    """Write the table beside path with the time in its name, before something is changed in place; the copy's path."""
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    target = f"{path.rstrip('/')}_backup_{stamp}"
    table.write.mode("errorifexists").parquet(target)
    return target


def sheet_names(names: list[str], longest: int = 31) -> list[str]:
    """The names without the characters that tables in a workbook can't have, cut, and numbered behind the first of equals."""
    out: list[str] = []
    for name in names:
        base = name.translate({ord(c): "_" for c in "[]:*?/\\"})[:longest] or "sheet"
        free, k = base, 0
        while free in out:
            k += 1
            free = f"{base[: longest - len(str(k)) - 1]}_{k}"
        out.append(free)
    return out


def save_tables(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Write each table that has columns as Parquet below path, under its sheet name; {table: path}."""
    named = [k for k, t in tables.items() if t.columns]
    out = {k: f"{path.rstrip('/')}/{n}" for k, n in zip(named, sheet_names(named), strict=True)}
    for k, target in out.items():
        tables[k].write.mode("overwrite").parquet(target)
    return out


def merge_tables(parts: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Tables of one name below each other, columns by name, missing ones null; tables without columns are skipped."""
    out: dict[str, DataFrame] = {}
    for part in parts:
        for name, table in part.items():
            if table.columns:
                out[name] = out[name].unionByName(table, allowMissingColumns=True) if name in out else table
    return out
