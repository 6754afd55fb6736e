"""Recordings as folders of plane arrays: fluorescence, cell masks, settings, labelled traces, and the files a whole recording has.

Files are found by Spark's listing and parsed by the executors, a file a row; no path is opened outside Spark. A recording's folder ends in
suite2p/plane0, or is the folder that holds F.npy.
"""

from __future__ import annotations

import ast
import io
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrays of a plane; those a recording can't do without; fields of its settings that are kept, and their defaults.
ARRAYS = ("F", "iscell", "Fneu", "spks")
REQUIRED = ("F.npy", "iscell.npy")
FS = 15.0
#: What object arrays may hold: array and scalar constructors of NumPy, and nothing that runs code.
SAFE = {
    ("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"),
    ("numpy._core.multiarray", "scalar"), ("numpy._core.numeric", "_frombuffer"), ("numpy.core.numeric", "_frombuffer"), ("builtins", "set"), ("builtins", "frozenset"), ("builtins", "complex"), ("_codecs", "encode"),
}


class _Reader(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) not in SAFE:
            raise pickle.UnpicklingError(f"{module}.{name} isn't allowed in an array file")
        return super().find_class(module, name)


def load_array(content: bytes) -> np.ndarray:
    """An array of a .npy file; object arrays are unpickled with SAFE names only."""
    f = io.BytesIO(content)
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    _, _, dtype = read(f)
    if not dtype.hasobject:
        return np.load(io.BytesIO(content), allow_pickle=False)
    return np.asarray(_Reader(f).load(), dtype=object)


def files(spark: SparkSession, root: str, pattern: str = "*.npy") -> DataFrame:
    """(folder, name, path, content) of files below root."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return found.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "path", "content")


def inventory(listed: DataFrame) -> DataFrame:
    """(folder, complete, missing) for folders of listed(folder, name) that hold an F.npy or iscell.npy: whether the required arrays are there."""
    have = listed.groupBy("folder").agg(F.collect_set("name").alias("names"))
    needed = F.array(*[F.lit(n) for n in REQUIRED])
    missing = F.array_sort(F.array_except(needed, "names"))
    return have.filter(F.arrays_overlap("names", needed)).select("folder", (F.size(missing) == 0).alias("complete"), missing.alias("missing"))


def discover_planes(spark: SparkSession, root: str, require_all: bool = False) -> DataFrame:
    """inventory() of the folders below root. require_all: an incomplete one is an error that names it."""
    found = inventory(files(spark, root).select("folder", "name"))
    if require_all:
        bad = found.filter("not complete").orderBy("folder").first()
        if bad:
            raise FileNotFoundError(f"{bad['folder']} lacks {', '.join(bad['missing'])}")
    return found


def read_traces(spark: SparkSession, root: str) -> DataFrame:
    """(folder, roi_idx, f, fneu, spks, is_cell, probability) of the complete recordings below root; fneu is 0 and spks null where a recording
    has none. Each array file is read by one task, its rows go on one by one."""
    wanted = files(spark, root).filter(F.col("name").isin([f"{n}.npy" for n in ARRAYS])).select("folder", "name", "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for folder, name, content in zip(pdf["folder"], pdf["name"], pdf["content"], strict=True):
                a = np.atleast_2d(load_array(content)).astype(float)
                yield pd.DataFrame({"folder": folder, "name": name.removesuffix(".npy"), "roi_idx": np.arange(len(a)), "v": list(a)})

    flat = wanted.mapInPandas(rows, "folder string, name string, roi_idx int, v array<double>")
    wide = flat.groupBy("folder", "roi_idx").agg(*[F.first(F.when(F.col("name") == n, F.col("v")), ignorenulls=True).alias(n) for n in ARRAYS])
    both = wide.filter(F.col("F").isNotNull() & F.col("iscell").isNotNull())
    return both.select(
        "folder", "roi_idx", F.col("F").alias("f"), F.coalesce("Fneu", F.transform("F", lambda x: F.lit(0.0))).alias("fneu"), "spks",
        (F.get("iscell", F.lit(0)) > 0).alias("is_cell"), F.get("iscell", F.lit(1)).alias("probability"))


def read_masks(spark: SparkSession, root: str) -> DataFrame:
    """(folder, roi_idx, ypix, xpix, lam, y, x) of each cell's pixels and middle, from stat.npy."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for folder, content in zip(pdf["folder"], pdf["content"], strict=True):
                out = []
                for k, cell in enumerate(load_array(content).ravel()):
                    y, x = (np.asarray(cell[c], dtype=int) for c in ("ypix", "xpix"))
                    middle = cell.get("med", (np.median(y), np.median(x)) if len(y) else (np.nan, np.nan))
                    out.append((folder, k, y.tolist(), x.tolist(), np.asarray(cell.get("lam", np.ones(len(y))), dtype=float).tolist(), float(middle[0]), float(middle[1])))
                yield pd.DataFrame(out, columns=["folder", "roi_idx", "ypix", "xpix", "lam", "y", "x"])

    found = files(spark, root, "stat.npy").select("folder", "content")
    return found.mapInPandas(rows, "folder string, roi_idx int, ypix array<int>, xpix array<int>, lam array<double>, y double, x double")


def read_settings(spark: SparkSession, root: str) -> DataFrame:
    """(folder, fs, height, width, mean_image) from ops.npy: the few fields an analysis takes, fs 15 where it isn't given. mean_image is null or
    its pixels, row by row; registration payloads are left behind in the task that reads the file."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for folder, content in zip(pdf["folder"], pdf["content"], strict=True):
                ops = load_array(content).item()
                image = ops.get("meanImg")
                out.append((folder, float(ops.get("fs", FS)), ops.get("Ly"), ops.get("Lx"), None if image is None else np.asarray(image, dtype=float).ravel().tolist()))
            yield pd.DataFrame(out, columns=["folder", "fs", "height", "width", "mean_image"]).astype({"height": "Int32", "width": "Int32"})

    found = files(spark, root, "ops.npy").select("folder", "content")
    return found.mapInPandas(rows, "folder string, fs double, height int, width int, mean_image array<double>")


def read_labelled(spark: SparkSession, root: str, pattern: str = "*.npy") -> DataFrame:
    """(path, key, trace, label_value, label_source, features) from files that hold one dict of labelled entries: each a dict with a trace, a label
    (a number, or a dict of value and source) and features. Entries without a label have (-1, unknown)."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                held = load_array(content).item()
                if not isinstance(held, dict):
                    raise ValueError(f"{path} doesn't hold a dict of labelled entries")
                for key, entry in held.items():
                    label = entry.get("label")
                    value, source = (label.get("value"), label.get("source")) if isinstance(label, dict) else (label, None)
                    features = {str(k): float(v) for k, v in (entry.get("features") or {}).items() if v is not None}
                    trace = entry.get("trace")
                    out.append((path, str(key), None if trace is None else np.asarray(trace, dtype=float).tolist(), -1 if value is None else int(value), source or "unknown", features))
            yield pd.DataFrame(out, columns=["path", "key", "trace", "label_value", "label_source", "features"])

    found = files(spark, root, pattern).select("path", "content")
    return found.mapInPandas(rows, "path string, key string, trace array<double>, label_value int, label_source string, features map<string, double>")


def ome_metadata(texts: DataFrame, key: str = "folder", xml: str = "xml") -> DataFrame:
    """(key, pixel_size_um, fs) from OME-XML texts: PhysicalSizeX, and the rate by the median step of the planes' DeltaT, in milliseconds unless the
    unit says otherwise. Null where the text has no such field, or steps that aren't positive."""
    plane = r"<(?:\w+:)?Plane\b[^>]*>"
    attribute = lambda name: rf"\b{name}\s*=\s*[\"']([^\"']*)[\"']"
    pixels = F.regexp_extract(xml, r"(<(?:\w+:)?Pixels\b[^>]*>)", 1)
    planes = F.filter(F.regexp_extract_all(xml, F.lit(f"({plane})"), F.lit(1)), lambda t: F.regexp_extract(t, attribute("DeltaT"), 1) != "")
    times = F.transform(planes, lambda t: F.regexp_extract(t, attribute("DeltaT"), 1).cast("double"))
    unit = F.coalesce(F.nullif(F.regexp_extract(F.get(planes, F.lit(0)), attribute("DeltaTUnit"), 1), F.lit("")), F.lit("ms"))
    rows = texts.select(key, F.nullif(F.regexp_extract(pixels, attribute("PhysicalSizeX"), 1), F.lit("")).cast("double").alias("pixel_size_um"), F.when(pixels != "", times).alias("t"), unit.alias("unit"))
    steps = F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda k: F.get("t", k) - F.get("t", k - 1))
    step = F.when(F.size("t") >= 2, F.array_sort(steps))
    n = F.size("step")
    middle = (F.get("step", F.floor((n - 1) / 2).cast("int")) + F.get("step", F.floor(n / 2).cast("int"))) / 2
    rows = rows.withColumn("step", step).withColumn("middle", F.when(n > 0, middle))
    per = F.when(F.lower("unit") == "ms", 1000.0).otherwise(1.0)
    return rows.select(key, "pixel_size_um", F.when(F.col("middle") > 0, per / F.col("middle")).alias("fs"))


def read_ome(spark: SparkSession, root: str) -> DataFrame:
    """ome_metadata() by folder: of a folder's *.ome.xml, or else *.xml files, the first by name."""
    found = files(spark, root, "*.xml").withColumn("rank", F.struct(~F.col("name").endswith(".ome.xml"), "name"))
    first = found.groupBy("folder").agg(F.min_by("content", "rank").alias("content"))
    return ome_metadata(first.select("folder", F.decode("content", "UTF-8").alias("xml")))


def load_config(text: str) -> dict:
    """Settings from YAML text: with PyYAML where it is, else nested maps of scalars and inline lists, which is what such settings are."""
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        return _plain_yaml(text)


def _plain_yaml(text: str) -> dict:
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for number, line in enumerate(text.splitlines(), 1):
        body = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not body.strip():
            continue
        indent = len(body) - len(body.lstrip())
        name, colon, value = body.strip().partition(":")
        if not colon or body.lstrip().startswith("- "):
            raise ValueError(f"line {number} isn't a setting: {line!r}")
        while stack[-1][0] >= indent:
            stack.pop()
        if value.strip():
            stack[-1][1][name.strip()] = _scalar(value.strip())
        else:
            stack[-1][1][name.strip()] = {}
            stack.append((indent, stack[-1][1][name.strip()]))
    return root


def _scalar(value: str):
    words = {"true": True, "false": False, "null": None, "~": None}
    if value.lower() in words:
        return words[value.lower()]
    if value.startswith("["):
        return [_scalar(v.strip()) for v in value[1:-1].split(",") if v.strip()]
    try:
        return ast.literal_eval(value)
    except (ValueError, SyntaxError):
        return value
