"""Shared parts of the text operators: tables, scratch space, skew-safe joins."""

from __future__ import annotations

import atexit
import contextlib
import gc
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.scratch import shared_dir

#: A key is hot when it holds more than one row in HOT; so at most HOT keys are hot, whatever the input's size.
HOT = 1000

#: Scratch folders by (application, scope), and the scope that new ones belong to.
_SCRATCH: dict[tuple[str, str], list[str]] = {}
_SCOPE = ["session"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tracewell-{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if not any(a == app for a, _ in _SCRATCH):
        atexit.register(_release_quietly, spark)
    _SCRATCH.setdefault((app, _SCOPE[-1]), []).append(path)
    return path


@contextlib.contextmanager
def scope(name: str):
    """Scratch tables written inside belong to this scope, and release() can drop them without touching others."""
    _SCOPE.append(name)
    try:
        yield
    finally:
        _SCOPE.pop()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, so that several readers share one computation.

    The files stay until release() or the end of the session, as a lazy result may still read them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, name: str) -> None:
    """Delete the scratch tables of a scope; only valid once every result that reads them has been written."""
    for path in _SCRATCH.pop((spark.sparkContext.applicationId, name), []):
        delete_path(spark, path)


def _release_quietly(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            for app, name in list(_SCRATCH):
                if app == spark.sparkContext.applicationId:
                    release(spark, name)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit; nothing is left to tidy then
        pass


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no DataFrame refers to any more, before the next large shuffle."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession, rows: int, per: int) -> int:
    """Enough partitions for `per` rows each, and at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / max(1, per)))


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with keyed (one row per key, `size` = rows under the key, `total` = all rows).

    A key may hold a third of all rows. Keys with more than total / HOT rows are at most HOT in number,
    a proven bound, and are joined map-side; all others fit in a task and go through a shuffle join.
    Both inputs are read twice, so pass materialised ones. `size` isn't kept. Only the hot keys themselves reach the driver.
    """
    hot = [r[0] for r in keyed.filter(F.col(size) * HOT > F.lit(total)).select(key).collect()]
    keyed = keyed.drop(size)
    if not hot:
        return rows.join(keyed.hint("merge"), key)
    is_hot = F.col(key).isin(hot)
    by_map = rows.filter(is_hot).join(F.broadcast(keyed.filter(is_hot)), key)
    by_shuffle = rows.filter(~is_hot).join(keyed.filter(~is_hot).hint("merge"), key)
    return by_map.unionByName(by_shuffle)
