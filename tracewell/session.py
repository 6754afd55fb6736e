"""Session defaults, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def session(app: str = "tracewell", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; a cluster sets its own and passes its session in."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.warehouse.dir": os.path.join(tempfile.gettempdir(), "tracewell-warehouse"),
    }
    return SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map={**base, **conf}).getOrCreate()


#: Rows of an Arrow batch: texts and pages make Spark's default of 10,000 rows some 40 MB, twice over for each running task.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that Python workers can import it anywhere.

    The session's Arrow batches are made smaller if they still have Spark's default size.
    """
    name, default, rows = ARROW_ROWS
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, rows)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="tracewell")) / "tracewell_pkg.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(app)
    return spark
