"""Session settings, and shipping this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch. Rows hold whole texts, so Spark's own 10,000 can take hundreds of megabytes in each of a few buffers.
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of a generated method, above which a stage isn't generated as a whole: the JVM doesn't compile methods over 8,000, and Spark's own limit is far above.
METHOD = "spark.sql.codegen.hugeMethodLimit"


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers, wherever they start (once for each application), with small Arrow batches where the session
    has Spark's default."""
    sc = spark.sparkContext
    if spark.conf.get(ROWS) == "10000":
        spark.conf.set(ROWS, "500")
    if sc.applicationId in _shipped:
        return spark
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """What the library needs of a session: UTC days, the last of equal JSON keys, and code that is compiled, where the session has Spark's default."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    if spark.conf.get(METHOD, "65535") == "65535":
        spark.conf.set(METHOD, "8000")
    return ship(spark)
