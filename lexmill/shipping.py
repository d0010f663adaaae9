"""Makes the package importable on the executors of any session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Arrow batches are bounded by bytes as well as rows, so that long texts do not fill a worker's memory.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once for each Spark context, and bound Arrow batches if nobody has."""
    context = spark.sparkContext
    if not getattr(context, "_lexmill_shipped", False):
        root = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="lexmill-ship-")) / "lexmill_package.zip"
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        context.addPyFile(str(at))
        if not context.getConf().contains(BATCH_BYTES):
            spark.conf.set(BATCH_BYTES, "8m")
        context._lexmill_shipped = True
    return spark
