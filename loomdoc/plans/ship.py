"""Makes the package importable in Python workers that don't share the driver's path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows and bytes of a batch to a Python worker, where the session says nothing else. Spark's 10,000 rows of whole texts are tens of megabytes, which a
#: task holds several times over (growing vectors, their copy on the way, the worker's own); the kernels work on slices of half a megabyte anyway.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once for each application, as --py-files would; and bounds the batches that go to Python workers."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="loomdoc-")) / "loomdoc.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
