"""Document-raster analytics on PySpark.

``attach(spark)`` hands this package to the session's Python workers; call it once per session
where the package isn't installed on the executors.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_attached: set[str] = set()


#: Rows of an Arrow batch where the session leaves Spark's own number: texts and pages are rows of some KB.
BATCH_ROWS = "2000"


def attach(spark: SparkSession) -> SparkSession:
    """Ship the package's sources to the workers of this session (once per application), and bound Arrow batches."""
    sc = spark.sparkContext
    if sc.applicationId not in _attached:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="lumenfold-src-")) / "lumenfold_src.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(str(target))
        _attached.add(sc.applicationId)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's own number
        spark.conf.set(key, BATCH_ROWS)
    return spark
