"""Making this package importable in Python workers on machines that don't have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Bytes of an Arrow batch, unless the session says otherwise: Spark's own 64 MB count several times in each Python worker's
#: executor, on both sides of the pipe.
BATCH_BYTES = 8 << 20
_DEFAULTS = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", f"{BATCH_BYTES}b")}


def ship(spark: SparkSession) -> None:
    """Send the package's own code to the executors, once for each application, and keep Arrow batches of long texts small:
    settings of the session that are at Spark's defaults are lowered."""
    for key, (default, own) in _DEFAULTS.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, own)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(to))
    _shipped.add(context.applicationId)
