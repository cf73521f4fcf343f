"""Makes the package importable in Spark's Python workers."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once an application; needed where it isn't installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
        if (here.parent / "corpus_pipeline.py").exists():
            z.write(here.parent / "corpus_pipeline.py", "corpus_pipeline.py")
    path = Path(tempfile.mkdtemp(prefix="ship-")) / "revlytics_src.zip"
    path.write_bytes(held.getvalue())
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
