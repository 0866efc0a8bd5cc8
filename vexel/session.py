"""Getting the package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of a session, once; they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_vexel_shipped", False) or not _PACKAGE.is_dir():
        return
    at = Path(tempfile.mkdtemp(prefix="vexel-package-")) / "vexel.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(at))
    sc._vexel_shipped = True
