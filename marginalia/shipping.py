"""The package's modules on the executors, also where they aren't installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once; Arrow functions import it by name."""
    context = spark.sparkContext
    if getattr(context, "_marginalia_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="marginalia-modules-")  # the driver serves the file; nothing reads the folder later
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "marginalia_modules.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._marginalia_shipped = True
