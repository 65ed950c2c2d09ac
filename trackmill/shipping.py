"""Gets this package to Python workers that could not import it otherwise."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once, unless workers find it by PYTHONPATH or (in local mode) in the working folder."""
    here = Path(__file__).resolve().parent
    found = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        found.append(Path.cwd().resolve())
    if here.parent in found or context.applicationId in _shipped or not here.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="trackmill-")) / "trackmill.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
