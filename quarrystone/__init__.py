"""Quarrystone: analytics and training-data queries on Spark."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path


def attach(spark) -> None:
    """Sends this package to the session's workers, for clusters where it is not installed on them; the driver serves the file while it runs."""
    root, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="quarrystone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder, "quarrystone.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
