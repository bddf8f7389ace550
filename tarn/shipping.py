"""Making this package importable for Python workers."""

from __future__ import annotations

import os
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from tarn.storage import shared_dir

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session, unless PYTHONPATH, which workers inherit, already holds it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    if str(root) in [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        return
    folder = Path(shared_dir(spark).removeprefix("file://"))
    if not folder.is_absolute() or "://" in str(folder):
        return  # a remote shared folder: the cluster is to have the package installed
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"tarn-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "tarn").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))
