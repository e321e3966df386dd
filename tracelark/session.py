"""Sessions for local runs; on a cluster the caller's own session is used."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable for Python workers that don't find it on their own path; once an application."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    on_path = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if sc.applicationId in _SHIPPED or (sc.master.startswith("local") and any(p and Path(p).resolve() == root for p in on_path)):
        return
    _SHIPPED.add(sc.applicationId)
    folder = tempfile.mkdtemp(prefix="tracelark-py-")  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "tracelark.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "tracelark").rglob("*.py")):
            z.write(f, f.relative_to(root))
        for f in root.glob("corpus_pipeline.py"):
            z.write(f, f.name)
    sc.addPyFile(str(target))
