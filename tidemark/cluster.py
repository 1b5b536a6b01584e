"""What jobs need of the cluster: the package on its workers, and a folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_package", False):
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="tidemark"), "tidemark_core.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    sc.addPyFile(archive)
    sc._tidemark_package = True


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; without that setting only a local session gets one, elsewhere it raises."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        shared = tempfile.mkdtemp(prefix="tidemark-work-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
