"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Make sure that checkpoint() has a folder: spark.checkpoint.dir, or a temporary one in local mode only."""
    if spark.sparkContext.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once for each application, so that its functions run on any executor."""
    context = spark.sparkContext
    if _shipped.get("application") != context.applicationId:
        package = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark_workers.zip"
        with zipfile.ZipFile(archive, "w") as file:
            for source in sorted(package.rglob("*.py")):
                file.write(source, f"{package.name}/{source.relative_to(package)}")
        context.addPyFile(str(archive))
        _shipped["application"] = context.applicationId
    return spark


_shipped: dict[str, str] = {}
