"""Sending the package to the Python workers of a cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor.

    It is sent once per Spark application as a zip archive, through Spark's
    own file server, so that executors need no shared folder for it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_keyloom_shipped", None) == sc.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    fd, name = tempfile.mkstemp(prefix=f"{root.name}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(name)
    sc._keyloom_shipped = sc.applicationId
