"""Session helpers that every part of the engine shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "spark.tamarack.shipped"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once a context: a zip served by the driver."""
    context = spark.sparkContext
    if spark.conf.get(_SHIPPED, "") == context.applicationId:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="tamarack-"), "tamarack_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(target)
    spark.conf.set(_SHIPPED, context.applicationId)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder that the driver and all executors see.

    The cluster names the parent in ``spark.checkpoint.dir``.  Only where that is unset and the master is local, as in
    tests, a local temporary folder is made, recorded in the session and deleted at the end.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None)
    if not parent:
        parent = spark.conf.get("spark.tamarack.shared.dir", None)
        if not parent:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors see")
            parent = tempfile.mkdtemp(prefix="tamarack-")
            atexit.register(shutil.rmtree, parent, ignore_errors=True)
            spark.conf.set("spark.tamarack.shared.dir", parent)
    return f"{parent.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage in a way that survives lost executors."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
