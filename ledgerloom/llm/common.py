"""What the operators of this package share."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.workspace import fresh_folder, shared_folder

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, f"{package.name}/{module.relative_to(package)}")
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame under the shared folder and read it back: cuts the lineage, survives executors.

    Where the session names no folder (as in tests), one below its warehouse is set.
    """
    spark = df.sparkSession
    if not shared_folder(spark):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        spark.sparkContext.setCheckpointDir(f"{warehouse}/_ledgerloom_work")
    path = fresh_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released() -> None:
    """Give the memory that a task leaves in its Python worker back to the system."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def whole_text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
