"""Folder for working files that every executor can reach, and the session settings of the jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Up to this size of the smaller side's partitions Spark joins by a hash table in memory.
HASH_JOINS = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
PARTITION_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def shared_folder(spark: SparkSession) -> str | None:
    """The session's ``spark.checkpoint.dir``, or the checkpoint folder set on its context."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    shared = shared_folder(spark)
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{shared.rstrip('/')}/ledgerloom/{label}-{uuid.uuid4().hex}"


@contextmanager
def hash_joins(spark: SparkSession) -> Iterator[None]:
    """Let adaptive execution join shuffled tables by hash, where it saw that they allow it.

    A join whose smaller side has no partition above the size that Spark aims at then keeps that
    side in a hash table; neither side is sorted, and wide rows pass several joins without a copy
    each. Larger or skewed sides are merged as before. A session that has the setting keeps it.
    """
    if spark.conf.get(HASH_JOINS) not in ("0", "0b"):
        yield
        return
    spark.conf.set(HASH_JOINS, spark.conf.get(PARTITION_SIZE))
    try:
        yield
    finally:
        spark.conf.unset(HASH_JOINS)
