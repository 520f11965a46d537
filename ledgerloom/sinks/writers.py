"""Sinks. Calling one of these runs the plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.profile import row_counts

# Spark jobs that the multi-table sinks submit at the same time.
CONCURRENT_WRITES = 4
# Rows of the longest table in one bucket of the order, about.
BUCKET_ROWS = 1_000_000


def write_parquet(
    df: DataFrame,
    path: str,
    *,
    partition_by: Sequence[str] = (),
    max_records_per_file: int = 0,
    single_file: bool = False,
) -> None:
    """Overwrite a Parquet folder.

    Files follow the plan's own partitions. ``single_file`` runs the last stage
    as one task, so it suits small results only and is off by default.
    """
    _writer(df, partition_by, max_records_per_file, single_file).parquet(path)


def write_parquet_tables(
    tables: Mapping[str, DataFrame],
    base_path: str,
    folders: Mapping[str, str],
    **options,
) -> None:
    """Overwrite one folder per table under ``base_path``."""

    def write(name: str) -> None:
        write_parquet(tables[name], f"{base_path.rstrip('/')}/{folders[name]}", **options)

    side_by_side(write, tables)


def side_by_side(action: Callable[[str], None], names: Iterable[str]) -> None:
    """Run independent writes a few at a time.

    The short jobs of small tables then fill the cores that a large table's last
    tasks leave idle. The first failure is raised once the running writes end.
    """
    with ThreadPoolExecutor(CONCURRENT_WRITES) as pool:
        list(pool.map(action, names))


def save_table(
    df: DataFrame,
    table: str,
    *,
    database: str | None = None,
    partition_by: Sequence[str] = (),
    max_records_per_file: int = 0,
    single_file: bool = False,
) -> None:
    """Overwrite a Parquet table of the session's catalogue; the database must exist."""
    name = f"{database}.{table}" if database else table
    writer = _writer(df, partition_by, max_records_per_file, single_file)
    writer.format("parquet").saveAsTable(name)


def save_tables(
    tables: Mapping[str, DataFrame],
    names: Mapping[str, str],
    *,
    database: str | None = None,
    **options,
) -> None:
    """Overwrite one catalogue table per frame."""

    def save(name: str) -> None:
        save_table(tables[name], names[name], database=database, **options)

    side_by_side(save, tables)


def save_by_order(
    tables: Mapping[str, DataFrame], *, database: str, buckets: int, prefix: str = ""
) -> dict[str, DataFrame]:
    """Overwrite catalogue tables, those with an ``order_id`` in buckets of it; return them read.

    Tables in as many buckets join by order without a shuffle, on every later run. One task reads
    a bucket, so there are at least ``buckets`` of them, and one per ``BUCKET_ROWS`` rows of the
    longest of these tables where that is more: its rows are counted first.
    """
    spark = next(iter(tables.values())).sparkSession
    by_order = {name: df for name, df in tables.items() if "order_id" in df.columns}
    if by_order:
        longest = row_counts(by_order).agg(F.max("rows")).first()[0]
        most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        buckets = max(buckets, min(most, -(-longest // BUCKET_ROWS)))

    def save(name: str) -> None:
        df = tables[name]
        writer = df.write.mode("overwrite").format("parquet")
        if name in by_order:
            # one file per bucket instead of one per bucket and task
            writer = df.repartition(buckets, "order_id").write.mode("overwrite") \
                .format("parquet").bucketBy(buckets, "order_id").sortBy("order_id")
        writer.saveAsTable(f"{database}.{prefix}{name}")

    side_by_side(save, tables)
    return {name: spark.table(f"{database}.{prefix}{name}") for name in tables}


def publish(spark: SparkSession, staged: str, target: str, names: Iterable[str]) -> None:
    """Put folders written below ``staged`` in the place of those below ``target``.

    All of them are written by then, so a job that fails on the way leaves the old ones. The old
    ones step aside first and go last; on file systems without renames this copies.
    """
    path_class = spark._jvm.org.apache.hadoop.fs.Path
    files = path_class(target).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(base: str, name: str):
        return path_class(f"{base.rstrip('/')}/{name}")

    def move(source, destination) -> None:
        if not files.rename(source, destination):
            raise OSError(f"could not move {source} to {destination}")

    aside = path(staged, "_replaced")
    files.mkdirs(aside)
    for name in names:
        old = path(target, name)
        if files.exists(old):
            move(old, path(aside.toString(), name))
        move(path(staged, name), old)
    files.delete(path_class(staged), True)


def register_tables(
    spark: SparkSession,
    paths: Mapping[str, str],
    *,
    database: str,
    partitioned: Iterable[str] = (),
) -> None:
    """Lay catalogue tables over Parquet folders: the files are not copied."""
    for table, path in paths.items():
        name = f"{database}.{table}"
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.catalog.createTable(name, path, source="parquet")
        if table in partitioned:
            spark.catalog.recoverPartitions(name)


@contextmanager
def reused(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a frame for several uses and release that same frame afterwards.

    For results that fit the executors' memory and disks, such as the exploration's. Blocks lost
    with an executor are computed again. The batch jobs write large intermediates to
    the shared folder instead, which also keeps column pruning.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def _writer(
    df: DataFrame,
    partition_by: Sequence[str],
    max_records_per_file: int,
    single_file: bool,
) -> DataFrameWriter:
    writer = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    return writer.partitionBy(*partition_by) if partition_by else writer
