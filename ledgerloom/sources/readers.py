"""Lazy readers for raw CSV and cleaned Parquet tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources import contracts


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    *,
    multi_line: bool = False,
) -> DataFrame:
    """One CSV table with a header row.

    With ``schema`` (DDL) the header is checked against it by name, so a file
    whose columns moved fails instead of being read into the wrong columns.
    Without it types are inferred, which reads the whole file once more and does
    so at once, while the plan is being built.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.option("enforceSchema", False).schema(schema).csv(path)


def load_csv_tables(
    spark: SparkSession,
    base_path: str,
    *,
    prefix: str = "",
    schemas: Mapping[str, str | None] = contracts.RAW_SCHEMAS,
    files: Mapping[str, str] = contracts.RAW_FILES,
    multi_line: frozenset[str] = contracts.MULTI_LINE_TABLES,
) -> dict[str, DataFrame]:
    """All raw tables under ``base_path``, keyed by short name.

    ``schemas`` may leave a table out, or map it to ``None``, to have its types
    inferred. ``prefix`` is the data set's own file prefix. ``multi_line`` names the
    tables whose records may hold line breaks; their files are read whole, so leave out
    what has none. Malformed values become null here: ``typed.load_csv_checked`` keeps them.
    """
    return {
        name: read_csv(spark, csv_path(base_path, name, prefix, files), schemas.get(name),
                       multi_line=name in multi_line)
        for name in files
    }


def load_parquet_tables(
    spark: SparkSession,
    base_path: str,
    folders: Mapping[str, str] = contracts.CLEANED_FOLDERS,
) -> dict[str, DataFrame]:
    """All cleaned tables under ``base_path``, keyed by the same short names."""
    return {name: spark.read.parquet(_child(base_path, folder)) for name, folder in folders.items()}


def csv_path(
    base_path: str, name: str, prefix: str = "", files: Mapping[str, str] = contracts.RAW_FILES
) -> str:
    """Where a raw table lies; the data set's own prefix stands before most file names."""
    lead = "" if name in contracts.UNPREFIXED_FILES else prefix
    return _child(base_path, lead + files[name])


def _child(base_path: str, name: str) -> str:
    return f"{base_path.rstrip('/')}/{name}"
