"""Profiling: completeness, nulls, duplicates, vocabularies, type conformance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def row_counts(
    tables: Mapping[str, DataFrame], expected: Mapping[str, int] | None = None
) -> DataFrame:
    """Rows per table as ``(table, rows)``; one column-free scan each.

    With ``expected`` the result is ``(table, expected, actual, diff)`` over the
    tables of both mappings: a table that is not declared, or not there, has a
    null on its side.
    """
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    counted = reduce(DataFrame.unionByName, parts)
    if expected is None:
        return counted
    declared = counted.sparkSession.createDataFrame(
        list(expected.items()), "table string, expected long"
    )
    return counted.withColumnRenamed("rows", "actual").join(declared, "table", "full").select(
        "table", "expected", "actual", (F.col("actual") - F.col("expected")).alias("diff")
    )


def null_counts(df: DataFrame) -> DataFrame:
    """One row with the number of nulls of every column. NaN is not null."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def null_profile(df: DataFrame) -> DataFrame:
    """The null counts in long form: ``(column, nulls, null_fraction)``.

    The turn to long form happens on the single aggregated row, so the table
    itself is read once and never multiplied.
    """
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    long = wide.unpivot(["_rows"], list(df.columns), "column", "nulls")
    return long.select(
        "column", "nulls", F.try_divide(F.col("nulls"), F.col("_rows")).alias("null_fraction")
    )


_FINGERPRINT = ("_fingerprint1", "_fingerprint2")


def _fingerprinted(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with 128-bit fingerprints, and the fingerprints that occur more than once.

    Counting fingerprints shuffles two longs and a count per row (copies are combined before),
    however wide the rows are.
    """
    rows = df.select("*", *[F.xxhash64(F.lit(seed), *df.columns).alias(name)
                            for seed, name in enumerate(_FINGERPRINT)])
    counts = rows.groupBy(*_FINGERPRINT).agg(F.count(F.lit(1)).alias("n"))
    return rows, counts.where("n > 1").select(*_FINGERPRINT)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Every row that occurs more than once, with its number of copies as ``count``.

    Only rows whose fingerprint repeats are compared in full, so a wide table is not shuffled to
    find few copies. Copies are counted on the map side first, so a row copied very often does
    not load one task.
    """
    rows, repeated = _fingerprinted(df)
    found = rows.join(repeated, list(_FINGERPRINT), "left_semi").drop(*_FINGERPRINT)
    return found.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def distinct_rows(df: DataFrame) -> DataFrame:
    """Rows distinct over all columns; for wide tables with few copies.

    Rows whose fingerprint is alone pass without a shuffle; the others are compared in full.
    """
    rows, repeated = _fingerprinted(df)
    alone = rows.join(repeated, list(_FINGERPRINT), "left_anti").drop(*_FINGERPRINT)
    copies = rows.join(repeated, list(_FINGERPRINT), "left_semi").drop(*_FINGERPRINT)
    return alone.unionByName(copies.dropDuplicates())


def duplicate_groups(df: DataFrame) -> DataFrame:
    """One row: groups of identical rows, and the surplus rows in them."""
    return duplicate_rows(df).agg(
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("surplus_rows"),
    )


def duplicate_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table, duplicate_groups, surplus_rows)`` over several tables."""
    parts = [
        duplicate_groups(df).select(F.lit(name).alias("table"), "duplicate_groups", "surplus_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


# Fixed values.
ORDER_AUDIT_COLUMNS = (
    "order_id", "order_status", "order_purchase_timestamp", "order_approved_at",
    "order_delivered_carrier_date", "order_delivered_customer_date",
)
# Fixed values.
AUDITED_STATUSES = ("delivered", "invoiced", "canceled")


def nulls_by_status(
    orders: DataFrame,
    statuses: Sequence[str] = AUDITED_STATUSES,
    columns: Sequence[str] = ORDER_AUDIT_COLUMNS,
) -> DataFrame:
    """Null counts of the order dates for each status, in one pass over the orders."""
    audited = [c for c in columns if c != "order_status"]
    return (
        orders.where(F.col("order_status").isin(*statuses))
        .groupBy("order_status")
        .agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in audited])
    )


def orders_of_status(
    orders: DataFrame, status: str, columns: Sequence[str] = ORDER_AUDIT_COLUMNS
) -> DataFrame:
    """Audit columns of the orders in one status."""
    return orders.select(*columns).where(F.col("order_status") == status)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Vocabulary of a column, null included."""
    return df.select(column).distinct()


def type_conformance(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """``(column, target_type, bad_rows)``: non-null values that would not cast."""

    def bad(column: str, target: str) -> Column:
        return F.count_if(F.col(column).isNotNull() & F.col(column).try_cast(target).isNull())

    wide = df.agg(*[bad(c, t).alias(c) for c, t in targets.items()])
    long = wide.unpivot([], list(targets), "column", "bad_rows")
    return long.select("column", _lookup(targets, "column").alias("target_type"), "bad_rows")


def _lookup(mapping: Mapping[str, str], column: str) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[F.col(column)]


class ObservedProfile:
    """Row and null counts of frames, taken while they are written: no scan of their own.

    ``watch`` a frame, write what it returns, and read the ``counts`` afterwards. Watch the very
    frame that is written: a metric above the last shuffle is taken by the tasks that write,
    which count once each, also if executors are lost and stages run again.
    """

    def __init__(self) -> None:
        self._watched: dict[str, tuple[Observation, list[str]]] = {}

    def watch(self, name: str, df: DataFrame) -> DataFrame:
        observation = Observation()
        self._watched[name] = observation, df.columns
        nulls = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
        return df.observe(observation, F.count(F.lit(1)).alias("rows"), *nulls)

    def counts(self, spark: SparkSession) -> DataFrame:
        """``(table, column, rows, nulls, null_fraction)``; call it after the writes."""
        found = []
        for name, (observation, columns) in self._watched.items():
            seen = observation.get
            total = seen["rows"]
            found += [(name, c, total, seen[f"n{i}"], seen[f"n{i}"] / total if total else None)
                      for i, c in enumerate(columns)]
        return spark.createDataFrame(
            found, "table string, column string, rows long, nulls long, null_fraction double")
