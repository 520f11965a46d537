"""Status flags and customer segments on the integrated table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.lookup import lookup_join

# A customer whose average order value exceeds the threshold.
PREMIUM_AOV = 1500
MEDIUM_AOV = 700
PREMIUM, MEDIUM, STANDARD = "Premium", "Medium", "Standard"

# Statuses an order can have; each becomes one flag column.
ORDER_STATUSES = (
    "approved", "canceled", "created", "delivered", "invoiced", "processing",
    "shipped", "unavailable",
)


def add_status_flags(orders: DataFrame, statuses: Sequence[str] = ORDER_STATUSES) -> DataFrame:
    """Add a boolean ``is_<status>`` per declared status; without a status all are false.

    A declared list keeps the schema the same on every run.
    """
    status = F.col("order_status")
    return orders.withColumns({
        f"is_{s}": F.coalesce(status == F.lit(s), F.lit(False)) for s in statuses
    })


def observed_statuses(orders: DataFrame) -> list[str]:
    """Statuses that occur, sorted, for ``add_status_flags``; one column each. Runs a job.

    Take it from the table that is flagged: statuses of orders that did not survive give no
    column there.
    """
    rows = orders.where("order_status is not null").select("order_status").distinct().collect()
    return sorted(row[0] for row in rows)


def add_status_map(orders: DataFrame) -> DataFrame:
    """Add ``status_flags``, a map with a boolean for each status that occurs among the orders.

    The statuses are a scalar subquery of the same plan: no job runs while it is built, and the
    schema stays the same whatever statuses there are.
    """
    observed = orders.agg(F.array_sort(F.collect_set("order_status"))).scalar()
    flags = F.transform("_statuses", lambda s: F.coalesce(s == F.col("order_status"), F.lit(False)))
    return (orders.withColumn("_statuses", observed)
            .withColumn("status_flags", F.map_from_arrays("_statuses", flags)).drop("_statuses"))


def undeclared_statuses(orders: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Rows per status that has no flag among the declared ``statuses``."""
    flagged = F.col("order_status").isin(*statuses)
    return (orders.where(F.col("order_status").isNotNull() & ~flagged)
            .groupBy("order_status").agg(F.count(F.lit(1)).alias("rows")))


def add_customer_segment(
    spending: DataFrame, premium: float = PREMIUM_AOV, medium: float = MEDIUM_AOV
) -> DataFrame:
    """Add ``customer_type`` by average order value; a customer without one is Standard."""
    segment = F.when(F.col("AOV") > premium, PREMIUM).when(F.col("AOV") > medium, MEDIUM)
    return spending.withColumn("customer_type", segment.otherwise(STANDARD))


def orders_with_segment(orders: DataFrame, segments: DataFrame) -> DataFrame:
    """Add each order's ``customer_type``; an order without a customer id keeps null."""
    types = segments.select("customer_unique_id", "customer_type")
    return lookup_join(orders, types, ["customer_unique_id"], "left")
