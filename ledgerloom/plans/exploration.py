"""First look at the raw tables: completeness, nulls, duplicates, distributions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import explore, profile, report


def profile_tables(
    tables: Mapping[str, DataFrame], expected: Mapping[str, int] | None = None
) -> dict[str, DataFrame]:
    """Data-quality frames over all tables: row counts, null profile, duplicates."""
    nulls = [
        profile.null_profile(df).select(F.lit(name).alias("table"), "*")
        for name, df in tables.items()
    ]
    return {
        "row_counts": profile.row_counts(tables, expected),
        "null_profile": reduce(DataFrame.unionByName, nulls),
        "duplicates": profile.duplicate_summary(tables),
    }


# What the text columns of the reviews should hold.
REVIEW_TYPES = {
    "review_score": "int",
    "review_creation_date": "timestamp",
    "review_answer_timestamp": "timestamp",
}


def audits(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """What cleaning will have to repair: missing dates by status, payment vocabulary, bad types."""
    return {
        "order_nulls_by_status": report.ordered(
            profile.nulls_by_status(tables["orders"]), "order_status"),
        "payment_vocabulary": report.ordered(
            profile.distinct_values(tables["payments"], "payment_type"), "payment_type"),
        "review_type_conformance": report.ordered(
            profile.type_conformance(tables["reviews"], REVIEW_TYPES), "column"),
    }


def distributions(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Distribution frames, each in its total order, largest first."""
    customers, orders, items = tables["customers"], tables["orders"], tables["order_items"]
    durations = explore.delivery_durations(orders)
    return {
        "customers_by_city": report.ordered(
            explore.customers_by(customers, "customer_city"), "-count", "customer_city"),
        "customers_by_state": report.ordered(
            explore.customers_by(customers, "customer_state"), "-count", "customer_state"),
        "customers_by_city_state": report.ordered(
            explore.customers_by(customers, "customer_city", "customer_state"),
            "-count", "customer_city", "customer_state"),
        "orders_by_status": report.ordered(
            explore.orders_by_status(orders), "-count", "order_status"),
        "delivery_durations": report.ordered(durations, "-delivery_duration", "order_id"),
        "delivery_status_counts": explore.orders_by_status(durations),
        "payment_types": report.ordered(
            explore.payment_types(tables["payments"]), "-count", "payment_type"),
        "products_by_orders": report.ordered(
            explore.products_by_orders(items), "-total_order", "product_id"),
        "products_by_revenue": report.top_products_by_revenue_report(
            explore.products_by_revenue(items)),
    }
