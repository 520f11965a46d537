"""Report layer: total order, top-k and number formatting. Always the last step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sort keys of each result; "-" marks descending. Descending keys put nulls last,
# ascending keys nulls first. The key columns at the end make the order total:
# results are stable at a cut, and the range shuffle of a sort can split equal
# leading values over several tasks.
OUTPUT_ORDER = {
    "customer_orders": ("-total_order", "customer_unique_id"),
    "seller_review_score": ("-avg_review_score", "seller_id"),
    "most_sold_products": ("-total_order", "product_id"),
    "customer_purchase": ("-total_amount_spent", "customer_id"),
    "customer_spending": ("-revenue", "customer_unique_id"),
    "seller_performance": ("-total_revenue", "seller_id"),
    "product_metrics": ("-total_sales", "product_id"),
    "monthly_stats": ("purchase_year", "purchase_month", "-seller_revenue"),
    "customer_retention": (
        "first_order_date", "last_order_date", "-total_amount_spent", "-retention_rate",
        "customer_unique_id",
    ),
}

# Decimal places of the formatted columns in each printed report.
# Fixed values.
REPORT_FORMATS = {
    "customer_orders": {"total_order": 0},
    "seller_review_score": {"avg_review_score": 0},
    "most_sold_products": {"total_order": 0},
    "customer_purchase": {"total_amount_spent": 2},
    "seller_products": {"total_revenue": 2},
    "dense_ranked_products": {"total_revenue": 2},
    "customer_spending": {"revenue": 2},
    "seller_performance": {"total_orders": 2, "total_revenue": 2},
    "monthly_stats": {
        "seller_revenue": 2, "customer_spend": 2, "total_freight": 2, "total_orders": 0,
        "aov_seller": 2, "aov_customer": 2, "min_order_value": 2, "max_order_value": 2,
    },
    "customer_retention": {
        "total_orders": 0, "total_amount_spent": 2, "aov": 2, "retention_rate": 2,
    },
    "products_by_revenue": {"total_amount_spent": 2},
}

# Fixed values.
MONTHLY_REPORT = (
    "purchase_month_name", "purchase_year", "seller_revenue", "customer_spend", "total_freight",
    "total_orders", "aov_seller", "aov_customer", "min_order_value", "max_order_value",
)


def sort_keys(keys: Sequence[str]) -> list[Column]:
    """Sort columns from names; a leading "-" means descending."""
    return [
        F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_first()
        for k in keys
    ]


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Total order over the whole result, kept when it is written."""
    return df.orderBy(*sort_keys(keys))


def ordered_output(name: str, df: DataFrame) -> DataFrame:
    """A named output in its declared order; outputs without one stay unsorted."""
    return ordered(df, *OUTPUT_ORDER[name]) if name in OUTPUT_ORDER else df


def top_k(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first ``k`` rows in order: each task keeps ``k`` rows, no full sort."""
    return ordered(df, *keys).limit(k)


def formatted(df: DataFrame, places: Mapping[str, int]) -> DataFrame:
    """Numbers as text with thousands separators; do not sort on the result."""
    return df.withColumns({c: F.format_number(c, d) for c, d in places.items()})


def top_products_by_revenue_report(revenue: DataFrame) -> DataFrame:
    """Products by revenue, highest first, with the amount as text."""
    ranked = ordered(revenue, "-total_amount_spent", "product_id")
    return formatted(ranked, REPORT_FORMATS["products_by_revenue"]).withColumnRenamed(
        "total_amount_spent", "total_amount_spent ($)"
    )


def monthly_report(stats: DataFrame) -> DataFrame:
    """Monthly figures in calendar order, as text."""
    sorted_stats = ordered(stats, *OUTPUT_ORDER["monthly_stats"])
    return formatted(sorted_stats, REPORT_FORMATS["monthly_stats"]).select(*MONTHLY_REPORT)


def retention_report(retention: DataFrame) -> DataFrame:
    """Customers by retention rate, highest first, as text.

    Sorted by the number and formatted afterwards: as text, 9.50 would come
    before 10.00.
    """
    ranked = ordered(retention, "-retention_rate", "-total_amount_spent", "customer_unique_id")
    return formatted(ranked, REPORT_FORMATS["customer_retention"])


def report(name: str, df: DataFrame, k: int | None = None) -> DataFrame:
    """A named output as printed: in order, cut to ``k`` rows if given, numbers as text."""
    result = ordered_output(name, df)
    if k is not None:
        result = result.limit(k)
    return formatted(result, REPORT_FORMATS.get(name, {}))
