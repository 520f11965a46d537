"""Exploration aggregates over the raw tables.

Results are unsorted; ``ledgerloom.operators.report`` sorts and cuts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import money_sum


def customers_by(customers: DataFrame, *places: str) -> DataFrame:
    """Customers per city, per state or per both: ``(*places, count)``."""
    return customers.groupBy(*places).agg(F.count("customer_id").alias("count"))


def orders_by_status(orders: DataFrame) -> DataFrame:
    """Orders per status."""
    return orders.groupBy("order_status").agg(F.count("order_id").alias("count"))


def delivery_durations(orders: DataFrame) -> DataFrame:
    """Whole calendar days from purchase to delivery, as found in the raw orders."""
    return orders.select(
        "order_id", "order_status", "order_purchase_timestamp", "order_delivered_customer_date",
        F.datediff("order_delivered_customer_date", "order_purchase_timestamp")
        .alias("delivery_duration"),
    )


def payment_types(payments: DataFrame) -> DataFrame:
    """Payment rows per type, null included."""
    return payments.groupBy("payment_type").agg(F.count(F.lit(1)).alias("count"))


def products_by_orders(order_items: DataFrame) -> DataFrame:
    """Ordered items per product."""
    return order_items.groupBy("product_id").agg(F.count("order_id").alias("total_order"))


def products_by_revenue(order_items: DataFrame) -> DataFrame:
    """Summed price per product."""
    return order_items.groupBy("product_id").agg(money_sum("price").alias("total_amount_spent"))
