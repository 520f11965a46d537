"""Joins of the order model, up to one integrated row per order."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.lookup import (
    hot_among, hot_keys, key_counts, lookup_join, one_row_per_key,
)
from ledgerloom.sources.contracts import ORDER_GRAIN

# Natural order of the rows that compete for one order or one zip prefix. All
# other columns break ties.
ITEM_ORDER = ("order_item_id",)
PAYMENT_ORDER = ("payment_sequential",)
REVIEW_ORDER = ("review_creation_date", "review_answer_timestamp")


def orders_with_items(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """One row per item of an order; orders without items drop out."""
    return lookup_join(order_items, orders, ["order_id"])


def with_products(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Add product attributes; rows of unknown products drop out."""
    return lookup_join(rows, products, ["product_id"])


def with_sellers(rows: DataFrame, sellers: DataFrame) -> DataFrame:
    """Add seller attributes; rows of unknown sellers drop out."""
    return lookup_join(rows, sellers, ["seller_id"])


def with_customers(rows: DataFrame, customers: DataFrame) -> DataFrame:
    """Add customer attributes; rows of unknown customers drop out."""
    return lookup_join(rows, customers, ["customer_id"])


def with_geolocation(
    rows: DataFrame, geolocation: DataFrame, hot: Callable[[], DataFrame] | None = None
) -> DataFrame:
    """Add the first geolocation row of the customer's zip prefix, if there is one.

    A zip prefix has many points. Reducing them before the join gives what a join
    followed by one row per order would keep, without multiplying the rows first.
    ``hot`` as for ``lookup_join``.
    """
    zip_code = "customer_zip_code_prefix"
    points = one_row_per_key(geolocation, ["geolocation_zip_code_prefix"])
    keyed = points.withColumn(zip_code, F.col("geolocation_zip_code_prefix"))
    return lookup_join(rows, keyed, [zip_code], "left", hot=hot)


def with_categories(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Add the category translation, if there is one; a null category matches none."""
    names = one_row_per_key(categories, ["product_category_name"])
    return lookup_join(rows, names, ["product_category_name"], "left")


def with_reviews(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Add the first review of each order, if there is one."""
    return _with_first(orders, reviews, REVIEW_ORDER)


def with_payments(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Add the first payment of each order, if there is one."""
    return _with_first(orders, payments, PAYMENT_ORDER)


def integrate(
    tables: Mapping[str, DataFrame],
    columns: Sequence[str] | None = None,
    *,
    stored_by_order: bool = False,
) -> DataFrame:
    """One row per order: its first surviving item, customer, geolocation, review and payment.

    An order survives if it has a customer and at least one item whose product and
    seller are known. Orders and customers may repeat their keys: after they join,
    one row per ``ORDER_GRAIN`` stays, the least by all their columns, so the choice
    does not depend on the columns that a caller needs. Every other side is reduced
    to one row per order before it joins, so nothing multiplies, and the result is
    one that joining everything and keeping one row per order could give.

    ``columns`` names the output columns a caller needs. Sides that supply none of
    them are left out, or only asked whether the key exists; the rows, and the item
    chosen for each order, stay the same.

    Products and sellers are asked whether an item's key exists before the choice of
    one item per order, and add their attributes after it, so that choice shuffles
    item columns only. Items, orders, reviews and payments are shuffled once each by
    order, which the choices and joins between them share. ``stored_by_order`` states that these
    four lie in buckets of the order already (``writers.save_by_order``): then, while the other
    tables are small enough for Spark to broadcast, none of them is shuffled.

    Hot keys of salted joins are counted in the base tables, so no join runs once more for them.
    """
    wanted = None if columns is None else set(columns)

    def needs(side: DataFrame, *keys: str) -> bool:
        return wanted is None or not wanted.isdisjoint(set(side.columns) - set(keys))

    orders, items = tables["orders"], tables["order_items"]
    products, sellers = tables["products"], tables["sellers"]
    customers, geolocation = tables["customers"], tables["geolocation"]
    categories, reviews, payments = tables["categories"], tables["reviews"], tables["payments"]

    item_columns = [c for c in items.columns if c != "order_id"]
    first = [c for c in ITEM_ORDER if c in item_columns]
    item_order = [*first, *[c for c in item_columns if c not in first]]

    if needs(categories, "product_category_name"):
        products = with_categories(products, categories)
    rows, attributes = items, []
    for side, key in ((products, "product_id"), (sellers, "seller_id")):
        hot = partial(hot_keys, items, [key])
        rows = lookup_join(rows, side.select(key), [key], "left_semi", hot=hot)
        if needs(side, key):
            attributes.append((one_row_per_key(side, [key]), key, hot))
    rows = one_row_per_key(rows, ["order_id"], item_order)
    own_items = rows.columns
    for side, key, _ in attributes:
        own_items = [key, *[c for c in own_items if c != key], *side.drop(key).columns]
    # narrow sides first: what a side adds is shuffled by each later join
    for side, key, hot in sorted(attributes, key=lambda a: len(a[0].columns)):
        rows = lookup_join(rows, side, [key], hot=hot)
    rows = rows.select(*own_items)

    placed = lookup_join(orders, customers, ["customer_id"])
    if not stored_by_order:
        placed = placed.repartition("order_id")
    # by order first: what is sorted for the choice is sorted for the joins by order
    placed = one_row_per_key(placed, sorted(ORDER_GRAIN, key=lambda c: c != "order_id"))
    if needs(geolocation):
        placed = with_geolocation(placed, geolocation, partial(hot_zips, orders, customers))

    own = [c for c in placed.columns if c != "order_id"]
    if needs(reviews, "order_id"):
        placed = with_reviews(placed, reviews)
    if needs(payments, "order_id"):
        placed = with_payments(placed, payments)
    # narrow sides first: rows are copied at full width by the last join only
    result = placed.join(rows, "order_id")
    if columns is None:
        added = [c for c in placed.columns if c not in ("order_id", *own)]
        columns = ["order_id", *own, *[c for c in rows.columns if c != "order_id"], *added]
    return result.select(*columns)


def grain_check(df: DataFrame, keys: Sequence[str] = ORDER_GRAIN) -> DataFrame:
    """One row: ``rows``, ``distinct_keys`` and whether the keys are ``unique``."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.max("n") <= 1, F.lit(True)).alias("unique"),
    )


def lost_orders(orders: DataFrame, integrated: DataFrame) -> DataFrame:
    """One row: orders read, orders integrated, and orders lost on the way."""
    read = orders.agg(F.count(F.lit(1))).scalar()
    kept = F.count(F.lit(1))
    return integrated.agg(kept.alias("integrated_orders")).select(
        read.alias("orders"),
        "integrated_orders",
        (read - F.col("integrated_orders")).alias("lost_orders"),
    )


def hot_zips(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Hot zip prefixes of the orders, from the orders of each customer."""
    zip_code = "customer_zip_code_prefix"
    per_customer = key_counts(orders, ["customer_id"])
    placed = per_customer.join(customers.select("customer_id", zip_code), "customer_id")
    counts = placed.dropna(subset=[zip_code]).groupBy(zip_code).agg(F.sum("n").alias("n"))
    return hot_among(counts, [zip_code])


def _with_first(orders: DataFrame, side: DataFrame, natural_order: Sequence[str]) -> DataFrame:
    order_by = [c for c in natural_order if c in side.columns]
    return orders.join(one_row_per_key(side, ["order_id"], order_by), "order_id", "left")
