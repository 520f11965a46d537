"""Cleaning: imputation, type repair, vocabulary, duplicates, outliers, bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import banded, known, midpoint, translate_values
from ledgerloom.operators.profile import distinct_rows
from ledgerloom.operators.quantiles import quantiles

# The status whose missing dates are filled in.
IMPUTED_STATUS = "delivered"

# Product measures filled with their mode. Category, name length,
# description length and photo count stay null: only the source could supply them.
MODE_IMPUTED = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")

# Payment vocabulary.
PAYMENT_TYPES = {
    "credit_card": "credit card",
    "boleto": "bank transfer",
    "debit_card": "debit card",
    "not_defined": "other",
}

# Price cut-offs and weight bands.
PRICE_CUTOFFS = (0.01, 0.99)
WEIGHT_PROBABILITIES = (0.20, 0.40, 0.60, 0.80)
WEIGHT_LABELS = ("Very Light", "Light", "Medium", "Heavy", "Very Heavy")


def impute_order_dates(orders: DataFrame, status: str = IMPUTED_STATUS) -> DataFrame:
    """Fill missing dates of orders in ``status``; other orders stay as they are.

    Approval falls back to the purchase time and customer delivery to the estimate.
    The carrier date then becomes the midpoint of those two, so it sees the values
    already filled in.
    """
    types = dict(orders.dtypes)
    eligible = F.col("order_status") == status

    def filled(name: str, fallback):
        column = F.col(name)
        value = F.when(eligible & column.isNull(), fallback).otherwise(column)
        return value.cast(types[name])

    first = orders.withColumns({
        "order_approved_at":
            filled("order_approved_at", F.col("order_purchase_timestamp")),
        "order_delivered_customer_date":
            filled("order_delivered_customer_date", F.col("order_estimated_delivery_date")),
    })
    halfway = midpoint(F.col("order_approved_at"), F.col("order_delivered_customer_date"))
    carrier = "order_delivered_carrier_date"
    return first.withColumn(carrier, filled(carrier, halfway.cast(types[carrier])))


def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the mode of each column; among equal counts the smallest value.

    Null and NaN do not vote. Values are counted with a spread aggregation over
    (column, value), so no task has to hold all distinct values of a column.
    """
    votes = (
        df.select(*[known(F.col(c).cast("double")).alias(c) for c in columns])
        .unpivot([], list(columns), "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.struct((-F.col("n")).alias("order"), F.col("value"))
    return votes.agg(
        *[F.min(F.when(F.col("column") == c, best))["value"].alias(c) for c in columns]
    )


def impute_mode(df: DataFrame, columns: Sequence[str] = MODE_IMPUTED) -> DataFrame:
    """Replace null and NaN in ``columns`` by the column's mode.

    The imputed columns move to the end. The mode reaches the rows as a scalar
    subquery inside the same plan.
    """
    modes = column_modes(df, columns).select(F.struct(*columns)).scalar()
    types = dict(df.dtypes)
    # One subquery in a column of its own: named per use, it would be planned per use.
    return df.withColumn("_modes", modes).select(
        *[c for c in df.columns if c not in columns],
        *[
            F.coalesce(known(F.col(c).cast("double")), F.col("_modes")[c]).cast(types[c]).alias(c)
            for c in columns
        ],
    )


def cast_columns(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """Cast the named columns; a value that does not parse becomes null.

    A zip prefix that an earlier step read as a number has lost its leading zeros
    for good; read it as text in the first place to keep them.
    """
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in targets.items()})


def standardise_payment_types(
    payments: DataFrame, mapping: Mapping[str, str] = PAYMENT_TYPES
) -> DataFrame:
    """Translate known payment types; unknown ones and nulls pass through."""
    return payments.withColumn("payment_type", translate_values(F.col("payment_type"), mapping))


def deduplicate(df: DataFrame, *, wide: bool = False) -> DataFrame:
    """Rows distinct over all columns.

    ``wide`` looks at the input twice and shuffles fingerprints and repeated rows only: better for
    stored tables with long texts.
    """
    return distinct_rows(df) if wide else df.dropDuplicates()


def drop_price_outliers(
    order_items: DataFrame,
    column: str = "price",
    cutoffs: tuple[float, float] = PRICE_CUTOFFS,
    accuracy: int | None = None,
) -> DataFrame:
    """Keep rows whose price lies between two quantiles, both ends included.

    Rows without a price go too. If no row has a price there is no cut-off, and
    nothing is kept.
    """
    bounds = quantiles(order_items, column, cutoffs, accuracy).scalar()
    return order_items.where(F.col(column).between(bounds[0], bounds[1]))


def add_weight_band(
    products: DataFrame,
    column: str = "product_weight_g",
    probabilities: Sequence[float] = WEIGHT_PROBABILITIES,
    labels: Sequence[str] = WEIGHT_LABELS,
    accuracy: int | None = None,
) -> DataFrame:
    """Add ``product_weight_category`` from quantile bands; a null weight gets the last band."""
    bounds = quantiles(products, column, probabilities, accuracy).scalar()
    limits = [F.col("_bounds")[i] for i in range(len(probabilities))]
    return (
        products.withColumn("_bounds", bounds)
        .withColumn("product_weight_category", banded(F.col(column), limits, labels))
        .drop("_bounds")
    )
