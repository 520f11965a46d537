"""Top products per seller, ranked without gathering a seller in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.lookup import hot_among, lookup_join

TOP = 5


def top_products_by_orders(products: DataFrame, k: int = TOP) -> DataFrame:
    """Rows of ``seller_products`` whose ``rank`` by orders within the seller is at most ``k``.

    Ties share a rank and leave a gap after it, so a seller may keep more than ``k`` rows.
    """
    above = F.col("running") - F.col("n")
    return _ranked(products, "total_orders", (above + 1).cast("int"), "rank", k)


def top_products_by_revenue(products: DataFrame, k: int = TOP) -> DataFrame:
    """Rows of ``seller_products`` in the seller's ``k`` highest revenue levels (``dense_rank``)."""
    return _ranked(products, "total_revenue", F.col("level"), "dense_rank", k)


def _ranked(rows: DataFrame, measure: str, rank: Column, name: str, k: int) -> DataFrame:
    """Attach a rank by ``measure`` (descending, nulls last) within the seller; keep ranks up to k.

    A rank depends only on how many rows lie on each higher level of the measure.
    So rows are first counted per (seller, level), a spread aggregation. Only the
    top ``k`` levels of each seller can qualify, and the early limit under the
    window keeps that many per seller in every task before the shuffle. The
    ranked levels, unique per seller, are then looked up by the rows. A seller
    with millions of tied products therefore never meets in one task, as it would
    if the rows themselves were ranked by a window.
    """
    key = F.struct(F.col("seller_id"), F.col(measure).alias("measure")).alias("_key")
    levels = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    by_level = Window.partitionBy("_key.seller_id").orderBy(F.col("_key.measure").desc_nulls_last())
    so_far = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = (
        levels.withColumns({
            "level": F.row_number().over(by_level),
            "running": F.sum("n").over(so_far),
        })
        .where(F.col("level") <= k)
        .select("_key", rank.alias(name))
        .where(F.col(name) <= k)
    )
    # A struct key is never null itself, so rows without a seller or a price are ranked too.
    keyed = rows.withColumn("_key", key)
    ranked = lookup_join(keyed, top, ["_key"], hot=lambda: hot_among(levels, ["_key"]))
    return ranked.drop("_key")
