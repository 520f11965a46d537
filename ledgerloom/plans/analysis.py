"""From cleaned tables to the thirteen analysed outputs."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import aggregate, enrich, rank, report
from ledgerloom.operators.integrate import grain_check, integrate, lost_orders
from ledgerloom.plans.workspace import hash_joins
from ledgerloom.sinks.writers import publish, register_tables, side_by_side, write_parquet
from ledgerloom.sources import contracts
from ledgerloom.sources.readers import load_parquet_tables

# Working table of the integrated orders; readers skip names with an underscore.
INTEGRATED_FOLDER = "_integrated"
# Working table that tells whether a customer's order has one row only.
CUSTOMER_ORDERS = "_customer_orders"
# Folder of a run's outputs until all are there.
STAGED_FOLDER = "_run"


def base_outputs(integrated: DataFrame) -> dict[str, DataFrame]:
    """The aggregates that later outputs build on."""
    return {
        "seller_products": aggregate.seller_products(integrated),
        "customer_spending":
            enrich.add_customer_segment(aggregate.customer_spending(integrated)),
    }


def outputs(
    integrated: DataFrame,
    base: Mapping[str, DataFrame] | None = None,
    statuses: Sequence[str] = enrich.ORDER_STATUSES,
    *,
    one_row_per_order: bool = False,
) -> dict[str, DataFrame]:
    """All thirteen outputs by name, unsorted and lazy.

    ``integrated`` has one row per order. It is best a stored table: each output
    then reads only the columns it needs. ``base`` hands in stored copies of
    ``base_outputs``. ``one_row_per_order`` states that no order of a customer has two rows, with
    different times: a customer's orders are then counted without a shuffle of every order id.
    """
    base = dict(base or base_outputs(integrated))
    products, spending = base["seller_products"], base["customer_spending"]
    complete = enrich.orders_with_segment(
        enrich.add_status_flags(integrated, statuses), spending)
    return {
        "complete_orders": complete,
        "customer_orders": aggregate.orders_per_customer(
            integrated, one_row_per_order=one_row_per_order),
        "seller_review_score": aggregate.seller_review_scores(integrated),
        "most_sold_products": aggregate.most_sold_products(integrated),
        "customer_purchase": aggregate.customer_purchases(integrated),
        "seller_products": products,
        "ranked_products": rank.top_products_by_orders(products),
        "dense_ranked_products": rank.top_products_by_revenue(products),
        "customer_spending": spending,
        "seller_performance": aggregate.seller_performance(integrated),
        "product_metrics": aggregate.product_metrics(integrated),
        "monthly_stats": aggregate.monthly_stats(integrated),
        "customer_retention": aggregate.customer_retention(
            integrated, one_row_per_order=one_row_per_order),
    }


def quality_outputs(
    orders: DataFrame, integrated: DataFrame, statuses: Sequence[str] = enrich.ORDER_STATUSES
) -> dict[str, DataFrame]:
    """What the integration kept: its grain, the orders it lost, statuses without a flag."""
    return {
        "quality_order_grain": grain_check(integrated),
        "quality_lost_orders": lost_orders(orders, integrated),
        "quality_undeclared_statuses": enrich.undeclared_statuses(integrated, statuses),
    }


def run_analysis(
    spark: SparkSession,
    cleaned_path: str,
    analysed_path: str,
    *,
    database: str | None = None,
    statuses: Sequence[str] | None = None,
    partition_orders_by: Sequence[str] = (),
) -> None:
    """Integrate the cleaned tables and overwrite all outputs, as Parquet and as tables.

    The integrated orders are written once and read back, so the joins run once,
    later steps prune columns, and a lost executor costs a re-read instead of a
    re-join. Outputs that feed others are written first and read back likewise.
    Everything is written to a folder of its own first and takes the place of the last run's
    outputs when all of it is there, so a job that fails leaves those. With ``database`` every
    output is also a catalogue table over the same files. ``partition_orders_by`` lays the complete orders out in
    folders, say by ``purchase_year``, so that readers of one year skip the rest, in the
    files and in the catalogue.

    A customer's orders are counted by rows where no order of a customer has two (which is checked
    first), else by their ids. Joins follow ``hash_joins``.

    Status flags are those of ``statuses``, by default of all statuses that the integrated
    orders have. The grain of the integrated orders, the orders lost, and statuses without a
    flag are written as quality outputs first; a broken grain ends the job there.
    """
    target = analysed_path.rstrip("/")
    staged = f"{target}/{STAGED_FOLDER}-{uuid.uuid4().hex}"

    def folder(name: str) -> str:
        return contracts.OUTPUT_NAMES.get(name, name)

    def path(name: str) -> str:
        return f"{staged}/{folder(name)}"

    def write(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        def write_one(name: str) -> None:
            folders = partition_orders_by if name == "complete_orders" else ()
            df = report.ordered_output(name, frames[name])
            write_parquet(df, path(name), partition_by=folders)

        side_by_side(write_one, frames)
        return {name: spark.read.parquet(path(name)) for name in frames}

    with hash_joins(spark):
        tables = load_parquet_tables(spark, cleaned_path)
        integrated = write({INTEGRATED_FOLDER: integrate(tables)})[INTEGRATED_FOLDER]
        if statuses is None:
            statuses = enrich.observed_statuses(integrated)
        by_customer = grain_check(integrated, ("customer_unique_id", "order_id"))
        quality = write({CUSTOMER_ORDERS: by_customer,
                         **quality_outputs(tables["orders"], integrated, statuses)})
        one_row = quality.pop(CUSTOMER_ORDERS).first()["unique"]
        if not quality["quality_order_grain"].first()["unique"]:
            raise ValueError(f"integrated orders are not unique: see {path('quality_order_grain')}")
        written = write(base_outputs(integrated))
        rest = outputs(integrated, written, statuses, one_row_per_order=one_row)
        written.update(write({name: df for name, df in rest.items() if name not in written}))
    publish(spark, staged, target,
            [folder(name) for name in (INTEGRATED_FOLDER, *quality, *written)])
    if database is not None:
        paths = {folder(name): f"{target}/{folder(name)}" for name in written}
        partitioned = [folder("complete_orders")] if partition_orders_by else []
        register_tables(spark, paths, database=database, partitioned=partitioned)
