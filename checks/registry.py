"""One query per operator, each over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from ledgerloom.operators import (
    aggregate, clean, enrich, explore, features, integrate as joins, profile, quantiles, rank,
    report,
)
from ledgerloom.functions.columns import money_sum
from ledgerloom.operators.lookup import SALTED_JOINS, first_by_sequence, one_row_per_key
from ledgerloom.plans import analysis, cleaning, exploration
from ledgerloom.plans.workspace import fresh_folder
from ledgerloom.sinks import writers
from ledgerloom.sources import contracts, readers, typed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STATUSES = ("delivered", "invoiced", "canceled")
REVIEW_TYPES = {
    "review_score": "int",
    "review_creation_date": "timestamp",
    "review_answer_timestamp": "timestamp",
}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def prepared(spark: SparkSession, sf_dir: str, **replaced: str) -> dict[str, DataFrame]:
    """The nine tables with calendar columns and a numeric review score."""
    tables = fx.tables(spark, sf_dir, **replaced)
    tables["orders"] = features.add_calendar(tables["orders"])
    tables["reviews"] = clean.cast_columns(tables["reviews"], {"review_score": "int"})
    return tables


def integrated(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None, **replaced: str
) -> DataFrame:
    return joins.integrate(prepared(spark, sf_dir, **replaced), columns)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seller products of the variant with few products and many ties."""
    columns = ["order_id", "seller_id", "product_id", "price"]
    return aggregate.seller_products(
        integrated(spark, sf_dir, columns, order_items="f_order_items_dense"))


# --- sources and sinks -------------------------------------------------------


@query
def src_csv(spark, sf):
    path = fresh_folder(spark, "csv")
    fx.frame(spark, sf, "f_customers").write.csv(path, header=True)
    return readers.read_csv(spark, path)


@query
def src_csv_schema(spark, sf):
    path = fresh_folder(spark, "csv")
    fx.frame(spark, sf, "f_products").write.csv(path, header=True)
    return readers.read_csv(spark, path, contracts.RAW_SCHEMAS["products"])


@query
def src_csv_catalogue(spark, sf):
    base = fresh_folder(spark, "csv")
    tables = fx.tables(spark, sf)
    for name, df in tables.items():
        lead = "" if name in contracts.UNPREFIXED_FILES else "shop_"
        df.write.csv(f"{base}/{lead}{contracts.RAW_FILES[name]}", header=True)
    schemas = {name: df.schema.simpleString()[7:-1].replace(":", " ") for name, df in tables.items()}
    return profile.row_counts(readers.load_csv_tables(spark, base, prefix="shop_", schemas=schemas))


#: Types of the columns of the text fixtures, which are written to CSV and read checked.
CHECKED_SCHEMAS = {
    "order_items": "order_id BIGINT, order_item_id INT, product_id BIGINT, seller_id BIGINT, "
                   "price DOUBLE, freight_value DOUBLE",
    "orders": "order_id BIGINT, customer_id BIGINT, order_status STRING, "
              "order_purchase_timestamp TIMESTAMP_NTZ, order_approved_at TIMESTAMP_NTZ",
    "reviews": "order_id BIGINT, review_score INT, review_creation_date TIMESTAMP_NTZ, "
               "review_answer_timestamp TIMESTAMP_NTZ",
}


def checked_tables(spark, sf) -> dict[str, typed.CheckedTable]:
    """All nine tables as raw CSV files, three of them with malformed fields, read checked."""
    base = fresh_folder(spark, "csv")
    tables = fx.tables(spark, sf, orders="f_orders_text", order_items="f_order_items_text")
    schemas = dict(CHECKED_SCHEMAS)
    for name, df in tables.items():
        df.write.csv(readers.csv_path(base, name, "shop_"), header=True)
        schemas.setdefault(name, ", ".join(f"{c} {t}" for c, t in df.dtypes))
    return typed.load_csv_checked(spark, base, prefix="shop_", schemas=schemas,
                                  multi_line=frozenset())


@query
def src_csv_checked(spark, sf):
    """All items, with the number of fields that did not parse."""
    rows = checked_tables(spark, sf)["order_items"].rows(with_rejected=True)
    return rows.withColumn("rejected", F.size(typed.REJECTED)).drop(typed.REJECTED)


@query
def src_csv_quarantine(spark, sf):
    """Every field that did not parse, with the order its record names."""
    found = typed.quarantine(checked_tables(spark, sf))
    order = F.split("record", ",")[0].cast("long").alias("order_id")
    return found.select("table", "column", "value", "target_type", order)


@query
def prf_type_conformance_raw(spark, sf):
    return typed.conformance(checked_tables(spark, sf))


@query
def src_parquet(spark, sf):
    base = fresh_folder(spark, "parquet")
    writers.write_parquet_tables(fx.tables(spark, sf), base, contracts.CLEANED_FOLDERS)
    return readers.load_parquet_tables(spark, base)["order_items"]


@query
def src_parquet_tables(spark, sf):
    """Nulls of every column of all nine tables, written and read back."""
    base = fresh_folder(spark, "parquet")
    writers.write_parquet_tables(fx.tables(spark, sf), base, contracts.CLEANED_FOLDERS)
    return exploration.profile_tables(readers.load_parquet_tables(spark, base))["null_profile"]


@query
def snk_parquet(spark, sf):
    path = fresh_folder(spark, "parquet")
    orders = features.add_calendar(fx.frame(spark, sf, "f_orders"))
    writers.write_parquet(orders, path, partition_by=["purchase_year"], max_records_per_file=100_000)
    return spark.read.parquet(path)


@query
def snk_parquet_single_file(spark, sf):
    path = fresh_folder(spark, "parquet")
    spending = aggregate.orders_per_customer(
        integrated(spark, sf, ["order_id", "customer_unique_id"]), one_row_per_order=True)
    writers.write_parquet(spending, path, single_file=True)
    return spark.read.parquet(path)


@query
def snk_table(spark, sf):
    database = "ledgerloom_checks"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{fresh_folder(spark, 'tables')}'")
    counts = explore.orders_by_status(fx.frame(spark, sf, "f_orders"))
    name = contracts.OUTPUT_NAMES["monthly_stats"]
    writers.save_table(counts, name, database=database)
    return spark.table(f"{database}.{name}")


@query
def snk_reuse(spark, sf):
    """Two results of one kept frame, written before it is released."""
    path = fresh_folder(spark, "reused")
    columns = ["order_id", "customer_unique_id", "product_id"]
    with writers.reused(integrated(spark, sf, columns)) as kept:
        by_customer = aggregate.orders_per_customer(kept, one_row_per_order=True)
        by_product = aggregate.most_sold_products(kept)
        writers.write_parquet(
            by_customer.select(F.lit("customer").alias("kind"),
                               F.col("customer_unique_id").alias("id"), "total_order")
            .unionByName(by_product.select(F.lit("product").alias("kind"),
                                           F.col("product_id").alias("id"), "total_order")), path)
    return spark.read.parquet(path)


# --- profiling ---------------------------------------------------------------


@query
def prf_row_counts(spark, sf):
    return profile.row_counts(fx.tables(spark, sf))


@query
def prf_nulls(spark, sf):
    return profile.null_counts(fx.frame(spark, sf, "f_products"))


@query
def prf_null_profile(spark, sf):
    return profile.null_profile(fx.frame(spark, sf, "f_orders"))


@query
def prf_null_profile_tables(spark, sf):
    return exploration.profile_tables(fx.tables(spark, sf))["null_profile"]


@query
def prf_row_counts_expected(spark, sf):
    """Against declared counts, one of a table that is not there."""
    return profile.row_counts(fx.tables(spark, sf), {"orders": 1, "sellers": 0, "coupons": 7})


@query
def prf_dup_groups(spark, sf):
    return profile.duplicate_groups(fx.frame(spark, sf, "f_orders_dup"))


@query
def prf_dup_rows(spark, sf):
    return profile.duplicate_rows(fx.frame(spark, sf, "f_orders_dup"))


@query
def prf_dup_tables(spark, sf):
    return profile.duplicate_summary(fx.tables(spark, sf, orders="f_orders_dup"))


@query
def prf_nulls_by_status(spark, sf):
    return profile.nulls_by_status(fx.frame(spark, sf, "f_orders"))


@query
def prf_orders_of_status(spark, sf):
    return profile.orders_of_status(fx.frame(spark, sf, "f_orders"), "delivered")


@query
def prf_distinct_payment_type(spark, sf):
    return profile.distinct_values(fx.frame(spark, sf, "f_payments"), "payment_type")


@query
def prf_type_conformance(spark, sf):
    return profile.type_conformance(fx.frame(spark, sf, "f_reviews"), REVIEW_TYPES)


# --- exploration -------------------------------------------------------------


@query
def exp_customers_by_city(spark, sf):
    counts = explore.customers_by(fx.frame(spark, sf, "f_customers"), "customer_city")
    return report.ordered(counts, "-count", "customer_city")


@query
def exp_customers_by_state(spark, sf):
    counts = explore.customers_by(fx.frame(spark, sf, "f_customers"), "customer_state")
    return report.ordered(counts, "-count", "customer_state")


@query
def exp_customers_by_city_state(spark, sf):
    places = ("customer_city", "customer_state")
    counts = explore.customers_by(fx.frame(spark, sf, "f_customers"), *places)
    return report.ordered(counts, "-count", *places)


@query
def exp_orders_by_status(spark, sf):
    counts = explore.orders_by_status(fx.frame(spark, sf, "f_orders"))
    return report.ordered(counts, "-count", "order_status")


@query
def exp_delivery_duration(spark, sf):
    durations = explore.delivery_durations(fx.frame(spark, sf, "f_orders"))
    return report.ordered(durations, "-delivery_duration", "order_id")


@query
def exp_delivery_status_counts(spark, sf):
    return explore.orders_by_status(explore.delivery_durations(fx.frame(spark, sf, "f_orders")))


@query
def exp_payment_types(spark, sf):
    counts = explore.payment_types(fx.frame(spark, sf, "f_payments"))
    return report.ordered(counts, "-count", "payment_type")


@query
def exp_top_products_by_orders(spark, sf):
    counts = explore.products_by_orders(fx.frame(spark, sf, "f_order_items"))
    return report.ordered(counts, "-total_order", "product_id")


@query
def exp_top_products_by_revenue(spark, sf):
    revenue = explore.products_by_revenue(fx.frame(spark, sf, "f_order_items"))
    return report.top_products_by_revenue_report(revenue)


# --- cleaning ----------------------------------------------------------------


@query
def cln_impute_order_dates(spark, sf):
    return clean.impute_order_dates(fx.frame(spark, sf, "f_orders"))


@query
def cln_impute_mode(spark, sf):
    return clean.impute_mode(fx.frame(spark, sf, "f_products"))


@query
def cln_cast_zip(spark, sf):
    tables = fx.tables(spark, sf)
    parts = [
        clean.cast_columns(tables[t], contracts.CORRECTED_TYPES[t]).select(
            F.lit(t).alias("table"), F.col(key).alias("id"), F.col(zip_code).alias("zip"))
        for t, key, zip_code in (
            ("customers", "customer_id", "customer_zip_code_prefix"),
            ("geolocation", "geo_point", "geolocation_zip_code_prefix"),
            ("sellers", "seller_id", "seller_zip_code_prefix"),
        )
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query
def cln_cast_reviews(spark, sf):
    return clean.cast_columns(
        fx.frame(spark, sf, "f_reviews"), contracts.CORRECTED_TYPES["reviews"])


@query
def cln_payment_types(spark, sf):
    return clean.standardise_payment_types(fx.frame(spark, sf, "f_payments"))


@query
def cln_dedup(spark, sf):
    return clean.deduplicate(fx.frame(spark, sf, "f_orders_dup"))


@query
def cln_dedup_wide(spark, sf):
    return clean.deduplicate(fx.frame(spark, sf, "f_orders_dup"), wide=True)


@query
def cln_price_cutoffs(spark, sf):
    bounds = quantiles.quantiles(fx.frame(spark, sf, "f_order_items"), "price", clean.PRICE_CUTOFFS)
    return bounds.select(F.col("quantiles")[0].alias("low"), F.col("quantiles")[1].alias("high"))


@query
def cln_price_outliers(spark, sf):
    return clean.drop_price_outliers(fx.frame(spark, sf, "f_order_items"))


@query
def cln_weight_bands(spark, sf):
    return clean.add_weight_band(fx.frame(spark, sf, "f_products"))


# --- features ----------------------------------------------------------------


@query
def fea_order_durations(spark, sf):
    return features.add_durations(fx.frame(spark, sf, "f_orders"))


@query
def fea_calendar(spark, sf):
    return features.add_calendar(fx.frame(spark, sf, "f_orders"))


# --- joins -------------------------------------------------------------------


@query
def jon_orders_items(spark, sf):
    return joins.orders_with_items(
        fx.frame(spark, sf, "f_orders"), fx.frame(spark, sf, "f_order_items"))


@query
def jon_items_products(spark, sf):
    return joins.with_products(
        fx.frame(spark, sf, "f_order_items"), fx.frame(spark, sf, "f_products"))


@query
def jon_items_sellers(spark, sf):
    return joins.with_sellers(
        fx.frame(spark, sf, "f_order_items"), fx.frame(spark, sf, "f_sellers"))


@query
def jon_orders_customers(spark, sf):
    return joins.with_customers(fx.frame(spark, sf, "f_orders"), fx.frame(spark, sf, "f_customers"))


@query
def jon_orders_geo(spark, sf):
    placed = joins.with_customers(
        fx.frame(spark, sf, "f_orders"), fx.frame(spark, sf, "f_customers"))
    return joins.with_geolocation(placed, fx.frame(spark, sf, "f_geolocation"))


@query
def jon_orders_reviews(spark, sf):
    return joins.with_reviews(fx.frame(spark, sf, "f_orders"), fx.frame(spark, sf, "f_reviews"))


@query
def jon_products_categories(spark, sf):
    return joins.with_categories(
        fx.frame(spark, sf, "f_products"), fx.frame(spark, sf, "f_categories"))


@query
def jon_orders_payments(spark, sf):
    return joins.with_payments(fx.frame(spark, sf, "f_orders"), fx.frame(spark, sf, "f_payments"))


@query
def jon_full_orders(spark, sf):
    return integrated(spark, sf)


@query
def jon_full_orders_dense(spark, sf):
    return integrated(spark, sf, order_items="f_order_items_dense")


@query
def jon_full_orders_bucketed(spark, sf):
    """From catalogue tables that lie in buckets of the order."""
    database = "ledgerloom_buckets"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{fresh_folder(spark, 'buckets')}'")
    prefix = "t" + uuid.uuid4().hex[:8] + "_"
    tables = writers.save_by_order(
        prepared(spark, sf), database=database, buckets=8, prefix=prefix)
    return joins.integrate(tables, stored_by_order=True)


def repeated(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The variant whose orders and customers repeat their keys."""
    return integrated(spark, sf_dir, columns,
                      orders="f_orders_repeated", customers="f_customers_repeated")


@query
def jon_full_orders_repeated_keys(spark, sf):
    return repeated(spark, sf)


@query
def agg_orders_per_customer_repeated_keys(spark, sf):
    return aggregate.orders_per_customer(repeated(spark, sf, ["customer_unique_id", "order_id"]))


@query
def agg_money_subcent(spark, sf):
    """Amounts with four decimals and more."""
    amounts = fx.frame(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("seller_id"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).alias("amount"))
    return amounts.groupBy("seller_id").agg(F.round(money_sum("amount"), 5).alias("revenue"))


@query
def jon_lost_orders(spark, sf):
    orders = fx.frame(spark, sf, "f_orders")
    return joins.lost_orders(orders, integrated(spark, sf, ["order_id"]))


# --- one row per key ---------------------------------------------------------


@query
def ded_one_row_per_order(spark, sf):
    rows = joins.with_customers(
        joins.orders_with_items(
            fx.frame(spark, sf, "f_orders"), fx.frame(spark, sf, "f_order_items")),
        fx.frame(spark, sf, "f_customers"))
    columns = [*contracts.ORDER_GRAIN, "order_item_id", "product_id", "seller_id", "price"]
    return one_row_per_key(rows.select(*columns), contracts.ORDER_GRAIN, joins.ITEM_ORDER)


@query
def ded_first_by_sequence(spark, sf):
    return first_by_sequence(fx.frame(spark, sf, "f_order_items"), ["order_id"], "order_item_id")


@query
def ded_first_review_by_sequence(spark, sf):
    """Equal dates and scores tie, malformed ones come first."""
    reviews = clean.cast_columns(fx.frame(spark, sf, "f_reviews"), {
        "review_score": "int", "review_creation_date": "timestamp_ntz"})
    return first_by_sequence(reviews, ["review_score"], "review_creation_date", ["order_id"])


@query
def ded_key_unique(spark, sf):
    return joins.grain_check(integrated(spark, sf, contracts.ORDER_GRAIN))


# --- aggregates --------------------------------------------------------------


@query
def agg_orders_per_customer(spark, sf):
    return aggregate.orders_per_customer(
        integrated(spark, sf, ["customer_unique_id", "order_id"]), one_row_per_order=True)


@query
def agg_distinct_orders_per_customer(spark, sf):
    rows = joins.with_customers(
        joins.orders_with_items(
            fx.frame(spark, sf, "f_orders"), fx.frame(spark, sf, "f_order_items")),
        fx.frame(spark, sf, "f_customers"))
    return aggregate.orders_per_customer(rows)


@query
def agg_seller_review_score(spark, sf):
    return aggregate.seller_review_scores(integrated(spark, sf, ["seller_id", "review_score"]))


@query
def agg_most_sold_products(spark, sf):
    return aggregate.most_sold_products(integrated(spark, sf, ["product_id", "order_id"]))


@query
def agg_customer_purchase(spark, sf):
    return aggregate.customer_purchases(integrated(spark, sf, ["customer_id", "payment_value"]))


@query
def agg_seller_products(spark, sf):
    return dense(spark, sf)


def spending(spark, sf):
    columns = ["customer_unique_id", "order_id", "payment_value"]
    return aggregate.customer_spending(integrated(spark, sf, columns))


@query
def agg_customer_spending(spark, sf):
    return spending(spark, sf)


def performance(spark, sf):
    columns = ["seller_id", "order_id", "price", "review_score"]
    return aggregate.seller_performance(integrated(spark, sf, columns))


@query
def agg_seller_performance(spark, sf):
    return performance(spark, sf)


@query
def agg_product_metrics(spark, sf):
    columns = ["product_id", "seller_id", "order_id", "price"]
    metrics = aggregate.product_metrics(
        integrated(spark, sf, columns, order_items="f_order_items_dense"))
    # The array as text, so that any comparison can read it.
    return metrics.withColumn("unique_sellers", F.array_join("unique_sellers", ","))


#: Products with more sellers have no array.
MOST_SELLERS = 12


@query
def agg_product_metrics_bounded(spark, sf):
    columns = ["product_id", "seller_id", "order_id", "price"]
    metrics = aggregate.product_metrics(
        integrated(spark, sf, columns, order_items="f_order_items_dense"), MOST_SELLERS)
    return metrics.withColumn("unique_sellers", F.array_join("unique_sellers", ","))


@query
def agg_product_sellers(spark, sf):
    return aggregate.product_sellers(
        integrated(spark, sf, ["product_id", "seller_id"], order_items="f_order_items_dense"))


def monthly(spark, sf):
    columns = [
        "purchase_month_name", "purchase_month", "purchase_year", "price", "payment_value",
        "freight_value", "order_id",
    ]
    return aggregate.monthly_stats(integrated(spark, sf, columns))


@query
def agg_monthly_stats(spark, sf):
    return monthly(spark, sf)


def retention(spark, sf):
    columns = ["customer_unique_id", "order_purchase_timestamp", "order_id", "payment_value"]
    return aggregate.customer_retention(
        integrated(spark, sf, columns), one_row_per_order=True)


@query
def agg_customer_retention(spark, sf):
    return retention(spark, sf)


# --- ranking, enrichment, reports --------------------------------------------


@query
def win_top_products_by_orders(spark, sf):
    return rank.top_products_by_orders(dense(spark, sf))


@query
def win_top_products_by_revenue(spark, sf):
    return rank.top_products_by_revenue(dense(spark, sf))


@query
def enr_status_flags(spark, sf):
    return enrich.add_status_flags(
        integrated(spark, sf, ["order_id", "order_status"]), STATUSES)


@query
def enr_status_flags_observed(spark, sf):
    """Flags of the statuses that occur, as rows."""
    orders = repeated(spark, sf, ["order_id", "order_status"])
    statuses = enrich.observed_statuses(orders)
    flagged = enrich.add_status_flags(orders, statuses)
    return flagged.select("order_id", F.explode(F.array(*[
        F.struct(F.lit(x).alias("status"), F.col(f"is_{x}").alias("flag")) for x in statuses
    ])).alias("x")).select("order_id", "x.status", "x.flag")


@query
def enr_status_flags_map(spark, sf):
    """The map's entries as rows."""
    flagged = enrich.add_status_map(repeated(spark, sf, ["order_id", "order_status"]))
    return flagged.select("order_id", F.explode("status_flags").alias("status", "flag"))


@query
def enr_customer_segment(spark, sf):
    return enrich.add_customer_segment(spending(spark, sf))


@query
def enr_orders_with_segment(spark, sf):
    columns = [*contracts.ORDER_GRAIN, "payment_value"]
    orders = integrated(spark, sf, columns)
    segments = enrich.add_customer_segment(aggregate.customer_spending(orders))
    return enrich.orders_with_segment(orders, segments)


@query
def top_k_products(spark, sf):
    counts = explore.products_by_orders(fx.frame(spark, sf, "f_order_items"))
    return report.top_k(counts, 10, "-total_order", "product_id")


@query
def srt_monthly(spark, sf):
    return report.ordered_output("monthly_stats", monthly(spark, sf))


@query
def fmt_monthly_report(spark, sf):
    return report.monthly_report(monthly(spark, sf))


@query
def fmt_retention_report(spark, sf):
    return report.retention_report(retention(spark, sf))


@query
def fmt_customer_orders(spark, sf):
    orders = integrated(spark, sf, ["customer_unique_id", "order_id"])
    counts = aggregate.orders_per_customer(orders, one_row_per_order=True)
    return report.report("customer_orders", counts)


@query
def fmt_seller_review_score(spark, sf):
    orders = integrated(spark, sf, ["seller_id", "review_score"])
    return report.report("seller_review_score", aggregate.seller_review_scores(orders))


@query
def fmt_most_sold_products(spark, sf):
    orders = integrated(spark, sf, ["product_id", "order_id"])
    return report.report("most_sold_products", aggregate.most_sold_products(orders), 10)


@query
def fmt_customer_purchase(spark, sf):
    orders = integrated(spark, sf, ["customer_id", "payment_value"])
    return report.report("customer_purchase", aggregate.customer_purchases(orders))


@query
def fmt_seller_products(spark, sf):
    return report.report("seller_products", dense(spark, sf))


@query
def fmt_customer_spending(spark, sf):
    return report.report("customer_spending", spending(spark, sf))


@query
def fmt_seller_performance(spark, sf):
    return report.report("seller_performance", performance(spark, sf))


@query
def fmt_dense_ranked_products(spark, sf):
    ranked = rank.top_products_by_revenue(dense(spark, sf))
    return report.report("dense_ranked_products", ranked)


# --- whole jobs --------------------------------------------------------------


def raw(spark, sf) -> dict[str, DataFrame]:
    """The nine tables with repeated order rows."""
    return fx.tables(spark, sf, orders="f_orders_dup")


def cleaned_files(spark, sf) -> str:
    """The nine tables through the whole cleaning, written as the cleaning job does."""
    base = fresh_folder(spark, "cleaned")
    cleaning.write_cleaned(raw(spark, sf), base)
    return base


@query
def job_cleaned_orders(spark, sf):
    return cleaning.clean_table("orders", fx.frame(spark, sf, "f_orders_dup"))


@query
def job_cleaned_items(spark, sf):
    return cleaning.clean_table("order_items", fx.frame(spark, sf, "f_order_items"))


@query
def job_cleaned_products(spark, sf):
    return cleaning.clean_table("products", fx.frame(spark, sf, "f_products"))


@query
def job_written_orders(spark, sf):
    return readers.load_parquet_tables(spark, cleaned_files(spark, sf))["orders"]


@query
def job_written_items(spark, sf):
    return readers.load_parquet_tables(spark, cleaned_files(spark, sf))["order_items"]


@query
def job_written_products(spark, sf):
    return readers.load_parquet_tables(spark, cleaned_files(spark, sf))["products"]


@query
def job_observed_profile(spark, sf):
    """Rows and nulls of all cleaned tables, counted while they are written."""
    return cleaning.write_cleaned(raw(spark, sf), fresh_folder(spark, "cleaned"))


#: Of each output: its key and the measures that are added up.
OUTPUT_MEASURES = {
    "customer_orders": ("customer_unique_id", "total_order"),
    "seller_review_score": ("seller_id", "avg_review_score"),
    "most_sold_products": ("product_id", "total_order"),
    "customer_purchase": ("customer_id", "total_amount_spent"),
    "seller_products": ("product_id", "total_orders", "total_revenue"),
    "ranked_products": ("product_id", "total_orders", "rank"),
    "dense_ranked_products": ("product_id", "total_revenue", "dense_rank"),
    "customer_spending": ("customer_unique_id", "total_orders", "revenue", "AOV"),
    "seller_performance": ("seller_id", "total_orders", "total_revenue", "avg_review_score",
                           "price_variability"),
    "product_metrics": ("product_id", "total_sales", "total_revenue", "avg_price",
                        "price_volatility", "unique_seller_count"),
    "monthly_stats": ("purchase_month", "seller_revenue", "customer_spend", "total_freight",
                      "total_orders", "min_order_value", "max_order_value", "aov_seller",
                      "aov_customer"),
    "customer_retention": ("customer_unique_id", "total_orders", "total_amount_spent", "aov",
                           "retention_rate"),
}


@query
def job_outputs(spark, sf):
    """Rows, different keys and added measures of the job's other twelve outputs, as written."""
    analysed = fresh_folder(spark, "analysed")
    analysis.run_analysis(spark, cleaned_files(spark, sf), analysed, statuses=STATUSES)

    def added(df, column):
        if dict(df.dtypes)[column] in ("int", "bigint"):
            return F.sum(column)
        return F.sum(F.round(F.col(column).cast("decimal(38,6)"), 2))

    def lines(name, key, *measures):
        df = spark.read.parquet(f"{analysed}/{contracts.OUTPUT_NAMES[name]}")
        found = {"rows": F.count(F.lit(1)), **{c: added(df, c) for c in measures}}
        entries = [F.struct(F.lit(m).alias("measure"), v.cast("double").alias("value"))
                   for m, v in found.items()]
        sums = df.agg(F.array(*entries).alias("entries")).select(
            F.lit(name).alias("output"), F.inline("entries"))
        # apart from the sums, which would otherwise be kept and shuffled per key
        keys = df.agg(F.count_distinct(key).cast("double").alias("value"))
        return sums.unionByName(
            keys.select(F.lit(name).alias("output"), F.lit("keys").alias("measure"), "value"))

    return reduce(DataFrame.unionByName, [lines(n, *m) for n, m in OUTPUT_MEASURES.items()])


@query
def job_complete_orders(spark, sf):
    analysed = fresh_folder(spark, "analysed")
    analysis.run_analysis(spark, cleaned_files(spark, sf), analysed, statuses=STATUSES)
    return spark.read.parquet(f"{analysed}/{contracts.OUTPUT_NAMES['complete_orders']}")


@query
def job_quality(spark, sf):
    """The quality outputs of the analysis job, with two declared statuses, as rows."""
    analysed = fresh_folder(spark, "analysed")
    analysis.run_analysis(
        spark, cleaned_files(spark, sf), analysed, statuses=("delivered", "invoiced"))

    def output(name, column):
        return spark.read.parquet(f"{analysed}/quality_{name}").agg(
            F.coalesce(F.sum(column), F.lit(0)).cast("long").alias("n"))

    measures = {
        "integrated_orders": output("order_grain", "rows"),
        "distinct_orders": output("order_grain", "distinct_keys"),
        "lost_orders": output("lost_orders", "lost_orders"),
        "rows_without_flag": output("undeclared_statuses", "rows"),
    }
    rows = [df.select(F.lit(name).alias("measure"), "n") for name, df in measures.items()]
    return reduce(DataFrame.unionByName, rows)


@query
def job_monthly_report(spark, sf):
    columns = [
        "purchase_month_name", "purchase_month", "purchase_year", "price", "payment_value",
        "freight_value", "order_id",
    ]
    cleaned = readers.load_parquet_tables(spark, cleaned_files(spark, sf))
    orders = joins.integrate(cleaned, columns)
    return report.monthly_report(aggregate.monthly_stats(orders))


def _salted(build: Query) -> Query:
    """The same query with the hot keys of every lookup join salted."""

    def run(spark, sf):
        before = spark.conf.get(SALTED_JOINS, None)
        spark.conf.set(SALTED_JOINS, "true")
        try:
            return build(spark, sf)
        finally:
            spark.conf.unset(SALTED_JOINS) if before is None else spark.conf.set(
                SALTED_JOINS, before)

    return run


#: Queries that are registered once more with salted joins.
SALTED = (
    "jon_orders_items", "jon_items_products", "jon_orders_geo", "jon_full_orders",
    "jon_full_orders_repeated_keys", "win_top_products_by_orders", "win_top_products_by_revenue",
    "enr_orders_with_segment",
)
QUERIES.update({f"{name}_salted": _salted(QUERIES[name]) for name in SALTED})
