"""Operators on hand-written frames: edges that the fixtures do not reach."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.columns import banded, money_sum, per, round2, translate_values
from ledgerloom.operators import (
    aggregate, clean, enrich, explore, features, integrate, profile, report,
)
from ledgerloom.operators.lookup import one_row_per_key
from ledgerloom.operators.quantiles import quantiles
from tests.helpers import physical_plan, rows

ORDER_DDL = """order_id string, order_status string, order_purchase_timestamp timestamp_ntz,
    order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz,
    order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz"""


def day(n, second=0):
    return datetime(2020, 1, n, 0, 0, second)


# --- column expressions ------------------------------------------------------


def test_money_sum_is_exact_and_skips_null_and_nan(spark):
    df = spark.createDataFrame([(0.1,)] * 10 + [(None,), (math.nan,)], "v double")
    assert rows(df.agg(money_sum("v"))) == [(1.0,)]
    assert rows(df.where("v is null").agg(money_sum("v"))) == [(None,)]


def test_money_sum_keeps_small_wide_and_infinite_amounts(spark):
    def total(values):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        return rows(df.agg(money_sum("v")))[0][0]

    assert total([0.004] * 1000) == 4.0
    assert total([1e-12] * 1000) == pytest.approx(1e-9)
    assert total([1e17, 2.5]) == 1e17 + 2.5
    assert total([math.inf, 1.0]) == math.inf


def test_round2_is_half_up_and_keeps_null(spark):
    df = spark.createDataFrame([(2.345,), (2.675,), (-1.005,), (None,)], "v double")
    assert [r[0] for r in rows(df.select(round2(F.col("v"))))] == [2.35, 2.68, -1.01, None]


def test_ratio_of_zero_is_null(spark):
    assert rows(spark.range(1).select(per(F.lit(1.0), F.lit(0)))) == [(None,)]


def test_translate_without_mapping_changes_nothing(spark):
    df = spark.createDataFrame([("a",)], "v string")
    assert rows(df.select(translate_values(F.col("v"), {}))) == [("a",)]


def test_bands_need_one_label_more_than_bounds():
    with pytest.raises(ValueError):
        banded(None, [1, 2], ["a", "b"])


# --- profiling ---------------------------------------------------------------


def test_nan_is_not_null(spark):
    df = spark.createDataFrame([(None, "a"), (math.nan, None)], "v double, s string")
    assert rows(profile.null_counts(df)) == [(1, 1)]
    assert sorted(rows(profile.null_profile(df))) == [("s", 1, 0.5), ("v", 1, 0.5)]


def test_null_profile_of_no_rows(spark):
    df = spark.createDataFrame([], "v double")
    assert rows(profile.null_profile(df)) == [("v", 0, None)]


def test_duplicates_count_groups_and_treat_nulls_alike(spark):
    df = spark.createDataFrame([(1, None)] * 3 + [(2, "x")] * 2 + [(3, "y")], "a int, b string")
    assert rows(profile.duplicate_groups(df)) == [(2, 3)]
    assert sorted(rows(profile.duplicate_rows(df))) == [(1, None, 3), (2, "x", 2)]
    assert rows(profile.duplicate_groups(df.where("a = 3"))) == [(0, 0)]


def test_row_counts_against_expected(spark):
    tables = {"a": spark.range(3), "b": spark.range(0)}
    counts = profile.row_counts(tables, {"a": 2, "c": 5})
    assert sorted(rows(counts)) == [("a", 2, 3, 1), ("b", None, 0, None), ("c", 5, None, None)]


def test_null_status_is_not_audited(spark):
    data = [("1", None, day(1), None, None, None, day(9)),
            ("2", "delivered", day(1), None, None, day(2), day(9))]
    audit = profile.nulls_by_status(spark.createDataFrame(data, ORDER_DDL))
    assert rows(audit) == [("delivered", 0, 0, 1, 1, 0)]


# --- exploration -------------------------------------------------------------


def test_null_payment_type_is_counted(spark):
    df = spark.createDataFrame([(None,), (None,), ("x",)], "payment_type string")
    assert sorted(rows(explore.payment_types(df)), key=str) == [("x", 1), (None, 2)]


def test_undelivered_orders_sort_last(spark):
    data = [("1", "canceled", day(1), None, None, None, day(9)),
            ("2", "delivered", day(1), None, None, day(4), day(9))]
    durations = explore.delivery_durations(spark.createDataFrame(data, ORDER_DDL))
    ranked = report.ordered(durations, "-delivery_duration", "order_id")
    assert [r[0] for r in rows(ranked)] == ["2", "1"]


# --- cleaning ----------------------------------------------------------------


def test_dates_of_delivered_orders_are_imputed_in_order(spark):
    data = [("1", "delivered", day(1), None, None, None, day(1, 1)),
            ("2", None, day(1), None, None, None, day(9)),
            ("3", "canceled", day(1), None, None, None, day(9)),
            ("4", "delivered", None, None, None, None, None)]
    orders = spark.createDataFrame(data, ORDER_DDL)
    result = clean.impute_order_dates(orders)
    assert result.dtypes == orders.dtypes
    found = {r.order_id: r for r in result.collect()}
    assert found["1"].order_approved_at == day(1)
    assert found["1"].order_delivered_customer_date == day(1, 1)
    # The midpoint of two instants one second apart keeps its half second.
    assert found["1"].order_delivered_carrier_date == datetime(2020, 1, 1, 0, 0, 0, 500000)
    for untouched in ("2", "3", "4"):
        assert tuple(found[untouched]) == data[int(untouched) - 1]


def test_mode_replaces_null_and_nan_and_breaks_ties_downwards(spark):
    data = [(i, v) for i, v in enumerate([3.0, 1.0, 1.0, 3.0, None, math.nan])]
    df = spark.createDataFrame(data, "id int, v double")
    result = clean.impute_mode(df, ["v"])
    assert [r[1] for r in sorted(rows(result))] == [3.0, 1.0, 1.0, 3.0, 1.0, 1.0]
    assert rows(clean.column_modes(df.where("v is null"), ["v"])) == [(None,)]


def test_mode_imputation_moves_columns_to_the_end_and_leaves_others_null(spark):
    df = spark.createDataFrame([(None, "a", None), (2, "b", 5.0)], "w int, id string, x double")
    result = clean.impute_mode(df, ["w"])
    assert result.dtypes == [("id", "string"), ("x", "double"), ("w", "int")]
    assert sorted(rows(result)) == [("a", None, 2), ("b", 5.0, 2)]


def test_malformed_values_become_null(spark):
    df = spark.createDataFrame([("5", "2020-01-01 10:00:00"), ("n/a", "soon")], "s string, t string")
    result = clean.cast_columns(df, {"s": "int", "t": "timestamp_ntz"})
    assert rows(result) == [(5, datetime(2020, 1, 1, 10)), (None, None)]


def test_unknown_and_null_payment_types_pass(spark):
    df = spark.createDataFrame([("boleto",), ("voucher",), (None,)], "payment_type string")
    found = [r[0] for r in rows(clean.standardise_payment_types(df))]
    assert found == ["bank transfer", "voucher", None]


def test_price_cutoffs_include_both_ends_and_drop_null(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 201)] + [(None,)], "price double")
    kept = clean.drop_price_outliers(df)
    assert rows(kept.agg(F.min("price"), F.max("price"), F.count("*"))) == [(2.0, 198.0, 197)]


def test_without_prices_nothing_is_kept(spark):
    df = spark.createDataFrame([(None,)], "price double")
    assert rows(quantiles(df, "price", [0.5])) == [([None],)]
    assert clean.drop_price_outliers(df).count() == 0


def test_null_weight_is_very_heavy(spark):
    data = [(None,)] + [(float(i),) for i in range(1, 6)]
    df = spark.createDataFrame(data, "product_weight_g double")
    found = dict(rows(clean.add_weight_band(df)))
    assert found == {None: "Very Heavy", 1.0: "Very Light", 2.0: "Light", 3.0: "Medium",
                     4.0: "Heavy", 5.0: "Very Heavy"}


def test_weight_bands_from_a_sketch(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("product_weight_g"))
    bands = clean.add_weight_band(df, accuracy=10_000).groupBy("product_weight_category").count()
    assert {n for _, n in rows(bands)} == {200}


# --- features ----------------------------------------------------------------


def test_duration_signs(spark):
    data = [("1", "delivered", day(1), day(2), day(4), day(8), day(20))]
    result = features.add_durations(spark.createDataFrame(data, ORDER_DDL)).first()
    assert result.approval_time == -1
    assert result.carrier_handling_time == -2
    assert result.delivery_delay == 12
    assert result.delivery_duration == 7
    assert result.shipping_time == -4


def test_calendar_names(spark):
    df = spark.createDataFrame([(datetime(2017, 9, 4, 23, 59),)], "t timestamp_ntz")
    assert rows(features.add_calendar(df, "t"))[0][1:] == (4, "Mon", 9, "Sep", 2017)


# --- one row per key ---------------------------------------------------------


def test_first_row_is_chosen_by_order_then_all_columns(spark):
    data = [("a", 2, "x", None), ("a", 1, "z", 1.0), ("a", 1, "y", 9.0), ("b", None, "q", 1.0),
            ("b", 0, "p", 1.0)]
    df = spark.createDataFrame(data, "k string, seq int, s string, v double")
    assert sorted(rows(one_row_per_key(df, ["k"], ["seq"]))) == [
        ("a", 1, "y", 9.0), ("b", None, "q", 1.0)]


def test_first_row_without_other_columns_is_distinct(spark):
    df = spark.createDataFrame([("a",), ("a",)], "k string")
    assert rows(one_row_per_key(df, ["k"])) == [("a",)]


def test_grain_check_sees_a_repeated_order(spark):
    df = spark.createDataFrame([("u", "o", 1), ("u", "o", 1)], ["u", "o", "t"])
    assert rows(integrate.grain_check(df, ["u", "o", "t"])) == [(2, 1, False)]
    assert rows(integrate.grain_check(df.limit(0), ["u", "o", "t"])) == [(0, 0, True)]


# --- aggregates and enrichment -----------------------------------------------


def test_one_sale_has_no_spread(spark):
    df = spark.createDataFrame([("s", "o", 5.0, None)],
                               "seller_id string, order_id string, price double, review_score int")
    assert rows(aggregate.seller_performance(df)) == [("s", 1, 5.0, None, None)]


def test_product_metrics_leave_null_sellers_out(spark):
    df = spark.createDataFrame(
        [("p", "o1", "b", 1.0), ("p", "o2", "a", 2.0), ("p", "o3", "b", None), ("p", "o4", None, 1.0)],
        "product_id string, order_id string, seller_id string, price double")
    assert rows(aggregate.product_metrics(df)) == [("p", 4, 4.0, 1.33, 0.58, ["a", "b"], 2)]


def test_distinct_orders_ignore_repeated_rows(spark):
    df = spark.createDataFrame([("u", "o"), ("u", "o"), ("u", "p")],
                               "customer_unique_id string, order_id string")
    assert rows(aggregate.orders_per_customer(df)) == [("u", 2)]
    assert rows(aggregate.orders_per_customer(df, relative_error=0.05)) == [("u", 2)]


def test_segment_thresholds_are_strict_and_null_is_standard(spark):
    df = spark.createDataFrame([(700.0,), (700.01,), (1500.0,), (1500.01,), (None,)], "AOV double")
    found = [r[1] for r in rows(enrich.add_customer_segment(df))]
    assert found == ["Standard", "Medium", "Medium", "Premium", "Standard"]


def test_flags_of_a_missing_status_are_false(spark):
    df = spark.createDataFrame([(None,), ("delivered",)], "order_status string")
    flagged = enrich.add_status_flags(df, ["delivered", "canceled"])
    assert rows(flagged) == [(None, False, False), ("delivered", True, False)]


def test_observed_and_undeclared_statuses(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "order_status string")
    assert enrich.observed_statuses(df) == ["a", "b"]
    assert rows(enrich.undeclared_statuses(df, ["a"])) == [("b", 1)]


# --- reports -----------------------------------------------------------------


def test_retention_report_sorts_by_the_number(spark):
    df = spark.createDataFrame(
        [("a", 1, 1.0, 1.0, 9.5), ("b", 2, 1.0, 1.0, 10.0)],
        "customer_unique_id string, total_orders long, total_amount_spent double, aov double, "
        "retention_rate double")
    assert [r.retention_rate for r in report.retention_report(df).collect()] == ["10.00", "9.50"]


def test_report_is_ordered_cut_and_formatted(spark):
    df = spark.createDataFrame([("a", 1234), ("b", 99), ("c", 1234)], "product_id string, total_order int")
    assert rows(report.report("most_sold_products", df, 2)) == [("a", "1,234"), ("c", "1,234")]


def test_operators_keep_their_schema_on_empty_input(spark):
    orders = spark.createDataFrame([], ORDER_DDL)
    for operator in (clean.impute_order_dates, features.add_durations, features.add_calendar):
        assert operator(orders).count() == 0
    items = spark.createDataFrame([], "product_id string, order_id string, price double")
    assert clean.drop_price_outliers(items).count() == 0
    assert explore.products_by_revenue(items).count() == 0


def test_calendar_names_are_those_of_the_formatter_without_its_cost(spark):
    moment = "timestamp_ntz '2015-12-30 23:59:59' + id * INTERVAL '1' DAY"
    days = spark.range(800).select(F.expr(moment).alias("t"))
    days = days.unionByName(days.select(F.lit(None).cast("timestamp_ntz").alias("t")).limit(1))
    named = features.add_calendar(days, "t").select(
        "purchase_day_name", "purchase_month_name", F.date_format("t", "EEE").alias("day"),
        F.date_format("t", "MMM").alias("month"))
    assert named.where("NOT (purchase_day_name <=> day AND purchase_month_name <=> month)").isEmpty()
    assert "date_format" not in physical_plan(features.add_calendar(days, "t"))
