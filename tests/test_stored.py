"""Plans and results of the stored, staged, observed and bounded forms."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import registry
from ledgerloom.functions.columns import money_spread, money_sum
from ledgerloom.operators import aggregate, clean, enrich, profile
from ledgerloom.operators.integrate import integrate
from ledgerloom.operators.lookup import first_by_sequence, one_row_per_key
from ledgerloom.plans import analysis, cleaning
from ledgerloom.sinks import writers
from ledgerloom.sources import contracts
from tests.conftest import SMALL
from tests.helpers import bag, physical_plan, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test data not present")


def exchanges(plan):
    return [line for line in plan.splitlines() if "Exchange" in line]


# --- duplicates by fingerprints ----------------------------------------------


def test_text_does_not_enter_the_exchange_of_fingerprints(spark):
    wide = fx.frame(spark, SMALL, "f_products")
    plan = physical_plan(profile.duplicate_rows(wide))
    counted = [x for x in exchanges(plan) if "hashpartitioning(_fingerprint1" in x]
    assert counted
    first = plan[plan.rindex("partial_count"):]  # the lowest aggregate, below the first exchange
    assert "keys=[_fingerprint1" in plan and "product_category_name" not in first.splitlines()[0]


def test_distinct_rows_equal_plain_distinct(spark):
    data = [(1, None, "x"), (None, 1, "x"), (1, None, "x"), (1, 1, None), (None, None, None)] * 3
    df = spark.createDataFrame(data, "a int, b int, c string").unionByName(
        spark.range(50).select(F.col("id").cast("int").alias("a"), F.lit(1).alias("b"),
                               F.lit("y").alias("c")))
    assert bag(clean.deduplicate(df, wide=True)) == bag(clean.deduplicate(df))
    assert clean.deduplicate(df.limit(0), wide=True).count() == 0


# --- first rows by a sequence ------------------------------------------------


def test_first_by_sequence_equals_one_row_per_key(spark):
    data = [(k % 7, None if n % 5 == 0 else n % 3, f"t{n % 4}", n % 2) for n in range(200)
            for k in (n, n + 3)] + [(None, 1, "z", 0), (None, None, "a", 1)]
    df = spark.createDataFrame(data, "k int, seq int, text string, other int")
    expected = one_row_per_key(df, ["k"], ["seq", "text"])
    assert bag(first_by_sequence(df, ["k"], "seq", ["text"])) == bag(expected)
    pairs = df.select("k", "seq")
    assert bag(first_by_sequence(pairs, ["k"], "seq")) == bag(one_row_per_key(pairs, ["k"], ["seq"]))


def test_first_by_sequence_needs_no_sort_aggregate(spark):
    items = fx.frame(spark, SMALL, "f_order_items")
    plan = physical_plan(first_by_sequence(items, ["order_id"], "order_item_id"))
    assert "SortAggregate" not in plan and "partial_min(order_item_id" in plan


# --- amounts -----------------------------------------------------------------


def test_sums_and_spreads_do_not_depend_on_the_partitioning(spark):
    df = spark.range(5000).select(
        (F.col("id") % 3).alias("k"),
        F.expr("CASE WHEN id % 7 = 0 THEN id * 1e-7 WHEN id % 11 = 0 THEN -id * 123456.789 "
               "WHEN id % 13 = 0 THEN NULL ELSE id * 0.01 END").alias("v"))

    def found(parts):
        return sorted(rows(df.repartition(parts, F.rand(parts)).groupBy("k").agg(
            money_sum("v").alias("a"), money_spread("v").alias("b"))))

    first = found(1)
    assert all(found(parts) == first for parts in (3, 8, 17))


@pytest.mark.parametrize("values", [
    [1.25, 3.5, 2.0], [1e8, 1e8 + 0.01], [5.0], [None, 4.0], [0.0001, 0.0002, 12.5],
    [2e9, 3e9, 1.0], [7.77] * 50, [-3.0, 3.0]])
def test_spread_is_the_sample_deviation(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got, plain = df.agg(money_spread("v"), F.stddev("v")).first()
    assert (got is None) == (plain is None)
    assert got is None or got == pytest.approx(plain, rel=1e-9, abs=1e-6)


def test_sums_of_all_kinds_of_amounts(spark):
    values = [0.1] * 10 + [1e7, 123.45678, 9999999.9999, -0.0001, 1e16, -5.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    from fractions import Fraction

    exact = float(sum(Fraction(str(v)) for v in values))
    assert df.agg(money_sum("v")).first()[0] == pytest.approx(exact, rel=1e-15)


# --- sellers of a hot product ------------------------------------------------


def test_arrays_are_bounded_and_no_seller_is_lost(spark):
    # a third of all rows is one product, with many sellers
    data = [("hot" if n % 3 == 0 else f"p{n % 20}", f"s{n % 90}" if n % 17 else None, n, 1.0)
            for n in range(3000)] + [(None, "s1", 1, 1.0), ("none", None, 2, None)]
    df = spark.createDataFrame(data, "product_id string, seller_id string, order_id int, price double")
    whole = {r.product_id: r for r in aggregate.product_metrics(df).collect()}
    bounded = {r.product_id: r for r in aggregate.product_metrics(df, 10).collect()}
    assert set(whole) == set(bounded)
    for key, row in whole.items():
        got = bounded[key]
        assert got.unique_seller_count == row.unique_seller_count
        assert got.total_sales == row.total_sales and got.total_revenue == row.total_revenue
        assert got.unique_sellers == (row.unique_sellers if row.unique_seller_count <= 10 else None)
    pairs = {(r.product_id, r.seller_id) for r in aggregate.product_sellers(df).collect()}
    assert pairs == {(k, s) for k, r in whole.items() for s in r.unique_sellers}


# --- statuses as a map -------------------------------------------------------


def test_status_map_has_one_schema(spark):
    df = spark.createDataFrame([("1", "b"), ("2", None), ("3", "a")], "order_id string, order_status string")
    flagged = enrich.add_status_map(df)
    assert {r.order_id: r.status_flags for r in flagged.collect()} == {
        "1": {"a": False, "b": True}, "2": {"a": False, "b": False}, "3": {"a": True, "b": False}}
    assert enrich.add_status_map(df.where("order_id = 3")).schema == flagged.schema
    assert enrich.add_status_map(df.limit(0)).count() == 0


# --- profiles taken while writing --------------------------------------------


def test_observed_profile_equals_scans_also_of_empty_tables(spark, tmp_path):
    frames = {
        "orders": fx.frame(spark, SMALL, "f_orders"), "none": spark.createDataFrame([], "a int"),
        "deduplicated": fx.frame(spark, SMALL, "f_orders_dup").dropDuplicates()}
    seen = profile.ObservedProfile()
    watched = {name: seen.watch(name, df) for name, df in frames.items()}
    writers.write_parquet_tables(watched, str(tmp_path), {x: x for x in frames})
    found = {(r.table, r.column): (r.rows, r.nulls, r.null_fraction)
             for r in seen.counts(spark).collect()}
    for name, df in frames.items():
        total = df.count()
        for r in profile.null_profile(df).collect():
            assert found.pop((name, r.column)) == (total, r.nulls, r.null_fraction)
    assert not found


# --- buckets -----------------------------------------------------------------


def test_bucketed_tables_join_without_exchanges_by_order(spark):
    database = "b" + uuid.uuid4().hex[:8]
    spark.sql(f"CREATE DATABASE {database}")
    tables = writers.save_by_order(registry.prepared(spark, SMALL), database=database, buckets=8)
    plan = physical_plan(integrate(tables, stored_by_order=True))
    assert not [x for x in exchanges(plan) if "hashpartitioning(order_id" in x]
    assert not [x for x in exchanges(plan) if "hashpartitioning(customer_unique_id" in x]
    assert bag(integrate(tables, stored_by_order=True)) == bag(registry.integrated(spark, SMALL))


def test_buckets_grow_with_the_longest_table(spark, monkeypatch):
    database = "b" + uuid.uuid4().hex[:8]
    spark.sql(f"CREATE DATABASE {database}")
    monkeypatch.setattr(writers, "BUCKET_ROWS", 500)
    tables = writers.save_by_order(registry.prepared(spark, SMALL), database=database, buckets=8)

    def buckets(name):
        found = spark.sql(f"DESCRIBE EXTENDED {database}.{name}").where("col_name = 'Num Buckets'")
        return [int(n) for n, in found.select("data_type").collect()]

    expected = [-(-tables["order_items"].count() // 500)]
    assert expected[0] > 8
    assert [buckets(n) for n in ("orders", "order_items", "reviews", "payments")] == [expected] * 4
    assert bag(integrate(tables, stored_by_order=True)) == bag(registry.integrated(spark, SMALL))


# --- reuse -------------------------------------------------------------------


def test_kept_frame_is_read_from_the_cache_and_released(spark):
    df = registry.integrated(spark, SMALL, ["order_id", "customer_unique_id"])
    with writers.reused(df) as kept:
        assert "InMemoryTableScan" in physical_plan(kept.groupBy("customer_unique_id").count())
    again = registry.integrated(spark, SMALL, ["order_id", "customer_unique_id"])
    assert "InMemoryTableScan" not in physical_plan(again.groupBy("customer_unique_id").count())


# --- staged outputs ----------------------------------------------------------


def test_a_failing_run_leaves_the_old_outputs(spark, tmp_path, monkeypatch):
    cleaned, analysed = str(tmp_path / "cleaned"), str(tmp_path / "analysed")
    cleaning.write_cleaned(fx.tables(spark, SMALL), cleaned)
    analysis.run_analysis(spark, cleaned, analysed, statuses=("delivered",))
    names = list(contracts.OUTPUT_NAMES.values())
    before = {n: sorted(os.listdir(f"{analysed}/{n}")) for n in names}

    ordered, calls = analysis.report.ordered_output, []

    def failing(name, df):
        calls.append(name)
        if name == "monthly_stats":
            raise RuntimeError("the tenth output")
        return ordered(name, df)

    monkeypatch.setattr(analysis.report, "ordered_output", failing)
    with pytest.raises(RuntimeError, match="tenth"):
        analysis.run_analysis(spark, cleaned, analysed, statuses=("delivered",))
    assert len(calls) > 5
    assert {n: sorted(os.listdir(f"{analysed}/{n}")) for n in names} == before
    monkeypatch.undo()
    analysis.run_analysis(spark, cleaned, analysed, statuses=("delivered",))
    after = {n: sorted(os.listdir(f"{analysed}/{n}")) for n in names}
    assert all(after[n] != before[n] for n in names)


def test_tables_lie_over_the_written_files(spark, tmp_path):
    database = "c" + uuid.uuid4().hex[:8]
    spark.sql(f"CREATE DATABASE {database}")
    cleaned, analysed = str(tmp_path / "cleaned"), str(tmp_path / "analysed")
    cleaning.write_cleaned(fx.tables(spark, SMALL), cleaned)
    for _ in range(2):
        analysis.run_analysis(spark, cleaned, analysed, database=database,
                              partition_orders_by=["purchase_year"])
        for name in contracts.OUTPUT_NAMES.values():
            table = spark.table(f"{database}.{name}")
            assert table.count() == spark.read.parquet(f"{analysed}/{name}").count() > 0
            assert all(f"{analysed}/{name}" in x for x in table.inputFiles())
