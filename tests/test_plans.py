"""Shape of the plans: lazy, pruned, pushed down, nothing gathered."""

import os

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import registry
from ledgerloom.operators import aggregate, explore, rank, report
from ledgerloom.operators.integrate import integrate
from ledgerloom.operators.lookup import one_row_per_key
from ledgerloom.operators.profile import orders_of_status
from ledgerloom.plans import analysis, cleaning, exploration
from ledgerloom.plans.workspace import HASH_JOINS, hash_joins
from tests.conftest import SMALL
from tests.helpers import bag, final_plan, jobs_started, physical_plan

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test data not present")

LAZY = [n for n in registry.QUERIES if not n.startswith(("src_", "snk_", "job_"))]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python_in_any_plan(spark, name):
    plan = physical_plan(registry.QUERIES[name](spark, SMALL))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "CollectLimit"):
        assert forbidden not in plan


def test_building_all_plans_starts_no_job(spark):
    raw = fx.tables(spark, SMALL)

    def build():
        cleaned = cleaning.clean_tables(raw)
        orders = integrate(cleaned)
        return [
            *exploration.profile_tables(raw).values(), *exploration.audits(raw).values(),
            *exploration.distributions(raw).values(),
            *analysis.outputs(orders).values(),
        ]

    started, frames = jobs_started(spark, build)
    assert started == 0
    assert len(frames) == 3 + 3 + 9 + 13


def test_job_counter_sees_jobs(spark):
    assert jobs_started(spark, lambda: spark.range(3).count())[0] > 0


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "orders")
    fx.frame(spark, SMALL, "f_orders").write.parquet(path)
    plan = physical_plan(orders_of_status(spark.read.parquet(path), "delivered"))
    assert "EqualTo(order_status,delivered)" in plan
    assert "customer_id" not in plan


def test_narrow_aggregate_reads_only_its_columns(spark, tmp_path):
    path = str(tmp_path / "integrated")
    registry.integrated(spark, SMALL).write.parquet(path)
    plan = physical_plan(aggregate.most_sold_products(spark.read.parquet(path)))
    assert "ReadSchema: struct<order_id:bigint,product_id:bigint>" in plan


def test_unneeded_sides_are_left_out(spark):
    tables = registry.prepared(spark, SMALL)
    plan = physical_plan(integrate(tables, ["order_id", "seller_id"]))
    for absent in ("geo_point", "review_score", "payment_value", "product_category_name"):
        assert absent not in plan


def test_column_choice_does_not_change_the_rows(spark):
    columns = ["order_id", "product_id", "seller_id", "price", "payment_value", "review_score"]
    full = registry.integrated(spark, SMALL).select(*columns)
    assert bag(registry.integrated(spark, SMALL, columns)) == bag(full)


def test_ranked_levels_are_limited_before_the_shuffle(spark):
    plan = physical_plan(rank.top_products_by_orders(registry.dense(spark, SMALL)))
    assert plan.count("WindowGroupLimit") >= 2
    assert plan.index("WindowGroupLimit") > plan.index("Window ")


def test_top_k_does_not_sort_everything(spark):
    counts = explore.products_by_orders(fx.frame(spark, SMALL, "f_order_items"))
    plan = physical_plan(report.top_k(counts, 10, "-total_order", "product_id"))
    assert "TakeOrderedAndProject" in plan
    assert "rangepartitioning" not in plan


def test_one_row_per_key_is_reduced_before_the_shuffle(spark):
    plan = physical_plan(one_row_per_key(fx.frame(spark, SMALL, "f_payments"), ["order_id"]))
    assert "partial_min" in plan
    assert plan.count("Exchange") == 1


def test_order_joins_share_one_partitioning(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1",
         spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    tables = registry.prepared(spark, SMALL)
    plan = physical_plan(integrate(tables, ["order_id", "price", "payment_value", "review_score"]))
    # Items, orders, reviews and payments: once each by order.
    assert plan.count("Exchange hashpartitioning(order_id") == 4


def test_product_metrics_take_one_scan(spark, tmp_path):
    path = str(tmp_path / "integrated")
    registry.integrated(spark, SMALL).write.parquet(path)
    plan = physical_plan(aggregate.product_metrics(spark.read.parquet(path)))
    assert plan.count("FileScan") == 1
    assert "Expand" not in plan


def test_product_metrics_are_shuffled_once_by_product(spark):
    df = spark.createDataFrame(
        [(p, s, f"o{i}", price) for p in ("p", "q", None) for i, (s, price) in enumerate(
            [("b", 2.5), ("a", 1.0), ("b", None), (None, 7.25), ("a", 1.0)])]
        + [("r", None, "o9", 3.0)],
        "product_id string, seller_id string, order_id string, price double")
    metrics = aggregate.product_metrics(df.repartition(4))
    assert physical_plan(metrics).count("Exchange hashpartitioning") == 1
    assert dict(metrics.dtypes)["unique_seller_count"] == "bigint"
    assert bag(metrics) == bag(aggregate.product_metrics(df, 2))


def test_narrow_attributes_of_items_join_first(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1",
         spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    orders = integrate(registry.prepared(spark, SMALL))
    shuffled = [line for line in physical_plan(orders).splitlines()
                if "Exchange hashpartitioning(" in line]
    # the tree is printed from the last join down
    kinds = [k for line in shuffled for k in ("product_id", "seller_id") if f"({k}#" in line]
    assert kinds[:1] == ["product_id"]
    names = orders.columns
    assert names.index("product_weight_g") < names.index("seller_zip_code_prefix")


def test_quantiles_scan_twice_and_sort_brackets_only(spark):
    plan = final_plan(registry.QUERIES["cln_price_cutoffs"](spark, SMALL))
    assert plan.count("FileScan parquet") - plan.count("ReusedExchange") <= 2
    assert "reflect" not in plan


@pytest.mark.parametrize("partitions", ["1", "3", "17"])
def test_integration_does_not_depend_on_partitioning(spark, conf, partitions):
    expected = bag(registry.integrated(spark, SMALL))
    conf(spark__sql__shuffle__partitions=partitions)
    shuffled = {
        name: df.repartition(int(partitions), F.rand(3))
        for name, df in registry.prepared(spark, SMALL).items()
    }
    assert bag(integrate(shuffled)) == expected


def test_orders_are_sorted_by_order_first_for_the_choice_of_one_row(spark):
    plan = physical_plan(integrate(registry.prepared(spark, SMALL)))
    assert "Sort [customer_unique_id" not in plan
    assert "Sort [order_id" in plan


def test_the_last_join_of_the_integration_adds_the_items(spark):
    tables = registry.prepared(spark, SMALL)
    plan = physical_plan(integrate(tables))
    joins = [line for line in plan.splitlines() if "Join" in line and "order_id" in line]
    assert "Inner" in joins[0] and all("LeftOuter" in line for line in joins[1:3])
    assert integrate(tables).columns[:1] == ["order_id"]
    assert integrate(tables).columns[-1] == "payment_value"


def test_hash_joins_neither_sort_nor_stay_set(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1",
         spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    orders = fx.frame(spark, SMALL, "f_orders")
    customers = fx.frame(spark, SMALL, "f_customers").select("customer_id", "customer_city")

    def joined():
        return orders.join(customers, "customer_id")

    expected = bag(joined())
    assert "ShuffledHashJoin" not in final_plan(joined())
    before = spark.conf.get(HASH_JOINS)
    with hash_joins(spark):
        df = joined()
        assert "ShuffledHashJoin" in final_plan(df)
        assert bag(df) == expected
    assert spark.conf.get(HASH_JOINS) == before
    conf(**{HASH_JOINS.replace(".", "__"): "1m"})
    with hash_joins(spark):
        assert spark.conf.get(HASH_JOINS) == "1m"


def test_orders_of_a_customer_are_counted_by_rows_where_each_has_one(spark):
    integrated = registry.integrated(spark, SMALL)
    by_rows = analysis.outputs(integrated, one_row_per_order=True)
    by_ids = analysis.outputs(integrated)
    for name in ("customer_orders", "customer_retention"):
        assert bag(by_rows[name]) == bag(by_ids[name])
        assert "count(distinct" not in physical_plan(by_rows[name])


def test_checked_sums_of_the_outputs_are_not_kept_per_key(spark):
    plan = physical_plan(registry.QUERIES["job_outputs"](spark, SMALL))
    distinct = [line for line in plan.splitlines() if "count(distinct" in line]
    assert distinct and not any("sum(" in line for line in distinct)
