"""Hot keys: the salted and levelled paths give the plain result, and spread the rows."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import fixtures as fx
from ledgerloom.operators import rank
from ledgerloom.operators.integrate import hot_zips, integrate
from ledgerloom.operators.lookup import hot_keys, lookup_join
from ledgerloom.operators.quantiles import quantiles
from tests.conftest import SMALL
from tests.helpers import bag, final_plan, rows


def skewed(spark, n=4000):
    """A third of the rows share key 0, a tenth have no key, key 9999 is unknown."""
    key = (
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 10 == 1, None)
        .when(F.col("id") % 101 == 2, 9999).otherwise(F.col("id") % 50)
    )
    return spark.range(n).select(key.alias("k"), F.col("id").alias("row"))


def lookup_table(spark):
    return spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_equals_plain_join(spark, always_salt, how):
    facts, table = skewed(spark), lookup_table(spark)
    salted = lookup_join(facts, table, ["k"], how)
    assert bag(salted) == bag(facts.join(table, "k", how))
    assert set(salted.columns) == set(facts.join(table, "k", how).columns)


def test_salted_join_keeps_repeated_lookup_rows(spark, always_salt):
    facts, table = skewed(spark), lookup_table(spark)
    twice = table.union(table)
    assert bag(lookup_join(facts, twice, ["k"])) == bag(facts.join(twice, "k"))


def test_hot_keys_are_few_and_exact(spark):
    hot = rows(hot_keys(skewed(spark, 3000), ["k"]))
    # 1,000 of 2,800 rows with a key: more than 1/8 of them, in 3 average partitions.
    assert hot == [(0, 3)]


def test_hot_key_is_spread_over_tasks(spark, always_salt, conf):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false",
         spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    facts, table = skewed(spark, 40_000), lookup_table(spark)

    def largest_share(df):
        per_task = df.groupBy(F.spark_partition_id().alias("p")).count()
        counts = [n for _, n in rows(per_task)]
        return max(counts) / sum(counts)

    plain = largest_share(facts.join(table, "k"))
    salted = largest_share(lookup_join(facts, table, ["k"]))
    assert plain > 0.33
    assert salted < plain - 0.05


def test_rejects_other_join_types(spark):
    with pytest.raises(ValueError):
        lookup_join(spark.range(1), spark.range(1), ["id"], "full")


def test_small_sides_join_plainly(spark):
    plan = final_plan(lookup_join(skewed(spark), lookup_table(spark), ["k"]))
    assert "_salt" not in plan


def skewed_tables(spark):
    """The fixture with a third of its rows on one product, seller, customer and zip prefix."""
    tables = fx.tables(spark, SMALL)

    def hot(df, key, column, value):
        return df.withColumn(column, F.when(F.col(key) % 3 == 0, value).otherwise(F.col(column)))

    items = hot(tables["order_items"], "order_id", "product_id", 7)
    tables["order_items"] = hot(items, "price", "seller_id", 5)
    tables["orders"] = hot(tables["orders"], "order_id", "customer_id", 3)
    tables["customers"] = hot(
        tables["customers"], "customer_id", "customer_zip_code_prefix", 1001)
    return tables


def test_integration_is_the_same_when_salted(spark, conf):
    plain = bag(integrate(skewed_tables(spark)))
    conf(ledgerloom__join__salted="true", spark__sql__autoBroadcastJoinThreshold="-1")
    tables = skewed_tables(spark)
    assert rows(hot_keys(tables["order_items"], ["product_id"]).select("product_id")) == [(7,)]
    assert rows(hot_keys(tables["orders"], ["customer_id"]).select("customer_id")) == [(3,)]
    salted = integrate(tables)
    assert "_salt" in salted._jdf.queryExecution().analyzed().toString()
    assert bag(salted) == plain


@pytest.mark.parametrize("replaced", [
    {}, {"orders": "f_orders_repeated", "customers": "f_customers_repeated"}])
def test_hot_keys_of_the_integration_run_none_of_its_joins_again(spark, always_salt, replaced):
    plan = integrate(fx.tables(spark, SMALL, **replaced))._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("Join LeftSemi") == 2


def test_hot_zips_of_the_orders(spark):
    tables = skewed_tables(spark)
    placed = lookup_join(tables["orders"], tables["customers"], ["customer_id"])
    found = rows(hot_zips(tables["orders"], tables["customers"]))
    assert 1001 in [zip_code for zip_code, _ in found]
    assert sorted(found) == sorted(rows(hot_keys(placed, ["customer_zip_code_prefix"])))


@pytest.mark.parametrize("salted", [False, True])
def test_ranks_equal_window_ranks_for_a_hot_seller(spark, request, salted):
    if salted:
        request.getfixturevalue("always_salt")
    draw = random.Random(5)
    data = [
        (None if i % 17 == 0 else (0 if i % 3 else i % 7), i, None if i % 11 == 0 else 1.5 * (i % 9),
         draw.choice([1, 1, 1, 2, 3, 4, 5, 6, 7]))
        for i in range(600)
    ]
    products = spark.createDataFrame(
        data, "seller_id int, product_id int, price double, total_orders long"
    ).withColumn("total_revenue", F.col("price") * F.col("total_orders"))

    def windowed(function, measure, name):
        w = Window.partitionBy("seller_id").orderBy(F.col(measure).desc_nulls_last())
        return products.withColumn(name, function().over(w)).where(F.col(name) <= 5)

    assert bag(rank.top_products_by_orders(products)) == bag(
        windowed(F.rank, "total_orders", "rank"))
    assert bag(rank.top_products_by_revenue(products)) == bag(
        windowed(F.dense_rank, "total_revenue", "dense_rank"))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    values=st.lists(
        st.one_of(
            st.floats(allow_nan=False, allow_infinity=True),
            st.sampled_from([0.0, -0.0, 1.0, 1.01, 99.99, 1e-300, 1e300]),
            st.integers(-5, 5).map(float),
        ),
        min_size=1, max_size=60),
    probabilities=st.lists(st.floats(0.0, 1.0), min_size=1, max_size=3),
)
def test_quantiles_are_order_statistics(spark, values, probabilities):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranked = sorted(values)
    expected = []
    for p in probabilities:
        need = max(1, -(-p * len(ranked) // 1))
        expected.append(ranked[int(need) - 1])
    assert rows(quantiles(df, "v", probabilities))[0][0] == expected


def test_tiny_values_beside_small_ones(spark):
    """Four hundred values below 1e-9 and one of 0.0019: each rank ends at one value."""
    df = spark.range(400).selectExpr("(id + 1) * 1e-15 AS v").unionByName(
        spark.createDataFrame([(0.0019,)], "v double"))
    assert rows(quantiles(df, "v", [0.5, 1.0]))[0][0] == [201 * 1e-15, 0.0019]


def test_quantiles_equal_the_exact_summary(spark):
    items = fx.frame(spark, SMALL, "f_order_items")
    probabilities = [0.0, 0.01, 0.2, 0.5, 0.99, 1.0]
    assert rows(quantiles(items, "price", probabilities))[0][0] == items.approxQuantile(
        "price", probabilities, 0.0)
