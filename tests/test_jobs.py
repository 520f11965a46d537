"""The batch jobs end to end, from CSV files to outputs and catalogue tables."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from ledgerloom.__main__ import main
from ledgerloom.operators.enrich import observed_statuses
from ledgerloom.operators.integrate import grain_check
from ledgerloom.plans import analysis, cleaning
from ledgerloom.plans.workspace import fresh_folder
from ledgerloom.sinks import writers
from ledgerloom.sources import contracts, readers
from tests.conftest import SMALL
from tests.helpers import bag, physical_plan, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test data not present")

PREFIX = "shop_"


def with_contract_columns(df, ddl, spark):
    """Fixture columns as the raw contract has them; columns the fixture lacks are null."""
    schema = spark.createDataFrame([], ddl).schema
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast("string").alias(f.name)
        for f in schema
    ])


@pytest.fixture(scope="module")
def raw_path(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("raw"))
    for name, df in fx.tables(spark, SMALL, orders="f_orders_dup").items():
        lead = "" if name in contracts.UNPREFIXED_FILES else PREFIX
        text = with_contract_columns(df, contracts.RAW_SCHEMAS[name], spark)
        text.write.csv(f"{base}/{lead}{contracts.RAW_FILES[name]}", header=True)
    return base


@pytest.fixture(scope="module")
def folders(spark, raw_path, tmp_path_factory):
    base = tmp_path_factory.mktemp("out")
    cleaned, analysed = str(base / "cleaned"), str(base / "analysed")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shop_out LOCATION '{base}/database'")
    main(["clean", raw_path, cleaned, "--prefix", PREFIX, "--single-file"])
    main(["analyse", cleaned, analysed, "--database", "shop_out"])
    return cleaned, analysed


def output(spark, folders, name):
    return spark.read.parquet(f"{folders[1]}/{contracts.OUTPUT_NAMES[name]}")


def test_every_cleaned_table_is_one_file(folders):
    for folder in contracts.CLEANED_FOLDERS.values():
        files = [f for f in os.listdir(f"{folders[0]}/{folder}") if f.endswith(".parquet")]
        assert len(files) == 1


def test_cleaned_types(spark, folders):
    tables = readers.load_parquet_tables(spark, folders[0])
    for name, targets in contracts.CORRECTED_TYPES.items():
        assert {c: dict(tables[name].dtypes)[c] for c in targets} == targets
    assert tables["orders"].count() == 1500
    assert "product_weight_category" in tables["products"].columns


def test_every_output_is_written_and_registered(spark, folders):
    for name, folder in contracts.OUTPUT_NAMES.items():
        written = output(spark, folders, name)
        assert written.count() > 0, name
        assert bag(written) == bag(spark.table(f"shop_out.{folder}")), name


def test_complete_orders_have_the_order_grain(spark, folders):
    complete = output(spark, folders, "complete_orders")
    count, distinct, unique = rows(grain_check(complete))[0]
    assert unique and count == distinct > 0
    assert {"is_delivered", "customer_type", "product_category_name_english"} <= set(complete.columns)
    assert {c for c in complete.columns if c.startswith("is_")} == {
        "is_canceled", "is_delivered", "is_invoiced"}
    flags = sum(F.col(c).cast("int") for c in complete.columns if c.startswith("is_"))
    assert complete.where(flags != 1).count() == 0


def test_outputs_agree_with_each_other(spark, folders):
    orders = output(spark, folders, "complete_orders")
    spending = output(spark, folders, "customer_spending")
    retention = output(spark, folders, "customer_retention")
    assert bag(spending.select("customer_unique_id", "total_orders")) == bag(
        retention.select("customer_unique_id", "total_orders"))
    products = output(spark, folders, "seller_products")
    for ranked in ("ranked_products", "dense_ranked_products"):
        top = output(spark, folders, ranked)
        assert not bag(top.select(*products.columns)) - bag(products)
        assert top.select("seller_id").distinct().count() == orders.select("seller_id").distinct().count()
    assert rows(output(spark, folders, "monthly_stats").agg(F.sum("total_orders"))) == [(orders.count(),)]


def test_stored_outputs_equal_lazy_outputs(spark, folders):
    integrated = spark.read.parquet(f"{folders[1]}/{analysis.INTEGRATED_FOLDER}")
    statuses = observed_statuses(integrated)
    for name, df in analysis.outputs(integrated, statuses=statuses).items():
        assert bag(df) == bag(output(spark, folders, name)), name


def test_output_order_is_kept_in_the_files(spark, folders):
    months = output(spark, folders, "monthly_stats").select("purchase_year", "purchase_month")
    assert rows(months) == sorted(rows(months))


def test_a_second_run_overwrites(spark, folders):
    before = bag(output(spark, folders, "seller_performance"))
    orders = bag(output(spark, folders, "complete_orders").select("order_id", "purchase_year"))
    analysis.run_analysis(spark, *folders, partition_orders_by=["purchase_year"])
    assert bag(output(spark, folders, "seller_performance")) == before
    again = output(spark, folders, "complete_orders")
    assert bag(again.select("order_id", "purchase_year")) == orders
    year = again.first().purchase_year
    assert "PartitionFilters: [isnotnull(purchase_year" in physical_plan(
        again.where(F.col("purchase_year") == year))


def test_explore_prints_every_result(spark, raw_path, capsys):
    main(["explore", raw_path, "--prefix", PREFIX, "--rows", "3"])
    printed = capsys.readouterr().out
    for name in ("row_counts", "null_profile", "duplicates", "payment_types", "products_by_revenue"):
        assert f"\n{name}\n" in printed


# --- readers and writers -----------------------------------------------------


def test_explicit_schema_keeps_leading_zeros_and_inference_does_not(spark, tmp_path):
    path = tmp_path / "sellers.csv"
    path.write_text("seller_id,seller_zip_code_prefix,seller_city,seller_state\na,01046,x,y\n")
    typed = readers.read_csv(spark, str(path), contracts.RAW_SCHEMAS["sellers"])
    assert rows(typed.select("seller_zip_code_prefix")) == [("01046",)]
    assert rows(readers.read_csv(spark, str(path)).select("seller_zip_code_prefix")) == [(1046,)]


def test_moved_columns_fail_instead_of_being_misread(spark, tmp_path):
    path = tmp_path / "categories.csv"
    path.write_text("product_category_name_english,product_category_name\nb,a\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, str(path), contracts.RAW_SCHEMAS["categories"]).collect()


def test_quoted_line_breaks_stay_in_one_record(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,"
        "review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,"good ""very""","line one\nline two",2018-01-01 00:00:00,2018-01-02 10:11:12\n')
    df = readers.read_csv(spark, str(path), contracts.RAW_SCHEMAS["reviews"], multi_line=True)
    row = df.first()
    assert row.review_comment_title == 'good "very"'
    assert row.review_comment_message == "line one\nline two"


def test_timestamps_are_read_without_a_zone(spark, tmp_path, conf):
    conf(spark__sql__session__timeZone="America/Sao_Paulo")
    path = tmp_path / "orders.csv"
    path.write_text(",".join(f.split()[0] for f in contracts.RAW_SCHEMAS["orders"].split(","))
                    + "\no,c,delivered,2018-10-21 00:30:00,,,,\n")
    df = readers.read_csv(spark, str(path), contracts.RAW_SCHEMAS["orders"])
    assert df.first().order_purchase_timestamp == datetime(2018, 10, 21, 0, 30)
    assert df.first().order_approved_at is None


def test_partitioned_write_allows_pruning(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(10).select("id", (F.col("id") % 2).alias("year"))
    writers.write_parquet(df, path, partition_by=["year"], max_records_per_file=2)
    assert sorted(d for d in os.listdir(path) if d.startswith("year")) == ["year=0", "year=1"]
    assert len([f for f in os.listdir(f"{path}/year=0") if f.endswith(".parquet")]) >= 3
    plan = spark.read.parquet(path).where("year = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_reused_frame_is_released(spark):
    df = spark.range(5)
    with writers.reused(df) as kept:
        derived = kept.withColumn("x", F.lit(1))
        assert kept.is_cached and derived.count() == 5
    assert not df.is_cached


def test_working_folder_is_new_each_time(spark):
    first, second = fresh_folder(spark, "x"), fresh_folder(spark, "x")
    assert first != second
    assert first.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_working_folder_must_be_named():
    class Unset:
        conf = {}
        sparkContext = property(lambda self: self)

        def getCheckpointDir(self):
            return None

    with pytest.raises(RuntimeError):
        fresh_folder(Unset(), "x")


def test_an_order_with_two_times_counts_once(spark, tmp_path):
    tables = cleaning.clean_tables(fx.tables(spark, SMALL))
    later = tables["orders"].where("order_id % 7 = 0").withColumn(
        "order_purchase_timestamp", F.expr("order_purchase_timestamp + INTERVAL '1' DAY"))
    tables["orders"] = tables["orders"].unionByName(later)
    cleaned, analysed = str(tmp_path / "cleaned"), str(tmp_path / "analysed")
    writers.write_parquet_tables(tables, cleaned, contracts.CLEANED_FOLDERS)
    analysis.run_analysis(spark, cleaned, analysed)
    integrated = spark.read.parquet(f"{analysed}/{analysis.INTEGRATED_FOLDER}")
    distinct = integrated.select("order_id").distinct().count()
    assert distinct < integrated.count()
    for name, column in (("customer_orders", "total_order"), ("customer_retention", "total_orders")):
        counted = output(spark, (cleaned, analysed), name).agg(F.sum(column)).first()[0]
        assert counted == distinct
    assert not os.path.exists(f"{analysed}/{analysis.CUSTOMER_ORDERS}")
