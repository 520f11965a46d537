"""The nine order tables, projected from the given star schema.

Each text runs on Spark and DuckDB alike, so a query and its oracle start from
the same rows. ``{name}`` stands for a raw table or an earlier projection. The
remainder tests only put nulls, gaps, repeats and dangling keys where the source
data has none; apart from such planted gaps every row of every table takes part.
"""

from __future__ import annotations

import string
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

FIXTURE_SQL = {
    # Two ids per person, zip prefix as a number.
    "f_customers": """
        SELECT c_custkey AS customer_id, c_custkey - c_custkey % 2 AS customer_unique_id,
               c_nationkey + 1000 AS customer_zip_code_prefix,
               n_name AS customer_city, r_name AS customer_state
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
        JOIN {region} ON n_regionkey = r_regionkey""",
    # Several rows per zip prefix, some prefixes missing.
    "f_geolocation": """
        SELECT s_nationkey + 1000 AS geolocation_zip_code_prefix, s_suppkey AS geo_point
        FROM {supplier} WHERE s_nationkey % 6 <> 0""",
    # Null dates in every status.
    "f_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'invoiced'
                    ELSE 'canceled' END AS order_status,
               o_orderdate AS order_purchase_timestamp,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    ELSE o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 3 AS INT)
                    END AS order_approved_at,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL
                    ELSE o_orderdate + INTERVAL '1' DAY * CAST(3 + o_orderkey % 5 AS INT)
                    END AS order_delivered_carrier_date,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL
                    ELSE o_orderdate + INTERVAL '1' DAY * CAST(8 + o_orderkey % 17 AS INT)
                    END AS order_delivered_customer_date,
               o_orderdate + INTERVAL '20' DAY AS order_estimated_delivery_date
        FROM {orders}""",
    # Unknown products and sellers, null prices.
    "f_order_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id,
               CASE WHEN l_orderkey % 211 = 0 THEN CAST(-1 AS BIGINT) ELSE l_partkey END
                   AS product_id,
               CASE WHEN l_orderkey % 223 = 0 THEN CAST(-1 AS BIGINT) ELSE l_suppkey END
                   AS seller_id,
               CASE WHEN l_orderkey % 307 = 0 THEN NULL ELSE l_extendedprice END AS price,
               l_quantity AS freight_value
        FROM {lineitem}""",
    # Few products with fixed prices, so that ranks have ties and counts above one.
    "f_order_items_dense": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id,
               l_partkey % 40 AS product_id, l_suppkey AS seller_id,
               p_retailprice AS price, l_quantity AS freight_value
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey % 40""",
    # Nulls in the imputed measures and in the category.
    "f_products": """
        SELECT p_partkey AS product_id,
               CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_type END AS product_category_name,
               CASE WHEN p_partkey % 29 = 0 THEN NULL
                    ELSE CAST(length(p_name) AS DOUBLE) END AS product_name_lenght,
               CASE WHEN p_partkey % 29 = 0 THEN NULL
                    ELSE CAST(length(p_name) * 10 AS DOUBLE) END AS product_description_lenght,
               CASE WHEN p_partkey % 29 = 0 THEN NULL
                    ELSE CAST(p_size % 6 AS DOUBLE) END AS product_photos_qty,
               CASE WHEN p_partkey % 50 = 0 THEN NULL
                    ELSE CAST(p_size * 100 AS DOUBLE) END AS product_weight_g,
               CASE WHEN p_partkey % 61 = 0 THEN NULL
                    ELSE CAST(p_size % 30 + 10 AS DOUBLE) END AS product_length_cm,
               CASE WHEN p_partkey % 67 = 0 THEN NULL
                    ELSE CAST(p_size % 20 + 5 AS DOUBLE) END AS product_height_cm,
               CASE WHEN p_partkey % 71 = 0 THEN NULL
                    ELSE CAST(p_size % 25 + 8 AS DOUBLE) END AS product_width_cm
        FROM {part}""",
    "f_sellers": """
        SELECT s_suppkey AS seller_id, s_nationkey + 1000 AS seller_zip_code_prefix
        FROM {supplier}""",
    # All raw codes and one unmapped, orders with no payment and with two.
    "f_payments": """
        SELECT o_orderkey AS order_id, 1 AS payment_sequential,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'credit_card'
                    WHEN '2-HIGH' THEN 'boleto' WHEN '3-MEDIUM' THEN 'debit_card'
                    WHEN '4-NOT SPECIFIED' THEN 'not_defined' ELSE 'voucher' END AS payment_type,
               CAST(floor(o_totalprice / 200) AS DOUBLE) AS payment_value
        FROM {orders} WHERE o_orderkey % 19 <> 0
        UNION ALL
        SELECT o_orderkey, 2, 'voucher', CAST(10 AS DOUBLE) FROM {orders}
        WHERE o_orderkey % 10 = 0""",
    # Text columns with malformed values, orders with no review and with two.
    "f_reviews": """
        SELECT o_orderkey AS order_id,
               CASE WHEN o_orderkey % 101 = 0 THEN 'n/a'
                    ELSE CAST(1 + o_orderkey % 5 AS VARCHAR(10)) END AS review_score,
               CASE WHEN o_orderkey % 103 = 0 THEN 'unknown'
                    ELSE CAST(o_orderdate + INTERVAL '10' DAY AS VARCHAR(30)) END
                   AS review_creation_date,
               CAST(o_orderdate + INTERVAL '12' DAY AS VARCHAR(30)) AS review_answer_timestamp
        FROM {orders} WHERE o_orderkey % 23 <> 0
        UNION ALL
        SELECT o_orderkey, '1', CAST(o_orderdate + INTERVAL '11' DAY AS VARCHAR(30)),
               CAST(o_orderdate + INTERVAL '13' DAY AS VARCHAR(30))
        FROM {orders} WHERE o_orderkey % 31 = 0""",
    # One category without a translation.
    "f_categories": """
        SELECT DISTINCT p_type AS product_category_name,
               lower(p_type) AS product_category_name_english
        FROM {part} WHERE p_type <> 'PROMO'""",
    # Orders and customers that repeat their keys with another status or city.
    "f_orders_repeated": """
        SELECT * FROM {f_orders} UNION ALL
        SELECT order_id, customer_id, 'returned' AS order_status, order_purchase_timestamp,
               order_approved_at, order_delivered_carrier_date, order_delivered_customer_date,
               order_estimated_delivery_date
        FROM {f_orders} WHERE order_id % 97 = 0""",
    "f_customers_repeated": """
        SELECT * FROM {f_customers} UNION ALL
        SELECT customer_id, customer_unique_id, customer_zip_code_prefix,
               'ELSEWHERE' AS customer_city, customer_state
        FROM {f_customers} WHERE customer_id % 10 = 0""",
    # Text as raw files hold it: decimal commas, unknown dates, letters for numbers, blanks.
    "f_order_items_text": """
        SELECT order_id, CASE WHEN order_id % 401 = 0 THEN 'first'
                              ELSE CAST(order_item_id AS VARCHAR(10)) END AS order_item_id,
               product_id, seller_id,
               CASE WHEN order_id % 103 = 0 THEN '12,50' WHEN order_id % 107 = 0 THEN ''
                    ELSE CAST(CAST(price AS DECIMAL(18, 2)) AS VARCHAR(30)) END AS price,
               CASE WHEN order_id % 109 = 0 THEN 'free'
                    ELSE CAST(CAST(freight_value AS DECIMAL(18, 2)) AS VARCHAR(30)) END
                   AS freight_value
        FROM {f_order_items}""",
    "f_orders_text": """
        SELECT order_id, customer_id, order_status,
               CASE WHEN order_id % 113 = 0 THEN 'unknown'
                    ELSE CAST(order_purchase_timestamp AS VARCHAR(30)) END
                   AS order_purchase_timestamp,
               CASE WHEN order_id % 127 = 0 THEN '2018-13-45'
                    ELSE CAST(order_approved_at AS VARCHAR(30)) END AS order_approved_at
        FROM {f_orders}""",
    # Repeated rows.
    "f_orders_dup": """
        SELECT * FROM {f_orders} UNION ALL SELECT * FROM {f_orders} WHERE order_id % 97 = 0""",
}

MODEL = {
    "customers": "f_customers",
    "geolocation": "f_geolocation",
    "order_items": "f_order_items",
    "payments": "f_payments",
    "reviews": "f_reviews",
    "orders": "f_orders",
    "products": "f_products",
    "sellers": "f_sellers",
    "categories": "f_categories",
}


@cache
def names_in(sql: str) -> tuple[str, ...]:
    """Placeholders of a text, in order of first use."""
    return tuple(dict.fromkeys(f for _, f, _, _ in string.Formatter().parse(sql) if f))


def frame(
    spark: SparkSession, sf_dir: str, name: str, built: dict[str, DataFrame] | None = None
) -> DataFrame:
    """A raw table or a projection as a lazy DataFrame; ``built`` holds those made so far."""
    built = {} if built is None else built
    if name not in built:
        if name in RAW_TABLES:
            built[name] = _raw_table(spark, f"{sf_dir}/{name}.parquet")
        else:
            sql = FIXTURE_SQL[name]
            inputs = {n: frame(spark, sf_dir, n, built) for n in names_in(sql)}
            built[name] = spark.sql(sql, **inputs)
    return built[name]


_SCHEMAS: dict[str, StructType] = {}


def _raw_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; its schema is read from the footers once per process."""
    reader = spark.read.schema(_SCHEMAS[path]) if path in _SCHEMAS else spark.read
    df = reader.parquet(path)
    _SCHEMAS.setdefault(path, df.schema)
    return df


def tables(spark: SparkSession, sf_dir: str, **replaced: str) -> dict[str, DataFrame]:
    """The nine tables; keywords put another projection in a table's place."""
    built: dict[str, DataFrame] = {}
    return {t: frame(spark, sf_dir, f, built) for t, f in {**MODEL, **replaced}.items()}
