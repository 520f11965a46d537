"""The same results in plain SQL, written independently of the DataFrame code.

A text names raw tables, fixture projections and other steps in braces;
``oracle_sql`` turns those into common table expressions.
"""

from __future__ import annotations

from checks.fixtures import FIXTURE_SQL, MODEL, RAW_TABLES, names_in
from checks.registry import MOST_SELLERS, OUTPUT_MEASURES, SALTED

# Four places more than any amount in the fixtures has.
MONEY = "CAST(sum(CAST({0} AS DECIMAL(38,10))) AS DOUBLE)"
R2 = "CAST(round(CAST({0} AS DECIMAL(38,6)), 2) AS DOUBLE)"


def money(column: str) -> str:
    return MONEY.format(column)


def r2(expression: str) -> str:
    return R2.format(expression)


def mode(column: str) -> str:
    return (
        f"coalesce({column}, (SELECT m.v FROM (SELECT {column} AS v, count(*) AS n "
        f"FROM {{f_products}} WHERE {column} IS NOT NULL GROUP BY 1) m "
        f"ORDER BY m.n DESC, m.v LIMIT 1)) AS {column}"
    )


def days(end: str, start: str) -> str:
    return f"CAST(date_diff('day', CAST({start} AS DATE), CAST({end} AS DATE)) AS INTEGER)"


PURCHASE, APPROVED = "order_purchase_timestamp", "order_approved_at"
CARRIER, CUSTOMER = "order_delivered_carrier_date", "order_delivered_customer_date"
ESTIMATED = "order_estimated_delivery_date"

DURATIONS = f"""
    {days(PURCHASE, APPROVED)} AS approval_time,
    {days(APPROVED, CARRIER)} AS carrier_handling_time,
    {days(ESTIMATED, CUSTOMER)} AS delivery_delay,
    {days(CUSTOMER, PURCHASE)} AS delivery_duration,
    {days(CARRIER, CUSTOMER)} AS shipping_time"""

CALENDAR = f"""
    CAST(day({PURCHASE}) AS INTEGER) AS purchase_day,
    strftime({PURCHASE}, '%a') AS purchase_day_name,
    CAST(month({PURCHASE}) AS INTEGER) AS purchase_month,
    strftime({PURCHASE}, '%b') AS purchase_month_name,
    CAST(year({PURCHASE}) AS INTEGER) AS purchase_year"""


def imputed(source: str) -> str:
    return f"""
        SELECT order_id, customer_id, order_status, {PURCHASE}, {APPROVED},
               CASE WHEN order_status = 'delivered' AND {CARRIER} IS NULL
                    THEN make_timestamp(CAST((epoch({APPROVED}) + epoch({CUSTOMER})) / 2 * 1000000
                                             AS BIGINT))
                    ELSE {CARRIER} END AS {CARRIER},
               {CUSTOMER}, {ESTIMATED}
        FROM (SELECT order_id, customer_id, order_status, {PURCHASE},
                     CASE WHEN order_status = 'delivered' THEN coalesce({APPROVED}, {PURCHASE})
                          ELSE {APPROVED} END AS {APPROVED},
                     {CARRIER},
                     CASE WHEN order_status = 'delivered' THEN coalesce({CUSTOMER}, {ESTIMATED})
                          ELSE {CUSTOMER} END AS {CUSTOMER},
                     {ESTIMATED}
              FROM {{{source}}}) filled"""


def bands(source: str) -> str:
    def q(p: str) -> str:
        return f"(SELECT quantile_disc(product_weight_g, {p}) FROM {{{source}}})"

    return f"""
        SELECT *, CASE WHEN product_weight_g <= {q('0.2')} THEN 'Very Light'
                       WHEN product_weight_g <= {q('0.4')} THEN 'Light'
                       WHEN product_weight_g <= {q('0.6')} THEN 'Medium'
                       WHEN product_weight_g <= {q('0.8')} THEN 'Heavy'
                       ELSE 'Very Heavy' END AS product_weight_category
        FROM {{{source}}}"""


def inside_cutoffs(source: str) -> str:
    return f"""
        SELECT * FROM {{{source}}}
        WHERE price >= (SELECT quantile_disc(price, 0.01) FROM {{{source}}})
          AND price <= (SELECT quantile_disc(price, 0.99) FROM {{{source}}})"""


def typed_reviews(source: str) -> str:
    return f"""
        SELECT order_id, TRY_CAST(review_score AS INTEGER) AS review_score,
               TRY_CAST(review_creation_date AS TIMESTAMP) AS review_creation_date,
               TRY_CAST(review_answer_timestamp AS TIMESTAMP) AS review_answer_timestamp
        FROM {{{source}}}"""


def first(source: str, key: str, *order: str) -> str:
    keys = ", ".join(f"{c} NULLS FIRST" for c in order)
    return f"""
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {keys}) AS rn
            FROM {source}) numbered
        WHERE rn = 1"""


def integrated(
    orders: str, items: str, customers: str, geolocation: str, products: str, sellers: str,
    reviews: str, payments: str, categories: str, product_columns: str = "",
) -> str:
    survivors = f"""(
        SELECT i.* FROM {{{items}}} i
        WHERE EXISTS (SELECT 1 FROM {{{products}}} p WHERE p.product_id = i.product_id)
          AND EXISTS (SELECT 1 FROM {{{sellers}}} s WHERE s.seller_id = i.seller_id))"""
    item = first(survivors, "order_id", "order_item_id", "product_id", "seller_id", "price",
                 "freight_value")
    point = first(f"{{{geolocation}}}", "geolocation_zip_code_prefix", "geo_point")
    review = first(f"{{{reviews}}}", "order_id", "review_creation_date",
                   "review_answer_timestamp", "review_score")
    payment = first(f"{{{payments}}}", "order_id", "payment_sequential", "payment_type",
                    "payment_value")
    # one row per customer, order and purchase: repeated rows differ in status or city
    placed = f"""(
        SELECT * EXCLUDE (number) FROM (
            SELECT o.*, c.* EXCLUDE (customer_id), row_number() OVER (
                PARTITION BY c.customer_unique_id, o.order_id, o.{PURCHASE}
                ORDER BY o.customer_id, o.order_status NULLS FIRST, c.customer_city NULLS FIRST)
                AS number
            FROM {{{orders}}} o JOIN {{{customers}}} c ON c.customer_id = o.customer_id)
        WHERE number = 1)"""
    return f"""
        SELECT o.*, g.*, i.* EXCLUDE (order_id),
               p.* EXCLUDE (product_id), s.* EXCLUDE (seller_id),
               k.* EXCLUDE (product_category_name), r.* EXCLUDE (order_id),
               y.* EXCLUDE (order_id)
        FROM {placed} o
        JOIN ({item}) i ON i.order_id = o.order_id
        JOIN {{{products}}} p ON p.product_id = i.product_id
        JOIN {{{sellers}}} s ON s.seller_id = i.seller_id
        LEFT JOIN ({point}) g ON g.geolocation_zip_code_prefix = o.customer_zip_code_prefix
        LEFT JOIN {{{categories}}} k ON k.product_category_name = p.product_category_name
        LEFT JOIN ({review}) r ON r.order_id = o.order_id
        LEFT JOIN ({payment}) y ON y.order_id = o.order_id"""


SOURCES = dict(
    orders="p_orders", items="f_order_items", customers="f_customers",
    geolocation="f_geolocation", products="f_products", sellers="f_sellers",
    reviews="p_reviews", payments="f_payments", categories="f_categories",
)
CLEANED = dict(
    orders="k_orders", items="k_items", customers="k_customers", geolocation="k_geolocation",
    products="k_products", sellers="k_sellers", reviews="k_reviews", payments="k_payments",
    categories="f_categories",
)

MONTHLY = f"""
    SELECT purchase_month_name, purchase_month, purchase_year,
           {money('price')} AS seller_revenue, {money('payment_value')} AS customer_spend,
           {money('freight_value')} AS total_freight, count(order_id) AS total_orders,
           min(price) AS min_order_value, max(price) AS max_order_value,
           {r2(money('price') + ' / count(order_id)')} AS aov_seller,
           {r2(money('payment_value') + ' / count(order_id)')} AS aov_customer
    FROM {{SOURCE}} GROUP BY 1, 2, 3"""


TEXT2 = "format('{{{{:,.2f}}}}', {0})"
TEXT0 = "format('{{{{:,.0f}}}}', CAST({0} AS DOUBLE))"


def monthly_report(source: str) -> str:
    amounts = (
        "seller_revenue", "customer_spend", "total_freight", "aov_seller", "aov_customer",
        "min_order_value", "max_order_value",
    )
    texts = ", ".join(f"{TEXT2.format(c)} AS {c}" for c in amounts)
    return f"""
        SELECT purchase_month_name, purchase_year, {TEXT0.format('total_orders')} AS total_orders,
               {texts}
        FROM {{{source}}}"""


TYPE_OF_PAYMENT = """CASE payment_type WHEN 'credit_card' THEN 'credit card'
    WHEN 'boleto' THEN 'bank transfer' WHEN 'debit_card' THEN 'debit card'
    WHEN 'not_defined' THEN 'other' ELSE payment_type END"""

SEGMENT = """CASE WHEN "AOV" > 1500 THEN 'Premium' WHEN "AOV" > 700 THEN 'Medium'
    ELSE 'Standard' END"""

STEPS = {
    **FIXTURE_SQL,
    # Prepared tables: calendar columns, numeric review score.
    "p_orders": f"SELECT *, {CALENDAR} FROM {{f_orders}}",
    "p_reviews": """SELECT order_id, TRY_CAST(review_score AS INTEGER) AS review_score,
        review_creation_date, review_answer_timestamp FROM {f_reviews}""",
    "x_orders": integrated(**SOURCES),
    "p_orders_repeated": f"SELECT *, {CALENDAR} FROM {{f_orders_repeated}}",
    "x_repeated": integrated(**{
        **SOURCES, "orders": "p_orders_repeated", "customers": "f_customers_repeated"}),
    "x_dense": integrated(**{**SOURCES, "items": "f_order_items_dense"}),
    # Cleaned tables.
    "k_imputed": imputed("f_orders_dup"),
    "k_orders": f"SELECT DISTINCT *, {DURATIONS}, {CALENDAR} FROM {{k_imputed}}",
    "k_customers": """SELECT DISTINCT customer_id, customer_unique_id,
        CAST(customer_zip_code_prefix AS VARCHAR) AS customer_zip_code_prefix,
        customer_city, customer_state FROM {f_customers}""",
    "k_geolocation": """SELECT DISTINCT
        CAST(geolocation_zip_code_prefix AS VARCHAR) AS geolocation_zip_code_prefix, geo_point
        FROM {f_geolocation}""",
    "k_sellers": """SELECT DISTINCT seller_id,
        CAST(seller_zip_code_prefix AS VARCHAR) AS seller_zip_code_prefix FROM {f_sellers}""",
    "k_distinct_items": "SELECT DISTINCT * FROM {f_order_items}",
    "k_items": inside_cutoffs("k_distinct_items"),
    "k_payments": f"""SELECT DISTINCT order_id, payment_sequential,
        {TYPE_OF_PAYMENT} AS payment_type, payment_value FROM {{f_payments}}""",
    "k_typed_reviews": typed_reviews("f_reviews"),
    "k_reviews": "SELECT DISTINCT * FROM {k_typed_reviews}",
    "imputed_products": f"""
        SELECT product_id, product_category_name, product_name_lenght,
               product_description_lenght, product_photos_qty, {mode('product_weight_g')},
               {mode('product_length_cm')}, {mode('product_height_cm')},
               {mode('product_width_cm')}
        FROM {{f_products}}""",
    "k_distinct_products": "SELECT DISTINCT * FROM {imputed_products}",
    "k_products": bands("k_distinct_products"),
    "k_full": integrated(**CLEANED),
    # Shared results.
    "a_products": """
        SELECT seller_id, product_id, price, count(order_id) AS total_orders,
               price * count(order_id) AS total_revenue
        FROM {x_dense} GROUP BY 1, 2, 3""",
    "a_spending": f"""
        SELECT customer_unique_id, count(order_id) AS total_orders,
               {money('payment_value')} AS revenue,
               {r2(money('payment_value') + ' / count(order_id)')} AS "AOV"
        FROM {{x_orders}} GROUP BY 1""",
    "a_performance": f"""
        SELECT seller_id, count(order_id) AS total_orders, {money('price')} AS total_revenue,
               {r2('avg(review_score)')} AS avg_review_score,
               {r2('stddev_samp(price)')} AS price_variability
        FROM {{x_orders}} GROUP BY 1""",
    "a_monthly": MONTHLY.replace("{SOURCE}", "{x_orders}"),
    "k_monthly": MONTHLY.replace("{SOURCE}", "{k_full}"),
    "a_retention": f"""
        SELECT customer_unique_id, min({PURCHASE}) AS first_order_date,
               max({PURCHASE}) AS last_order_date, count(DISTINCT order_id) AS total_orders,
               {money('payment_value')} AS total_amount_spent,
               {r2(money('payment_value') + ' / count(DISTINCT order_id)')} AS aov,
               {r2('CAST(count(DISTINCT order_id) AS DOUBLE) / '
                   '(SELECT count(*) FROM {x_orders}) * 100')} AS retention_rate
        FROM {{x_orders}} GROUP BY 1""",
    "k_spending": f"""
        SELECT customer_unique_id,
               {r2(money('payment_value') + ' / count(order_id)')} AS "AOV"
        FROM {{k_full}} GROUP BY 1""",
    # The outputs of the analysis job, over cleaned tables.
    "o_customer_orders": "SELECT customer_unique_id, count(DISTINCT order_id) AS total_order "
                         "FROM {k_full} GROUP BY 1",
    "o_seller_review_score": "SELECT seller_id, avg(review_score) AS avg_review_score "
                             "FROM {k_full} GROUP BY 1",
    "o_most_sold_products": "SELECT product_id, count(order_id) AS total_order "
                            "FROM {k_full} GROUP BY 1",
    "o_customer_purchase": f"SELECT customer_id, {money('payment_value')} AS total_amount_spent "
                           f"FROM {{k_full}} GROUP BY 1",
    "o_seller_products": """
        SELECT seller_id, product_id, price, count(order_id) AS total_orders,
               price * count(order_id) AS total_revenue FROM {k_full} GROUP BY 1, 2, 3""",
    "o_ranked_products": """
        SELECT * FROM (SELECT *, rank() OVER (PARTITION BY seller_id
            ORDER BY total_orders DESC NULLS LAST) AS "rank" FROM {o_seller_products}) ranked
        WHERE "rank" <= 5""",
    "o_dense_ranked_products": """
        SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY seller_id
            ORDER BY total_revenue DESC NULLS LAST) AS dense_rank FROM {o_seller_products}) ranked
        WHERE dense_rank <= 5""",
    "o_customer_spending": f"""
        SELECT customer_unique_id, count(order_id) AS total_orders,
               {money('payment_value')} AS revenue,
               {r2(money('payment_value') + ' / count(order_id)')} AS "AOV"
        FROM {{k_full}} GROUP BY 1""",
    "o_seller_performance": f"""
        SELECT seller_id, count(order_id) AS total_orders, {money('price')} AS total_revenue,
               {r2('avg(review_score)')} AS avg_review_score,
               {r2('stddev_samp(price)')} AS price_variability FROM {{k_full}} GROUP BY 1""",
    "o_product_metrics": f"""
        SELECT product_id, count(order_id) AS total_sales, {money('price')} AS total_revenue,
               {r2(money('price') + ' / count(price)')} AS avg_price,
               {r2('stddev_samp(price)')} AS price_volatility,
               count(DISTINCT seller_id) AS unique_seller_count FROM {{k_full}} GROUP BY 1""",
    "o_monthly_stats": "SELECT * FROM {k_monthly}",
    "o_customer_retention": f"""
        SELECT customer_unique_id, count(DISTINCT order_id) AS total_orders,
               {money('payment_value')} AS total_amount_spent,
               {r2(money('payment_value') + ' / count(DISTINCT order_id)')} AS aov,
               {r2('CAST(count(DISTINCT order_id) AS DOUBLE) / '
                   '(SELECT count(*) FROM {k_full}) * 100')} AS retention_rate
        FROM {{k_full}} GROUP BY 1""",
    "w_revenue": """
        SELECT * FROM (
            SELECT *, CAST(dense_rank() OVER (PARTITION BY seller_id
                ORDER BY total_revenue DESC NULLS LAST) AS INTEGER) AS dense_rank
            FROM {a_products}) ranked
        WHERE dense_rank <= 5""",
}

ORDER_AUDIT = (APPROVED, CARRIER, CUSTOMER)


def count_rows(tables: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f'SELECT \'{name}\' AS "table", count(*) AS "rows" FROM {{{step}}}'
        for name, step in tables.items()
    )


COLUMNS = {
    "f_customers": "customer_id, customer_unique_id, customer_zip_code_prefix, customer_city, "
                   "customer_state",
    "f_geolocation": "geolocation_zip_code_prefix, geo_point",
    "f_order_items": "order_id, order_item_id, product_id, seller_id, price, freight_value",
    "f_payments": "order_id, payment_sequential, payment_type, payment_value",
    "f_reviews": "order_id, review_score, review_creation_date, review_answer_timestamp",
    "f_orders_dup": f"order_id, customer_id, order_status, {PURCHASE}, {APPROVED}, {CARRIER}, "
                    f"{CUSTOMER}, {ESTIMATED}",
    "f_products": "product_id, product_category_name, product_name_lenght, "
                  "product_description_lenght, product_photos_qty, product_weight_g, "
                  "product_length_cm, product_height_cm, product_width_cm",
    "f_sellers": "seller_id, seller_zip_code_prefix",
    "f_categories": "product_category_name, product_category_name_english",
}


def duplicates(source: str, table: str | None = None) -> str:
    lead = f"'{table}' AS \"table\", " if table else ""
    return f"""
        SELECT {lead}count(*) AS duplicate_groups,
               CAST(coalesce(sum(copies - 1), 0) AS BIGINT) AS surplus_rows
        FROM (SELECT count(*) AS copies FROM {{{source}}} GROUP BY {COLUMNS[source]}
              HAVING count(*) > 1) repeated"""


def null_row(columns: str, source: str) -> str:
    parts = [f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in columns.split(", ")]
    return f"SELECT {', '.join(parts)} FROM {{{source}}}"


def null_rows(columns: str, source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS nulls,
            CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*) AS null_fraction
            FROM {{{source}}}"""
        for c in columns.split(", ")
    )


def bad_rows(column: str, target: str) -> str:
    return f"""SELECT '{column}' AS "column", '{target.lower()}' AS target_type,
        count(*) FILTER (WHERE {column} IS NOT NULL AND TRY_CAST({column} AS {target}) IS NULL)
            AS bad_rows
        FROM {{f_reviews}}"""


def by_place(*places: str) -> str:
    keys = ", ".join(places)
    return f'SELECT {keys}, count(customer_id) AS "count" FROM {{f_customers}} GROUP BY {keys}'


BY_STATUS = 'SELECT order_status, count(order_id) AS "count" FROM {f_orders} GROUP BY 1'

#: Typed columns of the checked tables, in the names of both engines.
CHECKED = {
    "customers": (("customer_id", "bigint"), ("customer_unique_id", "bigint"),
                  ("customer_zip_code_prefix", "int")),
    "geolocation": (("geolocation_zip_code_prefix", "int"), ("geo_point", "bigint")),
    "order_items": (("order_id", "bigint"), ("order_item_id", "int"), ("product_id", "bigint"),
                    ("seller_id", "bigint"), ("price", "double"), ("freight_value", "double")),
    "payments": (("order_id", "bigint"), ("payment_sequential", "int"),
                 ("payment_value", "double")),
    "reviews": (("order_id", "bigint"), ("review_score", "int"),
                ("review_creation_date", "timestamp_ntz"),
                ("review_answer_timestamp", "timestamp_ntz")),
    "orders": (("order_id", "bigint"), ("customer_id", "bigint"),
               (PURCHASE, "timestamp_ntz"), (APPROVED, "timestamp_ntz")),
    "products": tuple((c, "bigint" if c == "product_id" else "double") for c in (
        "product_id", "product_name_lenght", "product_description_lenght", "product_photos_qty",
        "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")),
    "sellers": (("seller_id", "bigint"), ("seller_zip_code_prefix", "int")),
    "categories": (),
}
TEXT_TABLES = {"order_items": "f_order_items_text", "orders": "f_orders_text"}


def malformed(column: str, kind: str) -> str:
    target = "TIMESTAMP" if kind == "timestamp_ntz" else kind
    text = f"CAST({column} AS VARCHAR)"
    return f"(trim({text}) <> '' AND TRY_CAST({text} AS {target}) IS NULL)"


def rejected_rows() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", CAST({c} AS VARCHAR) AS value,
            '{k}' AS target_type, order_id
            FROM {{{TEXT_TABLES.get(t, MODEL[t])}}} WHERE {malformed(c, k)}"""
        for t in ("order_items", "orders", "reviews") for c, k in CHECKED[t])


def rejected_counts() -> str:
    parts = []
    for t, typed in CHECKED.items():
        source = TEXT_TABLES.get(t, MODEL[t])
        parts += [f"""SELECT '{t}' AS "table", '{c}' AS "column", '{k}' AS target_type,
            count(*) FILTER (WHERE {malformed(c, k)}) AS bad_rows FROM {{{source}}}"""
                  for c, k in typed]
        parts.append(f"""SELECT '{t}' AS "table", 'record' AS "column", 'struct' AS target_type,
            CAST(0 AS BIGINT) AS bad_rows""")
    return " UNION ALL ".join(parts)


def profile_rows(tables: dict[str, tuple[str, str]], rows: bool = False) -> str:
    """Nulls by table and column; ``tables`` gives each its step and columns."""
    total = "count(*) AS \"rows\", " if rows else ""
    return " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", {total}
            count(*) FILTER (WHERE {c} IS NULL) AS nulls,
            CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*) AS null_fraction
            FROM {{{step}}}"""
        for t, (step, columns) in tables.items() for c in columns.split(", "))


MODEL_COLUMNS = {t: (s, COLUMNS["f_orders_dup" if t == "orders" else s])
                 for t, s in MODEL.items()}
DERIVED = ("approval_time, carrier_handling_time, delivery_delay, delivery_duration, "
           "shipping_time, purchase_day, purchase_day_name, purchase_month, purchase_month_name, "
           "purchase_year")
CLEANED_COLUMNS = {
    t: ({"order_items": "k_items", "categories": "f_categories"}.get(t, f"k_{t}"),
        columns + {"orders": f", {DERIVED}", "products": ", product_weight_category"}.get(t, ""))
    for t, (_, columns) in MODEL_COLUMNS.items()
}


def output_lines() -> str:
    parts = []
    for output, (key, *measures) in OUTPUT_MEASURES.items():
        found = {"rows": "count(*)", "keys": f"count(DISTINCT {key})"}
        found |= {m: f'sum(round(CAST("{m}" AS DECIMAL(38,6)), 2))' for m in measures}
        parts += [f"""SELECT '{output}' AS output, '{m}' AS measure,
            CAST({v} AS DOUBLE) AS value FROM {{o_{output}}}""" for m, v in found.items()]
    return " UNION ALL ".join(parts)


FIRST_ITEM = first("{f_order_items}", "order_id", "order_item_id", "product_id", "seller_id",
                   "price", "freight_value")

ORACLE = {
    "src_parquet_tables": profile_rows(MODEL_COLUMNS),
    "prf_null_profile_tables": profile_rows(MODEL_COLUMNS),
    "job_observed_profile": profile_rows(CLEANED_COLUMNS, rows=True),
    "prf_row_counts_expected": f"""
        SELECT coalesce(a."table", e."table") AS "table", e.expected, a."rows" AS actual,
               a."rows" - e.expected AS diff
        FROM ({count_rows(MODEL)}) a
        FULL JOIN (SELECT 'orders' AS "table", CAST(1 AS BIGINT) AS expected
                   UNION ALL SELECT 'sellers', 0 UNION ALL SELECT 'coupons', 7) e
        ON a."table" = e."table" """,
    "snk_reuse": """
        SELECT 'customer' AS kind, customer_unique_id AS id, count(order_id) AS total_order
        FROM {x_orders} GROUP BY 2
        UNION ALL SELECT 'product', product_id, count(order_id) FROM {x_orders} GROUP BY 2""",
    "cln_dedup_wide": "SELECT DISTINCT * FROM {f_orders_dup}",
    "jon_full_orders_bucketed": "SELECT * FROM {x_orders}",
    "ded_first_by_sequence": FIRST_ITEM,
    "ded_first_review_by_sequence": first(
        """(SELECT order_id, TRY_CAST(review_score AS INTEGER) AS review_score,
            TRY_CAST(review_creation_date AS TIMESTAMP) AS review_creation_date,
            review_answer_timestamp FROM {f_reviews})""",
        "review_score", "review_creation_date", "order_id", "review_answer_timestamp"),
    "agg_product_sellers": "SELECT DISTINCT product_id, seller_id FROM {x_dense} "
                           "WHERE seller_id IS NOT NULL",
    "enr_status_flags_map": f"""
        SELECT x.order_id, s.order_status AS status,
               coalesce(x.order_status = s.order_status, false) AS flag
        FROM {{x_repeated}} x, (SELECT DISTINCT order_status FROM {{x_repeated}}
                                WHERE order_status IS NOT NULL) s""",
    "job_written_orders": "SELECT * FROM {k_orders}",
    "job_written_items": "SELECT * FROM {k_items}",
    "job_written_products": "SELECT * FROM {k_products}",
    "job_outputs": output_lines(),
    "src_csv_checked": f"""
        SELECT order_id, TRY_CAST(order_item_id AS INTEGER) AS order_item_id, product_id,
               seller_id, TRY_CAST(price AS DOUBLE) AS price,
               TRY_CAST(freight_value AS DOUBLE) AS freight_value,
               CAST({malformed('order_item_id', 'int')} AS INTEGER)
               + CAST(coalesce({malformed('price', 'double')}, false) AS INTEGER)
               + CAST({malformed('freight_value', 'double')} AS INTEGER) AS rejected
        FROM {{f_order_items_text}}""",
    "src_csv_quarantine": rejected_rows(),
    "prf_type_conformance_raw": rejected_counts(),
    "src_csv": """
        SELECT CAST(customer_id AS INTEGER) AS customer_id,
               CAST(customer_unique_id AS INTEGER) AS customer_unique_id,
               customer_zip_code_prefix, customer_city, customer_state FROM {f_customers}""",
    "src_csv_schema": "SELECT * REPLACE (CAST(product_id AS VARCHAR) AS product_id) "
                      "FROM {f_products}",
    "src_csv_catalogue": count_rows(MODEL),
    "src_parquet": "SELECT * FROM {f_order_items}",
    "snk_parquet": "SELECT * FROM {p_orders}",
    "snk_parquet_single_file": "SELECT customer_unique_id, count(DISTINCT order_id) AS total_order "
                               "FROM {x_orders} GROUP BY 1",
    "snk_table": BY_STATUS,
    "prf_row_counts": count_rows(MODEL),
    "prf_nulls": null_row(COLUMNS["f_products"], "f_products"),
    "prf_null_profile": null_rows(COLUMNS["f_orders_dup"], "f_orders"),
    "prf_dup_groups": duplicates("f_orders_dup"),
    "prf_dup_rows": f'SELECT *, count(*) AS "count" FROM {{f_orders_dup}} '
                    f'GROUP BY {COLUMNS["f_orders_dup"]} HAVING count(*) > 1',
    "prf_dup_tables": " UNION ALL ".join(
        duplicates("f_orders_dup" if t == "orders" else s, t) for t, s in MODEL.items()),
    "prf_nulls_by_status": f"""
        SELECT order_status, count(*) FILTER (WHERE order_id IS NULL) AS order_id,
               count(*) FILTER (WHERE {PURCHASE} IS NULL) AS {PURCHASE},
               {", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in ORDER_AUDIT)}
        FROM {{f_orders}} WHERE order_status IN ('delivered', 'invoiced', 'canceled')
        GROUP BY 1""",
    "prf_orders_of_status": f"""
        SELECT order_id, order_status, {PURCHASE}, {APPROVED}, {CARRIER}, {CUSTOMER}
        FROM {{f_orders}} WHERE order_status = 'delivered'""",
    "prf_distinct_payment_type": "SELECT DISTINCT payment_type FROM {f_payments}",
    "prf_type_conformance": " UNION ALL ".join([
        bad_rows("review_score", "INT"), bad_rows("review_creation_date", "TIMESTAMP"),
        bad_rows("review_answer_timestamp", "TIMESTAMP")]),
    "exp_customers_by_city": by_place("customer_city"),
    "exp_customers_by_state": by_place("customer_state"),
    "exp_customers_by_city_state": by_place("customer_city", "customer_state"),
    "exp_orders_by_status": BY_STATUS,
    "exp_delivery_duration": f"""
        SELECT order_id, order_status, {PURCHASE}, {CUSTOMER},
               {days(CUSTOMER, PURCHASE)} AS delivery_duration FROM {{f_orders}}""",
    "exp_delivery_status_counts": BY_STATUS,
    "exp_payment_types": 'SELECT payment_type, count(*) AS "count" FROM {f_payments} GROUP BY 1',
    "exp_top_products_by_orders": "SELECT product_id, count(order_id) AS total_order "
                                  "FROM {f_order_items} GROUP BY 1",
    "exp_top_products_by_revenue": f"""
        SELECT product_id, {TEXT2.format(money('price'))} AS "total_amount_spent ($)"
        FROM {{f_order_items}} GROUP BY 1""",
    "cln_impute_order_dates": imputed("f_orders"),
    "cln_impute_mode": "SELECT * FROM {imputed_products}",
    "cln_cast_zip": """
        SELECT 'customers' AS "table", customer_id AS id,
               CAST(customer_zip_code_prefix AS VARCHAR) AS zip FROM {f_customers}
        UNION ALL SELECT 'geolocation', geo_point, CAST(geolocation_zip_code_prefix AS VARCHAR)
        FROM {f_geolocation}
        UNION ALL SELECT 'sellers', seller_id, CAST(seller_zip_code_prefix AS VARCHAR)
        FROM {f_sellers}""",
    "cln_cast_reviews": typed_reviews("f_reviews"),
    "cln_payment_types": f"SELECT * REPLACE ({TYPE_OF_PAYMENT} AS payment_type) "
                         f"FROM {{f_payments}}",
    "cln_dedup": "SELECT DISTINCT * FROM {f_orders_dup}",
    "cln_price_cutoffs": "SELECT quantile_disc(price, 0.01) AS low, "
                         "quantile_disc(price, 0.99) AS high FROM {f_order_items}",
    "cln_price_outliers": inside_cutoffs("f_order_items"),
    "cln_weight_bands": bands("f_products"),
    "fea_order_durations": f"SELECT *, {DURATIONS} FROM {{f_orders}}",
    "fea_calendar": "SELECT * FROM {p_orders}",
    "jon_orders_items": "SELECT o.*, i.* EXCLUDE (order_id) FROM {f_orders} o "
                        "JOIN {f_order_items} i ON i.order_id = o.order_id",
    "jon_items_products": "SELECT i.*, p.* EXCLUDE (product_id) FROM {f_order_items} i "
                          "JOIN {f_products} p ON p.product_id = i.product_id",
    "jon_items_sellers": "SELECT i.*, s.* EXCLUDE (seller_id) FROM {f_order_items} i "
                         "JOIN {f_sellers} s ON s.seller_id = i.seller_id",
    "jon_orders_customers": "SELECT o.*, c.* EXCLUDE (customer_id) FROM {f_orders} o "
                            "JOIN {f_customers} c ON c.customer_id = o.customer_id",
    "jon_orders_geo": f"""
        SELECT o.*, c.* EXCLUDE (customer_id), g.* FROM {{f_orders}} o
        JOIN {{f_customers}} c ON c.customer_id = o.customer_id
        LEFT JOIN ({first('{f_geolocation}', 'geolocation_zip_code_prefix', 'geo_point')}) g
        ON g.geolocation_zip_code_prefix = c.customer_zip_code_prefix""",
    "jon_orders_reviews": f"""
        SELECT o.*, r.* EXCLUDE (order_id) FROM {{f_orders}} o
        LEFT JOIN ({first('{f_reviews}', 'order_id', 'review_creation_date',
                          'review_answer_timestamp', 'review_score')}) r
        ON r.order_id = o.order_id""",
    "jon_products_categories": """
        SELECT p.*, k.* EXCLUDE (product_category_name) FROM {f_products} p
        LEFT JOIN {f_categories} k ON k.product_category_name = p.product_category_name""",
    "jon_orders_payments": f"""
        SELECT o.*, y.* EXCLUDE (order_id) FROM {{f_orders}} o
        LEFT JOIN ({first('{f_payments}', 'order_id', 'payment_sequential', 'payment_type',
                          'payment_value')}) y
        ON y.order_id = o.order_id""",
    "jon_full_orders": "SELECT * FROM {x_orders}",
    "jon_full_orders_dense": "SELECT * FROM {x_dense}",
    "jon_full_orders_repeated_keys": "SELECT * FROM {x_repeated}",
    "agg_orders_per_customer_repeated_keys": """
        SELECT customer_unique_id, count(DISTINCT order_id) AS total_order
        FROM {x_repeated} GROUP BY 1""",
    "agg_money_subcent": """
        SELECT l_suppkey AS seller_id, round(CAST(sum(CAST(
            l_extendedprice * (1 - l_discount) / 1000 AS DECIMAL(38,10))) AS DOUBLE), 5) AS revenue
        FROM {lineitem} GROUP BY 1""",
    "job_quality": """
        SELECT 'integrated_orders' AS measure, count(*) AS n FROM {k_full}
        UNION ALL SELECT 'distinct_orders', count(*) FROM (SELECT DISTINCT customer_unique_id,
            order_id, order_purchase_timestamp FROM {k_full})
        UNION ALL SELECT 'lost_orders', (SELECT count(*) FROM {k_orders})
            - (SELECT count(*) FROM {k_full})
        UNION ALL SELECT 'rows_without_flag', count(*) FROM {k_full}
            WHERE order_status NOT IN ('delivered', 'invoiced')""",
    "enr_status_flags_observed": f"""
        SELECT x.order_id, s.order_status AS status,
               coalesce(x.order_status = s.order_status, false) AS flag
        FROM {{x_repeated}} x, (SELECT DISTINCT order_status FROM {{x_repeated}}
                                WHERE order_status IS NOT NULL) s""",
    "jon_lost_orders": """
        SELECT (SELECT count(*) FROM {f_orders}) AS orders, count(*) AS integrated_orders,
               (SELECT count(*) FROM {f_orders}) - count(*) AS lost_orders FROM {x_orders}""",
    "ded_one_row_per_order": first(
        f"""(SELECT c.customer_unique_id, o.order_id, o.{PURCHASE}, i.order_item_id, i.product_id,
             i.seller_id, i.price FROM {{f_orders}} o
             JOIN {{f_order_items}} i ON i.order_id = o.order_id
             JOIN {{f_customers}} c ON c.customer_id = o.customer_id)""",
        f"customer_unique_id, order_id, {PURCHASE}",
        "order_item_id", "product_id", "seller_id", "price"),
    "ded_key_unique": f"""
        SELECT CAST(sum(n) AS BIGINT) AS "rows", count(*) AS distinct_keys,
               max(n) <= 1 AS "unique"
        FROM (SELECT count(*) AS n FROM {{x_orders}}
              GROUP BY customer_unique_id, order_id, {PURCHASE}) counted""",
    "agg_orders_per_customer": "SELECT customer_unique_id, count(DISTINCT order_id) AS total_order "
                               "FROM {x_orders} GROUP BY 1",
    "agg_distinct_orders_per_customer": """
        SELECT customer_unique_id, count(DISTINCT o.order_id) AS total_order FROM {f_orders} o
        JOIN {f_order_items} i ON i.order_id = o.order_id
        JOIN {f_customers} c ON c.customer_id = o.customer_id GROUP BY 1""",
    "agg_seller_review_score": "SELECT seller_id, avg(review_score) AS avg_review_score "
                               "FROM {x_orders} GROUP BY 1",
    "agg_most_sold_products": "SELECT product_id, count(order_id) AS total_order "
                              "FROM {x_orders} GROUP BY 1",
    "agg_customer_purchase": f"SELECT customer_id, {money('payment_value')} AS total_amount_spent "
                             f"FROM {{x_orders}} GROUP BY 1",
    "agg_seller_products": "SELECT * FROM {a_products}",
    "agg_customer_spending": "SELECT * FROM {a_spending}",
    "agg_seller_performance": "SELECT * FROM {a_performance}",
    "agg_product_metrics": f"""
        SELECT product_id, count(order_id) AS total_sales, {money('price')} AS total_revenue,
               {r2(money('price') + ' / count(price)')} AS avg_price,
               {r2('stddev_samp(price)')} AS price_volatility,
               (SELECT string_agg(CAST(d.seller_id AS VARCHAR), ',' ORDER BY d.seller_id)
                FROM (SELECT DISTINCT product_id, seller_id FROM {{x_dense}}) d
                WHERE d.product_id = x.product_id) AS unique_sellers,
               count(DISTINCT seller_id) AS unique_seller_count
        FROM {{x_dense}} x GROUP BY 1""",
    "agg_monthly_stats": "SELECT * FROM {a_monthly}",
    "agg_customer_retention": "SELECT * FROM {a_retention}",
    "win_top_products_by_orders": """
        SELECT * FROM (
            SELECT *, CAST(rank() OVER (PARTITION BY seller_id
                ORDER BY total_orders DESC NULLS LAST) AS INTEGER) AS "rank"
            FROM {a_products}) ranked
        WHERE "rank" <= 5""",
    "win_top_products_by_revenue": "SELECT * FROM {w_revenue}",
    "enr_status_flags": """
        SELECT order_id, order_status, coalesce(order_status = 'delivered', false) AS is_delivered,
               coalesce(order_status = 'invoiced', false) AS is_invoiced,
               coalesce(order_status = 'canceled', false) AS is_canceled
        FROM {x_orders}""",
    "enr_customer_segment": f"SELECT *, {SEGMENT} AS customer_type FROM {{a_spending}}",
    "enr_orders_with_segment": f"""
        SELECT x.customer_unique_id, x.order_id, x.{PURCHASE}, x.payment_value,
               {SEGMENT} AS customer_type
        FROM {{x_orders}} x JOIN {{a_spending}} a
        ON a.customer_unique_id = x.customer_unique_id""",
    "top_k_products": """
        SELECT product_id, count(order_id) AS total_order FROM {f_order_items}
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "srt_monthly": "SELECT * FROM {a_monthly}",
    "fmt_monthly_report": monthly_report("a_monthly"),
    "fmt_retention_report": f"""
        SELECT customer_unique_id, first_order_date, last_order_date,
               {TEXT0.format('total_orders')} AS total_orders,
               {TEXT2.format('total_amount_spent')} AS total_amount_spent,
               {TEXT2.format('aov')} AS aov, {TEXT2.format('retention_rate')} AS retention_rate
        FROM {{a_retention}}""",
    "fmt_customer_orders": f"""
        SELECT customer_unique_id, {TEXT0.format('count(order_id)')} AS total_order
        FROM {{x_orders}} GROUP BY 1""",
    "fmt_seller_review_score": f"""
        SELECT seller_id, {TEXT0.format('avg(review_score)')} AS avg_review_score
        FROM {{x_orders}} GROUP BY 1""",
    "fmt_most_sold_products": f"""
        SELECT product_id, {TEXT0.format('n')} AS total_order
        FROM (SELECT product_id, count(order_id) AS n FROM {{x_orders}} GROUP BY 1
              ORDER BY 2 DESC, 1 LIMIT 10) top""",
    "fmt_customer_purchase": f"""
        SELECT customer_id, {TEXT2.format(money('payment_value'))} AS total_amount_spent
        FROM {{x_orders}} GROUP BY 1""",
    "fmt_seller_products": f"""
        SELECT seller_id, product_id, price, total_orders,
               {TEXT2.format('total_revenue')} AS total_revenue FROM {{a_products}}""",
    "fmt_customer_spending": f"""
        SELECT customer_unique_id, total_orders, {TEXT2.format('revenue')} AS revenue, "AOV"
        FROM {{a_spending}}""",
    "fmt_seller_performance": f"""
        SELECT seller_id, {TEXT2.format('CAST(total_orders AS DOUBLE)')} AS total_orders,
               {TEXT2.format('total_revenue')} AS total_revenue, avg_review_score,
               price_variability FROM {{a_performance}}""",
    "fmt_dense_ranked_products": f"""
        SELECT seller_id, product_id, price, total_orders,
               {TEXT2.format('total_revenue')} AS total_revenue, dense_rank
        FROM {{w_revenue}}""",
    "job_cleaned_orders": "SELECT * FROM {k_orders}",
    "job_cleaned_items": "SELECT * FROM {k_items}",
    "job_cleaned_products": "SELECT * FROM {k_products}",
    "job_complete_orders": f"""
        SELECT x.*, coalesce(order_status = 'delivered', false) AS is_delivered,
               coalesce(order_status = 'invoiced', false) AS is_invoiced,
               coalesce(order_status = 'canceled', false) AS is_canceled,
               {SEGMENT} AS customer_type
        FROM {{k_full}} x JOIN {{k_spending}} a
        ON a.customer_unique_id = x.customer_unique_id""",
    "job_monthly_report": monthly_report("k_monthly"),
}


ORACLE["agg_product_metrics_bounded"] = f"""
    SELECT * REPLACE (CASE WHEN unique_seller_count <= {MOST_SELLERS} THEN unique_sellers END
                      AS unique_sellers) FROM ({ORACLE["agg_product_metrics"]}) metrics"""


def oracle_sql() -> dict[str, str]:
    """Self-contained SQL per query, over the raw tables."""
    salted = {f"{name}_salted": ORACLE[name] for name in SALTED}
    return {name: _with_steps(sql) for name, sql in {**ORACLE, **salted}.items()}


def _with_steps(sql: str) -> str:
    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in names_in(text):
            if name not in RAW_TABLES and name not in needed:
                visit(STEPS[name])
                needed[name] = None

    visit(sql)
    steps = [f"{name} AS ({_plain(STEPS[name])})" for name in needed]
    lead = "WITH " + ",\n".join(steps) + "\n" if steps else ""
    return lead + _plain(sql)


def _plain(sql: str) -> str:
    return sql.format(**{name: name for name in names_in(sql)})
