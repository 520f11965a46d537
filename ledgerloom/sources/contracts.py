"""Table names, file names, schemas and keys of the order model."""

from __future__ import annotations

TABLES = (
    "customers", "geolocation", "order_items", "payments", "reviews",
    "orders", "products", "sellers", "categories",
)

# Raw file name of each table. The loader puts the data set's own
# file prefix in front of every name except the translation table's.
RAW_FILES = {
    "customers": "customers_dataset.csv",
    "geolocation": "geolocation_dataset.csv",
    "order_items": "order_items_dataset.csv",
    "payments": "order_payments_dataset.csv",
    "reviews": "order_reviews_dataset.csv",
    "orders": "orders_dataset.csv",
    "products": "products_dataset.csv",
    "sellers": "sellers_dataset.csv",
    "categories": "product_category_name_translation.csv",
}
UNPREFIXED_FILES = frozenset({"categories"})

# Folder of each cleaned table (the last spelling is the one on disk).
CLEANED_FOLDERS = {
    "customers": "customers",
    "geolocation": "geolocations",
    "order_items": "orderItems",
    "payments": "payments",
    "reviews": "reviews",
    "orders": "orders",
    "products": "products",
    "sellers": "sellers",
    "categories": "categories_transalation",
}

# Folder or table name of each analysed output.
OUTPUT_NAMES = {
    "complete_orders": "completeOrderdetails",
    "customer_orders": "customerOrders",
    "seller_review_score": "avgSellerRevenueScore",
    "most_sold_products": "mostSoldProducts",
    "customer_purchase": "customerPurchase",
    "seller_products": "sellersProduct",
    "ranked_products": "rankedSellers",
    "dense_ranked_products": "denseRankedSellers",
    "customer_spending": "customerSpending",
    "seller_performance": "sellerPerformance",
    "product_metrics": "productsMetric",
    "monthly_stats": "monthlyStat",
    "customer_retention": "customerRetention",
}

# Explicit schemas spare the inference pass over the input, keep the leading
# zeros of zip prefixes, and read wall-clock times without a zone. Review scores
# and dates stay text here: cleaning repairs them, profiling counts the bad ones.
# Fixed values.
RAW_SCHEMAS = {
    "customers": """
        customer_id STRING, customer_unique_id STRING,
        customer_zip_code_prefix STRING, customer_city STRING, customer_state STRING""",
    "geolocation": """
        geolocation_zip_code_prefix STRING, geolocation_lat DOUBLE,
        geolocation_lng DOUBLE, geolocation_city STRING, geolocation_state STRING""",
    "order_items": """
        order_id STRING, order_item_id INT, product_id STRING, seller_id STRING,
        shipping_limit_date TIMESTAMP_NTZ, price DOUBLE, freight_value DOUBLE""",
    "payments": """
        order_id STRING, payment_sequential INT, payment_type STRING,
        payment_installments INT, payment_value DOUBLE""",
    "reviews": """
        review_id STRING, order_id STRING, review_score STRING,
        review_comment_title STRING, review_comment_message STRING,
        review_creation_date STRING, review_answer_timestamp STRING""",
    "orders": """
        order_id STRING, customer_id STRING, order_status STRING,
        order_purchase_timestamp TIMESTAMP_NTZ, order_approved_at TIMESTAMP_NTZ,
        order_delivered_carrier_date TIMESTAMP_NTZ,
        order_delivered_customer_date TIMESTAMP_NTZ,
        order_estimated_delivery_date TIMESTAMP_NTZ""",
    "products": """
        product_id STRING, product_category_name STRING,
        product_name_lenght DOUBLE, product_description_lenght DOUBLE,
        product_photos_qty DOUBLE, product_weight_g DOUBLE,
        product_length_cm DOUBLE, product_height_cm DOUBLE, product_width_cm DOUBLE""",
    "sellers": """
        seller_id STRING, seller_zip_code_prefix STRING,
        seller_city STRING, seller_state STRING""",
    "categories": """
        product_category_name STRING, product_category_name_english STRING""",
}

# Free text with quoted line breaks: such a file cannot be split, so it costs one
# task per file. Only the table that needs it is read that way.
MULTI_LINE_TABLES = frozenset({"reviews"})

# Types that cleaning gives to columns which inference or raw text gets wrong.
CORRECTED_TYPES = {
    "customers": {"customer_zip_code_prefix": "string"},
    "geolocation": {"geolocation_zip_code_prefix": "string"},
    "sellers": {"seller_zip_code_prefix": "string"},
    "reviews": {
        "review_score": "int",
        "review_creation_date": "timestamp_ntz",
        "review_answer_timestamp": "timestamp_ntz",
    },
}

# One row per order is the grain of the integrated table.
ORDER_GRAIN = ("customer_unique_id", "order_id", "order_purchase_timestamp")
