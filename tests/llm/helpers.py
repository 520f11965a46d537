"""Small tables with the awkward cases that every operator must take."""

from __future__ import annotations

import duckdb
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

PASSAGE = ("The committee met on a cold morning and spoke at length about the harbour wall. "
           "Nobody could say who had ordered the stones. They agreed to wait until spring. ")


def documents(spark: SparkSession, rows) -> DataFrame:
    """From (doc_id, text) pairs."""
    full = [(i, t, None, "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls, empty and long texts, ties, repeated rows and ids."""
    return documents(spark, [
        (1, PASSAGE + "One end."), (2, PASSAGE + "Another end."), (3, None), (4, ""),
        (5, "word " * 30_000), (6, "x" * 50_000), (7, PASSAGE + "One end."),
        (8, "Same row."), (8, "Same row."), (9, "First of the id."), (9, "Second of the id."),
        (None, PASSAGE + "No id."), (None, None), (10, "日本語 текст 🙂 naïve\u0001\ttab"),
        (11, " \n \n"), (12, "mail a.b@c-d.org, call +1 (555) 010-9999 or 4111 1111 1111 1111"),
    ])


def sample(path: str, columns: str = "doc_id, text", table: str = "documents"):
    return duckdb.sql(f"SELECT {columns} FROM '{path}/{table}.parquet' ORDER BY 1").fetchall()


def clashing(df: DataFrame, *names: str) -> DataFrame:
    """With extra columns of the given names."""
    for name in names:
        df = df.selectExpr("*", f"'kept' AS {name}")
    return df
