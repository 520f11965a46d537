"""A corpus from raw documents: filter, deduplicate, redact, pack.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
frame that ``run`` writes as Parquet and reads back for the next one. All but the last return
the columns of ``documents``. Defined cases are those of the operators; documents without an
id pass all stages, and an empty table gives no sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import packing, pii, simhash, suffix_dedup, toxicity
from ledgerloom.llm.common import stored, table

#: SQL cannot express the learned scores, the tokenizer, or the suffix arrays.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the grammar, learned from the labels, rejects."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that SimHash links join."""
    return simhash.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 50 bytes that an earlier document has, too."""
    return suffix_dedup.cleaned(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    text = pii.redacted(F.col("text"), F.col("spans"))
    found = pii.detect(docs).withColumn("text", text)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, with their sequences and places."""
    # the workers still hold what the stages before left in them
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"),
                        part_bytes=2 << 20, cached_words=300_000)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", one_of_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("pii", without_personal_data),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
