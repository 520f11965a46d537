"""Many-to-one joins that survive a hot key, and the choice of one row per key."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SALT, _COPIES = "_salt", "_copies"
# Session setting: salt the hot keys of every lookup join.
SALTED_JOINS = "ledgerloom.join.salted"

def hot_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys holding more rows than an average shuffle partition: ``(*on, _copies)``.

    With P shuffle partitions, fewer than P keys can hold more than 1/P of the
    rows each, so the result is bounded by configuration and never by the data;
    it is safe to broadcast. ``_copies`` is the number of average partitions the
    key fills, and sums to less than 2 P. The counts are exact, so every
    evaluation of the plan, also after a lost executor, agrees on them.
    """
    return hot_among(key_counts(df, on), on)


def key_counts(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows per key, ``(*on, n)``; rows without a key are left out."""
    return df.dropna(subset=list(on)).groupBy(*on).agg(F.count(F.lit(1)).alias("n"))


def hot_among(counts: DataFrame, on: Sequence[str]) -> DataFrame:
    """``hot_keys`` from row counts per key, ``(*on, n)``, that are there already."""
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Summing the counts, not counting the rows again, lets both reuse one shuffle.
    total = counts.agg(F.sum("n")).scalar()
    filled = F.col("n") * partitions
    return counts.where(filled > total).select(
        *on, F.ceil(filled / total).cast("int").alias(_COPIES)
    )


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    hot: Callable[[], DataFrame] | None = None,
    salted: bool | None = None,
) -> DataFrame:
    """Join ``rows`` with a lookup table whose key is (nearly) unique.

    The join is declared and left to Spark: a lookup side below its broadcast
    threshold is broadcast, where no key can be hot, and a shuffled join is split by
    adaptive execution where a partition is skewed. ``salted`` (or the session's
    ``ledgerloom.join.salted``) spreads hot keys whatever Spark does: a hot key's
    rows are dealt over several groups by a hash of the row, and its lookup row is
    copied once per group. Rows without a key match nothing; an outer join deals
    them out too. The hash keeps a row's group the same when a lost task runs again;
    it also keeps exact copies of a row together, so deduplicate first. Either way
    gives the same rows, whatever the sizes.

    ``hot`` makes the hot keys where there is a cheaper way than to count the keys
    of ``rows``: ``hot_keys`` of the base table, or ``hot_among`` counts that an
    aggregate has already. It decides the layout only, never the result.
    """
    on = list(on)
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"lookup_join does not support {how!r}")
    if salted is None:
        salted = rows.sparkSession.conf.get(SALTED_JOINS, "false") == "true"
    if not salted:
        return rows.join(lookup, on, how)

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot_rows = F.broadcast(hot_keys(rows, on) if hot is None else hot())
    row_hash = F.xxhash64(*[F.col(c) for c, t in rows.dtypes if "map<" not in t])
    no_key = reduce(or_, [F.col(c).isNull() for c in on])
    salt = (
        F.when(no_key, F.pmod(row_hash, F.lit(partitions)))
        .when(F.col(_COPIES).isNotNull(), F.pmod(row_hash, F.col(_COPIES)))
        .otherwise(0)
        .cast("int")
    )
    dealt = rows.join(hot_rows, on, "left").withColumn(_SALT, salt).drop(_COPIES)
    last_copy = F.coalesce(F.col(_COPIES), F.lit(1)) - 1
    copied = (
        lookup.join(hot_rows, on, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), last_copy)))
        .drop(_COPIES)
    )
    return dealt.join(copied, [*on, _SALT], how).drop(_SALT)


def one_row_per_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()
) -> DataFrame:
    """The first row per key, ordered by ``order_by`` and then by all other columns.

    Ordering by every column makes the choice the same on every run. Columns sort
    ascending with nulls first. It is an aggregate, so each task sends at most one
    row per key to the shuffle, however many rows one key has, and the optimiser
    knows the result to be unique on ``keys``.
    """
    keys, columns = list(keys), df.columns
    order = [*order_by, *[c for c in columns if c not in keys and c not in order_by]]
    if not order:
        return df.select(*keys).distinct()
    first = F.min(F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*columns)


def first_by_sequence(
    df: DataFrame, keys: Sequence[str], sequence: str, order_by: Sequence[str] = ()
) -> DataFrame:
    """The same row as ``one_row_per_key(df, keys, [sequence, *order_by])``, in two steps.

    A hash aggregate finds the least value of the sequence per key (fixed-width buffers: no sort and
    no struct of all columns), a join by key keeps its rows, and only rows that tie are
    ordered by the other columns, where the join has put them. Rows are moved once, by key, and
    never sorted before they are: better than the aggregate where rows are wide and the rows of a
    key lie in many files, worse where they lie together and the aggregate shrinks them first.
    """
    keys, columns = list(keys), df.columns
    rest = [c for c in columns if c not in keys and c != sequence and c not in order_by]
    own = [f"_key{i}" for i in range(len(keys))]
    least = df.groupBy(*[F.col(k).alias(x) for k, x in zip(keys, own)]).agg(
        F.min(sequence).alias("_least"), F.max(F.col(sequence).isNull()).alias("_missing"))
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(x)) for k, x in zip(keys, own)])
    # nulls come first
    wanted = F.when(~F.col("_missing"), F.col("_least"))
    kept = df.join(least, on).where(F.col(sequence).eqNullSafe(wanted))
    # rows that tie in every column are one
    number = F.row_number().over(
        Window.partitionBy(*keys).orderBy(*(order_by or ()), *rest, sequence))
    return kept.withColumn("_number", number).where("_number = 1").select(*columns)
