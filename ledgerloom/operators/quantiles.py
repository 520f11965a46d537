"""Quantiles that are exact without gathering or sorting the values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import known

# Accuracy of the sketch that brackets the ranks: its rank error is at most one part in so many.
SKETCH = 10_000
# A bracket reaches so many times that error to either side of its rank.
MARGIN = 3


def quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], accuracy: int | None = None
) -> DataFrame:
    """One row, one array column ``quantiles`` with a value per probability.

    A quantile is the smallest value whose cumulative share reaches the
    probability; nulls and NaN do not count, and there is no interpolation. If
    there are no values every entry is null. With ``accuracy`` a sketch with
    relative rank error ``1 / accuracy`` is used instead of the exact method.
    """
    values = df.select(known(F.col(column).cast("double")).alias("v")).where("v is not null")
    if accuracy is not None:
        sketch = F.percentile_approx("v", [float(p) for p in probabilities], accuracy)
        return values.agg(sketch.alias("quantiles"))
    return _exact(values, probabilities)


def _exact(values: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles by a sketch and one counting pass.

    The sketch gives a value on either side of each rank. The counting pass counts different
    values inside these brackets one by one and all others per stretch between brackets, so
    after it a row stands for a value of a bracket (``2 * MARGIN / SKETCH`` of the rows of each
    probability at most, fewer if values repeat) or for everything between two brackets.
    Running sums over these rows, the only part in one task, give the values at the ranks. A
    bracket that missed its rank would end the query; the sketch's error bound excludes it.
    """
    reach = MARGIN / SKETCH
    grid = [x for p in probabilities for x in (max(p - reach, 0.0), min(p + reach, 1.0))]
    # one subquery in a column of its own: named per use, it would be planned per use
    bounds = values.agg(F.percentile_approx("v", grid, SKETCH)).scalar()
    bracketed = values.withColumn("bounds", bounds)
    value, inside, passed = F.col("v"), [], []
    for i, (low, high) in enumerate(zip(grid[::2], grid[1::2])):
        reached = F.lit(True) if low == 0 else value >= F.col("bounds")[2 * i]
        left = F.lit(False) if high == 1 else value > F.col("bounds")[2 * i + 1]
        inside.append(reached & ~left)
        passed += [reached.cast("int"), left.cast("int")]
    stretch = reduce(add, passed)
    counted = bracketed.groupBy(
        stretch.alias("stretch"), F.when(reduce(or_, inside), value).alias("v")
    ).agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.orderBy("stretch", "v")
    ranked = counted.select(
        "v", F.sum("n").over(ordered).alias("running"),
        F.sum("n").over(Window.partitionBy()).alias("total"))
    return ranked.agg(F.array(*[_at(p) for p in probabilities]).alias("quantiles"))


def _at(probability: float) -> Column:
    """The value of the first row whose running count reaches the rank."""
    rank = F.greatest(F.ceil(F.lit(float(probability)) * F.col("total")), F.lit(1))
    first = F.min(F.when(F.col("running") >= rank, F.struct("running", "v")))
    missed = first.isNotNull() & first["v"].isNull()
    return F.when(missed, F.raise_error(F.lit("a rank lies outside its bracket"))) \
        .otherwise(first["v"])
