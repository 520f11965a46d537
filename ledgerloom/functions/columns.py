"""Column expressions shared by the operators. All stay inside JVM codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


# Amounts from here on are added as doubles; sums of smaller ones fit a decimal for 1e13 rows.
WIDE = 1e15
# Amounts below this with at most four decimals are added as two longs, which 8e12 rows cannot
# overflow: the upper bits of ten thousandths, and the lower ones.
NARROW = 1e7
SCALE = 10_000
LOWER_BITS = 20


def known(column: Column) -> Column:
    """A floating-point column with NaN read as null."""
    return F.when(~F.isnan(column), column)


def money_sum(name: str) -> Column:
    """Sum of an amount, the same whatever the order in which tasks finish.

    Amounts below ``NARROW`` with at most four decimals are added as whole ten thousandths, and
    others below ``WIDE`` as decimals of ten places; both is exact and so independent of the
    order. What such a decimal leaves of an amount (digits beyond the tenth place) and amounts
    beyond, infinite ones included, are added as doubles, so nothing is lost and no amount ends
    the query. Nulls and NaN are left out.
    """
    amount = known(F.col(name).cast("double"))
    scaled = F.rint(amount * SCALE)
    short = (F.abs(amount) < NARROW) & (scaled / SCALE == amount)
    whole = F.when(short, scaled.cast("long"))
    near = F.when(~short & (F.abs(amount) < WIDE), amount)
    exact = near.cast("decimal(25,10)")
    rest = F.when(short, F.lit(0.0)).otherwise(F.coalesce(near - exact.cast("double"), amount))
    upper = F.sum(F.shiftright(whole, LOWER_BITS)).cast("decimal(20,0)")
    lower = F.sum(whole.bitwiseAND(F.lit((1 << LOWER_BITS) - 1)))
    units = (upper * (1 << LOWER_BITS) + lower).cast("decimal(29,0)")
    zero = F.lit(0).cast("decimal(35,10)")
    total = F.coalesce((units * F.lit(Decimal("0.0001"))).cast("decimal(35,10)"), zero) \
        + F.coalesce(F.sum(exact), zero)
    return total.cast("double") + F.sum(rest)


def money_spread(name: str) -> Column:
    """Sample standard deviation of an amount, settled on four decimals; one row gives null.

    It is computed from the exact number, sum and sum of squares, so its bits do not depend on
    the order in which tasks finish. Groups with an amount of 1e9 or more use the deviation of
    doubles.
    """
    amount = known(F.col(name).cast("double"))
    near = F.when(F.abs(amount) < 1e9, F.rint(amount * SCALE).cast("decimal(13,0)"))
    count = F.count(near).cast("decimal(13,0)")
    total = F.sum(near).cast("decimal(25,0)")
    squares = F.sum(near * near)
    # n * sum(x * x) - sum(x) ** 2, exact where it has at most 38 digits
    exact = F.try_subtract(
        F.try_multiply(count, squares.cast("decimal(38,0)")),
        F.try_multiply(total.cast("decimal(38,0)"), total.cast("decimal(38,0)")))
    mean = total.cast("double") / count.cast("double")
    rough = (squares.cast("double") - mean * total.cast("double")) * count.cast("double")
    freedom = count.cast("double") * (count.cast("double") - 1)
    variance = F.greatest(F.coalesce(exact.cast("double"), rough), F.lit(0.0)) / freedom
    spread = F.when(F.count(near) > 1, F.sqrt(variance) / SCALE)
    return F.when(F.max(F.abs(amount)) >= 1e9, F.stddev(amount)).otherwise(spread)


def round2(column: Column) -> Column:
    """Half-up rounding to two places of a derived double.

    The value first settles on six places: two engines, or two runs with another
    task order, may differ in the last bit of a mean or a deviation, and
    rounding that bit directly could move the second place.
    """
    settled = column.try_cast("decimal(38,6)")
    return F.round(settled, 2).cast("double")


def per(numerator: Column, denominator: Column) -> Column:
    """Ratio as a double; null where the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), denominator)


def translate_values(column: Column, mapping: Mapping[str, str]) -> Column:
    """Replace known values by their translation; others, and null, stay."""
    chain = None
    for source, target in mapping.items():
        hit = column == F.lit(source)
        chain = F.when(hit, F.lit(target)) if chain is None else chain.when(hit, F.lit(target))
    return column if chain is None else chain.otherwise(column)


def banded(column: Column, upper_bounds: Sequence[Column], labels: Sequence[str]) -> Column:
    """Label of the first band whose upper bound is not exceeded.

    ``labels`` has one entry more than ``upper_bounds``. A null value, or a null
    bound, exceeds every bound and so falls into the last band.
    """
    if len(labels) != len(upper_bounds) + 1:
        raise ValueError("banded needs exactly one label more than bounds")
    chain = F.when(column <= upper_bounds[0], F.lit(labels[0]))
    for bound, label in zip(upper_bounds[1:], labels[1:-1]):
        chain = chain.when(column <= bound, F.lit(label))
    return chain.otherwise(F.lit(labels[-1]))


def midpoint(first: Column, second: Column) -> Column:
    """Instant halfway between two timestamps, to the half second."""
    seconds = (F.unix_timestamp(first) + F.unix_timestamp(second)) / 2
    return F.timestamp_seconds(seconds)
