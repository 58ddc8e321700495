"""Small numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division as double; NULL when the denominator is zero or NULL."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))


def rounded(column: Column, digits: int = 6) -> Column:
    # adding 0.0 turns a negative zero into a plain one
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def value_bucket(column: Column) -> Column:
    """Monotone bucket number of a numeric value.

    Logarithmic on both signs, linear near zero: a bucket spans about 0.1 % of
    the value, [0, 1] spans some 14,000 buckets and all finite doubles stay
    below ±750,000; infinite values and NaN have end buckets of their own. Order
    is kept whatever the distribution, so ordered work can be split by bucket
    without knowing the range first.
    """
    value = column.cast("double")
    size = F.least(F.log1p(F.abs(value) * 1e6) * 1024, F.lit(800_000.0))
    return F.when(F.isnan(value), 900_000).otherwise(F.floor(F.signum(value) * size).cast("int"))


def draw_digest(seed: int, block: Column, row: Column) -> Column:
    """Digest of one (row, block); holds the draws of four replicates."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), block.cast("string"), row.cast("string")))


def draw_word(digest: Column, word: int, size: Column) -> Column:
    """Uniform pick in ``[0, size)`` from the given 32-bit word of a digest."""
    return F.conv(F.substring(digest, word * 8 + 1, 8), 16, 10).cast("long") % size


def right_closed(value: Column, bins) -> Column:
    """Name of the first bin whose inclusive upper bound holds the value (above 0)."""
    expr = None
    for upper, name in bins:
        test = value <= upper
        expr = F.when((value > 0) & test, name) if expr is None else expr.when((value > 0) & test, name)
    return expr
