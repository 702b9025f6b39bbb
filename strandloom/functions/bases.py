"""Column expressions over the sequence and quality strings of reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGTN"


def qualities(quality: Column) -> Column:
    """Raw (ASCII) qualities as an array; empty for an empty string."""
    chars = F.when(F.length(quality) > 0, F.split(quality, "")).otherwise(F.array().cast("array<string>"))
    return F.transform(chars, lambda c: F.ascii(c))


def quality_sum(quality: Column) -> Column:
    """Sum of raw qualities, in one walk over the characters."""
    chars = F.split(quality, "")
    return F.when(F.length(quality) > 0, F.aggregate(chars, F.lit(0).cast("bigint"), lambda acc, c: acc + F.ascii(c))).otherwise(F.when(quality.isNotNull(), F.lit(0).cast("bigint")))


def count_of(sequence: Column, base: str) -> Column:
    return F.length(sequence) - F.length(F.replace(sequence, F.lit(base), F.lit("")))


def left_window(quality: Column, n: int) -> Column:
    return F.substring(quality, 1, n)


def right_window(quality: Column, n: int) -> Column:
    return F.right(quality, F.lit(n))


def mean_within(qsum: Column, n: Column, low: int | None, high: int | None, base: int) -> Column:
    """Whether the mean of n qualities with the raw sum is in range, in whole numbers."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (qsum >= n * F.lit(low + base).cast("bigint"))
    if high is not None:
        ok = ok & (qsum <= n * F.lit(high + base).cast("bigint"))
    return ok


def words_of(sequence: Column, k: int) -> Column:
    """struct(pos, word) of all k-words; pos from 0."""
    starts = F.when(F.length(sequence) >= k, F.sequence(F.lit(0), F.length(sequence) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda p: F.struct(p.alias("pos"), F.substring(sequence, p + 1, F.lit(k)).alias("word")))
