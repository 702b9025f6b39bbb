"""Splitting reads into passed and failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.bases import count_of, left_window, mean_within, qualities, quality_sum, right_window
from strandloom.spec import FilterSpec


def _end(window: Column, low: int | None, high: int | None, base: int) -> Column:
    return mean_within(quality_sum(window), F.length(window), low, high, base)


def predicate(spec: FilterSpec) -> Column:
    """Whether a read passes; conjuncts that aren't asked for are left out.  The
    quality of an empty read is unknown, so a quality range fails it; an empty
    end passes."""
    s, q, base = F.col("sequence"), F.col("quality"), spec.phred_base
    tests = []
    if spec.min_length is not None:
        tests.append(F.length(s) >= spec.min_length)
    if spec.max_length is not None:
        tests.append(F.length(s) <= spec.max_length)
    if spec.max_n is not None:
        tests.append(count_of(s, "N") <= spec.max_n)
    if spec.left_length is not None and (spec.min_left_quality is not None or spec.max_left_quality is not None):
        tests.append(_end(left_window(q, spec.left_length), spec.min_left_quality, spec.max_left_quality, base))
    if spec.right_length is not None and (spec.min_right_quality is not None or spec.max_right_quality is not None):
        tests.append(_end(right_window(q, spec.right_length), spec.min_right_quality, spec.max_right_quality, base))
    if spec.has_quality():
        if spec.quality_start is not None or spec.quality_end is not None:
            start = spec.quality_start or 0
            end = 1024 if spec.quality_end is None else spec.quality_end
            q = F.substring(q, start + 1, max(0, end - start))
        low = 0 if spec.min_quality is None else spec.min_quality
        if spec.max_out_of_quality is not None:
            raw = qualities(q)
            out = F.filter(raw, lambda z: (z < low + base) | (z > spec.max_quality + base if spec.max_quality is not None else F.lit(False)))
            tests.append(F.size(out) <= spec.max_out_of_quality)
        tests.append((F.length(q) > 0) & mean_within(quality_sum(q), F.length(q), spec.min_quality, spec.max_quality, base))
    passed = F.lit(True)
    for t in tests:
        passed = passed & t
    return F.coalesce(passed, F.lit(False))


def with_status(reads: DataFrame, spec: FilterSpec) -> DataFrame:
    """The reads with ``status``, passed or failed; one scan gives both."""
    return reads.withColumn("status", F.when(predicate(spec), "passed").otherwise("failed"))


def status_counts(reads: DataFrame) -> DataFrame:
    return reads.agg(F.count_if(F.col("status") == "passed").alias("num_passed"), F.count_if(F.col("status") == "failed").alias("num_failed"))
