"""Trimming reads by the quality of their ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.bases import left_window, mean_within, quality_sum, right_window
from strandloom.operators.filtering import with_status
from strandloom.spec import FilterSpec, TrimSpec


def trim(reads: DataFrame, spec: TrimSpec) -> DataFrame:
    """The reads with ends removed whose mean quality is out of range, and
    ``edited``.  Both ends are judged on the read as it was; an end longer than
    the read leaves it empty."""
    q, base = F.col("quality"), spec.phred_base
    cut = {}
    for side, on, n, low, high, window in (
        ("l", spec.trims_left(), spec.left_length, spec.min_left_quality, spec.max_left_quality, left_window),
        ("r", spec.trims_right(), spec.right_length, spec.min_right_quality, spec.max_right_quality, right_window),
    ):
        if on:
            end = window(q, n)
            bad = (F.length(end) > 0) & ~mean_within(quality_sum(end), F.length(end), low, high, base)
            cut[side] = F.coalesce(bad, F.lit(False))
    none = F.lit(False)
    rows = reads.withColumn("_cut_l", cut.get("l", none)).withColumn("_cut_r", cut.get("r", none))
    first = F.when(F.col("_cut_l"), F.lit((spec.left_length or 0) + 1)).otherwise(F.lit(1))
    kept = F.greatest(F.length("sequence") - F.when(F.col("_cut_l"), F.lit(spec.left_length or 0)).otherwise(0) - F.when(F.col("_cut_r"), F.lit(spec.right_length or 0)).otherwise(0), F.lit(0))
    return rows.withColumns(
        {
            "sequence": F.substring(F.col("sequence"), first, kept),
            "quality": F.substring(F.col("quality"), first, kept),
            "edited": F.col("_cut_l") | F.col("_cut_r"),
        }
    ).drop("_cut_l", "_cut_r")


def edit_then_filter(reads: DataFrame, trim_spec: TrimSpec, filter_spec: FilterSpec | None) -> DataFrame:
    """Trimmed reads with ``status``: the filter sees the edited reads, without
    its end predicates; without an effective filter all reads pass."""
    edited = trim(reads, trim_spec)
    if filter_spec is None or not filter_spec.is_effective():
        return edited.withColumn("status", F.lit("passed"))
    return with_status(edited, filter_spec.without_ends())


def trim_fixed(reads: DataFrame, left: int = 0, right: int = 0, min_read_length: int | None = None) -> DataFrame:
    """Cut off a fixed number of bases, at most a quarter of the shortest read."""
    if min_read_length is not None and max(left, right) > min_read_length // 4:
        raise ValueError("an end is longer than a quarter of the shortest read")
    kept = F.greatest(F.length("sequence") - left - right, F.lit(0))
    return reads.withColumns({c: F.substring(F.col(c), F.lit(left + 1), kept) for c in ("sequence", "quality")})


def edited_count(reads: DataFrame) -> DataFrame:
    return reads.agg(F.count_if(F.col("edited")).alias("num_edited"))


#: Codes of bases: A, C, G, T in either case; N; the record mark; all other letters.
LUT = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 5, ">": 62}
LUT_OTHER = 4


def lut_encode(reads: DataFrame) -> DataFrame:
    """``codes``: the code of each character of the sequence."""
    chars = F.when(F.length("sequence") > 0, F.split("sequence", "")).otherwise(F.array().cast("array<string>"))

    def code(c):
        out = F.lit(LUT_OTHER)
        for letter, n in LUT.items():
            same = (F.upper(c) == letter) if letter in "ACGT" else (c == letter)
            out = F.when(same, n).otherwise(out)
        return out

    return reads.withColumn("codes", F.transform(chars, code))
