"""Chaos-game genomic signatures: counts of k-words as cells of a square.

A word's cell has one bit for each base, the last base's being the highest: for
x set by A and T, for y by G and T.  A letter other than A, C, G, T interrupts a
word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import kernels
from strandloom.functions.bases import words_of

GREY, CLIP, IMAGE_BITS, MAX_QUALITY = 128.0, 255, 7, 62.0


def cell(word: Column) -> tuple[Column, Column]:
    bits = lambda ones: F.conv(F.reverse(F.translate(word, "ACGT", ones)), 2, 10).cast("int")
    return bits("1001"), bits("0011")


def fill(reads: DataFrame, k: int, phred_base: int = 33, engine: str = "arrow") -> DataFrame:
    """(x, y, n, qsum): words in each cell and the sum of their Phred qualities."""
    if engine == "arrow":
        cells = reads.select("sequence", "quality").mapInArrow(kernels.signature(k, phred_base), "x int, y int, n bigint, qsum bigint")
        return cells.groupBy("x", "y").agg(F.sum("n").alias("n"), F.sum("qsum").alias("qsum"))
    words = reads.select("quality", F.explode(words_of(F.col("sequence"), k)).alias("w")).where(F.col("w.word").rlike("^[ACGT]*$"))
    raw = F.aggregate(F.split(F.substring(F.col("quality"), F.col("w.pos") + 1, F.lit(k)), ""), F.lit(0).cast("bigint"), lambda a, c: a + F.ascii(c))
    # Words are grouped first: there are 4**k at most to turn into cells.
    by_word = words.groupBy(F.col("w.word").alias("word")).agg(F.count("*").alias("n"), F.sum(raw - k * phred_base).alias("qsum"))
    x, y = cell(F.col("word"))
    return by_word.select(x.alias("x"), y.alias("y"), "n", "qsum")


def mean_quality(cells: DataFrame, k: int) -> DataFrame:
    return cells.select("x", "y", F.expr(f"(qsum div {int(k)}) div n").alias("quality"))


def _scale(cells: DataFrame, k: int) -> DataFrame:
    """One row: what brings the mean cell to ``GREY``.  A signature that was read
    from a file states its number of words."""
    words = F.max("word_count") if "word_count" in cells.columns else F.sum("n")
    return cells.agg((F.lit(GREY) / (F.nullif(words, F.lit(0)) / F.lit(float(4**k)))).alias("scale"))


def difference(cells: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """(x, y, dif) where either has words: both are brought to the same mean."""
    own, other = _scale(cells, k).select(F.col("scale").alias("fn")), _scale(reference, k).select(F.col("scale").alias("gn"))
    both = cells.select("x", "y", F.col("n").alias("n")).join(reference.select("x", "y", F.col("n").alias("m")), ["x", "y"], "full")
    # The scales are one row each.
    both = both.join(F.broadcast(own), F.lit(True)).join(F.broadcast(other), F.lit(True))
    return both.select("x", "y", (F.coalesce("n", F.lit(0)) * F.col("fn") - F.coalesce("m", F.lit(0)) * F.col("gn")).cast("int").alias("dif"))


def require_words(cells: DataFrame) -> DataFrame:
    if not cells.agg(F.sum("n")).first()[0]:
        raise ValueError("a signature without words can't be compared")
    return cells


def difference_stats(dif: DataFrame, k: int) -> DataFrame:
    """Over all 4**k cells; those that are absent are 0."""
    size = float(4**k)
    sums = dif.agg(F.count("*").alias("cells"), F.max("dif").alias("most"), F.min("dif").alias("least"), F.sum("dif").alias("s"), F.sum(F.col("dif").cast("bigint") * F.col("dif")).alias("s2"))
    zero = F.when(F.col("cells") < 4**k, F.lit(0))
    mean = F.coalesce("s", F.lit(0)) / F.lit(size)
    deviation = F.sqrt(F.greatest(F.coalesce("s2", F.lit(0)) / F.lit(size) - mean * mean, F.lit(0.0)))
    return sums.select(F.greatest("most", zero).alias("highest"), F.least("least", zero).alias("lowest"), F.round(mean, 6).alias("mean"), F.round(deviation, 6).alias("stddev"))


def absolute_difference(dif: DataFrame) -> DataFrame:
    return dif.select("x", "y", F.least(F.abs("dif"), F.lit(CLIP)).alias("dif"))


def pixels(cells: DataFrame, k: int, value: str = "n", norm: float | None = None) -> DataFrame:
    """(row, col, grey) of the image: whole numbers modulo 256; a small signature
    is enlarged to 128 by 128.  Without ``norm`` the mean cell is 128."""
    every = cells.sparkSession.range(4**k).select((F.col("id") / 2**k).cast("int").alias("x"), (F.col("id") % 2**k).cast("int").alias("y"))
    scale = _scale(cells, k) if norm is None else cells.sparkSession.range(1).select(F.lit(float(norm)).alias("scale"))
    full = every.join(cells.select("x", "y", F.col(value).alias("v")), ["x", "y"], "left").join(F.broadcast(scale), F.lit(True))
    grey = F.pmod((F.coalesce("v", F.lit(0)) * F.coalesce("scale", F.lit(0.0))).cast("bigint"), F.lit(256)).cast("int")
    step = 2 ** max(0, IMAGE_BITS - k)
    spread = lambda c: F.explode(F.sequence(F.col(c) * step, F.col(c) * step + step - 1))
    return full.select("x", "y", grey.alias("grey")).select("y", "grey", spread("x").alias("row")).select("row", spread("y").alias("col"), "grey")
