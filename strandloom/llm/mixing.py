"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words.  Its documents stand in a fixed order;
the expected copies of a document are the target over the source's size.  With
one random offset, a document is taken as often as the running sum of expected
copies crosses an integer.  The order is by bands of size and, within a band, by
a hash of the id, so every stretch of it holds the source's mix of sizes and the
words taken come near the target.

The running sum needs ranks, not sizes.  A rank is that of the row within its
cell (source, band, hash) plus the rows of the source's earlier cells.  The number
of cells grows with the table, so that a cell of distinct ids has about
``ROWS_EACH`` rows at most, be all rows of one source and one size.

Defined results: a null or empty text has size 0 and is taken without words; a
very long text is counted whole; a null id, repeated ids and rows, and ties are
ordered by size; a source without words takes none; null is a source of its own;
an empty table gives no rows; ``emit`` returns all columns as they are, whatever
their names, ``mix`` and ``mixed`` read doc_id, source and text alone.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm._shared import materialize

WEIGHTS = (3, 1, 2)
#: Cells of a source and band, at least; rows of a cell, at most but for chance.
SUBCELLS, ROWS_EACH = 32, 50_000
BANDS = 256


def subcells(rows: int) -> int:
    """A power of two that grows with the table."""
    return max(SUBCELLS, 1 << max(0, -(-rows // ROWS_EACH) - 1).bit_length())


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: list[tuple[str | None, int]], share: Fraction = Fraction(3, 2), cap: int = 2, weights: tuple[int, ...] = WEIGHTS) -> dict[str | None, float]:
    """Target of each source.  Sources by code point, null last, weigh as
    ``weights`` repeating; what a source can't take is shared out again."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weigh = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    size = dict(ordered)
    left, open_, out = share * sum(size.values()), set(size), {}
    while open_:
        unit = Fraction(left) / sum(weigh[s] for s in open_)
        full = {s for s in open_ if unit * weigh[s] > cap * size[s]}
        if not full:
            out |= {s: unit * weigh[s] for s in open_}
            break
        out |= {s: Fraction(cap * size[s]) for s in full}
        left -= sum(cap * size[s] for s in full)
        open_ -= full
    return {s: float(x) for s, x in out.items()}


def distributed_targets(sources: DataFrame, share: Fraction, cap: int, weights: tuple[int, ...]) -> DataFrame:
    """``targets`` of a table of sources (is_null, name, n) too long for the driver:
    is_null, name, source_size and target.  What each round fills up is found by a
    sum over the table; only sums and the rows of each partition are collected."""
    ranked = materialize(sources.orderBy("is_null", "name").withColumn("at", F.monotonically_increasing_id()), "sources")
    part, before, begins = F.shiftright("at", 33), 0, {}
    for r in ranked.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.sum("n").alias("words")).orderBy("p").collect():
        begins[r["p"]], before = (before, r["words"]), before + r["n"]
    if not begins:
        return ranked.select("is_null", "name", F.col("n").alias("source_size"), F.lit(0.0).alias("target"))
    first = F.create_map(*[F.lit(x) for p, (b, _) in begins.items() for x in (p, b)])
    place = F.element_at(first, part) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weigh = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = ranked.select("is_null", "name", F.col("n").alias("source_size"), weigh.alias("w"))
    whole, unit, filled = share * sum(w for _, w in begins.values()), Fraction(0), None
    while True:
        full = F.col("w") * F.lit(float(unit)) > cap * F.col("source_size")
        got = rows.agg(F.sum(F.when(full, cap * F.col("source_size"))).alias("words"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if got["w"] is None or (got["words"] or 0, got["w"]) == filled:
            break
        filled = got["words"] or 0, got["w"]
        unit = (whole - filled[0]) / filled[1]
    target = F.least((cap * F.col("source_size")).cast("double"), F.col("w") * F.lit(float(unit)))
    return rows.select("is_null", "name", "source_size", target.alias("target"))


def _hex(key: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, digits), 16, 10).cast("bigint")


def mix(docs: DataFrame, share: Fraction = Fraction(3, 2), cap: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 7, driver_sources: int = 100_000, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every document.

    Up to ``driver_sources`` sources with their sizes come to the driver; targets of
    more are found by sums over their table.  ``extra`` columns of ``docs`` are
    carried along.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), *extra)
    if not extra:
        # Words are counted once; what follows reads the counts.
        rows = materialize(rows, "sizes")
    fine = subcells(rows.count() if not extra else docs.count())
    rows = rows.withColumn("is_null", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    # Eight bands for each power of two, in whole numbers.
    bits = F.length(F.bin(F.col("size") + 1)) - 1
    band = F.least((bits * 8 + F.expr("shiftright((size + 1) * 8, length(bin(size + 1)) - 1)") - 8).cast("bigint"), F.lit(BANDS - 1))
    sub = F.coalesce(F.pmod(_hex(F.col("doc_id"), 8), F.lit(fine)), F.lit(0))
    rows = rows.withColumn("cell", band * fine + sub)
    key = ["is_null", "name", "cell"]
    counts = materialize(rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "cells")
    sources = counts.groupBy("is_null", "name").agg(F.sum("words").alias("n"))
    found = [(r["is_null"], r["name"], r["n"]) for r in sources.limit(driver_sources + 1).collect()]
    if len(found) > driver_sources:
        table = distributed_targets(sources, share, cap, weights)
    else:
        aims = targets([(None if null else s, n) for null, s, n in found], share, cap, weights)
        table = F.broadcast(spark.createDataFrame([(null, s, n, aims[None if null else s]) for null, s, n in found], "is_null boolean, name string, source_size long, target double"))
    before = Window.partitionBy("is_null", "name").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n", "words")
    cells = cells.join(table, ["is_null", "name"])
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("size", "doc_id"))
    placed = rows.withColumn("rank", rank).join(cells, key)
    # A random number in [0, 1) for each source.
    offset = _hex(F.concat(F.lit(f"{seed}/"), F.col("is_null").cast("string"), F.lit("/"), F.col("name")), 8) / F.lit(float(1 << 32))
    rate = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.lit(float(cap)), F.col("target") / F.greatest("source_size", F.lit(1))))
    upto = lambda k: F.floor(k * F.col("rate") + F.col("offset"))
    k = F.col("before") + F.col("rank")
    return placed.withColumn("rate", rate).withColumn("offset", offset).withColumn("copies", (upto(k) - upto(k - 1)).cast("bigint")).select("doc_id", "source", "size", "source_size", "target", "copies", *extra)


def mixed(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame) -> DataFrame:
    """Every document as often as it is taken, with its columns as they are."""
    names = docs.columns
    packed = docs.select("doc_id", "source", "text", F.struct(*names).alias("_strandloom_row"))
    taken = mix(packed, extra=("_strandloom_row",))
    return taken.where("copies > 0").withColumn("_strandloom_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_strandloom_row.*")
