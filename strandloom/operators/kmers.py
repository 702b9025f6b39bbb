"""Counts of k-words of A, C, G, T; other letters interrupt a word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import kernels
from strandloom.functions.bases import words_of

K = 5


def _words(reads: DataFrame, k: int) -> DataFrame:
    rows = reads.select(F.explode(words_of(F.col("sequence"), k)).alias("w")).select(F.col("w.word").alias("kmer"), F.col("w.pos").alias("pos"))
    return rows.where(F.col("kmer").rlike("^[ACGT]*$"))


def counts(reads: DataFrame, k: int = K, engine: str = "arrow") -> DataFrame:
    """(kmer, n) of the words that occur."""
    if engine == "arrow":
        rows = reads.select("sequence").mapInArrow(kernels.kmers(k, False), "kmer string, pos int, n bigint")
        return rows.groupBy("kmer").agg(F.sum("n").alias("n"))
    return _words(reads, k).groupBy("kmer").agg(F.count("*").alias("n"))


def positions(reads: DataFrame, k: int = K, engine: str = "arrow") -> DataFrame:
    """(kmer, pos, n); pos from 0."""
    if engine == "arrow":
        rows = reads.select("sequence").mapInArrow(kernels.kmers(k, True), "kmer string, pos int, n bigint")
        return rows.groupBy("kmer", "pos").agg(F.sum("n").alias("n"))
    return _words(reads, k).groupBy("kmer", "pos").agg(F.count("*").alias("n"))


def dictionary(spark, k: int = K) -> DataFrame:
    """All 4**k words."""
    digits = F.lpad(F.conv(F.col("id"), 10, 4), k, "0")
    return spark.range(4**k).select(F.translate(digits, "0123", "ACGT").alias("kmer"))


def table(reads: DataFrame, k: int = K, engine: str = "arrow") -> DataFrame:
    """All words with their counts, zeros too, most frequent first."""
    return ranked(counts(reads, k, engine), k)


def ranked(found: DataFrame, k: int = K) -> DataFrame:
    """``table`` out of the counts of the words that occur."""
    every = dictionary(found.sparkSession, k)
    return every.join(found, "kmer", "left").select("kmer", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "kmer")


def of_sums(sums: DataFrame, k: int = K) -> DataFrame:
    """``positions`` out of statistics.one_pass."""
    code = F.col("key").bitwiseAND(F.lit((1 << 2 * k) - 1))
    word = F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")
    return sums.where(F.col("kind") == "kmer").select(word.alias("kmer"), F.shiftright("key", 2 * k).cast("int").alias("pos"), "n")


def top(reads: DataFrame, n: int = 20, k: int = K, report_compat: bool = False) -> DataFrame:
    """The most frequent words; the reports' table has one more than it says."""
    return table(reads, k).limit(n + 1 if report_compat else n)


def top_positions(reads: DataFrame, n: int = 5, k: int = K) -> DataFrame:
    """position (from 1), rank (from 1), kmer, n of the most frequent words, at
    every position up to the last at which one of them occurs."""
    return top_series(positions(reads, k), n, k)


def top_series(by_pos: DataFrame, n: int = 5, k: int = K) -> DataFrame:
    """``top_positions`` out of the counts by word and position."""
    from pyspark.sql import Window

    totals = dictionary(by_pos.sparkSession, k).join(by_pos.groupBy("kmer").agg(F.sum("n").alias("total")), "kmer", "left")
    best = totals.select("kmer", F.coalesce("total", F.lit(0)).alias("total")).orderBy(F.desc("total"), "kmer").limit(n)
    # n rows in one window.
    first = best.select("kmer", F.row_number().over(Window.orderBy(F.desc("total"), "kmer")).alias("rank"))
    of_best = by_pos.join(F.broadcast(first), "kmer")
    last = of_best.agg(F.max("pos").alias("last")).where("last is not null")
    every = last.select(F.explode(F.expr("sequence(0, last)")).alias("pos")).join(F.broadcast(first), F.lit(True))
    return every.join(of_best.select("kmer", "pos", "n"), ["kmer", "pos"], "left").select((F.col("pos") + 1).alias("position"), "rank", "kmer", F.coalesce("n", F.lit(0)).alias("n"))
