"""Statistics over reads: per read, in total, as histograms and by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import kernels
from strandloom.functions.bases import BASES, count_of, quality_sum


def read_stats(reads: DataFrame) -> DataFrame:
    """read_id, length, qsum (raw), mean_quality (raw; null if empty), counts of bases."""
    rows = reads.select("read_id", F.length("sequence").alias("length"), quality_sum(F.col("quality")).alias("qsum"), *[count_of(F.col("sequence"), b).alias(f"num_{b.lower()}") for b in BASES])
    return rows.withColumn("mean_quality", F.col("qsum") / F.expr("nullif(length, 0)"))


def _pct(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0))


def summary(stats: DataFrame, phred_base: int = 33) -> DataFrame:
    """One row over the per-read statistics; nulls if there are no reads.
    Quality is the mean over reads of the mean of each."""
    return stats.agg(
        F.count("*").alias("num_reads"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.sum("length").alias("sum_length"),
        F.round(F.sum("length") / F.nullif(F.count("*"), F.lit(0)), 6).alias("mean_length"),
        F.round(F.round(F.avg("mean_quality"), 6) - phred_base).cast("int").alias("mean_quality"),
        *[F.sum(f"num_{b}").alias(f"num_{b}") for b in BASES.lower()],
    )


def filtered_summary(rows: DataFrame, phred_base: int = 33) -> DataFrame:
    """``summary`` over the passed reads of rows with ``status``, with the counts
    of both and the share that was processed."""
    passed = summary(read_stats(rows.where(F.col("status") == "passed")), phred_base)
    counts = rows.agg(F.count_if(F.col("status") == "passed").alias("num_passed"), F.count_if(F.col("status") == "failed").alias("num_failed"))
    # One row beside one row.
    both = passed.join(F.broadcast(counts), F.lit(True))
    return both.withColumn("processed_pct", _pct(F.col("num_reads"), F.col("num_passed") + F.col("num_failed")))


def nucleotide_pct(stats: DataFrame) -> DataFrame:
    """Shares of the five letters among themselves, and of G and C."""
    sums = stats.agg(*[F.sum(f"num_{b}").alias(b) for b in BASES.lower()])
    whole = F.col("a") + F.col("c") + F.col("g") + F.col("t") + F.col("n")
    return sums.select(*[_pct(F.col(b), whole).alias(f"pct_{b}") for b in "atgcn"], _pct(F.col("g") + F.col("c"), whole).alias("pct_gc"))


def length_bucket() -> Column:
    return F.col("length").cast("bigint")


def quality_bucket() -> Column:
    """Rounded half up, in whole numbers."""
    return F.expr("(2 * qsum + length) div nullif(2 * length, 0)")


def gc_bucket() -> Column:
    return F.expr("(100 * (num_g + num_c)) div nullif(length, 0)")


def _dense(counts: DataFrame, low: str, high: str) -> DataFrame:
    """Buckets with zeros from ``low`` to ``high``, SQL over the least and the most."""
    ends = counts.agg(F.min("bucket").alias("least"), F.max("bucket").alias("most")).where("most is not null")
    every = ends.select(F.explode(F.expr(f"sequence(cast({low} as bigint), cast({high} as bigint))")).alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(stats: DataFrame, kind: str, phred_base: int = 33, report_compat: bool = False) -> DataFrame:
    """(bucket, n) of ``length`` (dense from 1, and 0 if there are empty reads),
    ``quality`` (Phred, dense) or ``gc`` (0 to 100; with report_compat the reports'
    1 to 99)."""
    bucket = {"length": length_bucket, "quality": quality_bucket, "gc": gc_bucket}[kind]()
    counts = stats.select(bucket.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))
    return shaped(counts, kind, phred_base, report_compat)


def shaped(counts: DataFrame, kind: str, phred_base: int = 33, report_compat: bool = False) -> DataFrame:
    """A histogram out of the counts of its buckets (qualities raw)."""
    if kind == "length":
        return _dense(counts, "least(1, least)", "greatest(1, most)")
    if kind == "quality":
        return _dense(counts, "least", "most").select((F.col("bucket") - phred_base).alias("bucket"), "n")
    return counts.where("bucket between 1 and 99") if report_compat else counts


def histograms(stats: DataFrame, phred_base: int = 33) -> DataFrame:
    """All three, sparse, in one pass: (kind, bucket, n)."""
    kinds = F.array(
        F.struct(F.lit("length").alias("kind"), length_bucket().alias("bucket")),
        F.struct(F.lit("quality").alias("kind"), (quality_bucket() - phred_base).alias("bucket")),
        F.struct(F.lit("gc").alias("kind"), gc_bucket().alias("bucket")),
    )
    return stats.select(F.inline(kinds)).where("bucket is not null").groupBy("kind", "bucket").agg(F.count("*").alias("n"))


_POSITION = "pos int, n bigint, qsum bigint, a bigint, c bigint, g bigint, t bigint, n_n bigint"


def position_counts(reads: DataFrame, engine: str = "arrow") -> DataFrame:
    """pos (from 0), n, qsum (raw), a, c, g, t, n_n.

    ``arrow`` adds up each partition in numpy; ``sql`` makes a row of each base.
    Both give the same.
    """
    sums = [F.sum(x).alias(x) for x in ("n", "qsum", "a", "c", "g", "t", "n_n")]
    if engine == "arrow":
        return reads.select("sequence", "quality").mapInArrow(kernels.by_position, _POSITION).groupBy("pos").agg(*sums)
    bases = reads.where(F.length("sequence") > 0).select("quality", F.posexplode(F.split("sequence", "")).alias("pos", "base"))
    raw = F.coalesce(F.ascii(F.substring(F.col("quality"), F.col("pos") + 1, F.lit(1))), F.lit(0))
    letters = [F.count_if(F.col("base") == b).alias(x) for b, x in zip(BASES, ("a", "c", "g", "t", "n_n"))]
    return bases.groupBy("pos").agg(F.count("*").alias("n"), F.sum(raw.cast("bigint")).alias("qsum"), *letters)


def quality_per_position(counts: DataFrame, phred_base: int = 33) -> DataFrame:
    mean = F.expr(f"(2 * qsum + n) div (2 * n) - {int(phred_base)}")
    shown = counts.select("pos", "n", "qsum", mean.cast("int").alias("mean_quality"))
    return shown.withColumn("quality_char", F.chr(F.col("mean_quality").cast("bigint") + phred_base))


def nt_per_position(counts: DataFrame) -> DataFrame:
    """Counts, and shares of the five letters among themselves."""
    whole = F.col("a") + F.col("t") + F.col("g") + F.col("c") + F.col("n_n")
    return counts.select("pos", "a", "t", "g", "c", "n_n", *[_pct(F.col(x), whole).alias(f"pct_{x}") for x in ("a", "t", "g", "c", "n_n")])


def gc_per_position(counts: DataFrame) -> DataFrame:
    """Positions from 1 whose share of G and C is above one in a hundred."""
    whole = F.col("a") + F.col("t") + F.col("g") + F.col("c") + F.col("n_n")
    return counts.select((F.col("pos") + 1).alias("position"), _pct(F.col("g") + F.col("c"), whole).alias("gc_pct")).where("gc_pct > 1.0")


def one_pass(reads: DataFrame, k: int | None = None) -> DataFrame:
    """All sums that a report needs, from one scan of the reads (kernels.REPORT):
    a row for each position, bucket and, with ``k``, k-word and position."""
    names = [x.split()[0] for x in kernels.REPORT.split(", ")][2:]
    rows = reads.select("sequence", "quality").mapInArrow(kernels.report(k), kernels.REPORT)
    return rows.groupBy("kind", "key").agg(*[F.sum(x).alias(x) for x in names])


def of_kind(sums: DataFrame, kind: str) -> DataFrame:
    """(bucket, n) of a histogram's kind, or what position_counts gives."""
    rows = sums.where(F.col("kind") == kind)
    if kind == "pos":
        return rows.select(F.col("key").cast("int").alias("pos"), "n", "qsum", "a", "c", "g", "t", "n_n")
    return rows.select(F.col("key").alias("bucket"), "n")


def summary_of(sums: DataFrame, phred_base: int = 33) -> DataFrame:
    """``summary`` out of ``one_pass``."""
    when = lambda kind, x: F.when(F.col("kind") == kind, x)
    reads, length = F.sum(when("read", F.col("qsum"))), F.sum(when("length", F.col("key") * F.col("n")))
    mean = F.sum(when("read", F.col("mean"))) / F.nullif(F.sum(when("read", F.col("n"))), F.lit(0))
    return sums.agg(
        F.coalesce(reads, F.lit(0)).alias("num_reads"),
        F.min(when("length", F.col("key"))).cast("int").alias("min_length"),
        F.max(when("length", F.col("key"))).cast("int").alias("max_length"),
        length.alias("sum_length"),
        F.round(length / F.nullif(reads, F.lit(0)), 6).alias("mean_length"),
        F.round(F.round(mean, 6) - phred_base).cast("int").alias("mean_quality"),
        *[F.sum(when("pos", F.col("n_n" if b == "n" else b))).alias(f"num_{b}") for b in BASES.lower()],
    )
