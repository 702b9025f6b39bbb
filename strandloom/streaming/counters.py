"""Statistics over a stream of reads.

All of them are sums, so a stream's state is one row for each group, and what a
micro-batch adds doesn't depend on the batches before.  Write them in complete or
update mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.filtering import with_status
from strandloom.operators.statistics import histograms, position_counts, read_stats
from strandloom.sources.fastq import register
from strandloom.spec import FilterSpec


def stream_fastq(spark: SparkSession, folder: str, **options) -> DataFrame:
    register(spark)
    return spark.readStream.format("fastq").options(**options).load(folder)


def status_counts(reads: DataFrame, spec: FilterSpec) -> DataFrame:
    return with_status(reads, spec).groupBy("status").agg(F.count("*").alias("n"))


def stream_histograms(reads: DataFrame, phred_base: int = 33) -> DataFrame:
    return histograms(read_stats(reads), phred_base)


def stream_positions(reads: DataFrame) -> DataFrame:
    return position_counts(reads, "arrow")
