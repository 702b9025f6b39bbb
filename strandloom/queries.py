"""Registered queries over sequencing reads, each with its DuckDB counterpart.

The reads are derived from ``orders``: 16 to 64 bases, about one in sixteen N,
qualities from 0 to 40.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import editing, filtering, kmers, signature, statistics
from strandloom.sources import fastq, signature_file
from strandloom.spec import FilterSpec, TrimSpec

HEX, BASE_CHARS, QUALITY_CHARS = "0123456789abcdef", "ACGTACGTACGTACGN", "!'*-039;=?ACEGHI"
ALL = FilterSpec(20, 60, 18, 40, 12, 5, 15, None, 5, 10, None, 3)
ONLY = {
    "filter_length": FilterSpec(min_length=20, max_length=50),
    "filter_quality": FilterSpec(min_quality=22, max_quality=27),
    "filter_out_of_quality": FilterSpec(min_quality=10, max_quality=38, max_out_of_quality=8),
    "filter_left": FilterSpec(left_length=5, min_left_quality=20, max_left_quality=35),
    "filter_right": FilterSpec(right_length=6, min_right_quality=15),
    "filter_max_n": FilterSpec(max_n=2),
    "filter_quality_window": FilterSpec(min_quality=20, max_quality=30, quality_start=4, quality_end=14),
    "filter_outer_bases": FilterSpec(min_length=20, min_quality=18, max_quality=32).with_outer_bases(4, 5),
    "filter_legacy": FilterSpec.legacy(),
    "filter_split": ALL,
}
LEFT, RIGHT = TrimSpec(4, 20, 40), TrimSpec(right_length=6, min_right_quality=18)
BOTH = TrimSpec(4, 20, 40, 6, 18)
WORD = 3


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    half = lambda p: F.md5(F.concat(F.lit(p), key).cast("binary"))
    made = lambda p, q, to: F.substring(F.translate(F.concat(half(p), half(q)), HEX, to), F.lit(1), (16 + F.col("o_orderkey") % 49).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("read_id"), made("s", "t", BASE_CHARS).alias("sequence"), made("q", "r", QUALITY_CHARS).alias("quality"))


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid

        return f"{shared.rstrip('/')}/strandloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="strandloom-")


def _scanned(spark: SparkSession, df: DataFrame, **options) -> DataFrame:
    path = f"{_folder(spark)}/reads"
    fastq.lines(df).write.text(path)
    return fastq.read_fastq(spark, path, **options)


def _scan_paired(spark: SparkSession, d: str) -> DataFrame:
    r = reads(spark, d)
    odd = F.col("read_id").cast("bigint") % 2 == 1
    paths = []
    for side in (odd, ~odd):
        paths.append(f"{_folder(spark)}/mates")
        fastq.lines(r.where(side)).write.text(paths[-1])
    return fastq.read_paired(spark, *paths)


def _sink(spark: SparkSession, d: str) -> DataFrame:
    """Both outputs of a filter, written and read again."""
    path = f"{_folder(spark)}/split"
    fastq.write_split(filtering.with_status(reads(spark, d), ALL), path)
    parts = [fastq.read_fastq(spark, f"{path}/status={s}").withColumn("status", F.lit(s)) for s in ("passed", "failed")]
    return parts[0].unionByName(parts[1])


def _edit_sink(spark: SparkSession, d: str) -> DataFrame:
    """Both outputs of an edit with a filter, written and read again."""
    path = f"{_folder(spark)}/edited"
    fastq.write_split(editing.edit_then_filter(reads(spark, d), BOTH, ALL), path)
    parts = [fastq.read_fastq(spark, f"{path}/status={s}").withColumn("status", F.lit(s)) for s in ("passed", "failed")]
    return parts[0].unionByName(parts[1])


def _written(spark: SparkSession, d: str) -> DataFrame:
    """The data source's own writer, read again in small splits."""
    path = f"{_folder(spark)}/own"
    fastq.register(spark)
    reads(spark, d).write.format("fastq").mode("append").save(path)
    return fastq.read_fastq(spark, path, splitBytes=50_000)


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = reads(spark, d)
    odd = F.col("read_id").cast("bigint") % 2 == 1
    return signature.fill(r.where(~odd), WORD), signature.fill(r.where(odd), WORD)


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    """A signature as a binary file, read again.  At most 4**k cells are collected."""
    cells = signature.fill(reads(spark, d), WORD).select("x", "y", "n").toArrow()
    data = signature_file.encode("reads", WORD, *(c.to_numpy() for c in cells.columns))
    path = f"{_folder(spark)}/reads.gs"
    store, own = fastq._opened(path)
    store.create_dir(own.rpartition("/")[0], recursive=True)
    with store.open_output_stream(own) as out:
        out.write(data)
    return signature_file.read_signature(spark, path).select("word_count", "x", "y", "n")


def _status(spec: FilterSpec) -> Callable:
    return lambda s, d: filtering.with_status(reads(s, d), spec).select("read_id", "status")


def _edited(spec: TrimSpec) -> Callable:
    return lambda s, d: editing.trim(reads(s, d), spec)


def _stats(f: Callable) -> Callable:
    return lambda s, d: f(statistics.read_stats(reads(s, d)))


def _positions(f: Callable) -> Callable:
    return lambda s, d: f(statistics.position_counts(reads(s, d)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _status(spec) for name, spec in ONLY.items()}
    found |= {
        "scan_fastq": lambda s, d: _scanned(s, reads(s, d), splitBytes=100_000),
        "scan_paired": _scan_paired,
        "sink_fastq": _sink,
        "sink_edit": _edit_sink,
        "sink_fastq_source": _written,
        "cgr_load_ref": _loaded,
        "read_stats": _stats(lambda x: x),
        "filter_counts": lambda s, d: filtering.status_counts(filtering.with_status(reads(s, d), ALL)),
        "edit_left": _edited(LEFT),
        "edit_right": _edited(RIGHT),
        "edit_all": _edited(BOTH),
        "edit_count": lambda s, d: editing.edited_count(editing.trim(reads(s, d), BOTH)),
        "edit_filter": lambda s, d: editing.edit_then_filter(reads(s, d), BOTH, ALL),
        "trim_fixed": lambda s, d: editing.trim_fixed(reads(s, d), 3, 4, 16),
        "lut_encode": lambda s, d: editing.lut_encode(reads(s, d)).select("read_id", F.array_join(F.transform("codes", lambda c: c.cast("string")), "").alias("codes")),
        "summary": _stats(statistics.summary),
        "summary_filtered": lambda s, d: statistics.filtered_summary(filtering.with_status(reads(s, d), ALL)),
        "nucleotide_pct": _stats(statistics.nucleotide_pct),
        "hist_length": _stats(lambda x: statistics.histogram(x, "length")),
        "hist_quality": _stats(lambda x: statistics.histogram(x, "quality")),
        "hist_gc": _stats(lambda x: statistics.histogram(x, "gc")),
        "histograms": _stats(statistics.histograms),
        "report_sums": lambda s, d: statistics.one_pass(reads(s, d)).where("kind <> 'read'").select("kind", "key", "n"),
        "report_summary": lambda s, d: statistics.summary_of(statistics.one_pass(reads(s, d))),
        "quality_per_position": _positions(statistics.quality_per_position),
        "nt_per_position": _positions(statistics.nt_per_position),
        "gc_per_position": _positions(statistics.gc_per_position),
        "kmer_counts": lambda s, d: kmers.counts(reads(s, d)),
        "kmer_positions": lambda s, d: kmers.positions(reads(s, d)),
        "kmer_table": lambda s, d: kmers.table(reads(s, d)),
        "kmer_top20": lambda s, d: kmers.top(reads(s, d)),
        "kmer_top5_positions": lambda s, d: kmers.top_positions(reads(s, d)),
        "cgr_fill": lambda s, d: signature.fill(reads(s, d), WORD),
        "cgr_valid_only": lambda s, d: signature.fill(filtering.with_status(reads(s, d), ALL).where("status = 'passed'"), WORD),
        "cgr_quality": lambda s, d: signature.mean_quality(signature.fill(reads(s, d), WORD), WORD),
        "cgr_diff": lambda s, d: signature.difference(*_sides(s, d), WORD),
        "cgr_diff_stats": lambda s, d: signature.difference_stats(signature.difference(*_sides(s, d), WORD), WORD),
        "cgr_absdiff": lambda s, d: signature.absolute_difference(signature.difference(*_sides(s, d), WORD)),
        "cgr_pixels": lambda s, d: signature.pixels(signature.fill(reads(s, d), WORD), WORD),
    }
    return found


def oracle_sql() -> dict[str, str]:
    from strandloom import reads_sql

    return reads_sql.all_sql()
