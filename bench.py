"""Times the headline queries; prints one JSON line.

Reads are derived once and kept in memory; each query is run three times and the
quickest counts.  Those under ``files`` read a FASTQ file of these reads, written
before, and aren't part of the total.
"""

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
PARTS = max(8, int(CPUS))


def main() -> None:
    from strandloom import queries
    from strandloom.operators import editing, filtering, kmers, signature, statistics
    from strandloom.plans import commands
    from strandloom.sources import fastq
    from strandloom.spec import StatsSpec

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(PARTS))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    reads = queries.reads(spark, SF_DIR).repartition(PARTS).cache()
    reads.count()
    folder = tempfile.mkdtemp(prefix="strandloom-bench-")
    fastq.lines(reads).write.text(f"file://{folder}/reads")
    scanned = lambda: fastq.read_fastq(spark, f"file://{folder}/reads")
    runs = {
        "read_stats": lambda: statistics.read_stats(reads),
        "summary": lambda: statistics.summary(statistics.read_stats(reads)),
        "filter_split": lambda: filtering.with_status(reads, queries.ALL),
        "edit_filter": lambda: editing.edit_then_filter(reads, queries.BOTH, queries.ALL),
        "histograms": lambda: statistics.histograms(statistics.read_stats(reads)),
        "quality_per_position": lambda: statistics.quality_per_position(statistics.position_counts(reads)),
        "kmer_counts": lambda: kmers.counts(reads),
        "kmer_positions": lambda: kmers.positions(reads),
        "cgr_fill": lambda: signature.fill(reads, queries.WORD),
    }
    of_files = {
        "scan_fastq": scanned,
        "report": lambda: commands.run_stats(spark, f"file://{folder}/reads", f"{folder}/report", StatsSpec(kmers=True)),
        "filter_files": lambda: commands.run_filter(spark, f"file://{folder}/reads", f"{folder}/filtered", queries.ALL),
    }
    took, files = {}, {}
    for name, make in (runs | of_files).items():
        best = float("inf")
        for _ in range(3):
            t = time.perf_counter()
            made = make()
            if name not in ("report", "filter_files"):  # these have written their files
                made.write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t)
        (took if name in runs else files)[name] = round(best, 3)
    print(json.dumps({"metric": "reads_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "files": files, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()
    shutil.rmtree(folder)


if __name__ == "__main__":
    main()
