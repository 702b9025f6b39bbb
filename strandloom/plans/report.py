"""Reports of a statistics run: text, tables and plot specifications.

What is collected is one row, or a row for each position, bucket or k-word.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strandloom.operators import filtering, kmers, statistics
from strandloom.spec import StatsSpec


@dataclass
class Plot:
    """A gnuplot specification; nothing runs it."""

    title: str
    x_label: str
    y_label: str
    series: list[str] = field(default_factory=list)

    def text(self, data: str) -> str:
        drawn = ", ".join(f"'{data}' using 1:{i + 2} title '{s}' with lines" for i, s in enumerate(self.series))
        return f"set title '{self.title}'\nset xlabel '{self.x_label}'\nset ylabel '{self.y_label}'\nplot {drawn}\n"


@dataclass
class Results:
    summary: dict
    files: list[str]


def _tsv(path: str, df: DataFrame, header: str | None = None) -> list[tuple]:
    rows = [tuple(r) for r in df.collect()]
    with open(path, "w") as out:
        if header:
            out.write(header + "\n")
        out.writelines("\t".join("" if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in r) + "\n" for r in rows)
    return rows


def write_report(reads: DataFrame, outdir: str, name: str, spec: StatsSpec = StatsSpec()) -> Results:
    """All reports of the reads; if the filter is effective, of those that pass.
    The reads are scanned once; the tables are made of what that scan adds up."""
    os.makedirs(outdir, exist_ok=True)
    base, seen = spec.phred_base, None
    if spec.filter.is_effective():
        seen = Observation()
        split = [F.count_if(F.col("status") == s).alias(f"num_{s}") for s in ("passed", "failed")]
        rows = filtering.with_status(reads, spec.filter).observe(seen, *split)
        reads = rows.where(F.col("status") == "passed").drop("status")
    sums = statistics.one_pass(reads, spec.k if spec.kmers else None).persist()
    try:
        return _tables(sums, seen, outdir, name, spec, base)
    finally:
        sums.unpersist()


def _tables(sums: DataFrame, seen: Observation | None, outdir: str, name: str, spec: StatsSpec, base: int) -> Results:
    one_row = statistics.summary_of(sums, base)
    one = one_row.first().asDict()  # this runs the scan
    counts = dict(seen.get) if seen else None
    positions = statistics.of_kind(sums, "pos")
    files, prefix = [], os.path.join(outdir, os.path.basename(name))

    def table(suffix: str, df: DataFrame, plot: Plot | None = None, header: str | None = None) -> list[tuple]:
        path = f"{prefix}.{suffix}"
        found = _tsv(path, df, header)
        files.append(path)
        if plot:
            with open(f"{path}.gnuplot", "w") as out:
                out.write(plot.text(os.path.basename(path)))
            files.append(f"{path}.gnuplot")
        return found

    histogram = lambda kind: statistics.shaped(statistics.of_kind(sums, kind), kind, base, spec.report_compat).orderBy("bucket")
    table("length.histogram.data", histogram("length"), Plot("Read lengths", "length", "reads", ["reads"]))
    table("read.quality.histogram.data", histogram("quality"), Plot("Read qualities", "quality", "reads", ["reads"]))
    table("GC.histogram.data", histogram("gc"), Plot("GC content", "%", "reads", ["reads"]))
    quality = statistics.quality_per_position(positions, base).orderBy("pos")
    by_pos = table("quality.per.nt.data", quality.select("pos", "mean_quality"), Plot("Quality by position", "position", "quality", ["mean"]))
    table("GC.per.nt.data", statistics.gc_per_position(positions).orderBy("position"), Plot("GC by position", "position", "%", ["GC"]))
    shares = statistics.nt_per_position(positions).orderBy("pos").select(F.col("pos") + 1, "pct_a", "pct_t", "pct_g", "pct_c", "pct_n_n")
    table("nucleotides.data", shares, Plot("Nucleotides by position", "position", "%", list("ATGCN")))
    top = []
    if spec.kmers:
        by_pos_word = kmers.of_sums(sums, spec.k)
        words = by_pos_word.groupBy("kmer").agg(F.sum("n").alias("n"))
        top = table("kmers.txt", kmers.ranked(words, spec.k), header="kmer\tcount")[: 21 if spec.report_compat else 20]
        wide = kmers.top_series(by_pos_word, 5, spec.k).groupBy("position").pivot("rank", [1, 2, 3, 4, 5]).agg(F.first("n")).orderBy("position")
        table("kmers.per.nt.data", wide, Plot("Frequent k-words by position", "position", "count", [r[0] for r in top[:5]]))
    if counts:
        whole = counts["num_passed"] + counts["num_failed"]
        one |= counts | {"processed_pct": 100.0 * one["num_reads"] / whole if whole else None}
    pct = statistics.nucleotide_pct(one_row).first().asDict()
    path = f"{prefix}.summary.txt"
    with open(path, "w") as out:
        if spec.filter.is_effective():
            out.write("Filters: " + ", ".join(f"{k}={v}" for k, v in vars(spec.filter).items() if v is not None) + "\n")
        for part in (one, pct):
            out.writelines(f"{k}: {'' if v is None else v}\n" for k, v in part.items())
        out.write("\nMean quality by position\n")
        for i in range(0, len(by_pos), 5):
            out.write("\t".join(f"{p + 1}: {q} ({chr(q + base)})" for p, q in by_pos[i : i + 5]) + "\n")
        if top:
            out.write("\nMost frequent k-words\n")
            out.writelines(f"{w}\t{n}\n" for w, n in top)
    files.append(path)
    return Results(one | pct, files)
