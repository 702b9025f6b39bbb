"""The genomic signature of a file of reads: a binary file, and grey images of the
words' frequency, of their quality, and of the difference to another signature.

What comes to the driver is a square of 4**k cells at most, as Arrow columns.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import filtering, signature
from strandloom.sources import fastq, signature_file
from strandloom.spec import FilterSpec

MAX_K = 12


@dataclass
class SignatureResults:
    """``difference`` has the highest and lowest cell, mean and deviation."""

    words: int
    files: list[str]
    difference: dict | None = None


def write_signature(reads: DataFrame, outdir: str, name: str, k: int = 7, reference: DataFrame | None = None, phred_base: int = 33) -> SignatureResults:
    """``reference`` is a signature of the same k, as ``read_signature`` gives it."""
    if not 1 <= k <= MAX_K:
        raise ValueError(f"words have 1 to {MAX_K} letters")
    os.makedirs(outdir, exist_ok=True)
    base = os.path.join(outdir, f"{os.path.basename(name)}_k={k}")
    files: list[str] = []

    def save(suffix: str, data: bytes) -> None:
        files.append(base + suffix)
        with open(files[-1], "wb") as out:
            out.write(data)

    def image(suffix: str, cells: DataFrame, value: str, norm: float | None) -> None:
        found = signature.pixels(cells, k, value, norm).select("row", "col", "grey").toArrow()
        save(suffix, signature_file.pgm(*(c.to_numpy() for c in found.columns)))

    cells = signature.fill(reads, k, phred_base).persist()
    try:
        signature.require_words(cells)
        x, y, n = (c.to_numpy() for c in cells.select("x", "y", "n").toArrow().columns)
        save(".gs", signature_file.encode(os.path.basename(name), k, x, y, n))
        image("_FG.pgm", cells, "n", None)
        image("_QQ.pgm", signature.mean_quality(cells, k), "quality", 256.0 / signature.MAX_QUALITY)
        stats = None
        if reference is not None:
            dif = signature.difference(cells, signature.require_words(reference), k)
            stats = signature.difference_stats(dif, k).first().asDict()
            image("_FG_dif.pgm", signature.absolute_difference(dif), "dif", 1.0)
        return SignatureResults(int(n.sum()), files, stats)
    finally:
        cells.unpersist()


def run_signature(spark: SparkSession, path: str, outdir: str, k: int = 7, reference: str | None = None, spec: FilterSpec | None = None, phred_base: int = 33, **options) -> SignatureResults:
    """With an effective filter, only the reads that pass count."""
    reads = fastq.read_fastq(spark, path, **options)
    if spec is not None and spec.is_effective():
        reads = filtering.with_status(reads, spec).where(F.col("status") == "passed")
    other = signature_file.read_signature(spark, reference) if reference else None
    return write_signature(reads, outdir, path, k, other, phred_base)
