"""The commands stats, filter, edit and signature, and their command line."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import editing, filtering
from strandloom.plans.report import Results, write_report
from strandloom.plans.signatures import run_signature
from strandloom.sources import fastq
from strandloom.spec import FilterSpec, StatsSpec, TrimSpec, parse_range, phred_base


log = logging.getLogger("strandloom")


@dataclass
class Counts:
    passed: int
    failed: int
    edited: int = 0


def target(spark: SparkSession, outdir: str) -> str:
    """``outdir`` as a URI that the driver and all executors reach.  A plain path
    is one only in local mode."""
    if "://" in outdir:
        return outdir.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{outdir} is not a URI of a store that all executors reach")
    return "file://" + os.path.abspath(outdir)


def _write(rows: DataFrame, outdir: str, names: dict[str, str], parts: bool = False) -> dict[str, int]:
    """One pass over the reads into a file for each status (``names``) and mate;
    rows of each status.

    Tasks write below ``outdir`` through Spark's writer.  With ``parts`` their
    files stay in ``<outdir>/parts/status=...``; otherwise they are merged.  What
    is there is counted against what was written.
    """
    root, spark = target(rows.sparkSession, outdir), rows.sparkSession
    folder = f"{root}/parts" if parts else f"{root}/.parts-{uuid.uuid4().hex}"
    seen = Observation()
    edited = F.count_if(F.col("edited") if "edited" in rows.columns else F.lit(False))
    mates = ("1", "2") if "mate" in rows.columns else ("",)
    kept = {f"{s}{m}": F.count_if((F.col("status") == s) & (F.col("mate") == int(m) if m else F.lit(True))) for s in ("passed", "failed") for m in mates}
    keys = ["status"] + ["mate"] * bool(mates[0])
    fastq.write_split(rows.observe(seen, *[c.alias(x) for x, c in kept.items()], edited.alias("edited")), folder, keys)
    got = seen.get
    if parts:
        there = {r["status"] + str(r["mate"] if mates[0] else ""): r["n"] // 4 for r in spark.read.text(folder).groupBy(*keys).agg(F.count("*").alias("n")).collect()}
    else:
        there = {}
        for status, name in names.items():
            for m in mates:
                stem, dot, suffix = name.partition(".")
                there[status + m] = fastq.merge(f"{folder}/status={status}" + (f"/mate={m}" if m else ""), f"{root}/{stem}{'_' + m if m else ''}{dot}{suffix}") // 4
        fastq.remove(folder)
    lost = {x: (got[x], there.get(x, 0)) for x in kept if (parts or x[:6] in names) and got[x] != there.get(x, 0)}
    if lost:
        raise OSError(f"reads written and found differ: {lost}")
    return {s: sum(got[f"{s}{m}"] for m in mates) for s in ("passed", "failed")} | {"edited": got["edited"]}


def _reads(spark: SparkSession, path: str | tuple[str, str], options: dict) -> DataFrame:
    return fastq.read_fastq(spark, path, **options) if isinstance(path, str) else fastq.read_paired(spark, *path, **options)


def run_stats(spark: SparkSession, path: str | tuple[str, str], outdir: str = ".", spec: StatsSpec = StatsSpec(), **options) -> Results:
    """Reports in ``outdir``, on the driver's disk.  Of paired files, over both."""
    return write_report(_reads(spark, path, options), outdir, path if isinstance(path, str) else path[0], spec)


def run_filter(spark: SparkSession, path: str | tuple[str, str], outdir: str, spec: FilterSpec, parts: bool = False, **options) -> Counts:
    """passed.fq and failed.fq in ``outdir``, a folder or a URI; of paired files, for
    each mate (``passed_1.fq``...)."""
    rows = filtering.with_status(_reads(spark, path, options), spec.require())
    got = _write(rows, outdir, {"passed": "passed.fq", "failed": "failed.fq"}, parts)
    return Counts(got["passed"], got["failed"])


def run_edit(spark: SparkSession, path: str | tuple[str, str], outdir: str, trim: TrimSpec, spec: FilterSpec | None = None, fixed: tuple[int, int] = (0, 0), min_read_length: int | None = None, parts: bool = False, **options) -> Counts:
    """edit.fq and, if there is a filter, failed.fq.  ``fixed`` bases are cut off
    each end first."""
    on = spec is not None and spec.is_effective()
    rows = _reads(spark, path, options)
    if any(fixed):
        rows = editing.trim_fixed(rows, *fixed, min_read_length)
        trims = trim.trims_left() or trim.trims_right()
        rows = editing.edit_then_filter(rows, trim if trims else TrimSpec(), spec)
        rows = rows.withColumn("edited", F.lit(True))
    else:
        rows = editing.edit_then_filter(rows, trim.require(), spec)
    got = _write(rows, outdir, {"passed": "edit.fq"} | ({"failed": "failed.fq"} if on else {}), parts)
    return Counts(got["passed"], got["failed"], got["edited"])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom", description="Statistics, filters and edits of FASTQ reads")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("stats", "filter", "edit", "signature"):
        p = commands.add_parser(name)
        p.add_argument("-f", "--fastq-file")
        p.add_argument("--fastq-file-2", help="the mates' file, of paired reads")
        p.add_argument("-o", "--outdir", default=".")
        p.add_argument("--conf", help="JSON file of options; those of the command line come first")
        p.add_argument("--log-file")
        p.add_argument("--multiline", action="store_true")
        p.add_argument("--num-threads", type=int, default=2)
        p.add_argument("--batch-size", type=int, default=10_000)
        p.add_argument("--quality-encoding", default="phred33")
        if name == "stats":
            p.add_argument("--kmers", action="store_true")
            p.add_argument("--report-compat", action="store_true")
        if name in ("filter", "edit"):
            p.add_argument("--parts", action="store_true", help="leave the tasks' files in place")
        if name == "edit":
            p.add_argument("--ltrim-nts", type=int, default=0)
            p.add_argument("--rtrim-nts", type=int, default=0)
        if name != "edit":
            p.add_argument("--legacy", action="store_true", help="the thresholds of old, where no others are given")
        p.add_argument("--lfilter-nts", type=int, default=None)
        p.add_argument("--rfilter-nts", type=int, default=None)
        p.add_argument("--quality-window", type=parse_range, default=(None, None), help="positions whose quality counts: from 0, the end not included")
        if name == "signature":
            p.add_argument("-k", type=int, default=7)
            p.add_argument("--gs-filename", help="signature to compare with")
        for option in ("read-length", "read-quality", "left-quality", "right-quality"):
            p.add_argument(f"--{option}-range", type=parse_range, default=(None, None))
        for option in ("left-length", "right-length", "max-N", "max-out-of-quality"):
            p.add_argument(f"--{option}", type=int, default=None)
    return top


def specs(args: argparse.Namespace) -> tuple[FilterSpec, TrimSpec]:
    base = phred_base(args.quality_encoding)
    ends = dict(
        left_length=args.left_length,
        min_left_quality=args.left_quality_range[0],
        max_left_quality=args.left_quality_range[1],
        right_length=args.right_length,
        min_right_quality=args.right_quality_range[0],
        max_right_quality=args.right_quality_range[1],
        phred_base=base,
    )
    given = dict(
        min_length=args.read_length_range[0],
        max_length=args.read_length_range[1],
        min_quality=args.read_quality_range[0],
        max_quality=args.read_quality_range[1],
        max_out_of_quality=args.max_out_of_quality,
        max_n=args.max_N,
        quality_start=args.quality_window[0],
        quality_end=args.quality_window[1],
    )
    old = vars(FilterSpec.legacy()) if getattr(args, "legacy", False) else {}
    keep = FilterSpec(**{k: old.get(k) if v is None else v for k, v in given.items()}, **ends)
    return keep.with_outer_bases(args.lfilter_nts, args.rfilter_nts), TrimSpec(**ends)


def parsed(argv: list[str] | None = None) -> argparse.Namespace:
    """Options of the command line and, where it has none, of the ``--conf`` file."""
    args = parser().parse_args(argv)
    if args.conf:
        with open(args.conf) as f:
            found = json.load(f)
        words = [args.command]
        for name, value in found.items():
            words += [f"--{name}"] if value is True else [] if value is False else [f"--{name}={value}"]
        args = parser().parse_args([*words, *(sys.argv[1:] if argv is None else argv)[1:]])
    if not args.fastq_file:
        parser().error("-f/--fastq-file is needed")
    return args


def main(argv: list[str] | None = None) -> int:
    args = parsed(argv)
    keep, trim = specs(args)
    if args.log_file:
        log.addHandler(logging.FileHandler(args.log_file))
        log.setLevel(logging.INFO)
    spark = SparkSession.builder.master(f"local[{args.num_threads}]").appName("strandloom").getOrCreate()
    options = {"batchSize": args.batch_size, "multiline": str(args.multiline).lower()}
    path = (args.fastq_file, args.fastq_file_2) if args.fastq_file_2 else args.fastq_file
    log.info("%s of %s", args.command, path)
    if args.command == "stats":
        found = run_stats(spark, path, args.outdir, StatsSpec(keep, args.kmers, phred_base=keep.phred_base, report_compat=args.report_compat), **options).summary
    elif args.command == "filter":
        found = vars(run_filter(spark, path, args.outdir, keep, args.parts, **options))
    elif args.command == "signature":
        found = vars(run_signature(spark, args.fastq_file, args.outdir, args.k, args.gs_filename, keep, keep.phred_base, **options))
    else:
        found = vars(run_edit(spark, path, args.outdir, trim, keep, (args.ltrim_nts, args.rtrim_nts), keep.min_length, args.parts, **options))
    shown = "\n".join(f"{k}: {v}" for k, v in found.items())
    log.info("results of %s\n%s", args.command, shown)
    print(shown)
    return 0


if __name__ == "__main__":
    sys.exit(main())
