"""Reads: golden values, properties, and the registered queries against DuckDB."""

import glob
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom import queries
from strandloom.operators import editing, filtering, kmers, signature, statistics
from strandloom.spec import FilterSpec, TrimSpec, parse_range, phred_base

GOLDEN = [
    ("r1", "ACGTACGTAC", "IIIIIIIIII"),
    ("r2", "AAAAANNGGC", "!!!!!IIIII"),
    ("r3", "GGGGGCCCCC", "5555555555"),
    ("r4", "ACGTN", "I!I!I"),
    ("r5", "TTTTTTTTTTTT", "IIIIIIIIII##"),
    ("r6", "acgtRACGTA", "IIIII55555"),
]
SCHEMA = "read_id string, sequence string, quality string"


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(GOLDEN, SCHEMA).cache()


@pytest.fixture(scope="module")
def reads(spark, sf_dir):
    return queries.reads(spark, sf_dir).cache()


def rows(df, *cols):
    return Counter(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_read_stats(golden):
    got = {r["read_id"]: r for r in statistics.read_stats(golden).collect()}
    assert [got[f"r{i}"]["qsum"] for i in range(1, 7)] == [730, 530, 530, 285, 800, 630]
    assert [tuple(got[f"r{i}"][f"num_{b}"] for b in "acgtn") for i in (1, 2, 6)] == [(3, 3, 2, 2, 0), (5, 1, 2, 0, 2), (2, 1, 1, 1, 0)]


def test_summary_and_histograms(golden):
    stats = statistics.read_stats(golden)
    one = statistics.summary(stats).first()
    assert (one["num_reads"], one["min_length"], one["max_length"], one["sum_length"], one["mean_quality"]) == (6, 5, 12, 57, 28)
    assert [one[f"num_{b}"] for b in "acgtn"] == [11, 11, 11, 16, 3]
    assert {r["bucket"]: r["n"] for r in statistics.histogram(stats, "length").collect() if r["n"]} == {5: 1, 10: 4, 12: 1}
    assert sorted(r["bucket"] for r in statistics.histogram(stats, "length").collect()) == list(range(1, 13))
    assert {r["bucket"]: r["n"] for r in statistics.histogram(stats, "quality").collect() if r["n"]} == {20: 2, 24: 1, 30: 1, 34: 1, 40: 1}
    assert rows(statistics.histogram(stats, "gc")) == Counter({(b, 1): 1 for b in (0, 20, 30, 40, 50, 100)})
    assert {r["bucket"] for r in statistics.histogram(stats, "gc", report_compat=True).collect()} == {20, 30, 40, 50}


@pytest.mark.parametrize("engine", ["arrow", "sql"])
def test_positions(golden, engine):
    got = {r["pos"]: tuple(r[x] for x in ("n", "qsum", "a", "t", "g", "c", "n_n")) for r in statistics.position_counts(golden, engine).collect()}
    assert got[0] == (6, 378, 3, 1, 1, 0, 0) and got[4] == (6, 378, 2, 1, 1, 0, 1) and got[11] == (1, 35, 0, 1, 0, 0, 0)
    assert len(got) == 12 and sum(x[0] for x in got.values()) == 57


@pytest.mark.parametrize("engine", ["arrow", "sql"])
def test_kmers(golden, engine):
    got = {r["kmer"]: r["n"] for r in kmers.counts(golden, 5, engine).collect()}
    assert got == {"TTTTT": 8, "ACGTA": 3, "CGTAC": 2} | dict.fromkeys("AAAAA CCCCC GCCCC GGCCC GGGCC GGGGC GGGGG GTACG TACGT".split(), 1)
    table = kmers.table(golden, 5, engine).collect()
    assert len(table) == 1024 and [r["kmer"] for r in table[:3]] == ["TTTTT", "ACGTA", "CGTAC"]
    assert kmers.top(golden).count() == 20 and kmers.top(golden, report_compat=True).count() == 21


@pytest.mark.parametrize("engine", ["arrow", "sql"])
def test_signature(golden, engine):
    cells = signature.fill(golden, 2, 33, engine)
    want = {(0, 0): (4, 160, 20), (0, 1): (2, 120, 30), (0, 2): (4, 240, 30), (0, 3): (5, 240, 24), (1, 0): (5, 320, 32), (2, 3): (4, 240, 30), (3, 0): (4, 0, 0), (3, 1): (3, 200, 33), (3, 3): (11, 766, 34)}
    quality = {(r["x"], r["y"]): r["quality"] for r in signature.mean_quality(cells, 2).collect()}
    assert {(r["x"], r["y"]): (r["n"], r["qsum"], quality[r["x"], r["y"]]) for r in cells.collect()} == want


def walk(sequence, k):
    """The point moves halfway to a corner for each base; exact in whole numbers."""
    out, held = [], []
    for c in sequence:
        held = [*held, c] if c in "ACGT" else []
        if len(held) >= k:
            x = y = 0
            for b in held[-k:]:
                x = (x >> 1) | ((b in "AT") << (k - 1))
                y = (y >> 1) | ((b in "GT") << (k - 1))
            out.append((x, y))
    return out


def test_signature_equals_a_walk(spark, reads):
    odd = spark.createDataFrame([("a", "A" * 200, "I" * 200), ("b", "T" * 300, "I" * 300), ("c", "", ""), ("d", "ACG", "III")], SCHEMA)
    both = reads.limit(200).unionByName(odd)
    for k in (3, 7):
        want = Counter(x for r in both.collect() for x in walk(r["sequence"], k))
        assert {(r["x"], r["y"]): r["n"] for r in signature.fill(both, k).collect()} == dict(want)


def test_difference_of_equal_signatures_is_zero(golden):
    cells = signature.fill(golden, 2)
    assert all(r["dif"] == 0 for r in signature.difference(cells, cells, 2).collect())
    with pytest.raises(ValueError):
        signature.require_words(signature.fill(golden.limit(0), 2))


@pytest.mark.parametrize(
    "spec,passed",
    [
        (FilterSpec(min_length=8, max_length=11), "1236"),
        (FilterSpec(min_quality=20, max_quality=40), "123456"),
        (FilterSpec(max_n=1), "13456"),
        (FilterSpec(min_quality=20, max_quality=41, max_out_of_quality=2), "13456"),
        (FilterSpec(left_length=3, min_left_quality=20), "13456"),
        (FilterSpec(right_length=3, min_right_quality=20), "12346"),
        (FilterSpec(min_left_quality=99), "123456"),
    ],
)
def test_filters(golden, spec, passed):
    got = filtering.with_status(golden, spec)
    assert {r["read_id"] for r in got.where("status = 'passed'").collect()} == {f"r{i}" for i in passed}
    assert got.count() == 6


def test_filter_properties(spark, reads):
    split = filtering.with_status(reads, queries.ALL)
    assert split.drop("status").exceptAll(reads).isEmpty() and split.count() == reads.count()
    again = filtering.with_status(split.where("status = 'passed'").drop("status"), queries.ALL)
    assert again.where("status = 'failed'").isEmpty()
    odd = spark.createDataFrame([("e", "", ""), ("n", None, None)], SCHEMA)
    assert rows(filtering.with_status(odd, FilterSpec(min_quality=0)), "status") == Counter({("failed",): 2})
    assert rows(filtering.with_status(odd, FilterSpec(left_length=3, min_left_quality=5, max_length=9)), "read_id", "status") == Counter([("e", "passed"), ("n", "failed")])


def test_trim(golden, reads):
    spec = TrimSpec(3, 20, 41, 3, 20, 41)
    got = {r["read_id"]: r for r in editing.trim(golden, spec).collect()}
    assert (got["r2"]["sequence"], got["r2"]["quality"]) == ("AANNGGC", "!!IIIII")
    assert (got["r5"]["sequence"], got["r5"]["quality"]) == ("TTTTTTTTT", "IIIIIIIII")
    assert sum(r["edited"] for r in got.values()) == 2
    cut = editing.trim(reads, TrimSpec(100, 41, None, 100, 41, None))
    assert cut.where("sequence <> '' or quality <> ''").isEmpty()
    assert editing.trim(reads, queries.BOTH).where("length(sequence) <> length(quality)").isEmpty()
    assert editing.edit_then_filter(reads, queries.BOTH, None).where("status <> 'passed'").isEmpty()


def test_sums_agree(reads):
    total = reads.agg(F.sum(F.length("sequence"))).first()[0]
    assert statistics.position_counts(reads).agg(F.sum("n")).first()[0] == total
    assert statistics.histogram(statistics.read_stats(reads), "length").agg(F.sum("n")).first()[0] == reads.count()
    pos = kmers.positions(reads)
    assert rows(pos.groupBy("kmer").agg(F.sum("n").alias("n"))) == rows(kmers.counts(reads))


@pytest.mark.parametrize("parts", [1, 7])
def test_engines_and_partitions_agree(reads, parts):
    r = reads.repartition(parts)
    assert rows(statistics.position_counts(r, "arrow")) == rows(statistics.position_counts(reads, "sql"))
    assert rows(kmers.positions(r, 5, "arrow")) == rows(kmers.positions(reads, 5, "sql"))
    assert rows(signature.fill(r, 4, 33, "arrow")) == rows(signature.fill(reads, 4, 33, "sql"))


def test_nothing_to_read(spark):
    none = spark.createDataFrame([], SCHEMA)
    stats = statistics.read_stats(none)
    assert statistics.summary(stats).first()["num_reads"] == 0
    assert all(statistics.histogram(stats, k).isEmpty() for k in ("length", "quality", "gc"))
    for engine in ("arrow", "sql"):
        assert statistics.position_counts(none, engine).isEmpty() and kmers.counts(none, 5, engine).isEmpty() and signature.fill(none, 2, 33, engine).isEmpty()
    empty = spark.createDataFrame([("e", "", ""), ("n", None, None)], SCHEMA)
    assert statistics.histogram(statistics.read_stats(empty), "gc").isEmpty()


@pytest.mark.parametrize("text,want", [("80,110", (80, 110)), ("80,", (80, None)), ("80", (80, None)), (",110", (None, 110)), (",", (None, None)), ("-1,5", (None, 5)), ("0,0", (0, 0))])
def test_ranges(text, want):
    assert parse_range(text) == want


@pytest.mark.parametrize("text", ["5,2", "-2,5", "x,5", "5,x", "20x"])
def test_bad_ranges(text):
    with pytest.raises(ValueError):
        parse_range(text)


def test_specs():
    for spec, on in [(FilterSpec(), False), (FilterSpec(max_n=0), True), (FilterSpec(left_length=3), False), (FilterSpec(min_left_quality=3), False), (FilterSpec(left_length=3, min_left_quality=3), True), (FilterSpec(max_out_of_quality=2), False), (FilterSpec.legacy(), True), (FilterSpec(left_length=3, min_left_quality=3).without_ends(), False)]:
        assert spec.is_effective() == on
    for spec in (FilterSpec(), TrimSpec(), TrimSpec(3), TrimSpec(None, 3, 4)):
        with pytest.raises(ValueError):
            spec.require()
    assert phred_base("phred64") == 64
    with pytest.raises(ValueError):
        phred_base("phred")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = Counter(tuple(x[names.index(c)] for c in cols) for x in found.fetchall())
    assert rows(df, *cols) == want
