"""The pipeline against its stages done by brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import corpus_pipeline
from helpers import DOC_SCHEMA, awkward_rows, words
from strandloom.llm import _shared, mixing
from test_operators import plain_hits, plain_wide, whole_ids
import numpy as np


def plain_copies(rows, seed=7):
    """rows: (doc_id, source, size) of distinct ids; one source and document at a time."""
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    aims = mixing.targets(list(sizes.items()))
    out = {}
    for source, whole in sizes.items():
        name = f"{seed}/{'true' if source is None else 'false'}/{source or ''}"
        offset = int(hashlib.md5(name.encode()).hexdigest()[:8], 16) / 2**32
        rate = min(2.0, aims[source] / whole) if whole else 0.0

        def place(row):
            doc_id, _, size = row
            bits = (size + 1).bit_length() - 1
            return bits * 8 + ((size + 1) * 8 >> bits) - 8, int(hashlib.md5(str(doc_id).encode()).hexdigest()[:8], 16) % 32, size, doc_id

        for k, row in enumerate(sorted((r for r in rows if r[1] == source), key=place), 1):
            out[row[0]] = math.floor(k * rate + offset) - math.floor((k - 1) * rate + offset)
    return out


def test_stages_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)

    known = stage["language_id"](spark, docs, sf_dir)
    assert known.columns == docs.columns and known.count() == docs.count()

    one = stage["near_dedup"](spark, known, sf_dir)
    of = plain_wide([(r["doc_id"], r["text"]) for r in known.collect()])
    rows = {r["doc_id"]: r for r in one.collect()}
    assert one.columns == docs.columns and set(rows) == set(of.values())

    clean = stage["decontamination"](spark, one, sf_dir)
    got = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == docs.columns
    for i, r in rows.items():
        _, n_hit, n_items, _, gone = plain_hits(r["text"], items)
        assert (i in got) == (not gone)
        if not gone:
            assert (got[i] == r) == (n_hit == 0) and plain_hits(got[i]["text"], items)[1] == 0

    mixed = stage["mixing"](spark, clean, sf_dir)
    copies = plain_copies([(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in got.values()])
    assert Counter(mixed.collect()) == Counter({got[i]: n for i, n in copies.items() if n})

    start, want = 0, []
    for r in sorted(mixed.collect(), key=lambda r: r["doc_id"]):
        ids = whole_ids([r["text"]])[0]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    final = stage["token_ids"](spark, mixed, sf_dir)
    assert Counter(tuple(r) for r in final.collect()) == Counter(want)
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == Counter(want)


def written(spark, rows, folder, schema=DOC_SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "same text twice"), (2, None), (3, "cat sat write")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, [], tmp_path)).count() == 0


def test_run_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, through
    the files between the stages; without a language to learn all documents go."""
    known = [(100 + i, f"a known text of number {i} " + words(40, i, 90), "en", "a", 1, 1, "k", 1, "f", 1, "h") for i in range(8)]
    folder = written(spark, awkward_rows() + known, tmp_path / "a")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == DOC_SCHEMA.replace(",", "").split()[::2]
    ids = Counter(r["doc_id"] for r in docs.collect())
    assert {2, 3, 6, 9}.isdisjoint(ids) and sum(ids[i] for i in (7, 8)) <= 6
    rows = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in rows) == ids
    long = [r for r in rows if r["doc_id"] == 5]
    assert all(r["n_tokens"] > 30_000 for r in long)
    bare = written(spark, [(1, "no language here", None), (2, None, None)], tmp_path / "b", "doc_id long, text string, lang string")
    assert corpus_pipeline.identify(spark, spark.read.parquet(f"{bare}/documents.parquet"), bare).count() == 0


def test_run_removes_the_files_between_its_stages(spark, sf_dir, monkeypatch):
    import os

    made, plain = [], _shared.work_path
    monkeypatch.setattr(_shared, "work_path", lambda s, label: (made.append(plain(s, label)), made[-1])[1])
    rows = corpus_pipeline.run(spark, sf_dir)
    gone = [x for x in made if x.rsplit("/", 1)[1].split("-")[0] not in ("mixing", "ids")]
    assert len(gone) > 8 and not any(os.path.exists(x.removeprefix("file://")) for x in gone)
    assert rows.count() > 0


def test_repeated_runs_and_empty_documents(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
