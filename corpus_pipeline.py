"""Documents to token ids: identify the language, drop near-duplicates, remove
benchmark passages, mix the sources, write the ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  ``run`` writes a
stage's result to the shared folder and reads it again for the next one, so a
lost executor costs no more than the tasks that it ran.  When a stage's result is
written, the one before it and the stage's own work files are removed.

Defined results, in the order of the stages: documents whose text is null, empty
or without a letter have no language and go, so nothing after sees one; very long
texts pass whole; copies and repeated rows of one text are a group, of which the
document with the smallest doc_id stays (rows without an id can't be told apart
and stay); ties are decided as the operators state; an empty table passes every
stage and gives no rows; all columns are returned as they are up to the last
stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import decontam, langid, mixing, simhash, tokenbin
from strandloom.llm._shared import discard, materialize, table, work_files


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return langid.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of two benchmark items or more go; from others the
    passages go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed ids, written and read again.  Workers have other stages' memory as
    well, so they keep fewer pieces of text than by default."""
    return tokenbin.tokenised(docs, tokenbin.default_tokenizer(), pieces=120_000)


STAGES = [
    ("language_id", identify),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_ids", tokenise),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with work_files(spark) as own:
            docs = materialize(stage(spark, docs, sf_dir), name, keep=True)
        discard(spark, before)
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
