"""The registered query of each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import decontam, htmltext, langid, lmscore, merkle, mixing, pii, ring, simhash, sql, tokenbin
from strandloom.llm._shared import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": lambda s, d: langid.identify(table(s, d, "documents")),
        "op2_merkle": lambda s, d: merkle.fingerprints(table(s, d, "documents")),
        "op3_ring": lambda s, d: ring.sharded(table(s, d, "documents")),
        "op4_tokenbin": lambda s, d: tokenbin.tokenised(table(s, d, "documents"), tokenbin.default_tokenizer()),
        "op5_pii": lambda s, d: pii.personal_data(table(s, d, "documents")),
        "op6_mixing": lambda s, d: mixing.mixed(table(s, d, "documents")),
        "op7_htmltext": lambda s, d: htmltext.extracted(table(s, d, "pages")),
        "op8_simhash": lambda s, d: simhash.near_duplicates(table(s, d, "documents")),
        "op9_decontam": lambda s, d: decontam.contamination(table(s, d, "documents"), table(s, d, "benchmark")),
        "op10_lmscore": lambda s, d: lmscore.score(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_merkle": sql.OP2_MERKLE, "op5_pii": sql.OP5_PII, "op6_mixing": sql.OP6_MIXING, "op9_decontam": sql.OP9_DECONTAM}
