"""The SQL counterparts give the queries' rows, on awkward tables as well."""

import duckdb
import pytest

from helpers import awkward_rows, words
from strandloom.llm import queries

LEAKS = [(i, f"{words(5, i)} zanzibar{'abc'[i]} Zanzibar lives near x{i}y and {words(3, 50 + i)} joe@corp.example.org {words(4, 70 + i)} the") for i in range(3)]
MANY = [(300 + i, f"{words(9, 300 + i).replace('w', 'word')} Zanzibarex {words(9, 400 + i)} amy@corp.example.org") for i in range(40)]
NOISE = [(i, "the one lives near here and there " + words(60, i).replace("w", "word")) for i in range(100, 160)]
LINES = [(200, "\n\n\na\n\nb\n"), (201, "a\n"), (202, "\n"), (203, "one\n\ntwo\nthree\n\n\n" + "x" * 200), (204, "😀" * 130)]
TABLES = {
    "awkward": [(r[0], r[1], r[2], r[3], r[4]) for r in awkward_rows()],
    "crafted": [(i, t, "en", "ab"[i % 2], len(t)) for i, t in LEAKS + NOISE + LINES + MANY],
    "empty": [],
}
BENCHMARK = [("1", "same text twice"), ("2", "text of id eight"), ("3", None), ("4", " lives near here and there word1 ")]


def normal(rows):
    return sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.parametrize("table", TABLES)
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, tmp_path, name, table):
    docs = spark.createDataFrame(TABLES[table], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.queries()[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    rows = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert normal(rows) == normal([tuple(r) for r in got.select(*columns).collect()])
    if (name, table) == ("op5_pii", "crafted"):
        assert any("generalised:" in str(r) for r in rows)
