"""DuckDB SQL with the same rows as the queries over reads."""

from __future__ import annotations

from strandloom import queries as q
from strandloom.spec import FilterSpec, TrimSpec

_QUOTED = q.QUALITY_CHARS.replace("'", "''")
READS = f"""reads AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS read_id, o_orderkey AS key,
         substr(translate(md5('s' || o_orderkey) || md5('t' || o_orderkey), '{q.HEX}', '{q.BASE_CHARS}'), 1, CAST(16 + o_orderkey % 49 AS INT)) AS s,
         substr(translate(md5('q' || o_orderkey) || md5('r' || o_orderkey), '{q.HEX}', '{_QUOTED}'), 1, CAST(16 + o_orderkey % 49 AS INT)) AS q
  FROM orders)"""
_PLAIN = "SELECT read_id, s AS sequence, q AS quality"


def _sum(text: str) -> str:
    return f"list_sum(list_transform(string_split({text}, ''), lambda z: CAST(ascii(z) AS BIGINT)))"


def _mean(text: str, low: int | None, high: int | None) -> str:
    tests = [f"({_sum(text)} * 1.0 / length({text}) - 33) {op} {x}" for op, x in ((">=", low), ("<=", high)) if x is not None]
    return "(" + " AND ".join(tests) + ")"


def _passes(spec: FilterSpec, s: str = "s", quality: str = "q") -> str:
    tests = []
    if spec.min_length is not None:
        tests.append(f"length({s}) >= {spec.min_length}")
    if spec.max_length is not None:
        tests.append(f"length({s}) <= {spec.max_length}")
    if spec.max_n is not None:
        tests.append(f"length({s}) - length(replace({s}, 'N', '')) <= {spec.max_n}")
    if spec.left_length is not None:
        tests.append(_mean(f"left({quality}, {spec.left_length})", spec.min_left_quality, spec.max_left_quality))
    if spec.right_length is not None:
        tests.append(_mean(f"right({quality}, {spec.right_length})", spec.min_right_quality, spec.max_right_quality))
    if spec.has_quality():
        if spec.quality_end is not None:
            quality = f"substr({quality}, {spec.quality_start + 1}, {spec.quality_end - spec.quality_start})"
        tests.append(_mean(quality, spec.min_quality, spec.max_quality))
        if spec.max_out_of_quality is not None:
            tests.append(f"len(list_filter(string_split({quality}, ''), lambda z: ascii(z) < {spec.min_quality + 33} OR ascii(z) > {spec.max_quality + 33})) <= {spec.max_out_of_quality}")
    return " AND ".join(tests)


def _status(spec: FilterSpec) -> str:
    return f"CASE WHEN {_passes(spec)} THEN 'passed' ELSE 'failed' END"


def _trimmed(spec: TrimSpec) -> str:
    left = f"(NOT {_mean(f'left(q, {spec.left_length})', spec.min_left_quality, spec.max_left_quality)})" if spec.trims_left() else "false"
    right = f"(NOT {_mean(f'right(q, {spec.right_length})', spec.min_right_quality, spec.max_right_quality)})" if spec.trims_right() else "false"
    return f"""cut AS (SELECT *, CASE WHEN {left} THEN {spec.left_length or 0} ELSE 0 END AS a, CASE WHEN {right} THEN {spec.right_length or 0} ELSE 0 END AS b, {left} OR {right} AS edited FROM reads),
trimmed AS (SELECT read_id, substr(s, 1 + a, length(s) - a - b) AS s, substr(q, 1 + a, length(q) - a - b) AS q, edited FROM cut)"""


_COUNTS = ", ".join(f"length(s) - length(replace(s, '{b}', '')) AS num_{b.lower()}" for b in "ACGTN")
_STATS = f"stats AS (SELECT read_id, length(s) AS length, {_sum('q')} AS qsum, {_COUNTS} FROM {{}})"
_SUMMARY = """count(*) AS num_reads, min(length) AS min_length, max(length) AS max_length, CAST(sum(length) AS BIGINT) AS sum_length,
  round(sum(length) * 1.0::DOUBLE / count(*), 6) AS mean_length, CAST(round(round(avg(qsum / length), 6) - 33) AS INT) AS mean_quality,
  CAST(sum(num_a) AS BIGINT) AS num_a, CAST(sum(num_c) AS BIGINT) AS num_c, CAST(sum(num_g) AS BIGINT) AS num_g, CAST(sum(num_t) AS BIGINT) AS num_t, CAST(sum(num_n) AS BIGINT) AS num_n"""
_PASSED = f"passed AS (SELECT * FROM reads WHERE {_passes(q.ALL)})"
_BUCKETS = {"length": "CAST(length AS BIGINT)", "quality": "CAST((2 * qsum + length) // (2 * length) - 33 AS BIGINT)", "gc": "CAST((100 * (num_g + num_c)) // length AS BIGINT)"}
_POSITIONS = """bases AS (SELECT p - 1 AS pos, substr(s, CAST(p AS INT), 1) AS base, ascii(substr(q, CAST(p AS INT), 1)) AS v FROM (SELECT s, q, unnest(range(1, length(s) + 1)) AS p FROM reads)),
positions AS (SELECT CAST(pos AS INT) AS pos, count(*) AS n, CAST(sum(v) AS BIGINT) AS qsum, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c,
  count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t, count(*) FILTER (base = 'N') AS n_n FROM bases GROUP BY pos)"""


def _words(k: int, source: str = "reads", name: str = "words") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT CAST(p - 1 AS INT) AS pos, substr(s, CAST(p AS INT), {k}) AS kmer, substr(q, CAST(p AS INT), {k}) AS kq
  FROM (SELECT s, q, unnest(range(1, length(s) - {k} + 2)) AS p FROM {source} WHERE length(s) >= {k})) WHERE regexp_full_match(kmer, '[ACGT]*'))"""


def _cells(source: str, name: str, k: int = q.WORD) -> str:
    bit = lambda ones: f"CAST(CAST('0b' || reverse(translate(kmer, 'ACGT', '{ones}')) AS BIGINT) AS INT)"
    return f"""{_words(k, source, f'w_{name}')},
{name} AS (SELECT {bit('1001')} AS x, {bit('0011')} AS y, count(*) AS n, CAST(sum({_sum('kq')} - {33 * k}) AS BIGINT) AS qsum FROM w_{name} GROUP BY ALL)"""


_DICTIONARY = "dictionary AS (SELECT a.b || b.b || c.b || d.b || e.b AS kmer FROM l a, l b, l c, l d, l e)"
_TABLE = f"l AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b), {_DICTIONARY}, {_words(5)}, counted AS (SELECT kmer, count(*) AS n FROM words GROUP BY kmer), listed AS (SELECT kmer, coalesce(n, 0) AS n FROM dictionary LEFT JOIN counted USING (kmer))"
_SIDES = f"""own_reads AS (SELECT * FROM reads WHERE key % 2 = 0), ref_reads AS (SELECT * FROM reads WHERE key % 2 = 1),
{_cells('own_reads', 'own')}, {_cells('ref_reads', 'ref')},
scales AS (SELECT 128.0::DOUBLE / ((SELECT sum(n) FROM own)::DOUBLE / {4**q.WORD}) AS fn, 128.0::DOUBLE / ((SELECT sum(n) FROM ref)::DOUBLE / {4**q.WORD}) AS gn),
difs AS (SELECT x, y, CAST(trunc(coalesce(own.n, 0) * fn - coalesce(ref.n, 0) * gn) AS INT) AS dif FROM own FULL JOIN ref USING (x, y), scales)"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join((READS, *parts)) + "\n" + select


def all_sql() -> dict[str, str]:
    out = {name: _with(select=f"SELECT read_id, {_status(spec)} AS status FROM reads") for name, spec in q.ONLY.items()}
    plain = _with(select=f"{_PLAIN} FROM reads")
    whole = "(a + t + g + c + n_n)"
    size = 4**q.WORD
    edited = "SELECT read_id, s AS sequence, q AS quality, edited"
    stats = _STATS.format("reads")
    histograms = {k: f"h AS (SELECT {b} AS bucket, count(*) AS n FROM stats GROUP BY 1)" for k, b in _BUCKETS.items()}
    dense = "SELECT b.bucket, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range({}, (SELECT max(bucket) FROM h) + 1)) AS BIGINT) AS bucket) b LEFT JOIN h USING (bucket)"
    pct = lambda x, w=whole: f"100.0::DOUBLE * {x} / {w}"
    out |= {
        "scan_fastq": plain,
        "sink_fastq_source": plain,
        "scan_paired": _with(select=f"{_PLAIN}, CASE WHEN key % 2 = 1 THEN 1 ELSE 2 END AS mate FROM reads"),
        "sink_fastq": _with(select=f"{_PLAIN}, {_status(q.ALL)} AS status FROM reads"),
        "sink_edit": _with(_trimmed(q.BOTH), select=f"SELECT read_id, s AS sequence, q AS quality, {_status(q.ALL.without_ends())} AS status FROM trimmed"),
        "report_summary": _with(stats, select=f"SELECT {_SUMMARY} FROM stats"),
        "report_sums": _with(
            stats,
            _POSITIONS,
            select=" UNION ALL ".join(f"SELECT '{k}' AS kind, {b}{' + 33' if k == 'quality' else ''} AS key, count(*) AS n FROM stats GROUP BY 2" for k, b in _BUCKETS.items())
            + " UNION ALL SELECT 'pos' AS kind, CAST(pos AS BIGINT) AS key, n FROM positions",
        ),
        "read_stats": _with(stats, select="SELECT *, qsum / length AS mean_quality FROM stats"),
        "filter_counts": _with(select=f"SELECT count(*) FILTER ({_passes(q.ALL)}) AS num_passed, count(*) FILTER (NOT ({_passes(q.ALL)})) AS num_failed FROM reads"),
        "edit_left": _with(_trimmed(q.LEFT), select=f"{edited} FROM trimmed"),
        "edit_right": _with(_trimmed(q.RIGHT), select=f"{edited} FROM trimmed"),
        "edit_all": _with(_trimmed(q.BOTH), select=f"{edited} FROM trimmed"),
        "edit_count": _with(_trimmed(q.BOTH), select="SELECT count(*) FILTER (edited) AS num_edited FROM trimmed"),
        "edit_filter": _with(_trimmed(q.BOTH), select=f"{edited}, {_status(q.ALL.without_ends())} AS status FROM trimmed"),
        "trim_fixed": _with(select="SELECT read_id, substr(s, 4, length(s) - 7) AS sequence, substr(q, 4, length(q) - 7) AS quality FROM reads"),
        "lut_encode": _with(select="SELECT read_id, translate(s, 'ACGTN', '01235') AS codes FROM reads"),
        "summary": _with(stats, select=f"SELECT {_SUMMARY} FROM stats"),
        "summary_filtered": _with(
            _PASSED,
            _STATS.format("passed"),
            f"one AS (SELECT {_SUMMARY} FROM stats)",
            select="SELECT one.*, num_reads AS num_passed, (SELECT count(*) FROM reads) - num_reads AS num_failed, 100.0::DOUBLE * num_reads / (SELECT count(*) FROM reads) AS processed_pct FROM one",
        ),
        "nucleotide_pct": _with(
            stats,
            "sums AS (SELECT sum(num_a)::DOUBLE AS a, sum(num_c)::DOUBLE AS c, sum(num_g)::DOUBLE AS g, sum(num_t)::DOUBLE AS t, sum(num_n)::DOUBLE AS n FROM stats)",
            select="SELECT " + ", ".join(f"{pct(x, '(a + c + g + t + n)')} AS pct_{x}" for x in "atgcn") + f", {pct('(g + c)', '(a + c + g + t + n)')} AS pct_gc FROM sums",
        ),
        "hist_length": _with(stats, histograms["length"], select=dense.format("1")),
        "hist_quality": _with(stats, histograms["quality"], select=dense.format("(SELECT min(bucket) FROM h)")),
        "hist_gc": _with(stats, histograms["gc"], select="SELECT * FROM h"),
        "histograms": _with(stats, select=" UNION ALL ".join(f"SELECT '{k}' AS kind, {b} AS bucket, count(*) AS n FROM stats GROUP BY 2" for k, b in _BUCKETS.items())),
        "quality_per_position": _with(_POSITIONS, select="SELECT pos, n, qsum, CAST(round(qsum / n - 33) AS INT) AS mean_quality, chr(CAST(round(qsum / n) AS INT)) AS quality_char FROM positions"),
        "nt_per_position": _with(_POSITIONS, select="SELECT pos, a, t, g, c, n_n, " + ", ".join(f"{pct(x)} AS pct_{x}" for x in ("a", "t", "g", "c", "n_n")) + " FROM positions"),
        "gc_per_position": _with(_POSITIONS, select=f"SELECT pos + 1 AS position, {pct('(g + c)')} AS gc_pct FROM positions WHERE {pct('(g + c)')} > 1.0"),
        "kmer_counts": _with(_words(5), select="SELECT kmer, count(*) AS n FROM words GROUP BY kmer"),
        "kmer_positions": _with(_words(5), select="SELECT kmer, pos, count(*) AS n FROM words GROUP BY kmer, pos"),
        "kmer_table": _with(_TABLE, select="SELECT * FROM listed"),
        "kmer_top20": _with(_TABLE, select="SELECT * FROM listed ORDER BY n DESC, kmer LIMIT 20"),
        "kmer_top5_positions": _with(
            _TABLE,
            "best AS (SELECT kmer, CAST(row_number() OVER (ORDER BY n DESC, kmer) AS INT) AS rank FROM listed ORDER BY n DESC, kmer LIMIT 5)",
            "by_pos AS (SELECT kmer, pos, count(*) AS n FROM words JOIN best USING (kmer) GROUP BY kmer, pos)",
            select="SELECT CAST(p + 1 AS INT) AS position, rank, b.kmer, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, (SELECT max(pos) FROM by_pos) + 1)) AS p) CROSS JOIN best b LEFT JOIN by_pos ON by_pos.kmer = b.kmer AND by_pos.pos = p",
        ),
        "cgr_fill": _with(_cells("reads", "cells"), select="SELECT * FROM cells"),
        "cgr_load_ref": _with(_cells("reads", "cells"), select="SELECT CAST(sum(n) OVER () AS BIGINT) AS word_count, x, y, n FROM cells"),
        "cgr_valid_only": _with(_PASSED, _cells("passed", "cells"), select="SELECT * FROM cells"),
        "cgr_quality": _with(_cells("reads", "cells"), select=f"SELECT x, y, (qsum // {q.WORD}) // n AS quality FROM cells"),
        "cgr_diff": _with(_SIDES, select="SELECT * FROM difs"),
        "cgr_absdiff": _with(_SIDES, select="SELECT x, y, least(abs(dif), 255) AS dif FROM difs"),
        "cgr_diff_stats": _with(
            _SIDES,
            f"dense AS (SELECT coalesce(dif, 0) AS dif FROM (SELECT CAST(i // {2**q.WORD} AS INT) AS x, CAST(i % {2**q.WORD} AS INT) AS y FROM (SELECT unnest(range({size})) AS i)) LEFT JOIN difs USING (x, y))",
            select="SELECT max(dif) AS highest, min(dif) AS lowest, round(avg(dif), 6) AS mean, round(stddev_pop(dif), 6) AS stddev FROM dense",
        ),
        "cgr_pixels": _with(
            _cells("reads", "cells"),
            f"scale AS (SELECT 128.0::DOUBLE / (sum(n)::DOUBLE / {size}) AS f FROM cells)",
            select=f"SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, CAST(CAST(trunc(coalesce(n, 0) * f) AS BIGINT) % 256 AS INT) AS grey FROM (SELECT unnest(range(128)) AS r) CROSS JOIN (SELECT unnest(range(128)) AS c) CROSS JOIN scale LEFT JOIN cells ON x = r // {2 ** (7 - q.WORD)} AND y = c // {2 ** (7 - q.WORD)}",
        ),
    }
    return out
