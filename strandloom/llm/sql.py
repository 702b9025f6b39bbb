"""DuckDB SQL with the same rows as the queries that SQL can express."""

OP6_MIXING = r"""
WITH rows_ AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM rows_ GROUP BY source
), filled AS (
  SELECT *, 2 * source_size AS cap, sum(w) OVER () AS w_all, 1.5::DOUBLE * sum(source_size) OVER () AS t_all,
         coalesce(sum(2 * source_size) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM sources
  WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, (t_all - cap_before) * w / (w_all - w_before) > cap AS is_full FROM filled
), aims AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap::DOUBLE
              ELSE (t_all - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) * w / sum(w) FILTER (NOT is_full) OVER () END AS target
  FROM capped
), fine AS (
  SELECT greatest(32, CAST(2 ** ceil(log2(greatest(count(*), 1) / 50000.0)) AS BIGINT)) AS n FROM documents
), placed AS (
  SELECT r.doc_id, r.size, a.source_size, a.target,
         row_number() OVER (PARTITION BY r.source ORDER BY
           (length(bin(size + 1)) - 1) * 8 + (((size + 1) * 8) >> (length(bin(size + 1)) - 1)) - 8,
           ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % (SELECT n FROM fine), size, doc_id) AS k,
         ('0x' || substr(md5('7/' || CASE WHEN r.source IS NULL THEN 'true' ELSE 'false' END || '/' || coalesce(r.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
         CASE WHEN a.source_size = 0 THEN 0.0::DOUBLE ELSE least(2.0::DOUBLE, a.target / a.source_size) END AS rate
  FROM rows_ r JOIN aims a ON r.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((floor(k * rate + u) - floor((k - 1) * rate + u)) * size AS BIGINT) AS taken
FROM placed
"""

OP9_DECONTAM = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(len(w), 8) AS k FROM b WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)
), places AS (
  SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k)
), hits AS (
  SELECT p.rid, p.i, p.k, g.item_id FROM places p JOIN grams g ON p.gram = g.gram AND p.k = g.k
), found AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS listed FROM hits GROUP BY rid
), covered AS (
  SELECT rid, count(DISTINCT spot) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS spot FROM hits) GROUP BY rid
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN found USING (rid) LEFT JOIN covered USING (rid)
"""

OP2_MERKLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), pairs AS (
  SELECT doc_id, text, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text FROM d
  WINDOW o AS (ORDER BY doc_id NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), rows_ AS (
  SELECT *, substr(text, 1, length(text) - length(text) // 4) || substr(next_text, 1, length(text) // 4) AS edited FROM pairs
), texts AS (
  SELECT text FROM rows_ UNION SELECT edited FROM rows_
), cut AS (
  -- A section begins with the text or with the second of two line ends in a row.
  SELECT text, [[[sha256(b) FOR b IN regexp_extract_all(p, '(?s).{1,64}')] FOR p IN string_split(s, chr(10))]
    FOR s IN CASE WHEN text = '' THEN [''] ELSE [x FOR x IN regexp_extract_all(text, '\n?(?:[^\n]+\n)*[^\n]*') IF x <> ''] END] AS tree
  FROM texts
), paragraphs AS (
  SELECT text, [[{'h': sha256('P' || coalesce(array_to_string(p, ''), '')), 'c': p} FOR p IN s] FOR s IN tree] AS tree FROM cut
), sections AS (
  SELECT text, [{'h': sha256('S' || array_to_string([p.h FOR p IN s], '')), 'c': s} FOR s IN tree] AS tree FROM paragraphs
), prints AS (
  SELECT text, sha256('D' || array_to_string([s.h FOR s IN tree], '')) AS root,
    array_to_string(flatten([list_concat(['S' || substr(s.h, 1, 10)],
      flatten([list_concat(['P' || substr(p.h, 1, 10)], ['L' || substr(b, 1, 10) FOR b IN p.c]) FOR p IN s.c])) FOR s IN tree]), ' ') AS nodes,
    list_distinct(flatten([flatten([[substr(b, 1, 10) FOR b IN p.c] FOR p IN s.c]) FOR s IN tree])) AS leaves
  FROM sections
), met AS (
  SELECT r.doc_id, length(r.text) AS n_chars, sha256(r.edited) AS edited_sha256, a.root || ' ' || a.nodes AS fingerprint,
    e.root || ' ' || e.nodes AS edited_fingerprint, a.root AS own_root, e.root AS edited_root, x.root AS next_root,
    len(a.leaves) AS n_own, len(e.leaves) AS n_edited, len(x.leaves) AS n_next,
    len(list_intersect(a.leaves, e.leaves)) AS both_edited, len(list_intersect(a.leaves, x.leaves)) AS both_next
  FROM rows_ r JOIN prints a ON r.text = a.text JOIN prints e ON r.edited = e.text JOIN prints x ON r.next_text = x.text
)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN own_root = edited_root THEN 1.0::DOUBLE WHEN n_own + n_edited = 0 THEN 0.0::DOUBLE
       ELSE both_edited::DOUBLE / (n_own + n_edited - both_edited) END AS near_edited,
  CASE WHEN own_root = next_root THEN 1.0::DOUBLE WHEN n_own + n_next = 0 THEN 0.0::DOUBLE
       ELSE both_next::DOUBLE / (n_own + n_next - both_next) END AS near_next
FROM met
"""

_PLAIN_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_FOUND = " UNION ALL ".join(
    f"SELECT rid, '{kind}' AS kind, {i} AS ord, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM d"
    for i, (kind, pattern) in enumerate(_PLAIN_PATTERNS.items())
)


def _located(found: str, partition: str) -> str:
    """Matches of ``found`` with the text on either side and where they start."""
    return f"""
  SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY {partition} ORDER BY i)
    + coalesce(sum(length(value)) OVER (PARTITION BY {partition} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM (SELECT * EXCLUDE (m, p), unnest(m) AS value, unnest(p[:len(m)]) AS piece, unnest(p[2:]) AS next_piece, generate_subscripts(m, 1) AS i FROM {found} WHERE len(m) > 0)"""


OP5_PII = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), found AS ({_FOUND}
), placed AS ({_located("found", "rid, kind")}
), read_ AS (
  SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM placed
), base AS (
  SELECT rid, kind, ord, start, start + length(value) AS stop, right(piece, 128) AS before, left(next_piece, 128) AS after,
    unnest([kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN digits ELSE lower(value) END,
      kind || '~' || CASE kind WHEN 'email' THEN regexp_replace(lower(value), '^[^@]*@', '@') WHEN 'ip' THEN regexp_extract(value, '^[0-9]+\.[0-9]+\.')
        WHEN 'card' THEN left(digits, 6) ELSE left(digits, length(digits) - 4) END,
      kind]) AS entity, unnest([1, 2, 3]) AS level
  FROM read_
  WHERE CASE kind
    WHEN 'ip' THEN regexp_full_match(value, '(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){{4}}')
    WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum([
      CASE WHEN k % 2 = 0 THEN CAST(substr(reverse(digits), k, 1) AS INT) * 2 // 10 + CAST(substr(reverse(digits), k, 1) AS INT) * 2 % 10
           ELSE CAST(substr(reverse(digits), k, 1) AS INT) END FOR k IN range(1, length(digits) + 1)]) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
    ELSE true END
), near AS (
  SELECT entity, before, after, unnest(regexp_extract_all(lower(
    CASE WHEN length(before) >= 128 THEN regexp_replace(before, '^[^ \t\n\x0B\f\r]+', '') ELSE before END || ' ' ||
    CASE WHEN length(after) >= 128 THEN regexp_replace(after, '[^ \t\n\x0B\f\r]+\z', '') ELSE after END), '\p{{L}}{{3,}}')) AS term
  FROM base
), pairs AS (
  SELECT entity, term, count(*) AS n_both, count(DISTINCT (before, after)) AS contexts, sum(count(*)) OVER (PARTITION BY entity) AS n_entity
  FROM near GROUP BY entity, term
), tokens AS (
  SELECT term, count(*) AS n_term, sum(count(*)) OVER () AS total
  FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}{{3,}}')) AS term FROM d) GROUP BY term
), shares AS (
  SELECT entity, term, least(1.0::DOUBLE, n_both::DOUBLE / n_term) AS p, greatest(1.0::DOUBLE, n_term::DOUBLE * contexts / n_both) AS m,
    -ln(least(1.0::DOUBLE, n_entity::DOUBLE / total)) AS ic
  FROM pairs JOIN tokens USING (term)
), scored AS (
  SELECT entity, term, ic, ln((p + 1.645::DOUBLE * 1.645::DOUBLE / (2 * m) - 1.645::DOUBLE * sqrt(p * (1 - p) / m + 1.645::DOUBLE * 1.645::DOUBLE / (4 * m * m)))
    / (1 + 1.645::DOUBLE * 1.645::DOUBLE / m)) AS log_share
  FROM shares
), disclosing AS (
  SELECT b.rid, s.term, max(least(1.0::DOUBLE, (log_share + ic) / ic)) AS disclosure
  FROM (SELECT DISTINCT rid, entity FROM base) b JOIN scored s USING (entity) WHERE ic > 0 AND (log_share + ic) / ic >= 0.85 GROUP BY ALL
), words_ AS (
  SELECT rid, regexp_extract_all(text, '\p{{L}}{{3,}}') AS m, string_split_regex(text, '\p{{L}}{{3,}}') AS p
  FROM d WHERE rid IN (SELECT rid FROM disclosing)
), spots AS ({_located("words_", "rid")}
), terms AS (
  SELECT s.rid, s.start, s.start + length(s.value) AS stop, CASE WHEN t.disclosure >= 0.95 THEN 'removed' ELSE 'generalised' END AS kind
  FROM spots s JOIN disclosing t ON s.rid = t.rid AND lower(s.value) = t.term
  WHERE NOT EXISTS (FROM base b WHERE b.level = 1 AND b.rid = s.rid AND b.start < s.start + length(s.value) AND s.start < b.stop)
), by_doc AS (
  SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
    count(*) FILTER (kind = 'phone') AS n_phone, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY ord, start) AS listed
  FROM base WHERE level = 1 GROUP BY rid
), by_term AS (
  SELECT rid, count(*) FILTER (kind = 'generalised') AS n_generalised, count(*) FILTER (kind = 'removed') AS n_removed,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY kind, start) AS listed
  FROM terms GROUP BY rid
)
SELECT doc_id, CAST(coalesce(n_email, 0) AS BIGINT) AS n_email, CAST(coalesce(n_ip, 0) AS BIGINT) AS n_ip, CAST(coalesce(n_card, 0) AS BIGINT) AS n_card,
  CAST(coalesce(n_phone, 0) AS BIGINT) AS n_phone, sha256(coalesce(b.listed, '')) AS base_sha256, coalesce(concat_ws(',', b.listed, t.listed), '') AS spans,
  CAST(coalesce(n_generalised, 0) AS BIGINT) AS n_generalised, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN by_doc b USING (rid) LEFT JOIN by_term t USING (rid)
"""
