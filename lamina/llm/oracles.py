"""SQL, as DuckDB runs it, of the operators that SQL can express."""

from __future__ import annotations

from .secrets import ADDED, EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, KINDS

SUBSTRINGS = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), w AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM d WHERE len(words) >= 13
), h AS (
  SELECT doc_id, i, sha256(array_to_string(words[i : i + 12], ' ')) AS h FROM w
), bad AS (
  SELECT doc_id, i FROM h JOIN (SELECT h, min(doc_id) AS first FROM h GROUP BY h) USING (h) WHERE doc_id > first
), gone AS (
  SELECT doc_id, list(DISTINCT i + k) AS gone FROM bad, (SELECT unnest(range(13)) AS k) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(words, lambda w, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

#: Brute force over all pairs; the operator finds the same links wherever its recall is one (they are far over the threshold in these tables).
NEIGHBOURS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
), ok AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= CAST(0.9 AS DOUBLE)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id LEFT JOIN (SELECT a AS r, min(b) AS low FROM reach GROUP BY a) ON r = vec_id
"""


def secret_scan(kinds, added, owners: int, repositories: int) -> str:
    found, order = [], 0
    for kind, pattern, group, least in [*kinds, *added]:
        p = pattern.replace("'", "''")
        found.append(f"""SELECT doc_id, lang, source, {order} AS ord, '{kind}' AS kind, {least} AS least, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {group}) AS v, string_split_regex(text, '{p}') AS gap FROM t WHERE regexp_matches(text, '{p}')""")
        order += 1
    union = "\n  UNION ALL ".join(found)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), f AS ({union}
), i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f
), p AS (
  SELECT doc_id, lang, source, ord, kind, v[i] AS v, least, length(m[i]) AS n,
    list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM i
), k AS (SELECT doc_id, lang, source, ord, kind, sha256(v) AS h, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM p WHERE length(v) >= least
), o AS (SELECT h, count(DISTINCT source) < {owners} AND count(DISTINCT (source, lang)) < {repositories} AS live FROM k GROUP BY h
), g AS (
  SELECT doc_id, count(*) FILTER (ord = 0) AS a, count(*) FILTER (ord = 1) AS b, count(*) FILTER (ord = 2) AS c, {joined} FILTER (ord < {len(kinds)}) AS base, {joined} AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM k JOIN o USING (h) GROUP BY doc_id
)
SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM t LEFT JOIN g USING (doc_id)
"""


ORACLE_SQL = {
    "op3_substring_dedup": SUBSTRINGS,
    "op6_embedding_neighbours": NEIGHBOURS,
    "op9_secret_scans": secret_scan(KINDS, ADDED, EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES),
}
