"""DuckDB SQL for the registered queries that SQL can express, written apart from the Spark code."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP6 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, t, w, len(w) AS n,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
numbered AS (SELECT row_number() OVER () AS r, * FROM p),
pos AS (SELECT r, w, unnest(range(1, n - 1)) AS i FROM numbered WHERE n >= 3),
grams AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM pos),
hot AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams),
covered AS (SELECT r, count(DISTINCT k) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM hot WHERE c > 1) GROUP BY r),
m AS (SELECT doc_id, n::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words
      FROM numbered LEFT JOIN covered USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
        + CASE WHEN 2 * n_letter_words < n_words THEN 64 ELSE 0 END)::BIGINT AS rule_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       rule_bits % 4 <> 0 AS base_failed, rule_bits = 0 AS kept, rule_bits FROM b
"""

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_TOKEN = (r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
          r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|AIza[A-Za-z0-9_-]{30,}"
          r"|-----BEGIN [A-Z ]*PRIVATE KEY-----)")


def _kind(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""SELECT r, src, {rank} AS rank, '{kind}' AS kind, unnest(list_zip(
        regexp_extract_all(t, '{pattern}', 0), regexp_extract_all(t, '{pattern}', {group}),
        regexp_split_to_array(t, '{pattern}'), range(1, len(regexp_extract_all(t, '{pattern}', 0)) + 1))) AS x,
        {least} AS least FROM d WHERE regexp_matches(t, '{pattern}')"""


OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '?') AS src FROM documents),
raw AS ({' UNION ALL '.join([_kind(0, 'assign', _ASSIGN, 2, 6), _kind(1, 'access', 'AKIA[A-Z0-9]+', 0, 20),
                             _kind(2, 'hex', '[0-9a-f]+', 0, 24), _kind(3, 'token', _TOKEN, 0, 10)])}),
cand AS (SELECT r, src, rank, kind, x[1] AS m, x[2] AS v, x[3] AS gap, x[4] AS i, least FROM raw WHERE x[1] IS NOT NULL),
placed AS (SELECT r, src, rank, kind, v, least, length(m) AS n,
        sum(length(gap) + length(m)) OVER (PARTITION BY r, rank ORDER BY i) AS stop FROM cand),
spans AS (SELECT r, src, rank, kind, v, stop - n AS start, stop FROM placed WHERE length(v) >= least),
owned AS (SELECT v, count(DISTINCT src) >= 3 AS example FROM spans GROUP BY v),
judged AS (SELECT r, rank, kind, start, example, kind || ':' || start::BIGINT || ':' || stop::BIGINT AS s
           FROM spans JOIN owned USING (v) WHERE rank < 3 OR NOT example),
per AS (SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b,
        count(*) FILTER (kind = 'hex') AS c, string_agg(s, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
        string_agg(s, ',' ORDER BY start, rank) AS alls, count(*) FILTER (NOT example) AS live FROM judged GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(alls, '') AS spans, coalesce(live, 0)::BIGINT AS n_live
FROM d LEFT JOIN per USING (r)
"""

OP1 = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
h AS (SELECT page_id, CASE WHEN strpos(u, '://') = 0 THEN '' ELSE substr(u, strpos(u, '://') + 3) END AS rest FROM p),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM h),
rules(host, path, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
        ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (SELECT s.page_id, r.host || r.path AS rule, r.action FROM s JOIN rules r
        ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM fit GROUP BY page_id),
spam AS (SELECT DISTINCT host AS spam_host FROM s WHERE regexp_matches(host, '(^|[.-])(spam|pills|casino|bets|adult|ads)([.-]|$)')),
bad AS (SELECT DISTINCT host FROM s JOIN spam ON s.host = spam_host OR ends_with(s.host, '.' || spam_host))
SELECT s.page_id, s.host, s.path, best.rule, coalesce(best.action, CASE WHEN bad.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       bad.host IS NOT NULL AS listed
FROM s LEFT JOIN best USING (page_id) LEFT JOIN bad ON s.host = bad.host
"""

OP5 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM w
"""

OP8 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

OP13 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
        list_dot_product(a.x, b.x)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10
"""

ORACLE: dict[str, str] = {
    "op1_url_filter": OP1, "op4_secret_scan": OP4, "op5_warc": OP5, "op6_quality_rules": OP6, "op8_exact_dedup": OP8,
    "op13_hard_negatives": OP13,
}
