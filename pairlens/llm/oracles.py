"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from pairlens.llm.licenses import TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: RFC 4648 base32.
BASE32 = UPPER + "234567"


def near_duplicates(width: int = 2, percent: int = 80) -> str:
    parts = " || ' ' || ".join(f"words[i + {k}]" for k in range(width))
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {width} THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - {width} + 2), lambda i: {parts}) END) AS shingles FROM w
), n AS (SELECT doc_id, len(shingles) AS n_shingles FROM s
), e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= {percent} * (a.n_shingles + b.n_shingles - common)
), u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, u.y FROM r JOIN u ON u.x = r.other
)
SELECT n.doc_id, n.n_shingles::BIGINT AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1) c ON c.doc_id = n.doc_id
"""


def warc_records(least_bytes: int = 0) -> str:
    letters = " || ".join(f"'{BASE32}'[((v >> {20 - 5 * k}) & 31)::INT + 1]" for k in range(1, 5))
    return f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages
), d AS (
  SELECT *, array_to_string(list_transform(list_transform(range(0, 8), lambda g: ('0x' || digest[g * 5 + 1:g * 5 + 5])::BIGINT), lambda v: {letters}), '') AS payload_digest,
    CASE WHEN payload_bytes >= {least_bytes} THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""


def top_k(k: int = 10, every: int = 100, scale: int = 1024) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % {every} = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
) WHERE rank <= {k}
"""


def contamination(window: int = 10) -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH b AS (SELECT item_id, {words} AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(words), {window}) AS n, unnest(list_transform(range(1, len(words) - least(len(words), {window}) + 2), lambda i: array_to_string(words[i:i + least(len(words), {window}) - 1], ' '))) AS win
  FROM b WHERE len(words) > 0
), d AS (SELECT doc_id, {words} AS words FROM documents
), dw AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(words) >= n)
), h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.win = dw.win
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def license_matches(least: float = 0.8) -> str:
    """Every passage against every template; the words of both are taken here."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, texts in TEMPLATES.items() for text in texts)
    words = lambda c: rf"list_filter(string_split(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
    grams = "list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"
    sentences = lambda c: rf"string_split(regexp_replace({c}, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10))"
    runs = lambda c, most: "flatten([" + ", ".join(f"list_transform(range(1, greatest(len({c}) - {n - 2}, 1)), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))" for n in range(1, most + 1)) + "])"
    return rf"""
WITH t AS (SELECT license, {grams} AS bigrams FROM (SELECT license, {words('text')} AS words FROM (VALUES {rows}) x(license, text))
), d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), j AS (
  SELECT r, list_transform(regexp_split_to_array(regexp_replace(text, '(^|\n)[ \t]*(?:#+|//+|/?[*]+/?|--+|;+|%+|<!--)[ \t]?', '\1', 'g'), '\n[ \t\r]*\n'), lambda p: regexp_replace(p, '[ \t\r\n]+', ' ', 'g')) AS joined FROM d
), s AS (SELECT r, {sentences('p')} AS held FROM (SELECT r, unnest(joined) AS p FROM j)
), p AS (
  SELECT DISTINCT r, passage FROM (
    SELECT r, unnest(list_concat([text], list_concat(regexp_split_to_array(text, '\n[ \t\r]*\n'), list_concat(string_split(text, chr(10)), {sentences('text')})))) AS passage FROM d
    UNION ALL SELECT r, unnest({runs('joined', 2)}) FROM j UNION ALL SELECT r, unnest({runs('held', 3)}) FROM s)
), g AS (SELECT r, passage, {grams} AS grams FROM (SELECT r, passage, {words('passage')} AS words FROM p WHERE length(passage) > 2) WHERE len(words) > 1
), c AS (
  SELECT r, passage, license, max(2.0::DOUBLE * len(list_intersect(grams, bigrams)) / (len(grams) + len(bigrams))) AS score FROM g JOIN t
    ON len(grams) BETWEEN len(bigrams) * {least / (2 - least)} - 1e-9 AND len(bigrams) / {least / (2 - least)} + 1e-9 GROUP BY ALL
), m AS (
  SELECT r, license, max(score) AS score FROM (SELECT *, max(score) OVER (PARTITION BY r, passage) AS best FROM c) WHERE score = best AND score >= {least} - 1e-12 GROUP BY r, license
), b AS (
  SELECT r, count(*) AS n, string_agg(license, ',' ORDER BY license) AS names, arg_min(license, struct_pack(a := -score, b := license)) AS best, max(score) AS score FROM m GROUP BY r
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(names, '') AS licenses, best AS best_license, round(score, 6) AS best_score FROM d LEFT JOIN b ON b.r = d.r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_licenses": license_matches(),
        "op6_near_duplicates": near_duplicates(),
        "op7_warc": warc_records(),
        "op8_topk": top_k(),
        "op10_decontamination": contamination(),
    }
