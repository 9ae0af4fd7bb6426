"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

# The rules of the url query and the words' separators.
_URL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM u
), r(rhost, rpath, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, v, length(rhost || rpath) AS n
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule, n) AS rule, coalesce(arg_max(v, n), 'allow') AS verdict
FROM m GROUP BY page_id
"""

_SPANS = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS s, w FROM w WHERE len(w) >= 20
), g AS (
  SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS win FROM p
), f AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) > 1 AS again FROM g
), c AS (
  SELECT DISTINCT doc_id, s + unnest(generate_series(0, 19)) AS i FROM f WHERE again
), l AS (
  SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(generate_series(1, len(w)), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: w[i]), ' ')) AS kept_sha256
FROM w LEFT JOIN l USING (doc_id)
"""

_HITS = r"""
WITH low AS (
  SELECT doc_id AS id, 0 AS kind, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT item_id, 1, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), w AS (
  SELECT id, kind, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM low
), i AS (
  SELECT id, w, least(10, len(w)) AS n FROM w WHERE kind = 1 AND len(w) > 0
), k AS (
  SELECT DISTINCT id AS item_id, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM (SELECT id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM i)
), d AS (
  SELECT id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM w, (SELECT DISTINCT n FROM k) WHERE kind = 0 AND len(w) >= n
), h AS (
  SELECT d.id, d.s, d.n, k.item_id FROM d JOIN k ON d.n = k.n AND array_to_string(d.w[d.s : d.s + d.n - 1], ' ') = k.win
), c AS (
  SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, s + unnest(generate_series(0, n - 1)) AS p FROM h) GROUP BY id
), e AS (
  SELECT id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY id
)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (id) LEFT JOIN e USING (id) WHERE w.kind = 0
"""

_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), b AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (
  SELECT b.a, b.b FROM b JOIN n x ON x.doc_id = b.a JOIN n y ON y.doc_id = b.b WHERE 100 * k >= 80 * (x.n + y.n - k)
), r AS (
  SELECT doc_id, doc_id AS c FROM w UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a
), m AS (
  SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id
)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

_LINES = r"""
WITH l AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), e AS (
  SELECT r, doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS i FROM l
), k AS (
  SELECT r, doc_id, line, i, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM e
), f AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY r
"""

def _codes(rounds: int = 2) -> str:
    """Assignment and means as often as asked, in whole numbers."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS (
  SELECT r, part, entry, sum((c.v - b.v) * (c.v - b.v)) AS far FROM c JOIN b{k} b USING (part, pos) GROUP BY ALL
), a{k} AS (
  SELECT r, part, arg_min(entry, far * 64 + entry) AS entry, min(far) AS far FROM d{k} GROUP BY ALL
)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS (
  SELECT part, pos, entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN (
    SELECT part, pos, entry, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v FROM c JOIN a{k} USING (r, part) GROUP BY ALL
  ) m USING (part, pos, entry)
)""")
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT r, i // (n // 16) AS part, i % (n // 16) AS pos, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT r, len(e) AS n, unnest(e) AS x, unnest(generate_series(0, len(e) - 1)) AS i FROM k)
), b0 AS (
  SELECT part, pos, r AS entry, v FROM c WHERE r < 64
), {", ".join(steps)}, t AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} JOIN k USING (r) GROUP BY r, vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256 FROM t
"""


TWINS: dict[str, str] = {
    "op2_lempel_ziv_dedup": _SPANS,
    "op8_tensored_minhash": _NEAR,
    "op9_url_rules": _URL,
    "op10_positional_index": _HITS,
    "op11_line_runs": _LINES,
    "op13_metric_codes": _codes(),
}
