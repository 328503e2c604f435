"""SQL for the corpus queries that SQL can express.

The others rest on trained models, schedules, tokenizers or keyed permutations; their tests compare
them with brute force, properties or round trips.
"""

OP3 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), q AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest,
    min(page_id) OVER (PARTITION BY body) AS first_id
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""

OP11 = """
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'
    ) AS terms
  FROM documents
), w AS (
  SELECT k, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10
), langs AS (
  SELECT l.lang, count(term) AS v, coalesce(sum(lang_n), 0) AS n FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept ON kept.lang = l.lang GROUP BY l.lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept ON kept.lang = w.lang AND kept.term = w.term GROUP BY w.lang, w.source, w.term
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM groups g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
), shares AS (
  SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * CAST(coalesce(c.n, 0) + 2 AS HUGEINT)) // CAST(t.n + 2 * langs.v AS HUGEINT) AS p,
    1 + (1000000000 * CAST(kept.lang_n + 2 AS HUGEINT)) // CAST(langs.n + 2 * langs.v AS HUGEINT) AS q
  FROM totals t JOIN langs ON langs.lang = t.lang JOIN kept ON kept.lang = t.lang
  LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

# The checksum of an id is that of its decimal digits, byte by byte with the table of the polynomial.
OP12 = """
WITH crc_table AS (
  SELECT list(c ORDER BY b) AS crcs FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS b)
  )
), ids AS (
  SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL
), checksums AS (
  SELECT c, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ord(substr(CAST(c AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))),
      lambda x, y: xor(x // 256, crcs[CAST(xor(x % 256, y) + 1 AS INTEGER)])
    ), 4294967295) % 4 AS h
  FROM ids, crc_table
), turns AS (
  SELECT conv_id AS c, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, digest, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS pos FROM turns
), made AS (
  SELECT k.c, o.digest, o.words, o.pos, 0 AS part FROM checksums k JOIN own o ON o.c = k.c - k.c % 20 AND o.pos <= k.h
  UNION ALL
  SELECT k.c, o.digest, o.words, o.pos, 1 AS part FROM checksums k JOIN own o ON o.c = k.c AND o.pos > k.h
), numbered AS (
  SELECT c, digest, words, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth FROM made
), prefixes AS (
  SELECT c, words, depth, count(*) OVER (PARTITION BY c) AS n_turns,
    sha256(string_agg(digest, ',') OVER (PARTITION BY c ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS node
  FROM numbered
  UNION ALL
  SELECT ids.c, 0, 0, (SELECT count(*) FROM numbered n WHERE n.c = ids.c), 'root' FROM ids
), linked AS (
  SELECT p.*, q.node AS above FROM prefixes p LEFT JOIN prefixes q ON q.c = p.c AND q.depth = p.depth - 1
), nodes AS (
  SELECT node, min(c) AS conv_id, min(depth) AS depth, min(above) AS above, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE depth = n_turns), '')) AS ends_sha256
  FROM linked GROUP BY node
), children AS (
  SELECT above AS node, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above
), full_nodes AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN children k ON k.node = n.node
), subtree AS (
  SELECT p.node, count(*) FILTER (WHERE n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM full_nodes n JOIN prefixes p ON p.c = n.conv_id AND p.depth <= n.depth GROUP BY p.node
)
SELECT CAST(n.conv_id AS BIGINT) AS conv_id, CAST(n.depth AS BIGINT) AS depth, CAST(a.conv_id AS BIGINT) AS parent_conv_id,
  CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN subtree s ON s.node = n.node LEFT JOIN nodes a ON a.node = n.above
"""

OP13 = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    array_to_string(list_sort(list_filter(
      string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND split_part(p, '=', 1) NOT IN ('ref', 'gclid', 'fbclid')
    )), '&') AS query
  FROM u
), p AS (
  SELECT page_id, host, path, CASE WHEN host = '' THEN ''
      ELSE regexp_replace(host, '^www[.]', '') || regexp_replace(path, '/+$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical,
    TRY_CAST(nullif(regexp_extract(path, '/([0-9]+)([.]html)?/?$', 1), '') AS BIGINT) AS doc
  FROM cut
), listed AS (
  SELECT DISTINCT canonical FROM p WHERE canonical <> '' AND doc IN (SELECT doc_id FROM labels WHERE toxic = 1)
), rules(verdict, host, path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fit AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, f.rule, p.canonical,
  coalesce(f.verdict, CASE WHEN l.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN fit f ON f.page_id = p.page_id AND f.k = 1 LEFT JOIN listed l ON l.canonical = p.canonical
"""

ORACLES: dict[str, str] = {
    "op3_warc": OP3, "op11_source_divergence": OP11, "op12_prefix_trie": OP12, "op13_url_verdicts": OP13,
}
