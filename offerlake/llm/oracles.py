"""SQL for DuckDB with the rows of those operators that SQL can express over whole tables."""

from __future__ import annotations

# Every 100-byte string as a row with its first place; runs of those that are not the first; and what lies between the runs.
PASSAGES = """WITH texts AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS digits, CAST(octet_length(encode(COALESCE(text, ''))) AS BIGINT) AS n_bytes FROM documents),
    strings AS (SELECT doc_id, place, md5(digits[2 * place + 1:2 * place + 200]) AS string FROM (SELECT doc_id, digits, unnest(range(n_bytes - 99)) AS place FROM texts)),
    repeated AS (SELECT doc_id, place FROM (SELECT doc_id, place, row_number() OVER (PARTITION BY string ORDER BY doc_id, place) AS nth FROM strings) WHERE nth > 1),
    marked AS (SELECT *, CASE WHEN place <= lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 100 THEN 0 ELSE 1 END AS opens FROM repeated),
    numbered AS (SELECT *, SUM(opens) OVER (PARTITION BY doc_id ORDER BY place) AS span FROM marked),
    spans AS (SELECT doc_id, MIN(place) AS start, MAX(place) + 100 AS stop FROM numbered GROUP BY doc_id, span),
    between_spans AS (SELECT doc_id, start, lag(stop, 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS since, stop FROM spans),
    pieces AS (SELECT t.doc_id, SUM(stop - start) AS n_removed, COUNT(*) AS n_spans, string_agg(digits[2 * since + 1:2 * start], '' ORDER BY start) || any_value(digits[2 * last + 1:]) AS kept
    FROM between_spans JOIN texts t USING (doc_id) JOIN (SELECT doc_id, MAX(stop) AS last FROM spans GROUP BY doc_id) USING (doc_id) GROUP BY t.doc_id)
    SELECT doc_id, n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(COALESCE(kept, digits))) AS kept_sha256 FROM texts LEFT JOIN pieces USING (doc_id)"""

# CRC-32 byte by byte: entry k of the table is k after eight steps of the reversed polynomial 0xEDB88320.
SHARDS = """WITH entries AS (SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY k) AS entry FROM range(256) r(k)),
    sized AS (SELECT doc_id, CAST(octet_length(encode(COALESCE(text, ''))) + 16 AS BIGINT) AS size, hex(encode(COALESCE(text, ''))) AS digits FROM documents),
    summed AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(size - 16), lambda i: CAST(concat('0x', digits[2 * i + 1:2 * i + 2]) AS BIGINT))),
    lambda c, b: xor(c >> 8, entry[xor(c & 255, b) + 1])), 4294967295) AS text_crc32 FROM sized, entries),
    placed AS (SELECT *, CAST(40 * (SUM(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size) // SUM(size) OVER () AS INT) AS shard FROM summed)
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM placed"""

# Each node is the list of its turns itself, and every node counts towards all lists that it begins with.
TRIE = """WITH entries AS (SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY k) AS entry FROM range(256) r(k)),
    ids AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
    heads AS (SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(s)), lambda i: CAST(ord(s[i + 1]) AS BIGINT))), lambda x, b: xor(x >> 8, entry[xor(x & 255, b) + 1])), 4294967295) % 4 AS h FROM ids, entries),
    turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, {'role': COALESCE(role, ''), 'text': COALESCE(text, '')} AS said FROM conversations),
    rebuilt AS (SELECT heads.c, p, said FROM heads JOIN turns t ON t.c = base WHERE p <= h UNION ALL SELECT heads.c, p, said FROM heads JOIN turns t ON t.c = heads.c WHERE p > h),
    paths AS (SELECT heads.c, COALESCE(path, []) AS path FROM heads LEFT JOIN (SELECT c, list(said ORDER BY p) AS path FROM rebuilt GROUP BY c) USING (c)),
    nodes AS (SELECT path[1:d] AS node, d, MIN(c) AS conv_id, COUNT(*) AS n_convs, COALESCE(string_agg(CASE WHEN d = len(path) THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends FROM (SELECT c, path, unnest(range(len(path) + 1)) AS d FROM paths) GROUP BY ALL),
    counted AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node[d].text, '[^\\x20\\x09-\\x0D]+')) END AS saved, node NOT IN (SELECT node[1:d - 1] FROM nodes WHERE d > 0) AS leaf FROM nodes),
    sums AS (SELECT node[1:a] AS node, SUM(CASE WHEN a = d - 1 THEN 1 ELSE 0 END) AS n_children, COUNT(*) FILTER (leaf) AS n_leaves, SUM(saved) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS a FROM counted) GROUP BY ALL)
    SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(n_children AS BIGINT) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
    FROM nodes n JOIN sums USING (node) LEFT JOIN nodes p ON n.d > 0 AND p.node = n.node[1:n.d - 1]"""

# A match starts after the pieces and matches before it; values are counted by source, and by source and language.
_SECRETS = [
    ("assign", "((?i:password|passwd|secret|token|api_?key))[\"\'\']?\\x20*[:=]\\x20*[\"\'\']?([A-Za-z0-9+/_.=-]+)", 2, "length(value) >= 6"),
    ("access", "AKIA[A-Z0-9]+", 0, "length(value) >= 20"),
    ("hex", "[0-9a-f]{24,}", 0, "true"),
    ("token", "[A-Za-z0-9_-]{20,}", 0, "regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')"),
]
_MATCHES = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT doc_id, {k} AS rank, '{kind}' AS kind, start, start + length(whole) AS stop, value FROM (
    SELECT doc_id, unnest(whole) AS whole, unnest(value) AS value, unnest(list_transform(range(1, len(whole) + 1), lambda k: CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + COALESCE(list_sum(list_transform(whole[1:k - 1], lambda x: length(x))), 0) AS BIGINT))) AS start
    FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS whole, regexp_extract_all(text, '{pattern}', {group}) AS value, string_split_regex(text, '{pattern}') AS gaps FROM texts) WHERE len(whole) > 0)) WHERE {least}"""
    for k, (kind, pattern, group, least) in enumerate(_SECRETS)
)
SECRETS = f"""WITH texts AS (SELECT doc_id, COALESCE(source, '') AS owner, COALESCE(source, '') || '/' || COALESCE(lang, '') AS repository, COALESCE(text, '') AS text FROM documents),
    matches AS ({_MATCHES}),
    judged AS (SELECT *, len(list_distinct(string_split(value, ''))) >= 8 AND regexp_matches(value, '[0-9]') AND NOT regexp_matches(lower(value), 'example|sample|dummy|placeholder|changeme|your|xxxx|0000|123456|abcdef') AS live, MIN(rank) OVER (PARTITION BY doc_id, value) AS first_rank FROM matches),
    common AS (SELECT value, COUNT(DISTINCT owner) > 2 OR COUNT(DISTINCT repository) > 20 AS copied FROM matches JOIN texts USING (doc_id) GROUP BY value),
    shown AS (SELECT doc_id, rank, kind || ':' || start || ':' || stop AS span, start, stop, live, copied FROM judged JOIN common USING (value) WHERE rank < 3 OR live AND NOT copied AND first_rank = 3),
    found AS (SELECT doc_id, COUNT(*) FILTER (rank = 0) AS n_assign, COUNT(*) FILTER (rank = 1) AS n_access, COUNT(*) FILTER (rank = 2) AS n_hex, COALESCE(string_agg(span, ',' ORDER BY start, rank, stop) FILTER (rank < 3), '') AS base,
    string_agg(span, ',' ORDER BY start, rank, stop) AS spans, COUNT(*) FILTER (live AND NOT copied) AS n_live, COUNT(*) FILTER (copied) AS n_copied FROM shown GROUP BY doc_id)
    SELECT doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans, COALESCE(n_live, 0) AS n_live, COALESCE(n_copied, 0) AS n_copied
    FROM texts LEFT JOIN found USING (doc_id)"""

ORACLE_SQL = {"op13_secret_scan": SECRETS, "op11_prefix_trie": TRIE, "op7_suffix_dedup": PASSAGES, "op8_sharding": SHARDS}
