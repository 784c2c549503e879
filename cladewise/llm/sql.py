"""DuckDB SQL for the rows of those operator queries that SQL can say."""

from __future__ import annotations

from . import secrets

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""

#: Messages without calls or results, as the given conversations are; others are an error here and tested against plain loops.
CHAT = """
SELECT conv_id, turn, coalesce(role, '') AS role, CAST(0 AS INT) AS n_calls, CAST(0 AS INT) AS n_linked, CAST(0 AS INT) AS n_valid, '' AS problems,
CASE WHEN ltrim(text) LIKE '{%' AND (role = 'tool' OR role = 'assistant' AND contains(text, '"tool_calls"')) THEN error('calls and results are beyond this SQL') ELSE CAST(to_json({'content': coalesce(text, ''), 'role': coalesce(role, '')}) AS VARCHAR) END AS message
FROM conversations
"""

WARC = """
SELECT page_id, url, bytes AS payload_bytes, sha1(body) AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT *, CASE WHEN bytes >= 1000 THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS first FROM (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS body, CAST(strlen(coalesce(html, '')) AS BIGINT) AS bytes FROM pages))
"""

MIDDLE = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || doc_id) AS digest FROM documents),
d AS (SELECT *, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(digest, 9, 8) AS BIGINT) % (n + 1) AS y, CAST('0x' || substr(digest, 17, 8) AS BIGINT) % 100 AS plain, CAST('0x' || substr(digest, 25, 8) AS BIGINT) % 100 AS spm FROM h),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR plain >= 90 THEN 'plain' WHEN spm < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""

RANKED = r"""
WITH words AS (SELECT kind, id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
FROM (SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS row, text FROM documents UNION ALL SELECT 'i', item_id, row_number() OVER (), text FROM benchmark)),
tf AS (SELECT id, row, term, CAST(count(*) AS BIGINT) AS tf FROM words WHERE kind = 'd' GROUP BY ALL),
own AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY row),
told AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM own),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, told GROUP BY term, docs),
s AS (SELECT i.id AS item_id, i.row AS item, tf.id AS doc_id, tf.row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) AS BIGINT) AS score
FROM (SELECT DISTINCT id, row, term FROM words WHERE kind = 'i') i JOIN tf ON i.term = tf.term JOIN w ON w.term = tf.term JOIN own ON own.row = tf.row, told GROUP BY ALL)
SELECT item_id, CAST(r AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= 50
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(pattern: str, kind: int, kept: str = "true") -> str:
    """The spans of a pattern's matches m: what lies between them tells where they begin."""
    p = _quoted(pattern)
    gaps, whole = f"list_transform(string_split_regex(text, {p}), lambda g: length(g))", f"regexp_extract_all(text, {p}, 0)"
    begin = "CAST(list_sum(list_slice(gaps, 1, i)) + coalesce(list_sum(list_transform(list_slice(whole, 1, i - 1), lambda m: length(m))), 0) AS INT)"
    span = f"{{'start': {begin}, 'kind': {kind}, 'end': CAST({begin} + length(whole[i]) AS INT)}}"
    return f"(SELECT list_transform(list_filter(range(1, len(whole) + 1), lambda i: {kept}), lambda i: {span}) FROM (SELECT {gaps} AS gaps, {whole} AS whole, regexp_extract_all(text, {p}, {2 if kind == 0 else 0}) AS value))"


def _near(*others: str) -> str:
    """Another part with at most SCOPE characters between."""
    return "(" + " OR ".join(f"len(list_filter({o}, lambda o: o['start'] - s['end'] <= {secrets.SCOPE} AND s['start'] - o['end'] <= {secrets.SCOPE})) > 0" for o in others) + ")"


def _shown(spans: str) -> str:
    names = "[" + ", ".join(_quoted(k) for k in secrets.KINDS) + "]"
    return f"array_to_string(list_transform({spans}, lambda s: {names}[s['kind'] + 1] || ':' || s['start'] || ':' || s['end']), ',')"


def secret_scans() -> str:
    # Without lookarounds: a weak part is a whole run of its letters that has the right shape.
    weak_id = _spans("[A-Za-z0-9]+", 3, "regexp_full_match(whole[i], '[A-Z][A-Z0-9]{15,}')")
    shape = " AND ".join(f"regexp_matches(whole[i], '{c}')" for c in ("[0-9]", "[a-z]", "[A-Z]"))
    weak_secret = _spans("[A-Za-z0-9+/=_-]+", 4, f"regexp_full_match(whole[i], '[A-Za-z0-9+/_-]{{20,}}=*') AND {shape}")
    parts = {"a": _spans(secrets.ASSIGN, 0, "length(value[i]) >= 6"), "k": _spans(secrets.ACCESS, 1), "h": _spans(secrets.HEX, 2), "wi": weak_id, "ws": weak_secret, "e": _spans(secrets.ENDPOINT, 5)}
    found = "SELECT doc_id, " + ", ".join(f"{x} AS {n}" for n, x in parts.items()) + " FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
    roles = f"SELECT *, list_sort(list_concat(a, k, h)) AS base, list_concat(k, wi) AS ids, list_concat(a, h, ws) AS secs, e AS ends FROM ({found})"
    free = "len(list_filter(base, lambda b: b['start'] < s['end'] AND s['start'] < b['end'])) = 0"
    kept = [f"list_filter({c}, lambda s: {_near(*o)} AND {free})" for c, o in (("wi", ("secs", "ends")), ("ws", ("ids", "ends")), ("e", ("ids", "secs")))]
    number = ", ".join(f"CAST(len({c}) AS BIGINT) AS n_{n}" for c, n in (("a", "assign"), ("k", "access"), ("h", "hex")))
    return f"SELECT doc_id, {number}, sha256({_shown('base')}) AS base_sha256, {_shown(f'list_sort(list_concat(base, {kept[0]}, {kept[1]}, {kept[2]}))')} AS spans FROM ({roles})"
