"""DuckDB SQL for the operators that SQL can express, written from their definitions."""

from __future__ import annotations

#: Smallest id that each id reaches: labels spread along links until none changes (UNION drops repeats).
_REACH = """reach(id, root) AS (SELECT id, id FROM ids UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id WHERE r.root < l.b),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""

OP6 = f"""WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
ids AS (SELECT vec_id AS id FROM embeddings),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_dot_product(p.e, q.e) / (p.norm * q.norm) >= 0.9),
{_REACH}
SELECT v.vec_id, count(l.b) AS n_links, any_value(root) AS component_id, any_value(root) = v.vec_id AS kept
FROM v LEFT JOIN links l ON l.a = v.vec_id JOIN roots ON roots.id = v.vec_id GROUP BY v.vec_id"""

OP9 = """WITH crc(n, c) AS (SELECT n, list_reduce([n, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) FROM range(256) t(n)),
lookup AS (SELECT list(c ORDER BY n) AS cell FROM crc),
d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))) AS bytes FROM documents),
s AS (SELECT doc_id, CAST(size AS BIGINT) AS size, xor(4294967295, list_reduce(bytes, lambda c, x: xor(cell[CAST(xor(c, x) % 256 AS INTEGER) + 1], c // 256))) AS text_crc32 FROM d, lookup),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM s),
q AS (SELECT *, CAST(least((2 * before + size) * 16 // (2 * total), 15) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM q"""

OP10 = f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
ids AS (SELECT doc_id AS id FROM documents),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
{_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, root AS component_id, root = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN roots ON roots.id = d.doc_id"""

#: The base patterns as they are stated.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_VALID = {
    "email": "TRUE",
    "ip": "len(list_filter(string_split(v, '.'), lambda p: len(ltrim(p, '0')) > 3 OR CAST(right('000' || p, 3) AS INTEGER) > 255)) = 0",
    "card": f"len({_DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, len({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(reverse({_DIGITS}), CAST(i + 1 AS INTEGER), 1) AS INTEGER) "
    f"ELSE (2 * CAST(substr(reverse({_DIGITS}), CAST(i + 1 AS INTEGER), 1) AS INTEGER)) // 10 + (2 * CAST(substr(reverse({_DIGITS}), CAST(i + 1 AS INTEGER), 1) AS INTEGER)) % 10 END)) % 10 = 0",
    "phone": f"len({_DIGITS}) BETWEEN 8 AND 15",
}


def _found(k: int, kind: str) -> str:
    """Matches with their places: between two matches lies what splitting at the pattern leaves."""
    p = _PATTERNS[kind].replace("'", "''")
    return f"""SELECT row, {k} AS k, '{kind}' AS kind, v, CAST(list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(vs[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s FROM (
    SELECT row, gaps, vs, unnest(vs) AS v, unnest(range(1, len(vs) + 1)) AS i FROM (SELECT row, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS vs FROM t)) WHERE {_VALID[kind]}"""


_ENTITY = "kind || ':' || CASE WHEN k <= 2 THEN lower(v) ELSE regexp_replace(v, '[^0-9]', '', 'g') END"
#: The share of its information that gives an entity away, and the number of the corpus's terms that may seem to by chance.
_SHARE, _CHANCE = 0.8, 0.05
#: Texts are counted once each; what lies between the spans of a text, put side by side, holds its terms.
OP4 = f"""WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({" UNION ALL ".join(_found(k, kind) for k, kind in enumerate(_PATTERNS, 1))}),
apart AS (SELECT row, s, s + len(v) AS e, coalesce(max(s + len(v)) OVER (PARTITION BY row ORDER BY s, s + len(v) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM base),
pieces AS (SELECT row, substr(text, before + 1, s - before) AS piece FROM apart JOIN t USING (row) WHERE s >= before
  UNION ALL SELECT row, substr(text, coalesce(e, 0) + 1) FROM t LEFT JOIN (SELECT row, max(e) AS e FROM apart GROUP BY row) USING (row)),
held AS (SELECT DISTINCT row, term FROM (SELECT row, unnest(regexp_extract_all(lower(piece), '\\p{{L}}+')) AS term FROM pieces)),
once AS (SELECT min(row) AS row FROM t GROUP BY text),
total AS (SELECT CAST((SELECT count(*) FROM once) AS DOUBLE) AS n, ln(greatest((SELECT count(DISTINCT term) FROM held), 1) / {_CHANCE}) AS least),
seen AS (SELECT DISTINCT row, {_ENTITY} AS entity FROM base JOIN once USING (row)),
counted AS (SELECT entity, count(*) AS n_e FROM seen GROUP BY entity),
df AS (SELECT term, count(*) AS n_t FROM held JOIN once USING (row) GROUP BY term),
pairs AS (SELECT entity, term, count(*) AS n_et FROM seen JOIN held USING (row) GROUP BY entity, term),
disclosing AS (SELECT DISTINCT term FROM pairs JOIN counted USING (entity) JOIN df USING (term), total WHERE n_e < n AND ln(n * n_et / (n_e * n_t)) / ln(n / n_e) >= {_SHARE}
  AND n_et * (ln(n_et / n_e) - ln(n_t / n)) + CASE WHEN n_et < n_e THEN (n_e - n_et) * (ln(1 - n_et / n_e) - ln(1 - n_t / n)) ELSE 0 END >= least),
patterns AS (SELECT row, '\\p{{L}}+' AS p, list(term) AS terms FROM held JOIN disclosing USING (term) GROUP BY row),
words AS (SELECT row, terms, string_split_regex(text, p) AS gaps, regexp_extract_all(text, p) AS vs FROM patterns JOIN t USING (row)),
spots AS (SELECT row, 5 AS k, 'term' AS kind, v, CAST(list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(vs[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s
  FROM (SELECT row, terms, gaps, vs, unnest(vs) AS v, unnest(range(1, len(vs) + 1)) AS i FROM words) WHERE list_contains(terms, lower(v))),
spans AS (SELECT row, k, kind, s, kind || ':' || s || ':' || (s + len(v)) AS span FROM (SELECT * FROM base UNION ALL SELECT * FROM spots))
SELECT doc_id, {", ".join(f"count(span) FILTER (k = {k}) AS n_{kind}" for k, kind in enumerate(_PATTERNS, 1))},
  sha256(coalesce(string_agg(span, ',' ORDER BY k, s) FILTER (k < 5), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY k, s), '') AS spans
FROM t LEFT JOIN spans USING (row) GROUP BY row, doc_id"""

OP11 = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5"""

_CRC = """crc(n, c) AS (SELECT n, list_reduce([n, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) FROM range(256) t(n)),
lookup AS (SELECT list(c ORDER BY n) AS cell FROM crc)"""
_KEY_BYTES = "list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda x: CAST('0x' || x AS BIGINT)))"
_SEEN = "'[^ \\t\\n\\x0B\\x0C\\r]'"


def _put(letter: str, cost: str, of: str, line: str = "''") -> str:
    """A derivation with an edit in front: cost, audit, repaired lines."""
    return f"{{'c': {of}.c + {cost}, 'w': '{letter}' || {of}.w, 't': {line} || {of}.t}}"


_NEW = "chr(10)"
_STAY = "CASE WHEN cut THEN 1 ELSE 0 END + CASE WHEN gone THEN 100000000 ELSE 0 END"


def _keep(initial: str, of: str) -> str:
    return _put("K", f"{_STAY} + CASE WHEN starts_with(role, '{initial}') THEN 0 ELSE 100000000 END", of, f"{_NEW} || role || ':' || text")


def _rerole(role: str, of: str) -> str:
    return _put("R", f"2 + {_STAY}", of, f"{_NEW} || '{role}:' || text")


def _least(*of: str) -> str:
    return f"list_sort([{', '.join(of)}])[1]"


#: The least derivations of a conversation's last rows by what they start with, row by row from its end; a turn put in follows at each place.
OP12 = f"""WITH RECURSIVE {_CRC},
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce({_KEY_BYTES}, lambda c, x: xor(cell[CAST(xor(c, x) % 256 AS INTEGER) + 1], c // 256))) % 20 AS code FROM conversations, lookup),
g AS (SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE code WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM d WHERE code <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM g),
f AS (SELECT *, NOT regexp_matches(text, {_SEEN}) AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') AS unended,
  left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair FROM o),
m AS (SELECT *, blank OR again AS gone, unended AND NOT blank AND NOT again AS cut FROM f),
begin_ AS (SELECT {{'c': 0, 'w': '', 't': ''}} AS e, {{'c': 2, 'w': 'I', 't': {_NEW} || 'assistant:'}} AS a, {{'c': 4, 'w': 'II', 't': {_NEW} || 'user:' || {_NEW} || 'assistant:'}} AS u, {{'c': 100000000, 'w': '', 't': ''}} AS s),
walk(conv_id, pos, e, a, u, s) AS (
  SELECT conv_id, n + 1, e, a, u, s FROM (SELECT DISTINCT conv_id, n FROM m), begin_
  UNION ALL
  SELECT conv_id, pos, e, a1, {_least("u0", _put("I", "2", "a1", f"{_NEW} || 'user:'"))}, s FROM (
    SELECT conv_id, pos, e, u0, s, {_least("a0", _put("I", "2", "e", f"{_NEW} || 'assistant:'"), _put("I", "2", "u0", f"{_NEW} || 'assistant:'"))} AS a1 FROM (
      SELECT m.conv_id, m.pos, {_put("D", "3", "e")} AS e,
        {_least(_put("D", "3", "a"), _keep("a", "e"), _keep("a", "u"), _rerole("assistant", "e"), _rerole("assistant", "u"))} AS a0,
        {_least(_put("D", "3", "u"), _keep("u", "a"), _rerole("user", "a"))} AS u0, {_least(_put("D", "3", "s"), _keep("s", "u"))} AS s
      FROM walk JOIN m ON m.conv_id IS NOT DISTINCT FROM walk.conv_id AND m.pos = walk.pos - 1))),
best AS (SELECT conv_id, {_least("e", "u", "s")} AS b FROM walk WHERE pos = 1),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut) AS truncated,
  count(*) FILTER (pos > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.w, '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id"""

OP13 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM f"""

ORACLES: dict[str, str] = {"op4_pii": OP4, "op6_embedding_dedup": OP6, "op9_sharding": OP9, "op10_minhash": OP10, "op11_hard_negatives": OP11, "op12_conversation_repair": OP12, "op13_warc": OP13}
