"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

# Everything reachable by links, as pairs (node, reached); links holds both directions.
_REACHED = """
reached AS (
  SELECT node, node AS other FROM nodes
  UNION
  SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a
)"""

JACCARD = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM words, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
nodes AS (SELECT doc_id AS node FROM documents),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs p JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b
  WHERE 100 * common >= 75 * (m.n + n.n - common)
), {_REACHED}
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reached r ON r.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id
"""

SUBSTRINGS = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM words, unnest(range(1, len(w) - 48)) AS u(i) WHERE len(w) >= 50
), firsts AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS spots
  FROM windows JOIN firsts USING (h) WHERE least < doc_id GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(w) AS n, coalesce(len(spots), 0) AS removed,
    list_filter(list_transform(w, lambda x, k: CASE WHEN list_contains(coalesce(spots, []), k) THEN NULL ELSE x END),
      lambda x: x IS NOT NULL) AS words
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id
)
SELECT doc_id, n::BIGINT AS n_words, removed::BIGINT AS n_removed,
  sha256(array_to_string(words, ' ')) AS kept_sha256 FROM kept
"""

ARCHIVES = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), d AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(p.h, 1 + 5 * (i // 4), 5))::INT >> (5 * (3 - i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN d ON d.h = p.h
"""

# In double precision, as the sums run in another order, a cosine within rounding of the threshold could differ.
VECTORS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
    AND list_contains(list_transform(embedding, lambda x: x <> 0), true)
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.9
), nodes AS (SELECT vec_id AS node FROM embeddings), {_REACHED}
SELECT n.node AS vec_id, (SELECT count(*) FROM links WHERE a = n.node) AS n_links, min(r.other) AS component_id,
  n.node = min(r.other) AS kept
FROM nodes n JOIN reached r ON r.node = n.node GROUP BY n.node
"""

SEARCH = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), stats AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM words),
tf AS (
  SELECT doc_id, len(w) AS length, t AS term, count(*)::DOUBLE AS tf
  FROM (SELECT doc_id, w, unnest(w) AS t FROM words) GROUP BY ALL
), df AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS weight FROM tf, stats GROUP BY term),
scores AS (
  SELECT q.doc_id AS query_id, d.doc_id,
    round(sum(weight * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * d.length / mean))), 6) AS score
  FROM tf q JOIN tf d ON q.term = d.term JOIN df ON df.term = q.term, stats
  WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, d.doc_id
)
SELECT query_id, row_number() OVER best AS rank, doc_id, score FROM scores
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, doc_id) QUALIFY rank <= 10
"""

RANKED = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), stats AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM words WHERE len(w) > 0),
tf AS (SELECT doc_id, len(w) AS length, t AS term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM words) GROUP BY ALL),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, stats GROUP BY term
), scores AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * length * n) // l))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term), stats GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 10
"""

# A turn adds its marks, two line ends and a mark for each "<" that a "|" or a backslash follows.
CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL
  SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), s AS (
  SELECT *, length('<|im_start|><|im_end|>') + 2 + length(role) + length(text)
    + len(regexp_extract_all(role, '<[|\\]')) + len(regexp_extract_all(text, '<[|\\]')) AS size FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

# The CRC-32 of an ASCII text, bit by bit.
def _crc(text: str) -> str:
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::INT, 1))::BIGINT)"
    fold = f"list_reduce({codes}, lambda c, b: list_reduce(range(8), lambda x, k: {bit}, xor(c, b)), 4294967295)"
    return f"xor({fold}, 4294967295)"


def _row_digest(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    coded = [f"coalesce(octet_length(encode({f}::VARCHAR)) || ':' || {f}, '-')" for f in fields]
    return f"sha256({' || '.join(coded)})"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GROUP = "n.tree = c.tree AND n.level = c.level AND n.position // 8 = c.position // 8"


def _grown(name: str, leaves: str) -> str:
    """All nodes above some leaves (tree, size, position, digest)."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, size, position, digest FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, (any_value(size) + 7) // 8, position // 8, sha256(string_agg(digest, '' ORDER BY position))
  FROM {name} WHERE size > 1 GROUP BY tree, level, position // 8
)"""


def _climbed(name: str, starts: str, nodes: str) -> str:
    """Rows (r, tree, position, now, proof) at their own level and all above."""
    return f"""{name} AS (
  SELECT r, tree, 0 AS level, position, now, proof FROM {starts}
  UNION ALL
  SELECT c.r, c.tree, c.level + 1, c.position // 8,
    sha256(string_agg(CASE WHEN n.position = c.position THEN c.now ELSE n.digest END, '' ORDER BY n.position)),
    c.proof || coalesce(string_agg(n.digest, '' ORDER BY n.position) FILTER (n.position <> c.position), '')
  FROM {name} c JOIN {nodes} n ON {_GROUP} AND n.size > 1 GROUP BY c.r, c.tree, c.level, c.position, c.proof
)"""


MERKLE = f"""
WITH RECURSIVE numbered AS (SELECT row_number() OVER () AS r, doc_id::VARCHAR AS s, * FROM documents),
hashed AS (
  SELECT r, doc_id, lang, {_row_digest("text")} AS leaf,
    CASE WHEN {_crc("s")} % 3 = 0 THEN {_row_digest(_LOWER)} ELSE {_row_digest("text")} END AS other FROM numbered
), leaves AS (
  SELECT r, doc_id, leaf AS digest, other AS now, '' AS proof, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS position,
    count(*) OVER (PARTITION BY lang) AS size FROM hashed
), {_grown("lower_nodes", "leaves")},
subroots AS (
  SELECT -1 AS tree, count(*) OVER () AS size, tree AS position, digest FROM lower_nodes WHERE size = 1
), {_grown("upper_nodes", "subroots")},
{_climbed("lower_path", "leaves", "lower_nodes")},
arrived AS (
  SELECT c.r, -1 AS tree, c.tree AS position, c.now, c.proof, n.digest AS subroot
  FROM lower_path c JOIN lower_nodes n ON n.tree = c.tree AND n.level = c.level AND n.size = 1
), {_climbed("upper_path", "arrived", "upper_nodes")}
SELECT l.doc_id, l.digest AS leaf, a.subroot, n.digest AS root, sha256(c.proof) AS proof_sha256,
  c.now AS folded_root, c.now = n.digest AS verified
FROM upper_path c JOIN upper_nodes n ON n.level = c.level AND n.size = 1
JOIN leaves l ON l.r = c.r JOIN arrived a ON a.r = c.r
"""

_ASSIGNED = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
_TOKEN = (
    "length(m) = 40 AND list_reduce(list_transform(substr(m, 35, 6).string_split(''), "
    "lambda d: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', d)::BIGINT - 1), "
    "lambda a, b: 62 * a + b, 0::BIGINT) = " + _crc("substr(m, 5, 30)")
)
# Bech32: digits shift into a remainder of 30 bits, whose five highest choose among the generators.
_BECH32 = """length(m) = 74 AND list_reduce(list_concat(
    list_transform(string_split('age-secret-key-', ''), lambda d: ascii(d)::BIGINT >> 5), [0::BIGINT],
    list_transform(string_split('age-secret-key-', ''), lambda d: ascii(d)::BIGINT & 31),
    list_transform(string_split(lower(substr(m, 17)), ''), lambda d: strpos('qpzry9x8gf2tvdw0s3jn54khce6mua7l', d)::BIGINT - 1)),
    lambda a, b: xor(xor((a & 33554431) << 5, b), list_reduce([996825010, 642813549, 513874426, 1027748829, 705979059],
      lambda x, g, k: CASE WHEN (a >> 25 >> (k - 1)) & 1 = 1 THEN xor(x, g) ELSE x END, 0::BIGINT)), 1::BIGINT) = 1
    AND NOT regexp_matches(lower(substr(m, 17)), '[^qpzry9x8gf2tvdw0s3jn54khce6mua7l]')"""
_KINDS = [
    ("assign", _ASSIGNED, f"length(regexp_extract(m, '{_ASSIGNED}', 2)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
    ("github", "gh[pousr]_[0-9A-Za-z]+", _TOKEN),
    ("npm", "npm_[0-9A-Za-z]+", _TOKEN),
    ("age", "AGE-SECRET-KEY-1[0-9A-Z]+", _BECH32),
]


def _matches(number: int, kind: str, pattern: str, valid: str) -> str:
    """Places of a kind's matches: each lies behind the pieces between matches and the matches before it."""
    return f"""
  SELECT r, {number} AS number, '{kind}' AS kind, first, first + length(m) AS past FROM (
    SELECT r, m, sum(length(gap)) OVER (PARTITION BY r ORDER BY k) + sum(length(m)) OVER (PARTITION BY r ORDER BY k) - length(m) AS first
    FROM (
      SELECT r, unnest(found) AS m, unnest(gaps[:len(found)]) AS gap, generate_subscripts(found, 1) AS k
      FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS found, regexp_split_to_array(text, '{pattern}') AS gaps FROM d)
    )
  ) WHERE {valid}"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_matches(k, *kind) for k, kind in enumerate(_KINDS))}),
lists AS (
  SELECT r, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
    string_agg(kind || ':' || first::BIGINT || ':' || past::BIGINT, ',' ORDER BY first, number) FILTER (number < 3) AS base,
    string_agg(kind || ':' || first::BIGINT || ':' || past::BIGINT, ',' ORDER BY first, number) AS spans
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN lists l ON l.r = d.r
"""

ORACLE_SQL: dict[str, str] = {
    "op2_archive_conversion": ARCHIVES,
    "op4_vector_dedup": VECTORS,
    "op5_jaccard_join": JACCARD,
    "op6_bm25_search": SEARCH,
    "op8_chat_format": CHAT,
    "op10_substring_dedup": SUBSTRINGS,
    "op11_k2_search": RANKED,
    "op12_secret_scan": SECRETS,
    "op13_merkle_manifest": MERKLE,
}
