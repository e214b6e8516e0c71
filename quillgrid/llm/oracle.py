"""The queries of this subpackage that SQL can express, for DuckDB."""

from __future__ import annotations

# Fixed values, written out again so that the SQL does not share them with the code it checks.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_GAP = r"[\x20\x09-\x0D]+"
RULES = [
    ("allow", "org", "/"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
]


def _lower(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{LOWER}')"


OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: '{BASE32}'[
    1 + ((('0x' || h[1 + (i // 4) * 5:(i // 4) * 5 + 5])::BIGINT >> (15 - 5 * (i % 4))) & 31)]), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to,
  CASE WHEN page_id = keeper THEN greatest(ceil(strlen(html) / 1048576), 1) ELSE 1 END::INT AS n_chunks, TRUE AS digest_matches
FROM p JOIN g USING (h)
"""


def _host(url: str) -> str:
    return _lower(f"regexp_extract(coalesce({url}, ''), '://([^/?#]*)', 1)")


def _path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '://[^/?#]*([^?#]*)', 1)"


def _rule(host: str, path: str, what: str) -> str:
    """The longest rule that fits, or its verdict."""
    cases = " ".join(
        f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{h + p if what == 'rule' else v}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"CASE {cases} END"


def _resource(url: str) -> str:
    bare = f"regexp_replace({url}, '(?s)#.*$', '')"
    site = f"regexp_extract({bare}, '^([^/?#]*://[^/?#]*)', 1)"
    return f"{_lower(site)} || substr({bare}, length({site}) + 1)"


LINK = r"(?i)<link\b[^<>]*\brel\s*=\s*[\"'']?\s*canonical\b[^<>]*>"
META = r"(?i)<meta\b[^<>]*\bhttp-equiv\s*=\s*[\"'']?\s*refresh\b[^<>]*>"
HREF = r"(?i)\bhref\s*=\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\s\"''<>]+))"
REFRESH = r"(?i)\burl\s*=\s*[''\"]?([^''\"<>\s]+)"
OP2 = f"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(list_concat(regexp_extract_all(html, '{LINK}'), regexp_extract_all(html, '{META}'))) AS tag
  FROM pages WHERE contains(url, '://') AND html IS NOT NULL),
named AS (SELECT url, replace(trim(CASE WHEN lower(tag[1:5]) = '<link' THEN
  regexp_extract(tag, '{HREF}', 1) || regexp_extract(tag, '{HREF}', 2) || regexp_extract(tag, '{HREF}', 3)
  ELSE regexp_extract(tag, '{REFRESH}', 1) END), '&amp;', '&') AS t FROM tags),
targets AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
  WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^/?#]*:)//', 1) || t
  WHEN starts_with(t, '/') THEN regexp_extract(url, '^([^/?#]*://[^/?#]*)', 1) || t
  ELSE regexp_extract(url, '^([^/?#]*://[^/?#]*)', 1) || CASE WHEN contains({_path('url')}, '/')
    THEN regexp_extract({_path('url')}, '^(.*/)', 1) ELSE '/' END || t END AS target FROM named WHERE t <> ''),
pairs AS (SELECT {_resource('url')} AS a, {_resource('target')} AS b FROM targets),
edges AS (SELECT a, b FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b),
reached AS (SELECT a AS node, a AS other FROM edges UNION SELECT r.node, e.b FROM reached r JOIN edges e ON e.a = r.other),
classes AS (SELECT node, bool_or({_rule(_host('other'), _path('other'), 'verdict')} = 'block') AS blocked,
  coalesce(bool_or({_rule(_host('other'), _path('other'), 'verdict')} = 'allow'), FALSE) AS allowed FROM reached GROUP BY node),
judged AS (SELECT page_id, {_host('url')} AS host, {_path('url')} AS path, {_resource('url')} AS node FROM pages)
SELECT page_id, host, path, {_rule('host', 'path', 'rule')} AS rule,
  coalesce({_rule('host', 'path', 'verdict')}, CASE WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN classes USING (node)
"""

OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{BENCH_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{BENCH_WORD}') AS v FROM benchmark),
sized AS (SELECT *, least(13, len(v)) AS n FROM b WHERE len(v) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(v[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(v) - n + 2)) AS i FROM sized)),
found AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
  SELECT d.*, s.n, unnest(range(1, len(w) - s.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM sized) s)),
hits AS (SELECT doc_id, item_id, i, n FROM found JOIN windows USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (
  SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _escaped(column: str) -> str:
    return f"length({column}) + length(regexp_replace({column}, '[^\\\\<>]', '', 'g'))"


# A budget of 512 tokens less a history of 64 and the system turn gives pieces of half of that; marks of a turn are 4 tokens and 15 characters.
OP7 = f"""
WITH every AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
sized AS (SELECT *, len(list_filter(regexp_split_to_array(text, '{WORD_GAP}'), lambda t: t <> '')) + 4 AS tokens,
  {_escaped('role')} + {_escaped('text')} + 15 AS chars,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS number FROM every),
placed AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY number) - tokens AS start, sum(tokens) OVER (PARTITION BY conv_id) AS total,
  greatest(1, (448 - coalesce(max(CASE WHEN number = 0 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0)) // 2) AS size FROM sized),
lined AS (SELECT *, start // size AS piece, coalesce(max(CASE WHEN tokens > size THEN start + tokens END) OVER (
  PARTITION BY conv_id, start // size ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS after_long FROM placed),
spans AS (SELECT *, min(start) OVER w AS first, max(start + tokens) OVER w AS last, number = 0 AND role = 'system' AS opens
  FROM lined WINDOW w AS (PARTITION BY conv_id, piece, after_long, tokens > size))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY number)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY number) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(chars * (1 + (last - start <= 64 AND last < total AND NOT opens)::INT))
    + (count(DISTINCT first) - 1) * coalesce(max(chars) FILTER (opens), 0))::BIGINT AS formatted_chars
FROM spans GROUP BY conv_id
"""

OP11 = """
WITH used AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM used a JOIN used b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""

# The checksum is CRC-32, its table made by rule; near words share what is left when one letter is cut at one place, or a cut of one is the other.
OP13 = f"""
WITH RECURSIVE table_rows AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)
), crc AS (SELECT list(v ORDER BY i) AS tab FROM table_rows),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_lower('text')}, '[a-zÀ-ÿ]+')) AS run FROM documents
), each AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 5 GROUP BY ALL
), hexed AS (
  SELECT run, times, hex(encode(doc_id::VARCHAR || ':' || run)) AS h, (SELECT tab FROM crc) AS tab FROM each
), summed AS (
  SELECT run, times, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda k: (instr('0123456789ABCDEF', h[k]) - 1) * 16 + instr('0123456789ABCDEF', h[k + 1]) - 1)),
    lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) AS checksum
  FROM hexed
), words AS (
  SELECT CASE WHEN checksum % 97 = 0 THEN left(run, checksum % length(run)) || substr(run, checksum % length(run) + 2) ELSE run END AS word, sum(times)::BIGINT AS n
  FROM summed GROUP BY 1 HAVING length(word) >= 5 AND sum(times) >= 3
), gaps AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words
), cuts AS (
  SELECT word, n, k, left(word, k - 1) || substr(word, k + 1) AS rest FROM gaps
), pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, n, count(*) AS n_near, min((-near_n, encode(near), near)) AS top FROM pairs GROUP BY word, n
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top[1] >= 2 * w.n THEN top[3] END AS form, CASE WHEN -top[1] >= 2 * w.n THEN -top[1] END AS form_n
  FROM words w LEFT JOIN best USING (word)
), followed AS (
  SELECT word, word AS root FROM formed
  UNION SELECT f.word, g.form FROM followed f JOIN formed g ON g.word = f.root WHERE g.form IS NOT NULL
), ends AS (SELECT f.word, f.root FROM followed f JOIN formed g ON g.word = f.root WHERE g.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""

LLM_ORACLE = {
    "op1_warc": OP1, "op2_url_filters": OP2, "op5_benchmark_decontamination": OP5, "op7_chat_formatting": OP7, "op11_hard_negatives": OP11,
    "op13_spelling_variants": OP13,
}
