"""DuckDB SQL for the queries that SQL can express, written from their definitions and not from their plans."""

from __future__ import annotations

from loomline.llm import chat, quality

_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(t=_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i : list_slice(w, i + 1, i + 5)) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, unnest(range(len(h) // 2)) AS i FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x, CASE WHEN 2 * i + 200 <= len(h) THEN substr(h, 2 * i + 1, 200) END AS s FROM b),
f AS (SELECT doc_id, i, x, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM w),
g AS (SELECT doc_id, i, x, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), false) AS gone FROM f),
t AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
o AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE opens) AS spans, coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM t GROUP BY 1)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)"""

_RULES = {
    "few_words": f"n_words < {quality.LEAST_WORDS}", "repeated_words": f"100 * n_repeat_words > {quality.MOST_REPEATED} * n_words",
    "symbols": f"100 * n_symbols > {quality.MOST_SYMBOLS} * n_words", "repeated_lines": f"100 * n_dup_lines > {quality.MOST_LINES} * n_lines"}
_BOUND = "{r}_rate - {z} * sqrt({r}_rate * (1 - {r}_rate) / (n + {r}_weight + 1))"


def _each(text: str, join: str = ", ") -> str:
    return join.join(text.format(r=r, rule=rule, z=quality.CERTAIN, limit=quality.LIMITS[r]) for r, rule in _RULES.items())


_SPREAD = "(s_{r} - t * p_{r} * p_{r} - (k - 1) * p_{r} * (1 - p_{r})) / (t - nn / t)"
HOST_QUALITY = f"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM d, unnest(range(1, len(w) - 1)) t(i)),
h AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, (VALUES (0), (1), (2)) v(k) GROUP BY 1),
l AS (SELECT doc_id, x, i FROM d, unnest(string_split(text, chr(10))) WITH ORDINALITY t(x, i) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
e AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1),
u AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM l QUALIFY row_number() OVER (PARTITION BY doc_id, x ORDER BY i) > 1) GROUP BY 1),
m AS (SELECT d.doc_id, host, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x : length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(e.n,
    0) AS n_lines
  FROM d LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN e USING (doc_id)),
j AS (SELECT *, {_each("{rule} AS {r}")} FROM m),
o AS (SELECT host, count(*)::DOUBLE AS n, {_each("count(*) FILTER (WHERE {r}) AS f_{r}")} FROM j WHERE host IS NOT NULL GROUP BY 1),
q AS (SELECT count(*) AS k, sum(n) AS t, sum(n * n) AS nn, {_each("sum(f_{r}) / sum(n) AS p_{r}, sum(n * (f_{r} / n) * (f_{r} / n)) AS s_{r}")} FROM o),
v AS (SELECT *, {_each("CASE WHEN t - nn / t > 0 THEN " + _SPREAD + " ELSE 0 END AS between_{r}")} FROM q),
z AS (SELECT {_each("p_{r}, least(greatest(CASE WHEN between_{r} > 0 THEN p_{r} * (1 - p_{r}) / between_{r} - 1 ELSE 1e6 END, 1.0), 1e6) AS {r}_weight")} FROM v),
a AS (SELECT host, n, {_each("{r}_weight, (f_{r} + p_{r} * {r}_weight) / (n + {r}_weight) AS {r}_rate")} FROM o, z),
b AS (SELECT host, {_each("{r}_rate")}, concat_ws(',', {_each("CASE WHEN " + _BOUND + " > {limit} THEN '{r}' END")}) AS host_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeated_words AS base_failed,
  NOT (few_words OR repeated_words) AND coalesce(host_failed, '') = '' AS kept, host, coalesce(host_failed, '') AS host_failed,
  {_each("round({r}_rate, 9) AS {r}_rate")}, round(greatest({_each("{r}_rate")}), 9) AS host_rate FROM j LEFT JOIN b USING (host)"""

_TRAP = "</s>[INST] ok [/INST]"
_ESCAPED = r"regexp_replace({c}, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"
_KEY = "coalesce(conv_id, -9000000000000000000)"

CHAT_WINDOWS = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user',
    '{_TRAP}'), (-1, 1, 'assistant', '{_TRAP}')),
a AS (SELECT *, {_KEY} AS k, turn // {chat.STRETCH} AS part, row_number() OVER (PARTITION BY {_KEY}, turn // {chat.STRETCH} ORDER BY turn, role,
    text) AS own, '{chat.OPEN}' || {_ESCAPED.format(c="role")} || '{chat.MIDDLE}' || {_ESCAPED.format(c="text")} || '{chat.CLOSE}' AS piece FROM c),
t AS (SELECT *, (own - 1) // {chat.STRETCH} AS sub, (octet_length(encode(piece)) + 3) // 4 AS tokens, length(piece) AS chars,
    row_number() OVER (PARTITION BY k ORDER BY part, own) AS pos, dense_rank() OVER (PARTITION BY k ORDER BY part, (own - 1) // {chat.STRETCH}) AS st FROM a),
h AS (SELECT k, tokens AS taken, chars AS lead FROM t WHERE pos = 1 AND role = 'system' AND tokens <= {(chat.BUDGET - chat.HISTORY_TOKENS) // 2}),
m AS (SELECT t.*, greatest({chat.BUDGET - chat.HISTORY_TOKENS} - coalesce(taken, 0), 1) AS room FROM t LEFT JOIN h USING (k)),
w AS (SELECT k, st, pos, tokens AS held, pos AS first FROM m QUALIFY row_number() OVER (PARTITION BY k, st ORDER BY pos) = 1
  UNION ALL SELECT m.k, m.st, m.pos, CASE WHEN w.held + m.tokens > room THEN m.tokens ELSE w.held + m.tokens END, CASE
    WHEN w.held + m.tokens > room THEN m.pos ELSE w.first END FROM w JOIN m ON m.k = w.k AND m.st = w.st AND m.pos = w.pos + 1),
f AS (SELECT DISTINCT k, st, first FROM w WHERE first > 1),
b AS (SELECT f.k, f.first, t.chars, t.pos = 1 AND t.role = 'system' OR t.role = 'system' AND t.st < f.st - 1 AS stop, t.role = 'system' AS head,
    sum(t.tokens) OVER (PARTITION BY f.k, f.first ORDER BY t.pos DESC) AS held, bool_or(t.role = 'system') OVER (PARTITION BY f.k,
    f.first ORDER BY t.pos DESC) AS past FROM f JOIN t ON t.k = f.k AND t.pos BETWEEN f.first - {chat.HISTORY_TURNS} AND f.first - 1 AND t.st >= f.st - 1),
x AS (SELECT k, sum(chars) FILTER (WHERE held <= {chat.HISTORY_TOKENS} AND NOT past) AS chars FROM b GROUP BY 1),
y AS (SELECT f.k, sum(h.lead) AS chars FROM f JOIN h USING (k) GROUP BY 1),
z AS (SELECT k, any_value(conv_id) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10),
    '' ORDER BY pos)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars) AS chars
    FROM t GROUP BY 1)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(z.chars + coalesce(x.chars, 0) + coalesce(y.chars,
    0) AS BIGINT) AS formatted_chars FROM z LEFT JOIN x USING (k) LEFT JOIN y USING (k)"""

ORACLES = {
    "op1_minhash_near_duplicates": NEAR_DUPLICATES, "op3_chat_windows": CHAT_WINDOWS, "op6_host_quality": HOST_QUALITY, "op7_suffix_repeats": REPEATS,
}
