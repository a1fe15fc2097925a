"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
windows AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS k FROM starts),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM ranked WHERE rn > 1),
each_word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.j) AS t, count(*) AS n FROM each_word e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.j = g.j WHERE g.j IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

_SYMBOLS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((v >> {s}) & 31) AS INT), 1)" for s in range(35, -1, -5))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS s FROM p),
parts AS (SELECT page_id, k, CAST('0x' || substr(s, CAST(1 + 10 * k AS INT), 10) AS BIGINT) AS v FROM (SELECT page_id, s, unnest(range(4)) AS k FROM d)),
coded AS (SELECT page_id, string_agg({_SYMBOLS}, '' ORDER BY k) AS payload_digest FROM parts GROUP BY page_id),
last AS (SELECT s, max(page_id) AS m FROM d GROUP BY s)
SELECT d.page_id, payload_bytes, payload_digest, CASE WHEN d.page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN d.page_id <> m THEN m END AS refers_to
FROM d JOIN coded USING (page_id) JOIN last USING (s)"""

JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes s ON x = s.doc_id JOIN sizes t ON y = t.doc_id WHERE 100 * k >= 75 * (s.n + t.n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.y FROM reach r JOIN both_ways l ON r.b = l.x)
SELECT w.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id FROM w JOIN reach ON a = w.doc_id LEFT JOIN sizes USING (doc_id) GROUP BY w.doc_id"""


def _quality() -> str:
    """The rules and the estimation of ``quality`` in SQL, from the same constants."""
    from locusflow.llm import quality as q

    stops = ", ".join(f"'{w}'" for w in q.STOP_WORDS)
    strip = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    vote = lambda good, junk: f"CASE WHEN {good} THEN 1 WHEN {junk} THEN -1 ELSE 0 END"
    votes = ", ".join([
        vote("n_symbols * 100 <= n_words", "n_symbols * 5 >= n_words"), vote("n_upper * 8 <= word_chars", "n_upper * 4 >= word_chars"), vote("n_shouts * 100 <= n_words", "n_shouts * 5 >= n_words"),
        vote("word_chars >= 3 * n_words AND word_chars <= 7 * n_words", "word_chars < 2 * n_words OR word_chars > 8 * n_words"), vote("n_stops * 10 >= n_words", "n_stops * 20 < n_words"),
        vote("n_dup_lines = 0", "n_dup_lines * 4 >= n_lines AND n_lines >= 3"), vote("n_repeat_words * 50 <= n_words", "n_repeat_words * 5 >= n_words"), vote("n_distinct * 3 >= n_words", "n_distinct * 6 <= n_words"),
    ])
    guess = lambda g: "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in g * 8) + "]"
    cells = lambda kind, weight, g: f"list_transform(range(24), lambda c: (pull * {guess(g)}[c + 1] + list_sum(list_transform(range(1, len(pats) + 1), lambda k: CASE WHEN pats[k].v[c // 3 + 1] = c % 3 - 1 THEN pats[k].n * ({weight}) ELSE 0.0 END))) / (pull + {kind}))"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
w8 AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM w8) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
f AS (SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST({strip(q.SYMBOLS)} AS BIGINT) AS n_symbols, {strip("!")} AS n_shouts, {strip("ABCDEFGHIJKLMNOPQRSTUVWXYZ")} AS n_upper,
 len(list_filter(ws, lambda x: x IN ({stops}))) AS n_stops, len(list_distinct(ws)) AS n_distinct, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words FROM l LEFT JOIN cover USING (doc_id)),
v AS (SELECT *, [{votes}] AS v FROM f),
p AS (SELECT list({{'v': v, 'n': n}} ORDER BY v) AS pats, sum(n) AS every, {0.02} * sum(n) + 1 AS pull FROM (SELECT v, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY v)),
em AS (SELECT 0 AS it, CAST({q.GUESS_PRIOR} AS DOUBLE) AS prior, {guess(q.GUESS_GOOD)} AS good, {guess(q.GUESS_JUNK)} AS junk UNION ALL
 SELECT it + 1, (pull * {q.GUESS_PRIOR} + mg) / (pull + every), {cells("mg", "post[k]", q.GUESS_GOOD)}, {cells("mj", "1 - post[k]", q.GUESS_JUNK)}
 FROM (SELECT *, list_sum(list_transform(range(1, len(pats) + 1), lambda k: pats[k].n * post[k])) AS mg, list_sum(list_transform(range(1, len(pats) + 1), lambda k: pats[k].n * (1 - post[k]))) AS mj
  FROM (SELECT *, list_transform(pats, lambda x: 1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(range(8), lambda i: ln(good[3 * i + x.v[i + 1] + 2] / junk[3 * i + x.v[i + 1] + 2]))))))) AS post FROM em, p WHERE it < 25))),
m AS (SELECT prior, good, junk FROM em WHERE it = 25),
s AS (SELECT v.*, 1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(range(8), lambda i: ln(good[3 * i + v[i + 1] + 2] / junk[3 * i + v[i + 1] + 2])))))) AS quality, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM v, m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND quality >= 0.5 AS kept, round(quality, 6) AS quality FROM s"""


QUALITY = _quality()

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT r, lang, source, unnest(ts) AS t FROM d),
kept AS (SELECT lang, t FROM w GROUP BY lang, t HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, t, count(*) AS n FROM w JOIN kept USING (lang, t) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT e.lang, e.source, coalesce(v, 0) AS v, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) e LEFT JOIN l ON e.lang = l.lang LEFT JOIN c ON c.lang = e.lang AND c.source = e.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.t, coalesce(c.n, 0) AS k, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // CAST(g.n + g.v AS HUGEINT) AS p FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = kept.t),
q AS (SELECT c.lang, c.t, 1 + (CAST(1000000000 AS HUGEINT) * (sum(c.n) + 1)) // CAST(any_value(every + v) AS HUGEINT) AS q FROM c JOIN l ON l.lang = c.lang JOIN (SELECT lang, sum(n) AS every FROM c GROUP BY lang) s ON s.lang = c.lang GROUP BY c.lang, c.t),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN (SELECT x.lang, x.source AS s1, y.source AS s2, sum((x.p - y.p) * (x.p - y.p) // y.p) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY ALL) z ON z.lang = a.lang AND s1 = a.source AND s2 = b.source),
marked AS (SELECT p.lang, p.source, 'term' AS part, p.t AS item, (p - q) * (p - q) // q AS value FROM p JOIN q ON p.lang = q.lang AND p.t = q.t WHERE k > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM marked))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS shown, replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS head FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length('### ' || head || ': ' || shown || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

REPAIR = r"""
WITH RECURSIVE src AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hits AS (SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS hit FROM src),
dam AS (SELECT r, conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE hit WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM hits WHERE hit <> 0),
num AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, r, copy) AS i FROM dam),
cls AS (SELECT *, substr(role, 1, 1) AS c, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
 CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM num),
tally AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM cls GROUP BY conv_id),
ins(p, j, q) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)),
moves AS (SELECT p, 'D' AS l, q, j, 4 AS cost, '' AS need FROM ins UNION ALL SELECT p, 'R', CASE q WHEN 2 THEN 3 ELSE 2 END, j, 3, '' FROM ins UNION ALL SELECT p, 'K', 1, j, 0, 's' FROM ins WHERE q = 0 UNION ALL SELECT p, 'K', 2, j, 0, 'u' FROM ins WHERE q <> 2 UNION ALL SELECT p, 'K', 3, j, 0, 'a' FROM ins WHERE q = 2),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit FROM tally UNION ALL
 SELECT conv_id, i, q, cost, audit FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS rn FROM
  (SELECT dp.conv_id, cls.i, m.q, CAST(dp.cost + 3 * m.j + m.cost + CASE WHEN l <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS BIGINT) AS cost, dp.audit || repeat('I', m.j) || l AS audit
   FROM dp JOIN cls ON cls.conv_id IS NOT DISTINCT FROM dp.conv_id AND cls.i = dp.i + 1 JOIN moves m ON m.p = dp.q WHERE (l = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (l <> 'K' OR need = c))) WHERE rn = 1),
best AS (SELECT conv_id, cost, audit FROM (SELECT dp.conv_id, cost + 3 * [0, 2, 1, 0][q + 1] AS cost, audit || repeat('I', [0, 2, 1, 0][q + 1]) AS audit, row_number() OVER (PARTITION BY dp.conv_id ORDER BY cost + 3 * [0, 2, 1, 0][q + 1], audit || repeat('I', [0, 2, 1, 0][q + 1])) AS rn FROM dp JOIN tally t ON t.conv_id IS NOT DISTINCT FROM dp.conv_id AND t.n = dp.i) WHERE rn = 1),
steps AS (SELECT conv_id, k, l, count(*) FILTER (WHERE l <> 'I') OVER w AS i, count(*) FILTER (WHERE l <> 'D') OVER w AS m FROM (SELECT conv_id, k, substr(audit, CAST(k AS INT), 1) AS l FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM best)) WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
shown AS (SELECT s.conv_id, k, l, role, text, m - max(CASE WHEN l = 'K' AND c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS m FROM steps s LEFT JOIN cls ON l <> 'I' AND cls.conv_id IS NOT DISTINCT FROM s.conv_id AND cls.i = s.i),
texts AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN m % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS t FROM shown WHERE l <> 'D' GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN tally ON tally.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM e.conv_id"""
