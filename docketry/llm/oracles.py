"""DuckDB SQL with the results of the operators that SQL can express."""

from __future__ import annotations

from docketry.llm import quality

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ITEM_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LINE_DEDUP = f"""
WITH l AS (
  SELECT doc_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
shared AS (SELECT key, max(doc_id) AS home FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(home <> doc_id, FALSE) AS gone FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM rep WHERE c > 1) GROUP BY doc_id),
b AS (SELECT d.doc_id, text, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    [x FOR x IN a IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS full_lines, coalesce(cov.n, 0) AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)),
c AS (SELECT *, CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    len(regexp_extract_all(text, '[A-Z]')) AS upper_n, len(regexp_extract_all(text, '[a-z]')) AS lower_n, len(regexp_extract_all(text, '!')) AS shouts,
    len([i FOR i IN range(2, len(w) + 1) IF w[i] = w[i - 1]]) AS echoes FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_symbols <= {quality.MAX_SYMBOLS} * n_words AND n_dup_lines <= {quality.MAX_DUP_LINES} * len(full_lines)
    AND word_chars BETWEEN {quality.MEAN_WORD[0]} * n_words AND {quality.MEAN_WORD[1]} * n_words AND upper_n <= {quality.MAX_CAPITALS} * (upper_n + lower_n)
    AND echoes <= {quality.MAX_ECHO} * n_words AND shouts <= {quality.MAX_SHOUTS} * n_words AS kept
FROM c"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = r)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""

CONTAMINATION = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
t AS (SELECT item, least(13, len(w)) AS k, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_ITEM_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM t))),
h AS (SELECT doc_id, p, dw.k, item FROM dw JOIN t ON dw.x = t.x AND dw.k = t.k),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top, sha1(html) AS h FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, 5 * (j // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (j % 4))) & 31) AS INT) + 1, 1) FOR j IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM g"""

#: near: words that lose one character at the same place and are alike then, or of which one is the other without a character.
SPELLING = rf"""
WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t),
r AS (SELECT doc_id, {_LOWER.format("raw")} AS w FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS raw FROM documents)),
u AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS k, w, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT w, n, list_reduce(flatten(list_transform(string_split(k, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)) AS c FROM u, tbl),
h AS (SELECT w, n, xor(c, 4294967295) AS h FROM b),
e AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT x.word, y.word AS near FROM d x JOIN d y ON x.cut = y.cut AND x.i = y.i AND x.word <> y.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.cut = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.cut = v.word),
g AS (SELECT p.word, count(*) AS n_near, max(y.n) AS top FROM p JOIN v y ON y.word = p.near GROUP BY p.word),
f AS (SELECT g.word, min(p.near) AS form, any_value(top) AS form_n FROM g JOIN v ON v.word = g.word JOIN p ON p.word = g.word JOIN v y ON y.word = p.near AND y.n = top WHERE top >= 5 * v.n GROUP BY g.word),
chain(word, root) AS (SELECT word, form FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root),
last AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM f))
SELECT v.word, form, coalesce(root, v.word) AS root, v.n, coalesce(n_near, 0) AS n_near, form_n FROM v LEFT JOIN g USING (word) LEFT JOIN f USING (word) LEFT JOIN last USING (word)"""
