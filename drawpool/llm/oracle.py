"""DuckDB SQL for the queries that SQL can express, each over whole tables."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{pattern}')"


OP1 = f"""
WITH d AS (SELECT doc_id, {_words(_LOWER.format("text"), _ALNUM)} AS ws FROM documents),
i AS (SELECT item_id, {_words(_LOWER.format("text"), _ALNUM)} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS w
       FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS s FROM (SELECT *, least(10, len(ws)) AS n FROM i WHERE len(ws) > 0))),
dw AS (SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS w
       FROM (SELECT d.*, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
h AS (SELECT doc_id, n, s, item_id FROM dw JOIN iw USING (n, w)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP2 = f"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOWER.format("text"), _WORD)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS g
      FROM (SELECT *, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM d WHERE len(ws) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE 100 * m >= 75 * (zx.n + zy.n - m)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, q.c AS component_id, d.doc_id = q.c AS kept
FROM d LEFT JOIN z USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) q USING (doc_id)
"""

OP7 = f"""
WITH d AS (SELECT doc_id, {_words("text", _WORD)} AS ws FROM documents),
w AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h
      FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS s FROM d WHERE len(ws) >= 50)),
f AS (SELECT doc_id, s FROM w JOIN (SELECT h, min(doc_id) AS first FROM w GROUP BY h) USING (h) WHERE first < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM f),
k AS (SELECT u.doc_id, string_agg(u.x, ' ' ORDER BY u.p) AS t
      FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM d) u ANTI JOIN g ON u.doc_id = g.doc_id AND u.p = g.p
      GROUP BY u.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) USING (doc_id) LEFT JOIN k USING (doc_id)
"""

def _crc32(x: str) -> str:
    """Unsigned crc32 of ASCII text, bit by bit."""
    step = "lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))"
    bits = f"flatten(list_transform(range(1, length({x}) + 1), lambda i: [ord(substr({x}, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), {step}), 4294967295)"


_PUT = "CASE WHEN {0} = '~' THEN '~' ELSE printf('%09d', left({0}, 9)::BIGINT + {2}) || substr({0}, 10) || '{1}' END"


def _put(x: str, letter: str, cost) -> str:
    """Text of nine digits of cost and the audit letters; ~ is out of reach."""
    return _PUT.format(x, letter, cost)


_U_FROM, _BLANK = ("n", "s", "a"), r"[\x20\x09-\x0D]"
_ROLE = "CASE WHEN (j - s_first) % 2 = 1 THEN 'user' ELSE 'assistant' END"
OP12 = f"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
       {_crc32("key")} % 20 AS k FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
       CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS z
      FROM r WHERE k <> 0),
o AS (SELECT *, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, z) AS i,
       row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, z) AS seen, regexp_replace(text, '{_BLANK}', '', 'g') AS dense FROM d),
f AS (SELECT *, CASE WHEN dense = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(dense, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
       lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM o),
p(conv_id, i, n, s, u, a) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '000000000', '~', '~', '~' FROM conversations
  UNION ALL
  SELECT conv_id, i, n_, s_, least(u_, {", ".join(_put(x + "_", "I", 3) for x in _U_FROM)}),
         least(a_, {_put("least(u_, " + ", ".join(_put(x + "_", "I", 3) for x in _U_FROM) + ")", "I", 3)})
  FROM (SELECT p.conv_id, f.i, {_put("n", "D", 4)} AS n_,
      least({_put("s", "D", 4)}, CASE WHEN go OR c <> 's' THEN '~' ELSE {_put("n", "K", "more")} END) AS s_,
      least({_put("u", "D", 4)}, CASE WHEN go THEN '~' ELSE least({", ".join(_put(x, "R", "3 + more") for x in _U_FROM)}) END,
            CASE WHEN go OR c <> 'u' THEN '~' ELSE least({", ".join(_put(x, "K", "more") for x in _U_FROM)}) END) AS u_,
      least({_put("a", "D", 4)}, CASE WHEN go THEN '~' ELSE {_put("u", "R", "3 + more")} END, CASE WHEN go OR c <> 'a' THEN '~' ELSE {_put("u", "K", "more")} END) AS a_
    FROM (SELECT conv_id, i, n, s, least(u, {", ".join(_put(x, "I", 3) for x in _U_FROM)}) AS u,
                 least(a, {_put("least(u, " + ", ".join(_put(x, "I", 3) for x in _U_FROM) + ")", "I", 3)}) AS a FROM p) p
    JOIN (SELECT conv_id, i, c, fault IN ('blank', 'duplicate') AS go, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more FROM f) f
      ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1)),
e AS (SELECT conv_id, least(n, a) AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS last FROM p) WHERE last = 1),
l AS (SELECT *, sum((x <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY q) AS row, sum((x <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY q) AS j
      FROM (SELECT conv_id, q, substr(best, 9 + q::INT, 1) AS x FROM (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS q FROM e))),
m AS (SELECT l.*, f.role, f.text, f.c, max((l.j = 1 AND l.x = 'K' AND f.c = 's')::INT) OVER (PARTITION BY l.conv_id) AS s_first
      FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.row),
t AS (SELECT conv_id, string_agg(CASE x WHEN 'I' THEN {_ROLE} || ':' WHEN 'K' THEN role || ':' || text ELSE {_ROLE} || ':' || text END, chr(10) ORDER BY q) AS body
      FROM m WHERE x <> 'D' GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
       count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
       count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, left(best, 9)::BIGINT AS cost, substr(best, 10) AS audit,
       sha256(coalesce(body, '')) AS repaired_sha256
FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""

SQL = {"op1_decontaminate": OP1, "op2_exact_dedup": OP2, "op5_near_dedup": OP5, "op7_substring_dedup": OP7, "op12_conversation_repair": OP12}
