"""DuckDB SQL for the queries that SQL can express."""

import re

from lakeloom.llm import chat

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i, w FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS x FROM s),
dn AS (SELECT rid, w, n FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
ds AS (SELECT rid, n, w, unnest(range(0, len(w) - n + 1)) AS i FROM dn),
dw AS (SELECT rid, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS x FROM ds),
h AS (SELECT rid, item_id, dw.n AS n, i FROM dw JOIN iw ON dw.n = iw.n AND dw.x = iw.x),
p AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS q FROM h) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)
"""

OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 4), ' ') AS x FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS x, a AS y FROM g UNION SELECT r.x, g.b FROM r JOIN g ON r.y = g.a),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.y, d.doc_id) AS component_id, d.doc_id = coalesce(m.y, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id
"""

OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT rid, w, unnest(range(0, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
x AS (SELECT rid, i, md5(array_to_string(list_slice(w, i + 1, i + 35), ' ')) AS m FROM i),
r0 AS (SELECT rid, i, m FROM (SELECT rid, i, m, count(*) OVER (PARTITION BY m) AS c FROM x) WHERE c > 1),
LEVELS
z AS (SELECT rid, max(n) AS longest FROM (ALL_LEVELS) GROUP BY rid),
g AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS k FROM r0),
k AS (SELECT rid, unnest(range(0, len(w))) AS k, unnest(w) AS word FROM d),
o AS (SELECT k.rid, string_agg(word, ' ' ORDER BY k.k) AS kept, count(*) AS n FROM k LEFT JOIN g ON g.rid = k.rid AND g.k = k.k WHERE g.k IS NULL GROUP BY k.rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(o.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256, CAST(coalesce(z.longest, 0) AS INTEGER) AS longest
FROM d LEFT JOIN o USING (rid) LEFT JOIN z USING (rid)
"""
# windows of twice the length are pairs of windows that repeat; twelve doublings reach texts of 143,360 words
_DOUBLED = "r{b} AS (SELECT rid, i, m FROM (SELECT *, count(*) OVER (PARTITION BY m) AS c FROM (SELECT p.rid, p.i, md5(p.m || q.m) AS m FROM r{a} p JOIN r{a} q ON p.rid = q.rid AND q.i = p.i + {n})) WHERE c > 1),"
OP10 = OP10.replace("ALL_LEVELS", " UNION ALL ".join(f"SELECT rid, {35 << k} AS n FROM r{k}" for k in range(13))).replace("LEVELS", "\n".join(_DOUBLED.format(a=k, b=k + 1, n=35 << k) for k in range(12)))

# the 256 remainders of the public CRC-32, and the checksum of the ASCII text {0} by them
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len({0}) + 1), lambda j: CAST(ascii({0}[j]) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])))"

OP11 = r"""
WITH RECURSIVE CRC_TABLE,
d AS (SELECT doc_id, lang, FIELDS[1] || FIELDS[2] || FIELDS[3] || FIELDS[4] || FIELDS[5] AS body,
      FIELDS[1] || FIELDS[2] || FIELDS[3] || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + CASE WHEN CRC % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR)) || ':' || CAST(n_chars + CASE WHEN CRC % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR) END || FIELDS[5] AS shown
      FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s, [CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END FOR v IN [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text]] AS f FROM documents), crc),
l AS (SELECT doc_id, lang, sha256(body) AS leaf, sha256(shown) AS shown, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(body)) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d),
up AS (SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM l UNION ALL SELECT tree, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, lvl, n, pos // 2),
sub AS (SELECT tree, h AS subroot FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, tree AS pos, (SELECT count(*) FROM sub) AS n, subroot AS h FROM sub UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, n, pos // 2),
node AS (SELECT 0 AS stage, tree, lvl, pos, h, n FROM up UNION ALL SELECT 1, 0, lvl, pos, h, n FROM top),
walk AS (SELECT row_number() OVER () AS rid, 0 AS stage, tree, 0 AS lvl, pos, n, shown AS f, '' AS proof FROM l
  UNION ALL
  SELECT rid, CASE WHEN w.n = 1 THEN 1 ELSE w.stage END, CASE WHEN w.n = 1 THEN 0 ELSE w.tree END, CASE WHEN w.n = 1 THEN 0 ELSE w.lvl + 1 END, CASE WHEN w.n = 1 THEN w.tree ELSE w.pos // 2 END,
    CASE WHEN w.n = 1 THEN (SELECT count(*) FROM sub) ELSE (w.n + 1) // 2 END,
    CASE WHEN w.n = 1 THEN f WHEN s.h IS NULL THEN sha256(f) WHEN w.pos % 2 = 1 THEN sha256(s.h || f) ELSE sha256(f || s.h) END, proof || CASE WHEN w.n = 1 THEN '' ELSE coalesce(s.h, '') END
  FROM walk w LEFT JOIN node s ON s.stage = w.stage AND s.tree = w.tree AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1) WHERE w.n > 1 OR w.stage = 0),
r AS (SELECT rid, f, proof FROM walk WHERE stage = 1 AND n = 1),
k AS (SELECT *, row_number() OVER () AS rid FROM l)
SELECT k.doc_id, k.leaf, sub.subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(r.proof) AS proof_sha256, r.f AS folded_root, r.f = (SELECT h FROM top WHERE n = 1) AS verified
FROM k JOIN sub USING (tree) JOIN r USING (rid)
"""
OP11 = OP11.replace("CRC_TABLE", _CRC_TABLE).replace("CRC", _CRC.format("s")).replace("FIELDS", "f")

# a cheapest way to each state as one text, its cost in eight digits and then its initials: texts compare as (cost, initials)
OP12 = r"""
WITH RECURSIVE CRC_TABLE,
f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CRC % 20 AS fate FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations), crc),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS twice FROM f WHERE fate > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text), twice) AS k, right(rtrim(text, e' \t\n\x0b\x0c\r'), 1) AS tail FROM d),
q AS (SELECT *, tail = '' AS blank, tail <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again FROM o),
r AS (SELECT *, NOT blank AND NOT again AND tail NOT IN ('.', '!', '?') AS cut, blank OR again AS gone, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM q),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(CAST(blank AS INT)) AS blank, sum(CAST(again AS INT)) AS duplicate, sum(CAST(cut AS INT)) AS truncated,
      sum(CASE WHEN before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, '00000000' AS n, CAST(NULL AS VARCHAR) AS s, '00000003I' AS u, '00000006II' AS a FROM c
  UNION ALL
  SELECT conv_id, k, n, s, least(u, WAY(n,3,I), WAY(s,3,I), WAY(a,3,I)), least(a, WAY(least(u, WAY(n,3,I), WAY(s,3,I), WAY(a,3,I)),3,I)) FROM (
    SELECT w.conv_id, r.k, WAY(n,4,D) AS n, least(WAY(s,4,D), CASE WHEN NOT gone AND i = 's' THEN WAY(n,e,K) END) AS s,
      least(WAY(u,4,D), CASE WHEN NOT gone AND i = 'u' THEN least(WAY(n,e,K), WAY(s,e,K), WAY(a,e,K)) END, CASE WHEN NOT gone THEN least(WAY(n,3 + e,R), WAY(s,3 + e,R), WAY(a,3 + e,R)) END) AS u,
      least(WAY(a,4,D), CASE WHEN NOT gone AND i = 'a' THEN WAY(u,e,K) END, CASE WHEN NOT gone THEN WAY(u,3 + e,R) END) AS a
    FROM w JOIN (SELECT *, CASE WHEN cut THEN 3 ELSE 0 END AS e FROM r) r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1)),
z AS (SELECT c.*, CAST(left(least(w.n, w.a), 8) AS BIGINT) AS cost, substr(least(w.n, w.a), 9) AS audit FROM w JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.k),
l AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM z),
m AS (SELECT conv_id, p, audit[p] AS x, len(regexp_replace(left(audit, p), 'I', '', 'g')) AS k, len(regexp_replace(left(audit, p - 1), 'D', '', 'g')) + len(regexp_replace(audit, 'D', '', 'g')) % 2 AS j FROM l WHERE audit[p] <> 'D'),
t AS (SELECT m.conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN j % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS repaired FROM m LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.k = m.k AND x <> 'I' GROUP BY m.conv_id)
SELECT g.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM g.conv_id
"""
OP12 = OP12.replace("CRC_TABLE", _CRC_TABLE).replace("CRC", _CRC.format("s"))
_WAY = re.compile(r"WAY\((\w),([^,()]+),(\w)\)|WAY\((least\([^W]*\)),([^,()]+),(\w)\)")
while "WAY(" in OP12:  # the inner ones first
    OP12 = _WAY.sub(lambda m: f"lpad(CAST(CAST(left({m[1] or m[4]}, 8) AS INT) + {m[2] or m[5]} AS VARCHAR), 8, '0') || substr({m[1] or m[4]}, 9) || '{m[3] or m[6]}'", OP12)

# every pair; where the error bounds lose no neighbour the search returns these rows
OP13 = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

SQL = {"op1_chat": chat.ORACLE, "op8_decontamination": OP8, "op9_minhash_dedup": OP9, "op10_substring_dedup": OP10, "op11_merkle": OP11, "op12_turns": OP12, "op13_onebit": OP13}
