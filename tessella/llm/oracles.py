"""DuckDB SQL of the operators whose results SQL can say on small tables, by all strings and all pairs."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every string of 400 bytes (as 800 hex digits, taken from pieces of 512 starts, in which a place is found sooner) and every run of 51 words, counted by hash; runs by gaps and islands.
OP3 = f"""
WITH h AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
piece AS (SELECT r, a, substr(h, 2 * a - 1, 2 * 911) AS p FROM (SELECT r, h, unnest(range(1, strlen(h) // 2 - 398, 512)) AS a FROM h WHERE strlen(h) >= 800)),
s AS (SELECT r, a + i - 1 AS i, hash(substr(p, 2 * i - 1, 800)) AS x FROM (SELECT r, a, p, unnest(range(1, strlen(p) // 2 - 398)) AS i FROM piece)),
again AS (SELECT x FROM s GROUP BY x HAVING count(*) > 1),
b AS (SELECT r, i, i + 400 AS e, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM s SEMI JOIN again USING (x)),
island AS (SELECT r, min(i) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN before IS NULL OR before + 400 < i THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM b) GROUP BY r, g),
gap AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 1) AS o FROM island),
cut AS (SELECT r, count(*) AS n, sum(gap.e - gap.s) AS removed, string_agg(substr(h, 2 * o - 1, 2 * (gap.s - o)), '' ORDER BY gap.s) AS kept, max(gap.e) AS last FROM gap JOIN h USING (r) GROUP BY r),
n AS (SELECT r, list_transform(w, lambda x: hash(x)) AS w FROM h WHERE len(w) >= 51),
v AS (SELECT r, i, hash(list_slice(w, i, i + 50)) AS x FROM (SELECT r, w, unnest(range(1, len(w) - 49)) AS i FROM n)),
vagain AS (SELECT x FROM v GROUP BY x HAVING count(*) > 1),
vb AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM v SEMI JOIN vagain USING (x)),
passages AS (SELECT r, count(*) FILTER (before IS NULL OR before + 51 < i) AS n FROM vb GROUP BY r)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(cut.n, 0) AS BIGINT) AS n_spans,
sha256(unhex(CASE WHEN cut.r IS NULL THEN h ELSE kept || substr(h, 2 * last - 1) END)) AS kept_sha256, CAST(coalesce(passages.n, 0) AS BIGINT) AS n_passages
FROM h LEFT JOIN cut USING (r) LEFT JOIN passages USING (r)
"""

#: All pairs that share a shingle, and everything reachable by links.
OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 85 * (na + nb - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS root FROM d UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.v),
least AS (SELECT v, min(root) AS component_id FROM reach GROUP BY v)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON v = doc_id
"""

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = ((0, _ASSIGN, 2), (1, "AKIA[A-Z0-9]{16,}", 0), (2, "[0-9a-f]{24,}", 0), (3, "[A-Za-z0-9+/_-]{20,}={0,2}", 0))
_TAIL = "1.0::DOUBLE / (1.0::DOUBLE + exp(least(700.0::DOUBLE, 1.5976::DOUBLE * ({z}) + 0.070565992::DOUBLE * ({z}) * ({z}) * ({z}))))"
_TWO = f"least(1.0::DOUBLE, 2.0::DOUBLE * ({_TAIL}))"
_LEVEL = " + ".join(f"CAST(e - s >= {b} AS INTEGER)" for b in (24, 32, 40, 64, 128))

#: Matches placed by running sums, the three tests on each token, the bound of each stratum from the counts of all tokens.
OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
pieces AS ({" UNION ALL ".join(f"SELECT r, {k} AS kind, string_split_regex(t, '{p}') AS b, regexp_extract_all(t, '{p}', 0) AS h, regexp_extract_all(t, '{p}', {g}) AS v FROM d WHERE regexp_matches(t, '{p}')" for k, p, g in _KINDS)}),
listed AS (SELECT r, kind, unnest(range(1, len(b) + 1)) AS i, unnest(b) AS b, unnest(h) AS h, unnest(v) AS v FROM pieces),
placed AS (SELECT r, kind, h, v, CAST(sum(length(b)) OVER (PARTITION BY r, kind ORDER BY i) + coalesce(sum(length(h)) OVER (PARTITION BY r, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM listed),
base AS (SELECT r, kind, s, s + length(h) AS e FROM placed WHERE h IS NOT NULL AND (kind = 0 AND length(v) >= 6 OR kind = 1 AND length(h) >= 20 OR kind = 2 AND length(h) >= 24)),
token AS (SELECT r, s, e, body, CASE WHEN regexp_full_match(body, '[0-9a-f]+|[0-9A-F]+') THEN 0 WHEN regexp_full_match(body, '[A-Z2-7]+') THEN 1 ELSE 2 END AS enc
  FROM (SELECT r, s, s + length(h) AS e, regexp_replace(h, '=+$', '') AS body FROM placed WHERE kind = 3 AND h IS NOT NULL) WHERE length(body) >= 20),
plain AS (SELECT r, s, e, enc, CASE enc WHEN 0 THEN lower(body) ELSE translate(body, '-_', '+/') END AS p,
  CASE enc WHEN 0 THEN '0123456789abcdef' WHEN 1 THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' ELSE 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/' END AS abc FROM token),
codes AS (SELECT r, s, e, enc, CAST(length(abc) AS DOUBLE) AS k, CAST(length(p) AS DOUBLE) AS n,
  CAST(list_sum(list_transform(string_split(abc, ''), lambda c: (length(p) - length(replace(p, c, ''))) * (length(p) - length(replace(p, c, ''))))) AS DOUBLE) AS sq,
  list_transform(string_split(p, ''), lambda c: CAST(instr(abc, c) - 1 AS DOUBLE)) AS x FROM plain),
sums AS (SELECT r, s, e, enc, k, n, sq * k / n - n AS chi, k - 1 AS df, CAST(len(list_filter(x, lambda v: v >= k / 2)) AS DOUBLE) AS n1,
  1 + CAST(len(list_filter(range(1, len(x)), lambda i: (x[i] >= k / 2) <> (x[i + 1] >= k / 2))) AS DOUBLE) AS runs,
  list_sum(list_transform(range(1, len(x)), lambda i: (x[i] - (k - 1) / 2) * (x[i + 1] - (k - 1) / 2))) AS products FROM codes),
moments AS (SELECT *, 2.0::DOUBLE * n1 * (n - n1) / n + 1.0::DOUBLE AS mean FROM sums),
tests AS (SELECT r, s, e, enc, {_TAIL.format(z="(pow(chi / df, 1.0::DOUBLE / 3) - (1.0::DOUBLE - 2.0::DOUBLE / (9.0::DOUBLE * df))) / sqrt(2.0::DOUBLE / (9.0::DOUBLE * df))")} AS p_chi,
  CASE WHEN (mean - 1) * (mean - 2) / (n - 1) > 0 THEN {_TWO.format(z="abs((runs - mean) / sqrt(greatest((mean - 1) * (mean - 2) / (n - 1), 1e-9::DOUBLE)))")} ELSE 1e-9::DOUBLE END AS p_runs,
  {_TWO.format(z="abs(products / ((k * k - 1.0::DOUBLE) / 12.0::DOUBLE * sqrt(n - 1.0::DOUBLE)))")} AS p_serial FROM moments),
joint AS (SELECT r, s, e, enc, -ln(greatest(p_chi, 1e-9::DOUBLE)) - ln(greatest(p_runs, 1e-9::DOUBLE)) - ln(greatest(p_serial, 1e-9::DOUBLE)) AS half FROM tests),
scored AS (SELECT r, s, e, enc, {_LEVEL} AS level, least(1.0::DOUBLE, exp(-half) * (1.0::DOUBLE + half + half * half / 2.0::DOUBLE)) AS p FROM joint),
counts AS (SELECT level, enc, CAST(least(floor(p * 50), 49) AS INTEGER) AS b, count(*) AS n FROM scored GROUP BY ALL),
cells AS (SELECT level, enc, sum(n) AS size, (SELECT sum(n) FROM counts w WHERE w.enc = c.enc) AS wide FROM counts c GROUP BY level, enc),
pool AS (SELECT c.level, c.enc, q.b, sum(q.n) AS n FROM cells c JOIN counts q ON CASE WHEN c.size >= 50 THEN q.level = c.level AND q.enc = c.enc WHEN c.wide >= 50 THEN q.enc = c.enc ELSE true END GROUP BY ALL),
above AS (SELECT c.level, c.enc, g.b, coalesce((SELECT CAST(sum(n) AS DOUBLE) FROM pool q WHERE q.level = c.level AND q.enc = c.enc AND q.b >= g.b), 0) AS above,
  coalesce((SELECT 2 * CAST(sum(n) AS DOUBLE) FROM pool q WHERE q.level = c.level AND q.enc = c.enc AND q.b >= 25), 0) AS chance FROM cells c, (SELECT unnest(range(1, 50)) AS b) g),
bound AS (SELECT level, enc, coalesce(min(b) FILTER (above > 0 AND greatest(0.0::DOUBLE, above - chance * (1.0::DOUBLE - b / 50.0::DOUBLE)) <= 0.05::DOUBLE * above) / 50.0::DOUBLE, 1.0::DOUBLE) AS low FROM above GROUP BY level, enc),
added AS (SELECT r, 3 AS kind, s, e FROM scored c JOIN bound USING (level, enc) WHERE p >= low AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = c.r AND b.s < c.e AND c.s < b.e)),
named AS (SELECT r, kind, s, e, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || s || ':' || e AS name FROM (FROM base UNION ALL FROM added)),
joined AS (SELECT r, count_if(kind = 0) AS a, count_if(kind = 1) AS c, count_if(kind = 2) AS x, string_agg(name, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS own, string_agg(name, ',' ORDER BY s, kind, e) AS spans FROM named GROUP BY r)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(c, 0) AS BIGINT) AS n_access, CAST(coalesce(x, 0) AS BIGINT) AS n_hex, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN joined USING (r)
"""
