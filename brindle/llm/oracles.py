"""SQL that makes the same rows as the queries that SQL can express, by brute force."""

from __future__ import annotations

from brindle.llm import licenses, lines, secrets

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOW = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NEAR_DOCUMENTS = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_ASCII_LOW}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
SELECT r.x AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.y) AS component_id, min(r.y) = r.x AS kept FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
  e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
  r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
SELECT r.x AS vec_id, (SELECT count(*) FROM e WHERE e.a = r.x) AS n_links, min(r.y) AS component_id, min(r.y) = r.x AS kept FROM r GROUP BY r.x"""


def _secret_spans(rule: secrets.Rule, order: int) -> str:
    p = _text(rule.java)
    return f"""(SELECT list_filter(list_transform(range(1, len(h) + 1), lambda i: {{'s': CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda z: length(z))), 0) AS BIGINT), 'o': {order}, 'k': '{rule.kind}', 'n': length(h[i]), 'm': length(m[i])}}), lambda z: z.m >= {rule.least})
    FROM (SELECT regexp_split_to_array(t, {p}) AS g, regexp_extract_all(t, {p}, 0) AS h, regexp_extract_all(t, {p}, {rule.group}) AS m))"""


def _listed(spans: str) -> str:
    return f"coalesce(array_to_string(list_transform(list_sort({spans}), lambda z: z.k || ':' || z.s || ':' || (z.s + z.n)), ','), '')"


_RULES = [*secrets.BASE, *secrets.ADDED]
SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  f AS (SELECT doc_id, {", ".join(f"{_secret_spans(r, i)} AS s{i}" for i, r in enumerate(_RULES))} FROM d)
SELECT doc_id, len(s0) AS n_assign, len(s1) AS n_access, len(s2) AS n_hex, sha256({_listed("list_concat(list_concat(s0, s1), s2)")}) AS base_sha256,
  {_listed("flatten([" + ", ".join(f"s{i}" for i in range(len(_RULES))) + "])")} AS spans FROM f"""

_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_PLACES = ", ".join(f"(list_transform(list_filter(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + {len(p.split()) - 1}], ' ') = '{p}'), lambda i: {{'i': i - 1, 'l': '{label}'}}))" for p, label in licenses.PHRASES)
_TEMPLATES = ", ".join(f"({_text(label)}, [{', '.join(map(_text, licenses.tokens(t)))}], {licenses.width_of(t)})" for label, t in licenses.TEMPLATES)
LICENSES = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_ASCII_LOW)} AS w FROM documents),
  b AS (SELECT doc_id, len(w) AS n_words, flatten([{_PLACES}]) AS p FROM d),
  t(label, need, width) AS (VALUES {_TEMPLATES}),
  s AS (SELECT doc_id, {_WORDS.format("lower(text)")} AS w FROM documents),
  c AS (SELECT doc_id, w, label, need, width FROM s JOIN t ON len(list_intersect(need, w)) >= {licenses.THRESHOLD} * len(need) - 1e-9),
  i AS (SELECT doc_id, label, need, width, i, x FROM (SELECT doc_id, label, need, width, unnest(w) AS x, unnest(range(len(w))) AS i FROM c) WHERE list_contains(need, x)),
  h AS (SELECT a.doc_id, a.label, a.i, count(DISTINCT b.x)::DOUBLE / len(any_value(a.need)) AS c FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.label = b.label AND b.i BETWEEN a.i AND a.i + a.width - 1
    GROUP BY 1, 2, 3 HAVING count(DISTINCT b.x) >= {licenses.THRESHOLD} * len(any_value(a.need)) - 1e-9),
  k AS (SELECT h.doc_id, h.label, h.i, h.c, o.label AS wider, o.need, o.width, unnest(range(greatest(h.i + t.width - o.width, 0), h.i + 1)) AS k
    FROM h JOIN t ON t.label = h.label JOIN t o ON len(o.need) > len(t.need) AND list_has_all(o.need, t.need) AND o.width >= t.width),
  v AS (SELECT DISTINCT doc_id, label, i FROM (SELECT k.doc_id, k.label, k.i, k.wider, k.k FROM k JOIN i x ON x.doc_id = k.doc_id AND x.label = k.wider AND x.i BETWEEN k.k AND k.k + k.width - 1
    GROUP BY ALL HAVING count(DISTINCT x.x) >= greatest({licenses.THRESHOLD}, any_value(k.c)) * len(any_value(k.need)) - 1e-9)),
  m AS (SELECT doc_id, list(DISTINCT label) AS more, list(DISTINCT label) FILTER (v.label IS NULL) AS narrow, max(c) AS best FROM h LEFT JOIN v USING (doc_id, label, i) GROUP BY 1)
SELECT doc_id, n_words, len(p) AS n_base, list_min(list_transform(p, lambda z: z.i)) AS first_word, list_max(list_transform(p, lambda z: z.i)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda z: z.l))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda z: z.l), coalesce(more, [])))), ',') AS labels,
  greatest(CASE WHEN len(p) > 0 THEN 1.0 ELSE 0.0 END, coalesce(best, 0.0))::DOUBLE AS score,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda z: z.l), coalesce(narrow, [])))), ',') AS specific FROM b LEFT JOIN m USING (doc_id)"""

# one edit leaves the first or the second half of a line whole
LINES = f"""
WITH RECURSIVE o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
  u AS (SELECT x, min({{'d': doc_id, 'i': i}}) AS f, row_number() OVER (ORDER BY x) AS n FROM o WHERE length(x) >= {lines.MIN_CHARS} GROUP BY x),
  h AS (SELECT n, x, length(x) AS k, left(x, (length(x) - g) // 2) AS a, right(x, (length(x) - g) // 2) AS z FROM u, (VALUES (0), (1)) gaps(g)),
  e AS (SELECT DISTINCT a.n AS a, b.n AS b FROM h a JOIN h b ON a.a = b.a AND a.n <> b.n AND abs(a.k - b.k) <= 1 AND levenshtein(a.x, b.x) <= 1
    UNION SELECT DISTINCT a.n, b.n FROM h a JOIN h b ON a.z = b.z AND a.n <> b.n AND abs(a.k - b.k) <= 1 AND levenshtein(a.x, b.x) <= 1),
  r(x, y) AS (SELECT n, n FROM u UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
  c AS (SELECT r.x AS n, min(r.y) AS c FROM r GROUP BY 1),
  s AS (SELECT c.c, min(u.f) AS stay FROM u JOIN c USING (n) GROUP BY 1),
  k AS (SELECT o.doc_id, o.i, o.x, u.f, s.stay, u.f IS NOT NULL AND s.stay <> {{'d': o.doc_id, 'i': o.i}} AS gone FROM o LEFT JOIN u ON u.x = o.x LEFT JOIN c USING (n) LEFT JOIN s ON s.c = c.c)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone AND f = stay) AS gone_exact, count(*) FILTER (gone AND f <> stay) AS gone_near, md5(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_md5 FROM k GROUP BY 1"""


# CRC-32 of a text's UTF-8 bytes, by its table of 256, which the rule of its polynomial makes
_CRC_TABLE = "SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))"


def _crc(text: str) -> str:
    """Over a row that holds the table as t."""
    bytes_ = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INT + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


_DAY = 86_400_000_000
LAST_ORDERS = f"""
WITH crc AS ({_CRC_TABLE}),
  k AS (SELECT click_id, client_id, CASE WHEN {_crc("click_id::VARCHAR")} % 2 = 1 THEN m - (m % {_DAY} + {_DAY}) % {_DAY} ELSE m END AS ts_us
    FROM (SELECT click_id, client_id, epoch_us(ts) AS m FROM clicks WHERE click_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts IS NULL OR client_id IS NULL, ts, client_id) = 1), crc),
  s AS (SELECT *, CASE WHEN h % 2 = 1 THEN m - (m % {_DAY} + {_DAY}) % {_DAY} ELSE m END AS o_us FROM (SELECT sale_id, client_id, priority, floor(100 * total + 0.5)::BIGINT AS cents, epoch_us(sold_at) AS m, {_crc("sale_id::VARCHAR")} AS h FROM sales, crc)),
  o AS (SELECT client_id, o_us, sale_id, priority, cents FROM s UNION ALL SELECT client_id, o_us, -1 - sale_id, 6 - priority, cents FROM s WHERE h % 3 <> 0),
  j AS (SELECT k.click_id, o.*, max(o.o_us) OVER (PARTITION BY k.click_id) AS last FROM k JOIN o ON o.client_id = k.client_id AND o.o_us <= k.ts_us AND o.o_us >= k.ts_us - 3 * {_DAY}),
  m AS (SELECT *, count(*) OVER (PARTITION BY click_id) AS n_tied, row_number() OVER (PARTITION BY click_id ORDER BY priority DESC NULLS LAST, sale_id NULLS LAST, cents DESC NULLS LAST) AS nth FROM j WHERE o_us = last)
SELECT k.click_id, k.client_id, k.ts_us, m.sale_id, k.ts_us - m.o_us AS lag_us, m.cents AS total_cents, coalesce(m.n_tied, 0) AS n_tied FROM k LEFT JOIN m ON m.click_id = k.click_id AND m.nth = 1"""


def _features(table: str, id_: str) -> str:
    runs = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"SELECT {id_} AS id, len(w) AS n_words, {runs} AS f FROM (SELECT {id_}, {_WORDS.format(_ASCII_LOW)} AS w FROM {table})"


RESAMPLE = f"""
WITH crc AS ({_CRC_TABLE}),
  d AS ({_features("documents", "doc_id")}), e AS ({_features("benchmark", "item_id")}),
  dc AS (SELECT id, f, count(*) AS n FROM (SELECT id, unnest(f) AS f FROM d) GROUP BY 1, 2), ec AS (SELECT f, count(*) AS n FROM (SELECT unnest(f) AS f FROM e) GROUP BY 1),
  b AS (SELECT f, {_crc("f")} % 10000 AS b FROM (SELECT f FROM dc UNION SELECT f FROM ec), crc),
  s AS (SELECT b, sum(n) AS s FROM dc JOIN b USING (f) GROUP BY 1), t AS (SELECT b, sum(n) AS t FROM ec JOIN b USING (f) GROUP BY 1),
  g AS (SELECT b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (coalesce((SELECT sum(s) FROM s), 0)::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (b)),
  w AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM dc JOIN b USING (f) JOIN g USING (b) GROUP BY 1),
  r AS (SELECT doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM (SELECT d.id AS doc_id, n_words, coalesce(n_features, 0) AS n_features,
    coalesce((total - (total % n_features + n_features) % n_features) // n_features, 0) AS weight, ('0x' || substr(sha256('7:' || d.id), 1, 8))::BIGINT::DOUBLE AS h FROM d LEFT JOIN w USING (id))),
  p AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS nth FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= (SELECT count(*) FROM r WHERE n_words >= 20) * 25 // 100 THEN nth END AS rank FROM p"""
