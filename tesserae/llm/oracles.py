"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

_FOLD = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP5 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE sid % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, source_size * 2.0::DOUBLE AS cap FROM per
), open AS (
  SELECT a.sid, a.cap / a.weight AS room,
         ((SELECT sum(source_size) FROM per) * 1.5::DOUBLE - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight OR (b.cap / b.weight = a.cap / a.weight AND b.sid < a.sid)), 0))
         / sum(b.weight) FILTER (NOT (b.cap / b.weight < a.cap / a.weight OR (b.cap / b.weight = a.cap / a.weight AND b.sid < a.sid))) AS level
  FROM weighed a CROSS JOIN weighed b GROUP BY a.sid, a.cap, a.weight
), water AS (
  SELECT level FROM open WHERE level <= room ORDER BY room, sid LIMIT 1
), targets AS (
  SELECT sid, source, source_size, least(cap, coalesce((SELECT level FROM water) * weight, cap)) AS target FROM weighed
), graded AS (
  SELECT *, len(list_filter(range(1, 17), lambda k: words * 16.0::DOUBLE ** k <= most)) AS level
  FROM (SELECT *, max(words) OVER () AS most FROM (SELECT *, CAST(round(target) AS BIGINT) AS words FROM targets) WHERE words > 0)
), summed AS (
  SELECT *, CAST(sum(words) OVER (PARTITION BY level ORDER BY sid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto,
         CAST(sum(words) OVER (PARTITION BY level) AS BIGINT) AS total, min(words) OVER (PARTITION BY level) AS least
  FROM graded
), spans AS (
  SELECT *, CAST(upto - words AS DOUBLE) / total AS low, CAST(upto AS DOUBLE) / total AS high, greatest(1, least // 1024) AS b FROM summed
), frame AS (
  SELECT level, max(greatest((total + b - 1) // b, (4 * total + least - 1) // least)) AS n FROM spans GROUP BY level
), points AS (
  SELECT level, n, i AS slot, (i + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE - floor((i + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) AS pt
  FROM (SELECT level, n, unnest(range(n)) AS i FROM frame)
), ranked AS (
  SELECT sid, source_size, b, words, n, slot, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS r, count(*) OVER (PARTITION BY sid) AS slots
  FROM points JOIN spans USING (level) WHERE pt >= low AND pt < high
), ended AS (
  SELECT *, (source_size + b - 1) // b AS blocks, words % source_size AS rest,
         words // source_size * ((source_size + b - 1) // b) + (words % source_size + b - 1) // b AS ranks
  FROM ranked
), shares AS (
  SELECT *, unnest(range(r, CASE WHEN r = slots - 1 THEN ranks ELSE r + 1 END)) AS k FROM ended WHERE r < ranks
), dealt AS (
  SELECT sid, k % blocks AS block, (slot + 0.5::DOUBLE) / n AS spot, k % blocks * b AS first,
         CASE WHEN k = ranks - 1 AND rest > 0 THEN rest ELSE least((k % blocks + 1) * b, source_size) END AS past
  FROM shares
), placed AS (
  SELECT s.doc_id, s.size, t.sid, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY t.sid ORDER BY s.h, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), pieces AS (
  SELECT doc_id, sid, start, size, unnest(range(CAST(start // b AS BIGINT), CAST((start + size - 1) // b + 1 AS BIGINT))) AS block
  FROM placed JOIN (SELECT sid, b FROM spans) USING (sid) WHERE size > 0
), taken AS (
  SELECT doc_id, sum(least(start + size, past) - greatest(start, first)) AS taken, min(spot) AS first_at
  FROM pieces JOIN dealt USING (sid, block) WHERE least(start + size, past) > greatest(start, first) GROUP BY doc_id
)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken, first_at
FROM placed p LEFT JOIN taken t USING (doc_id)
"""

OP10 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_FOLD.format("text")}, {_ALNUM}) AS w FROM documents
), q AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLD.format("text")}, {_ALNUM}) AS w FROM benchmark
), asked AS (
  SELECT item, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM q WHERE len(w) > 0)
), held AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM asked) WHERE len(w) >= n)
), found AS (
  SELECT DISTINCT doc_id, item, s, n FROM held JOIN asked USING (n, g)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM d
), asked_words AS (
  SELECT id, item, n, unnest(w) AS t, unnest(range(n)) AS off FROM (SELECT row_number() OVER () AS id, item, w, len(w) AS n FROM q)
), df AS (
  SELECT t, count(*) AS c FROM words SEMI JOIN asked_words USING (t) GROUP BY t
), ranked AS (
  SELECT id, item, n, t, off, row_number() OVER (PARTITION BY id ORDER BY c, off) AS k, count(*) OVER (PARTITION BY id) AS present FROM asked_words JOIN df USING (t)
), chosen AS (
  SELECT * FROM ranked WHERE k <= 4 AND present >= least(4, n)
), needed AS (
  SELECT id, count(*) AS m FROM chosen GROUP BY id
), anchors AS (
  SELECT id, doc_id, p, off FROM chosen JOIN words USING (t) WHERE k = 1
), met AS (
  SELECT a.id, c.item, a.doc_id, a.p, count(DISTINCT c.k) AS m
  FROM anchors a JOIN chosen c ON a.id = c.id JOIN words w ON w.t = c.t AND w.doc_id = a.doc_id AND abs(w.p - (a.p + c.off - a.off)) <= 4 GROUP BY ALL
), near AS (
  SELECT doc_id, count(DISTINCT item) AS n_near FROM met JOIN needed USING (id, m) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""

_SPEAKER = "lower(trim(role))"
_ESCAPED = r"regexp_replace(coalesce(text, ''), '<(\\*\|im_(?:start|end)\|>)', '<\\\1', 'g')"
OP4 = f"""
WITH base AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), t AS (
  SELECT *, row_number() OVER w AS place,
         string_agg(coalesce('r' || role, 'n') || chr(31) || coalesce('t' || text, 'n') || chr(30), '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM base WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), ends AS (
  SELECT conv_id, max(place) AS n, arg_max(prefix, place) AS p FROM t GROUP BY conv_id
), firsts AS (
  SELECT p, n, min(conv_id) AS conv_id, count(*) AS n_equal FROM ends GROUP BY p, n
), kept AS (
  SELECT * FROM firsts ANTI JOIN (SELECT DISTINCT prefix AS p FROM t JOIN ends USING (conv_id) WHERE place < n) inside USING (p)
)
SELECT conv_id, (place - 1) // 4096 AS piece, n AS n_turns, n_equal,
       string_agg('<|im_start|>' || CASE WHEN {_SPEAKER} IN ('system', 'user', 'assistant', 'tool') THEN {_SPEAKER} ELSE 'user' END
                  || chr(10) || {_ESCAPED} || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
FROM t JOIN kept USING (conv_id) GROUP BY ALL
"""

OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_FOLD.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least_of AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""

# texts as hexadecimal digits, two a byte; a window is 400 of them
OP7 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)
), again AS (
  SELECT k FROM w GROUP BY k HAVING count(*) > 1
), starts AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM w SEMI JOIN again USING (k)
), runs AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts
), spans AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

# crc32 bit by bit; a stretch is a maximal run of equal words p apart, and a run unless a run of a divisor of p holds it
OP11 = r"""
WITH hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
             lambda crc, byte: list_reduce(range(8), lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte)), 4294967295)) AS h
  FROM documents
), cut AS (
  SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM hashed
), aimed AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM cut
), words AS (
  SELECT doc_id, n, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS t FROM (SELECT *, unnest(range(n)) AS i FROM aimed)
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS p FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.t = y.t AND y.i > x.i AND y.i - x.i <= x.n // 3 WHERE x.n >= 24
), islands AS (
  SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT doc_id, p, min(i) AS s, count(*) + p AS l FROM islands GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(24, 3 * p)
), runs AS (
  SELECT * FROM stretches x WHERE NOT EXISTS (
    SELECT 1 FROM stretches y WHERE y.doc_id = x.doc_id AND y.p < x.p AND x.p % y.p = 0 AND y.s <= x.s AND y.s + y.l >= x.s + x.l)
), per AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM runs GROUP BY doc_id
), best AS (
  SELECT * FROM runs x WHERE NOT EXISTS (
    SELECT 1 FROM runs y WHERE y.doc_id = x.doc_id
      AND (y.l * x.p > x.l * y.p OR (y.l * x.p = x.l * y.p AND (y.s < x.s OR (y.s = x.s AND y.p < x.p)))))
), kept AS (
  SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS k FROM words x
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = x.doc_id AND x.i >= r.s + r.p AND x.i < r.s + r.l) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(p AS BIGINT) AS period,
       CAST(1000 * l // p AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256
FROM documents d LEFT JOIN per USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP12 = """
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, a.label = b.label AS same, b.id AS id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.id <> b.id WHERE a.id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

SQL = {"op2_ngram_jaccard_join": OP2, "op4_chat_formatting": OP4, "op5_source_mixing": OP5, "op7_suffix_dedup": OP7, "op10_benchmark_decontamination": OP10, "op11_periodic_runs": OP11, "op12_hard_negatives": OP12}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
