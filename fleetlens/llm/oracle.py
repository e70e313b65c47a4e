"""SQL for the registered queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
), g AS (
  SELECT *, payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AS later FROM f
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN later THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN later THEN first_id END AS refers_to,
       TRUE AS valid
FROM g
"""

# Rows are numbered, as ids may repeat; bins of a group are its quantile sketch.
ORACLES["op2_quality_rules"] = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d
), places AS (
  SELECT r, unnest(range(1, len(words) - 5 + 2)) AS pos, words FROM w WHERE len(words) > 5
), windows AS (
  SELECT r, pos, array_to_string(words[pos : pos + 4], ' ') AS name FROM places
), twice AS (
  SELECT r, pos FROM windows QUALIFY count(*) OVER (PARTITION BY r, name) > 1
), repeated AS (
  SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(pos, pos + 5)) AS place FROM twice) GROUP BY r
), lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), per_doc AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r
), counts AS (
  SELECT d.r, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d JOIN w USING (r) LEFT JOIN repeated USING (r) LEFT JOIN per_doc USING (r)
), base AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
), bins AS (
  SELECT r, lang, source, base_failed, unnest([
    {m: 'symbol_share', bin: least(CAST(floor(n_symbols / CAST(word_chars AS DOUBLE) / 0.002::DOUBLE) AS BIGINT), 500)},
    {m: 'dup_line_share', bin: least(CAST(floor(n_dup_lines / CAST(n_lines AS DOUBLE) / 0.002::DOUBLE) AS BIGINT), 500)},
    {m: 'repeat_share', bin: least(CAST(floor(n_repeat_words / CAST(n_words AS DOUBLE) / 0.002::DOUBLE) AS BIGINT), 500)},
    {m: 'long_words', bin: least(CAST(floor(word_chars / CAST(n_words AS DOUBLE) / 0.02::DOUBLE) AS BIGINT), 5000)},
    {m: 'short_words', bin: least(CAST(floor(word_chars / CAST(n_words AS DOUBLE) / 0.02::DOUBLE) AS BIGINT), 5000)}
  ], recursive := true) FROM base WHERE n_words > 0
), sketch AS (
  SELECT lang, source, m, bin, count(*) AS n FROM bins WHERE NOT base_failed GROUP BY ALL
), levels AS (
  SELECT *, sum(n) OVER own AS upto, sum(n) OVER (PARTITION BY level, lang, source, m) AS total
  FROM (
    SELECT 0 AS level, lang, source, m, bin, sum(n) AS n FROM sketch GROUP BY ALL
    UNION ALL SELECT 1, lang, NULL, m, bin, sum(n) FROM sketch GROUP BY ALL
    UNION ALL SELECT 2, NULL, NULL, m, bin, sum(n) FROM sketch GROUP BY ALL
  ) WINDOW own AS (PARTITION BY level, lang, source, m ORDER BY bin)
), points AS (
  SELECT level, lang, source, m, max(total) AS rows, min(bin) FILTER (upto * 100 >= total * 25) AS q25,
    min(bin) FILTER (upto * 100 >= total * 50) AS q50, min(bin) FILTER (upto * 100 >= total * 75) AS q75,
    min(bin) FILTER (upto * 100 >= total * 99) AS q99
  FROM levels GROUP BY ALL
), used AS (
  SELECT a.lang, a.source, a.m, CASE WHEN a.rows >= 30 THEN a WHEN b.rows >= 30 THEN b ELSE c END AS q
  FROM points a
  JOIN points b ON b.level = 1 AND b.m = a.m AND b.lang IS NOT DISTINCT FROM a.lang
  JOIN points c ON c.level = 2 AND c.m = a.m
  WHERE a.level = 0
), bounds AS (
  SELECT lang, source, m, CASE m
    WHEN 'symbol_share' THEN q.q75 + greatest(6 * abs(q.q75 - q.q50), 2)
    WHEN 'dup_line_share' THEN q.q99 + greatest(abs(q.q99 - q.q50), 2)
    WHEN 'repeat_share' THEN q.q99 + greatest(abs(q.q99 - q.q50), 2)
    WHEN 'long_words' THEN q.q75 + greatest(10 * abs(q.q75 - q.q50), 2)
    ELSE q.q25 - greatest(8 * abs(q.q25 - q.q50), 2) END AS bound
  FROM used
), failures AS (
  SELECT b.r, string_agg(b.m, ',' ORDER BY list_position(
    ['symbol_share', 'dup_line_share', 'repeat_share', 'long_words', 'short_words'], b.m)) AS failed
  FROM bins b JOIN bounds t ON t.m = b.m AND t.lang IS NOT DISTINCT FROM b.lang AND t.source IS NOT DISTINCT FROM b.source
  WHERE CASE WHEN b.m = 'short_words' THEN b.bin < bound ELSE b.bin > bound END GROUP BY b.r
), judged AS (
  SELECT *, coalesce(failed, '') AS failures FROM base LEFT JOIN failures USING (r)
)
SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
  failures AS failed, NOT base_failed AND failures = '' AS kept
FROM judged
"""

ORACLES["op6_topk"] = """
WITH w AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM w q JOIN w c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""

# Texts in hexadecimal, two digits a byte, cut in overlapping parts so that windows are
# taken from short strings.
ORACLES["op9_suffix_dedup"] = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k,
    hex(encode(coalesce(text, ''))) AS h
  FROM documents
), parts AS (
  SELECT r, k, 512 * p AS first, substr(h, 1024 * p + 1, 1122) AS part
  FROM (SELECT r, k, h, unnest(range(0, length(h) // 1024 + 1)) AS p FROM d)
), windows AS (
  SELECT r, k, first + i AS pos, substr(part, 2 * i + 1, 100) AS name
  FROM (SELECT r, k, first, part, unnest(range(0, least(512, length(part) // 2 - 49))) AS i FROM parts WHERE length(part) >= 100)
), repeated AS (
  SELECT r, pos FROM windows QUALIFY min(k) OVER (PARTITION BY name) < k
), marked AS (
  SELECT r, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY r ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS new FROM repeated
), numbered AS (
  SELECT r, pos, sum(new) OVER (PARTITION BY r ORDER BY pos) AS run FROM marked
), spans AS (
  SELECT r, run, min(pos) AS a, max(pos) + 50 AS b FROM numbered GROUP BY r, run
), gaps AS (
  SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS since FROM spans
), per_doc AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last_end,
    string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept
  FROM gaps JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last_end, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN per_doc USING (r)
"""

ORACLES["op11_hard_negatives"] = """
WITH w AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM w a JOIN w c ON a.vec_id <> c.vec_id
  WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank",
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY "rank" <= 10
"""

# Every contiguous run of one to five words of a piece; whole numbers of 128 bits.
ORACLES["op13_collocations"] = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM d
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM places, (VALUES (1), (2), (3), (4), (5)) AS s(size) WHERE i + size - 1 <= len(w)
), f AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), n AS (
  SELECT lang, count(*) AS n FROM places GROUP BY lang
), cuts AS (
  SELECT lang, phrase, f AS a, size, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f WHERE size >= 2
), scores AS (
  SELECT c.lang, c.phrase, c.a, c.size, c.k, x.f AS l, y.f AS r, n.n,
    (1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN n USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ')
), lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT DISTINCT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, a
  FROM (SELECT lang, a, size, string_split(phrase, ' ') AS w, unnest(range(1, size + 1)) AS i FROM (SELECT lang, phrase, size, f AS a FROM f WHERE size >= 2)),
    (VALUES (2), (3), (4)) AS t(s)
  WHERE s < size AND i + s - 1 <= size
), whole AS (
  SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL
), kept AS (
  SELECT c.* FROM lowest c LEFT JOIN whole o USING (lang, phrase) WHERE o.most IS NULL OR o.most < c.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS "rank",
  phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY "rank" <= 2000
"""


def oracles() -> dict[str, str]:
    return dict(ORACLES)
