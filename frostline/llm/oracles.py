"""DuckDB statements for the queries that SQL expresses."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _ascii_lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_UPPER.lower()}')"


OP9 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array({_ascii_lower("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array({_ascii_lower("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), lengths AS (SELECT DISTINCT least(13, len(w)) AS n FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), grams AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), found AS (SELECT g.r, g.n, g.i, w.item_id FROM grams g JOIN windows w ON g.n = w.n AND g.t = w.t),
hit AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r
), held AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM found GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
"""

OP10 = f"""
WITH lines AS (
  SELECT r, doc_id, i, line, {_ascii_lower(f"trim(line, {_SPACE})")} AS key
  FROM (
    SELECT r, doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line
    FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
  )
), held AS (
  SELECT key, count(DISTINCT r) AS n, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key
), judged AS (
  SELECT r, l.doc_id, i, line, coalesce(n >= 3 AND l.doc_id IS DISTINCT FROM last, false) AS gone
  FROM lines l LEFT JOIN held USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""

OP7 = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM conversations
), said AS (
  SELECT conv_id, n, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS chat,
    coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-') AS exact
  FROM t
), prefixes AS (
  SELECT conv_id, n, max(n) OVER (PARTITION BY conv_id) AS last,
    string_agg(exact, ',') OVER (PARTITION BY conv_id ORDER BY n) AS prefix,
    string_agg(chat, '') OVER (PARTITION BY conv_id ORDER BY n) AS chat
  FROM said
), whole AS (
  SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS copies, any_value(chat) AS chat
  FROM prefixes WHERE n = last GROUP BY prefix, n
)
SELECT conv_id, n AS n_turns, copies, chat FROM whole
WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.n < p.last AND p.prefix = whole.prefix)
"""

# The byte table of CRC-32 by its rule, then each different word's bytes folded into it.
OP11 = rf"""
WITH words AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({_ascii_lower("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), NULL, list_filter(regexp_split_to_array({_ascii_lower("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')
  FROM benchmark
), counted AS (
  SELECT side, r, w, count(*) AS n FROM (SELECT side, r, unnest(w) AS w FROM words) GROUP BY ALL
), bytes AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1))) ORDER BY b) AS crc
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)
), hashed AS (
  SELECT w, xor(list_reduce([4294967295] || list_transform(range(1, length(x) // 2 + 1), lambda i: CAST('0x' || x[2 * i - 1 : 2 * i] AS BIGINT)),
    lambda a, z: xor(a >> 8, crc[(xor(a, z) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM counted)), bytes
), features AS (SELECT side, r, bucket, sum(n) AS n FROM counted JOIN hashed USING (w) GROUP BY ALL),
corpus AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM features GROUP BY bucket
), sums AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM corpus),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM corpus, sums
), weights AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM features JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM (FROM words WHERE side = 'd') LEFT JOIN weights USING (r)
), noisy AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS n
  FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""


def _clusters(k: int, rounds: int, width: int) -> str:
    """Assignment and floored means, a pair of statements for each round."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, q) - 1 AS c, q FROM v
  ORDER BY sha256('2:' || vec_id) NULLS LAST, q LIMIT {k}
)""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, q, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.r, v.vec_id, v.q, m.c, CAST(list_sum(list_transform(list_zip(v.q, m.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM v, c{i} m) GROUP BY ALL
)""".replace("GROUP BY ALL", "GROUP BY r, vec_id, q"))
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS q FROM (
    SELECT c, j, sum(q[j]) AS s, count(*) AS n FROM a{i}, range(1, {width + 1}) t(j) GROUP BY c, j) GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} USING (c))""")
    return f"""WITH {', '.join(steps)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m USING (c)"""


OP13 = _clusters(40, 5, 64)

ORACLES = {
    "op7_snapshot_collapse": OP7,
    "op9_winnowing": OP9,
    "op10_perfect_hash_lines": OP10,
    "op11_bitsliced_resampling": OP11,
    "op13_simplex_clusters": OP13,
}
