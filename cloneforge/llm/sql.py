"""Queries of this subpackage in SQL, by brute force or nearly so, for tables of a few thousand documents."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


#: CRC-32 of `hex`, byte by byte, by its 256 `steps`.
CRC = """CAST(xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST(('0x' || substr(hex, 2 * j - 1, 2)) AS BIGINT) FOR j IN range(1, length(hex) // 2 + 1)]),
  lambda acc, b: xor(acc >> 8, steps[(xor(acc, b) & 255) + 1]))) AS BIGINT)"""

#: The 256 steps of CRC-32, from its polynomial.
CRCS = """crcs AS (SELECT k, list_reduce(list_concat([CAST(k AS BIGINT)], [CAST(0 AS BIGINT) FOR j IN range(8)]),
  lambda acc, b: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END) AS c FROM range(256) t(k))"""

SHARDING = f"""WITH {CRCS},
docs AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS hex FROM documents),
slim AS (SELECT doc_id, size, {CRC} AS text_crc32 FROM docs, (SELECT list(c ORDER BY k) AS steps FROM crcs)),
draws AS (SELECT *, md5(k || '|' || doc_id) AS h, k FROM slim, range(17) t(k)),
placed AS (SELECT doc_id, size, text_crc32, arg_max(k, left(h, 13)) FILTER (k < 16) AS shard, arg_max(k, left(h, 13)) AS grown_shard FROM draws GROUP BY ALL),
cut AS (SELECT *, CAST(('0x' || left(md5('slot|' || doc_id || '|' || text_crc32 || '|' || size), 8)) AS BIGINT) % greatest(16, CAST(ceil((SELECT count(*) FROM slim) / 50000) AS BIGINT)) AS bucket FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM cut"""

REPEATS = """WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hex FROM documents),
starts AS (SELECT doc_id, j, hash(substr(hex, 2 * j + 1, 100)) AS w FROM docs, UNNEST(range(0, greatest(0, length(hex) // 2 - 49))) t(j)),
firsts AS (SELECT w, min(doc_id) AS first FROM starts GROUP BY w),
hit AS (SELECT doc_id, j FROM starts JOIN firsts USING (w) WHERE doc_id > first),
begun AS (SELECT *, CASE WHEN j <= lag(j) OVER (PARTITION BY doc_id ORDER BY j) + 50 THEN 0 ELSE 1 END AS new FROM hit),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY j) AS run FROM begun),
spans AS (SELECT doc_id, run, min(j) AS a, max(j) + 50 AS b FROM runs GROUP BY doc_id, run),
ends AS (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, length(hex) // 2, length(hex) // 2 FROM docs),
gaps AS (SELECT doc_id, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, a AS hi FROM ends),
kept AS (SELECT doc_id, string_agg(substr(hex, CAST(2 * lo + 1 AS BIGINT), CAST(2 * greatest(0, hi - lo) AS BIGINT)), '' ORDER BY lo, hi) AS hex FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(length(docs.hex) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.hex)) AS kept_sha256
FROM docs JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""


def sets(width: int) -> str:
    """Of `own` (id, w: words) the tokens of each set, with its size, and pairs that are alike to 0.8: these share one of their rarest tokens, of which each has n - ceil(0.8 n) + 1."""
    return f"""toks AS (SELECT DISTINCT id, CASE WHEN len(w) < {width} THEN array_to_string(w, ' ') || ' (' || len(w) || ')' ELSE array_to_string(w[i:i + {width - 1}], ' ') END AS tok
  FROM own, UNNEST(range(1, greatest(1, len(w) - {width - 1}) + 1)) t(i) WHERE len(w) > 0),
sized AS (SELECT id, count(*) AS n FROM toks GROUP BY id),
rare AS (SELECT tok, count(*) AS f FROM toks GROUP BY tok),
placed AS (SELECT id, tok, n, row_number() OVER (PARTITION BY id ORDER BY f, tok) AS pos FROM toks JOIN sized USING (id) JOIN rare USING (tok)),
prefix AS (SELECT id, tok, n FROM placed WHERE pos <= n - (80 * n + 99) // 100 + 1),
maybe AS (SELECT DISTINCT x.id AS a, y.id AS b, x.n AS na, y.n AS nb FROM prefix x JOIN prefix y ON x.tok = y.tok AND x.id < y.id WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
links AS (SELECT a, b FROM maybe JOIN toks x ON x.id = a JOIN toks y ON y.id = b AND y.tok = x.tok GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*)))"""


MINHASH = rf"""WITH RECURSIVE own AS (SELECT doc_id AS id, regexp_extract_all({lowered("text")}, '[^ \t-\r]+') AS w FROM documents),
{sets(2)},
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
least_of AS (SELECT id, id AS m FROM own UNION SELECT b, m FROM least_of JOIN sides ON a = id WHERE m < b)
SELECT own.id AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(m) AS component_id, own.id = min(m) AS kept
FROM own JOIN least_of ON least_of.id = own.id LEFT JOIN sized ON sized.id = own.id GROUP BY own.id"""

LINES = rf"""WITH split AS (SELECT doc_id, place, string_split(text, chr(10))[place] AS line FROM documents, UNNEST(range(1, len(string_split(text, chr(10))) + 1)) t(place) WHERE text IS NOT NULL),
own AS (SELECT row_number() OVER (ORDER BY doc_id, place) AS id, doc_id, place, line, regexp_extract_all({lowered("line")}, '[^ \t-\r]+') AS w FROM split),
{sets(5)},
gone AS (SELECT DISTINCT b AS id FROM links),
per AS (SELECT doc_id, count(*) AS n_lines, count(gone.id) AS n_removed, string_agg(line, chr(10) ORDER BY place) FILTER (gone.id IS NULL) AS kept FROM own LEFT JOIN gone USING (id) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN per USING (doc_id)"""

DECONTAMINATION = rf"""WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({lowered("text")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(10, len(w)) AS s, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win FROM items, UNNEST(range(1, len(w) - least(10, len(w)) + 2)) t(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, regexp_extract_all({lowered("text")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
sizes AS (SELECT DISTINCT s FROM windows),
places AS (SELECT doc_id, i, s, array_to_string(w[i:i + s - 1], ' ') AS win FROM docs, sizes, UNNEST(range(1, greatest(0, len(w) - s + 1) + 1)) t(i)),
hits AS (SELECT doc_id, i, s, item FROM places JOIN windows USING (s, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, UNNEST(range(i, i + s)) t(p) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN met USING (doc_id)"""

def nearest(k: int) -> str:
    """Vectors' nearest centroids of table m<k>, as a<k>."""
    d = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))"
    return f"a{k} AS (SELECT rid, arg_min(c, {d} * 100 + c) AS c, min({d}) AS d FROM own, m{k} GROUP BY rid)"


def means(k: int) -> str:
    """Centroids m<k + 1>: floors of the means of what is nearest to those of m<k>."""
    floor = "CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END"
    return f"""s{k} AS (SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{k} JOIN own USING (rid), range(1, 65) t(i) GROUP BY c, i),
f{k} AS (SELECT c, list({floor} ORDER BY i) AS f FROM s{k} GROUP BY c),
m{k + 1} AS (SELECT c, coalesce(f, m) AS m FROM m{k} LEFT JOIN f{k} USING (c))"""


BALLS = f"""WITH own AS (SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v AS m FROM own QUALIFY c < 16),
{nearest(0)}, {means(0)}, {nearest(1)}, {means(1)}, {nearest(2)}, {means(2)}, {nearest(3)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a3 JOIN own USING (rid) JOIN m3 USING (c)"""

ORACLES = {"op1_sharding": SHARDING, "op3_suffix_array": REPEATS, "op6_minhash": MINHASH, "op7_decontamination": DECONTAMINATION, "op9_lines": LINES, "op11_balls": BALLS}
