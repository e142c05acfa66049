"""DuckDB SQL that gives the rows of a query, where SQL can express its operator."""

WORD = r"[^\x20\x09-\x0D]+"

OP6 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * pair.n >= 85 * (x.n + y.n - pair.n)
), way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, way.b FROM reach JOIN way ON reach.b = way.a
)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) r ON r.a = d.doc_id
"""

OP7 = f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), place AS (
  SELECT r, w, unnest(CASE WHEN len(w) < 5 THEN [] ELSE range(1, len(w) - 3) END) AS i FROM doc
), win AS (SELECT r, i, count(*) OVER (PARTITION BY r, list_slice(w, i, i + 4)) AS n FROM place
), rep AS (
  SELECT r, count(DISTINCT i + j) AS n FROM win, (SELECT unnest(range(0, 5)) AS j) WHERE win.n > 1 GROUP BY 1
), base AS (
  SELECT doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM doc LEFT JOIN rep USING (r)
), failed AS (
  SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR n_dup_lines * 10 > len(lines) * 3
    OR length(regexp_replace(t, '[^A-Z]', '', 'g')) > length(regexp_replace(t, '[^a-z]', '', 'g')) OR NOT regexp_matches(t, '\\p{{L}}')) AS kept
FROM failed
"""

OP9 = """
WITH pair AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.embedding, c.embedding),
    lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM pair)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op11(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every part against every entry, in whole numbers, round after round."""
    nearest = """SELECT r.vec_id, r.part, r.x, min(struct_pack(d := list_sum(list_transform(list_zip(r.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry := b.entry)) AS best
  FROM part r JOIN book{} b USING (part) GROUP BY ALL"""
    step = """near{0} AS MATERIALIZED ({1}
), book{2} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{0} b LEFT JOIN (
    SELECT part, entry, list(floor(total / n)::BIGINT ORDER BY place) AS x FROM (
      SELECT part, best.entry AS entry, place, sum(x[place]) AS total, count(*) AS n FROM near{0}, (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM part)))) AS places(place) GROUP BY ALL
    ) GROUP BY ALL
  ) m USING (part, entry)
), """
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), part AS MATERIALIZED (
  SELECT vec_id, p AS part, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, (SELECT unnest(range(0, {parts})) AS p)
), book0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM part QUALIFY entry < {entries}
), {"".join(step.format(i, nearest.format(i), i + 1) for i in range(rounds))}coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM ({nearest.format(rounds)}) GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP12 = f"""
WITH item AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all({LOWER}, '{LETTERS}') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
), doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{LETTERS}') AS w FROM documents
), place AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win))
), found AS (SELECT r, k, i, item_id FROM place JOIN win USING (k, s)
), hit AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest(range(0, k)) AS j FROM found) GROUP BY r
), named AS (SELECT r, count(DISTINCT item_id) AS n, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS s FROM found GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, coalesce(named.s, sha256('')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

OP13 = f"""
WITH crc AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(b, range(0, 8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(0, 256)) AS b)
), word AS (
  SELECT *, row_number() OVER () AS r FROM (
    SELECT TRUE AS of_documents, doc_id, regexp_extract_all({LOWER}, '{LETTERS}') AS w FROM documents
    UNION ALL SELECT FALSE, item_id, regexp_extract_all({LOWER}, '{LETTERS}') FROM benchmark)
), feature AS MATERIALIZED (
  SELECT r, of_documents, s, count(*) AS n FROM (SELECT r, of_documents, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM word) GROUP BY ALL
), bucket AS MATERIALIZED (
  SELECT s, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: 16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT s, hex(encode(s)) AS h FROM (SELECT DISTINCT s FROM feature)), crc
), held AS (
  SELECT b, coalesce(sum(n) FILTER (of_documents), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT of_documents), 0)::DOUBLE AS t FROM feature JOIN bucket USING (s) GROUP BY b
), gain AS (
  SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM held) + 10000) / ((s + 1) * ((SELECT sum(t) FROM held) + 10000))))::BIGINT AS g FROM held
), mean AS (SELECT r, floor(sum(n * g) / sum(n))::BIGINT AS weight FROM feature JOIN bucket USING (s) JOIN gain USING (b) GROUP BY r
), hashed AS (
  SELECT r, list_reduce(list_transform(string_split(sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8], ''), lambda c: (instr('0123456789abcdef', c) - 1)::BIGINT), lambda a, c: 16 * a + c) AS h FROM word
), scored AS (
  SELECT r, doc_id, len(w) AS words, greatest(0, 2 * len(w) - 1) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score
  FROM word JOIN hashed USING (r) LEFT JOIN mean USING (r) WHERE of_documents
), placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, weight DESC, n_features) AS place, count(*) OVER () AS n FROM scored WHERE words >= 20
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)
"""
