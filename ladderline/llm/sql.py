"""SQL that says the same as those queries that SQL can express."""

from __future__ import annotations

from . import codes

#: CRC-32 by its table, words, near words by cutting out each letter, and forms followed to their roots.
SPELLING_VARIANTS = r"""
WITH RECURSIVE
crc_step(i, k, v) AS (SELECT i, 0, i FROM range(256) AS t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_step WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM crc_step WHERE k = 8),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(encode(key))), lambda i: CAST('0x' || substr(hex(encode(key)), 2 * i + 1, 2) AS BIGINT))), lambda acc, b: xor(acc >> 8, t[xor(acc & 255, b) + 1])), 4294967295) AS h
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key, run, n FROM runs), crc_table),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r FROM words, range(1, 1 + (SELECT max(length(word)) FROM words)) AS t(i) WHERE i <= length(word)),
pairs AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.l = b.l AND a.r = b.r WHERE a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.l || c.r
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.l || c.r),
best AS (SELECT word, count(*) AS n_near, min({'m': -m, 'o': other}) AS b FROM pairs GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.b.m >= 10 * w.n THEN b.b.o END AS form, CASE WHEN -b.b.m >= 10 * w.n THEN -b.b.m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
chain(word, tip) AS (SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.tip = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.tip AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM formed f JOIN chain c ON f.word = c.word JOIN formed e ON e.word = c.tip WHERE e.form IS NULL
"""


def vector_codes() -> str:
    """Every round as a join with its codebook, and as means by floor."""
    dot = lambda a, b: f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {codes.PARTS}) + 1 : (p + 1) * (len(v) // {codes.PARTS})] AS x FROM kept, range({codes.PARTS}) AS t(p))",
        f"book0 AS MATERIALIZED (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS BIGINT) AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {codes.ENTRIES}))",
    ]
    for r in range(codes.ROUNDS + 1):
        steps.append(f"near{r} AS MATERIALIZED (SELECT vec_id, label, p, x, min({{'d': d, 'e': e}}) AS m FROM (SELECT vec_id, label, a.p, x, e, CAST({dot('c', 'c')} - 2 * {dot('x', 'c')} + {dot('x', 'x')} AS BIGINT) AS d FROM parts a JOIN book{r} b ON a.p = b.p) GROUP BY vec_id, label, p, x)")
        if r < codes.ROUNDS:
            steps.append(f"sum{r} AS (SELECT p, m.e AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM near{r}, range(1, 1 + (SELECT max(len(x)) FROM parts)) AS t(i) GROUP BY p, m.e, i)")
            steps.append(f"mean{r} AS (SELECT p, e, list(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END ORDER BY i) AS c FROM sum{r} GROUP BY p, e)")
            steps.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.e = m.e)")
    steps.append(f"coded AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{codes.ROUNDS} GROUP BY vec_id, label)")
    digest = f"SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{codes.ROUNDS}"
    return "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, ({digest}) AS codebooks_sha256 FROM coded"
