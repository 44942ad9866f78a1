"""Query op13_spelling_variants and its SQL."""

from tessera.llm.common import settled, table
from tessera.llm.variants import damaged_words, spelling_variants


def op13_spelling_variants(spark, sf_dir):
    return settled(spark, "variants", lambda: spelling_variants(damaged_words(table(spark, sf_dir, "documents"))))


SQL = """
WITH RECURSIVE tab0 AS (
  SELECT i, 0 AS k, i::UBIGINT AS c FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END FROM tab0 WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY i) AS t FROM tab0 WHERE k = 8
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]{7,}')) AS run FROM documents
), counted AS (
  SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS named, count(*) AS k FROM runs GROUP BY ALL
), bytes AS (
  SELECT run, k, hex(encode(named)) AS x, strlen(named) AS size FROM counted
), hashed AS (
  SELECT run, k, xor(4294967295::UBIGINT, list_reduce(
    list_transform(range(size), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT),
    lambda a, b: xor(a >> 8, t[((xor(a, b) & 255) + 1)::BIGINT]), 4294967295::UBIGINT))::BIGINT AS h
  FROM bytes, tab
), w AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), del AS (
  SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS key FROM (SELECT word, n, unnest(range(length(word))) AS p FROM w)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM del a JOIN del b ON a.key = b.key AND a.p = b.p AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM del d JOIN w ON d.key = w.word
  UNION SELECT w.word, d.word, d.n FROM del d JOIN w ON d.key = w.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS reached, 0 AS k FROM f
  UNION ALL
  SELECT walk.word, f.form, k + 1 FROM walk JOIN f ON walk.reached = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(reached, k) AS root FROM walk GROUP BY word) r USING (word)
"""

QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLE = {"op13_spelling_variants": SQL}
