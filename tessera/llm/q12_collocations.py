"""Query op12_collocations and its SQL."""

from tessera.llm.collocations import collocations
from tessera.llm.common import settled, table


def op12_collocations(spark, sf_dir):
    return settled(spark, "collocations", lambda: collocations(table(spark, sf_dir, "documents")))


SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces
), total AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, phrase, d, count(*) AS f FROM (
    SELECT lang, d, unnest(list_transform(range(1, len(ws) - d + 2), lambda i: array_to_string(ws[i:i + d - 1], ' '))) AS phrase FROM w, range(1, 5) t(d))
  GROUP BY ALL
), cand AS (
  SELECT lang, phrase, d, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE d > 1 AND f >= 30
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:d], ' ') AS rp FROM cand, range(1, 4) t(k) WHERE k < d
), scored AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, k, 2000000::HUGEINT * c.a // (l.f + r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.lp JOIN f r ON r.lang = c.lang AND r.phrase = c.rp
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), subs AS (
  SELECT lang, a, array_to_string(ws[i:i + s - 1], ' ') AS phrase FROM cand, range(2, 4) t(s), range(1, 4) u(i) WHERE s < d AND i + s - 1 <= d
), over AS (
  SELECT lang, phrase, max(a) AS longer FROM subs GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN over o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN total USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op12_collocations": op12_collocations}
ORACLE = {"op12_collocations": SQL}
