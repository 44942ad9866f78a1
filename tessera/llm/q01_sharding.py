"""Query op1_jump_sharding and its SQL."""

from tessera.llm.common import table
from tessera.llm.sharding import shard_rows


def op1_jump_sharding(spark, sf_dir):
    return shard_rows(table(spark, sf_dir, "documents"), 40)


SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents
), b AS (
  SELECT rid, doc_id, strlen(body) + 16 AS size, hex(encode(body)) AS h FROM d
), tab0 AS (
  SELECT i, 0 AS k, i::UBIGINT AS c FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END FROM tab0 WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY i) AS t FROM tab0 WHERE k = 8
), c AS (
  SELECT rid, doc_id, size, xor(4294967295::UBIGINT, list_reduce(
    list_transform(range(size - 16), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT),
    lambda a, x: xor(a >> 8, t[((xor(a, x) & 255) + 1)::BIGINT]), 4294967295::UBIGINT)) AS crc
  FROM b, tab
), s(rid, n, cur, nxt, k) AS (
  SELECT rid, n, 0::BIGINT, 0::BIGINT, (CASE WHEN doc_id IS NULL THEN 0 WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id END)::HUGEINT
  FROM d, (VALUES (40), (41)) v(n)
  UNION ALL
  SELECT rid, n, nxt, floor((nxt + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592)::DOUBLE + 1.0::DOUBLE)))::BIGINT, k2
  FROM (SELECT rid, n, nxt, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM s WHERE nxt < n)
), j AS (
  SELECT rid, max(cur) FILTER (n = 40) AS shard, max(cur) FILTER (n = 41) AS grown FROM s GROUP BY rid
), m AS (
  SELECT c.doc_id, c.size, c.crc::BIGINT AS crc, j.shard, j.grown,
    xor((((CASE WHEN doc_id IS NULL THEN 0 WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id END)::HUGEINT
      * 2862933555777941757 + 1) % 18446744073709551616 // 4294967296)::BIGINT, c.crc::BIGINT) AS mix
  FROM c JOIN j USING (rid)
)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY mix, doc_id NULLS FIRST, crc, size) - 1)::BIGINT AS slot, grown::INTEGER AS grown_shard
FROM m
"""

QUERIES = {"op1_jump_sharding": op1_jump_sharding}
ORACLE = {"op1_jump_sharding": SQL}
