"""Query op2_warc_archives and its SQL."""

from tessera.llm.common import settled, table
from tessera.llm.warc import read_archives, write_archives


def op2_warc_archives(spark, sf_dir):
    def records():
        found = read_archives(write_archives(table(spark, sf_dir, "pages")), payloads=False)
        return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

    return settled(spark, "warc-records", records)


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM g
"""

QUERIES = {"op2_warc_archives": op2_warc_archives}
ORACLE = {"op2_warc_archives": SQL}
