from newsloom.llm.registry import query, table
from newsloom.llm.zip_archives import round_trip

_SYMBOLS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, {5 * i + 1}, 5))::INT >> {shift}) & 31) + 1, 1)"
    for i in range(8) for shift in (15, 10, 5, 0)
)
CHECK = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT hex, max(page_id) AS first_id FROM p GROUP BY hex)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_SYMBOLS} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN g USING (hex)
"""


@query("op5_zip_archives", CHECK)
def op5_zip_archives(spark, sf_dir):
    records = round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
