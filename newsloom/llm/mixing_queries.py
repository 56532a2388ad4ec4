from newsloom.llm.mixing import EPOCHS, QUANTA, SEED, mix
from newsloom.llm.registry import query, table

CHECK = rf"""
WITH sized AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS shuffle,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number,
    (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight, {EPOCHS} * source_size AS most
  FROM sums
),
filled AS (
  SELECT *, most / weight AS full_at,
    (sum(most) OVER o - most)::DOUBLE AS used, sum(weight) OVER () - (sum(weight) OVER o - weight) AS rest,
    sum(source_size) OVER () AS budget
  FROM ranked WINDOW o AS (ORDER BY most / weight, number)
),
level AS (SELECT arg_min(l, full_at) AS l FROM (
  SELECT (budget - used) / rest AS l, full_at FROM filled) WHERE l <= full_at),
sources AS (SELECT r.*, least(weight * l, most::DOUBLE) AS target FROM ranked r, level),
queued AS (
  SELECT d.doc_id, d.size, s.source_size, s.number, s.weight, s.target,
    sum(d.size) OVER (PARTITION BY s.number ORDER BY shuffle, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source
),
quantum AS (SELECT greatest(1, sum(source_size)::BIGINT // ({QUANTA} * count(*))) AS q FROM sources),
offers AS (
  SELECT doc_id, number, least(j * q, size) - (j - 1) * q AS words,
    (e * source_size + upto - size + least(j * q, size))::DOUBLE / weight AS finish
  FROM (SELECT *, unnest(range(1, ((size + q - 1) // q)::BIGINT + 1)) AS j FROM queued, quantum), range({EPOCHS}) t(e)
),
taken AS (
  SELECT doc_id, sum(words) AS taken FROM (
    SELECT *, sum(words) OVER (ORDER BY finish, number ROWS UNBOUNDED PRECEDING) AS total FROM offers)
  WHERE total <= (SELECT sum(size) FROM sized) GROUP BY 1
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM queued LEFT JOIN taken USING (doc_id)
"""


@query("op10_weighted_fair_queue", CHECK)
def op10_weighted_fair_queue(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
