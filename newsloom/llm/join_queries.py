from newsloom.llm.ngram_join import NGRAM_WORDS, PERCENT, jaccard_groups
from newsloom.llm.registry import query, table

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
CHECK = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {NGRAM_WORDS} - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {NGRAM_WORDS}, 0) + 2)) AS i FROM d WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c.n >= {PERCENT} * (x.n + y.n - c.n)
),
reach AS (SELECT DISTINCT a AS doc_id, a AS node FROM links UNION SELECT r.doc_id, b FROM reach r JOIN links ON a = node),
least AS (SELECT doc_id, min(node) AS smallest FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(smallest, doc_id)::BIGINT AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""


@query("op13_size_aware_join", CHECK)
def op13_size_aware_join(spark, sf_dir):
    return jaccard_groups(table(spark, sf_dir, "documents"))
