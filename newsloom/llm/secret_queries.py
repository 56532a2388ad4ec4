from pyspark.sql import functions as F

from newsloom.llm.registry import query, table
from newsloom.llm.secret_scan import FORMS, KINDS, MOST_OWNERS, MOST_REPOSITORIES, scan_secrets, span_text


def _matches(n: int, kind: str) -> str:
    pattern, group, least = FORMS[kind]
    quoted = pattern.replace("'", "''")
    mixed = " AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')"
    return f"""
  SELECT doc_id, source, lang, {n} AS kind_no, length(found) AS size, value,
    length(value) >= {least}{mixed if kind == "owned" else ""} AS good,
    sum(length(before) + length(found)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
  FROM (
    SELECT doc_id, source, lang, i, before[i] AS before, found[i] AS found, val[i] AS value FROM (
      SELECT doc_id, source, lang, unnest(range(1, len(found) + 1)) AS i, before, found, val FROM (
        SELECT doc_id, source, lang, string_split_regex(text, '{quoted}') AS before,
          regexp_extract_all(text, '{quoted}', 0) AS found, regexp_extract_all(text, '{quoted}', {group}) AS val
        FROM d)))"""


_NAMES = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
CHECK = f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_matches(n, k) for n, k in enumerate(KINDS))}),
good AS (SELECT * FROM m WHERE good),
owners AS (
  SELECT value, count(DISTINCT coalesce(source, '')) <= {MOST_OWNERS}
    AND count(DISTINCT concat_ws('/', source, lang)) <= {MOST_REPOSITORIES} AS live
  FROM good GROUP BY value
),
s AS (
  SELECT doc_id, kind_no, stop - size AS start, live,
    {_NAMES}[kind_no + 1] || ':' || (stop - size) || ':' || stop AS span
  FROM good JOIN owners USING (value) WHERE kind_no < 3 OR live
),
per AS (
  SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
    count(*) FILTER (kind_no = 2) AS n_hex, count(*) FILTER (live) AS n_live,
    string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind_no < 3) AS base,
    string_agg(span, ',' ORDER BY start, kind_no) AS spans
  FROM s GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, coalesce(n_live, 0)::BIGINT AS n_live,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""


@query("op6_ownership_frequency", CHECK)
def op6_ownership_frequency(spark, sf_dir):
    owner, repository = F.col("source").cast("string"), F.concat_ws("/", "source", "lang")
    spans = scan_secrets(table(spark, sf_dir, "documents"), owner, repository)

    def count(array: str, rule):
        return F.size(F.filter(array, rule)).cast("bigint")

    def of_kind(n: int):
        return lambda s: s["kind_no"] == n

    return spans.select(
        "doc_id", *[count("base", of_kind(n)).alias(f"n_{k}") for n, k in enumerate(KINDS[:3])],
        count("every", lambda s: s["live"]).alias("n_live"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("every")).alias("spans"),
    )
