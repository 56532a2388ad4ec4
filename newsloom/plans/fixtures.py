"""Inputs of the registered queries, derived from the given tables.

Each recipe is one SELECT that means the same in Spark SQL and in ANSI engines,
so a query and its check start from the same rows. Recipes may use other
recipes; ``cte`` puts them in order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "pages", "events", "labels")
AS_OF = "2024-01-02 00:00:00+00:00"

RECIPES: dict[str, str] = {
    # Candidate links of all rule outcomes.
    "candidates_fx": """
SELECT doc_id, 'https://' || source || '.example.com' AS media_url,
  CASE doc_id % 8
    WHEN 0 THEN 'https://' || source || '.example.com'
    WHEN 1 THEN 'https://' || source || '.example.com/' || lang || '/report-' || CAST(doc_id AS STRING) || '.pdf'
    WHEN 2 THEN 'https://' || source || '.example.com/opinion/a-b-c-d-' || CAST(doc_id AS STRING)
    WHEN 3 THEN 'https://' || source || '.example.com/only-one-long-slug-' || CAST(doc_id AS STRING)
    WHEN 4 THEN 'https://' || source || '.example.com/' || lang || '/short-' || CAST(doc_id AS STRING)
    WHEN 5 THEN 'https://elsewhere.example.org/' || lang || '/a-b-c-d-' || CAST(doc_id AS STRING)
    ELSE 'https://' || source || '.example.com/' || lang || '/a-b-c-d-' || CAST(doc_id % 300 AS STRING)
  END AS url,
  CAST(n_chars % 50 AS DOUBLE) AS score
FROM documents""",
    # Candidates that were rejected before: those of documents labelled toxic.
    "garbage_fx": """
SELECT DISTINCT c.url, c.media_url, '3_2' AS status_code
FROM candidates_fx c JOIN labels l ON c.doc_id = l.doc_id WHERE l.toxic = 1""",
    # Urls that are stored: articles of documents labelled good.
    "known_urls_fx": """
SELECT DISTINCT 'https://' || source || '.example.com/' || lang || '/a-b-c-d-' || CAST(d.doc_id % 300 AS STRING) AS url,
  'https://' || source || '.example.com' AS media_url
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 AND l.toxic = 0""",
    # Stored news of all release states.
    "news_fx": """
SELECT 'https://' || source || '.example.com/' || lang || '/' || CAST(doc_id AS STRING) AS url,
  'https://' || source || '.example.com' AS media_url,
  TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 200) * INTERVAL '1' MINUTE AS created_at,
  TIMESTAMP '2024-01-02 00:00:00' AS inserted_at,
  CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' END AS processed_at,
  'Title ' || CAST(doc_id AS STRING) AS title,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'desc ' || CAST(doc_id % 60 AS STRING) END AS description,
  text AS article_body,
  CASE doc_id % 4 WHEN 0 THEN 'Política' WHEN 1 THEN 'deportes,futbol' WHEN 2 THEN 'ECONOMIA' ELSE '' END AS main_topic,
  '' AS image_url, lang AS country, -1 AS n_tokens,
  CAST(n_chars % 50 AS DOUBLE) AS score,
  doc_id % 5 = 0 AS preprocessed
FROM documents""",
    # Section links with topics in singular, plural and rare forms.
    "sections_fx": """
SELECT 'https://www.' || source || '.example.com/' || topic || '/' AS url, topic,
  'www.' || source || '.example.com' AS domain
FROM (SELECT source, CASE doc_id % 9
    WHEN 0 THEN 'deportes' WHEN 1 THEN 'deporte' WHEN 2 THEN 'economia'
    WHEN 3 THEN 'economias' WHEN 4 THEN 'cultura' WHEN 5 THEN 'motor'
    WHEN 6 THEN 'mundo' WHEN 7 THEN 'moda' ELSE 'x' || CAST(doc_id AS STRING) END AS topic
  FROM documents) d""",
    # Media ranking: some sources are not ranked, one ranked domain has no sections.
    "ranking_fx": """
SELECT DISTINCT source AS media, source || '.example.com' AS domain, 'Spain' AS country,
  CASE WHEN length(source) = 4 THEN 'Western Europe' ELSE 'Southern Europe' END AS region,
  'Spanish' AS language,
  CAST(1 + length(source) * 10 + ascii(substr(source, length(source), 1)) % 10 AS DOUBLE) AS overall
FROM documents WHERE source NOT LIKE '%7'
UNION ALL
SELECT 'ghost', 'ghost.example.com', 'Spain', 'Western Europe', 'Spanish', 50.0""",
    # Outcomes of ingest runs with their time.
    "ingest_events_fx": """
SELECT event_id, ts, event_type AS media_url,
  CASE event_id % 6 WHEN 0 THEN 'link' WHEN 1 THEN 'known' WHEN 2 THEN 'stored' ELSE 'page' END AS stage,
  CASE WHEN event_id % 6 = 0 THEN '3_2' WHEN event_id % 6 < 3 THEN NULL
    WHEN user_id % 3 = 0 THEN '0' WHEN user_id % 3 = 1 THEN '5_6' ELSE '5_8' END AS status_code
FROM events""",
    # A ranking with a media per document, many of equal rank.
    "media_ranking_fx": """
SELECT 'm' || CAST(doc_id AS STRING) AS media, 'm' || CAST(doc_id AS STRING) || '.' || source || '.example.com' AS domain,
  CAST(1 + n_chars % 40 AS DOUBLE) AS overall
FROM documents""",
    # The ranking as it comes: capital names, spaces around, a rank column.
    "raw_ranking_fx": """
SELECT '  ' || media || ' ' AS Media, domain || '  ' AS Domain, country AS Country, region AS Region,
  language AS Language, overall AS Overall, CAST(overall * 2 AS BIGINT) AS Global_rank
FROM ranking_fx""",
    # Special media lists.
    "special_media_fx": """
SELECT DISTINCT ' ' || lang || '-' || source || ' ' AS Media, lang || '.' || source || '.example.com ' AS Domain
FROM documents""",
    # name;domain;score lines, some with two domains.
    "ranking_text_fx": """
SELECT DISTINCT source AS media,
  CASE WHEN length(source) = 4 THEN source || '.example.com|www.' || source || '.example.com'
       ELSE source || '.example.com' END AS domain,
  CAST(length(source) AS DOUBLE) AS score
FROM documents""",
    # Names of versioned files.
    "files_fx": """
SELECT CASE doc_id % 3 WHEN 0 THEN 'source_urls_v' || CAST(doc_id AS STRING) || '.json'
    WHEN 1 THEN 'ranking_Spanish_' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') ||
      lpad(CAST(1 + n_chars % 12 AS STRING), 2, '0') || CAST(2000 + doc_id % 25 AS STRING) || '.csv'
    ELSE 'notes ' || source || '.txt' END AS name
FROM documents""",
    # Fetched article pages: one slot per gate, the rest are articles.
    "article_pages_fx": """
SELECT doc_id AS page_id,
  'https://' || source || '.example.com/' || lang || '/a-b-c-d-' || CAST(doc_id AS STRING) AS url,
  'https://' || source || '.example.com' AS media_url,
  CAST(n_chars % 50 AS DOUBLE) AS score,
  CASE doc_id % 40 WHEN 17 THEN 'too_many_redirects' WHEN 27 THEN 'unicode_error' WHEN 37 THEN 'timeout' END AS fetch_error,
  CASE WHEN doc_id % 40 = 30 THEN '<div>' WHEN doc_id % 40 = 20 THEN '<html lang="' || lang || '">' ELSE
  '<html lang="' || lang || '"><head>' END
  || CASE WHEN doc_id % 10 = 0 THEN '' ELSE '<meta property="og:type" content="article">' END
  || CASE WHEN doc_id % 10 = 5 THEN '' ELSE '<meta property="og:title" content="Title ' || CAST(doc_id AS STRING) || '">' END
  || CASE doc_id % 10 WHEN 1 THEN ''
       WHEN 2 THEN '<meta property="article:published_time" content="">'
       WHEN 3 THEN '<meta property="article:published_time" content="2023-12-01T00:00:00+01:00">'
       WHEN 4 THEN '<meta property="article:published_time" content="2024-01-01T12:00:00">'
       ELSE '<meta property="article:published_time" content="2024-01-01T12:00:00+01:00">' END
  || '<meta name="keywords" content="Uno, Dos Tres"><meta property="article:section" content="Deportes">'
  || '<meta name="description" content="About ' || source || '"><meta property="og:image" content="https://img.example.com/' || CAST(doc_id AS STRING) || '.jpg">'
  || CASE WHEN doc_id % 3 = 0 THEN '<meta property="article:modified_time" content="2024-01-01T18:00:00+01:00">' ELSE '' END
  || CASE WHEN doc_id % 10 >= 8 THEN '<script type="application/ld+json">{"publisher":{"name":"P"},"@type":"NewsArticle","headline":"H ' || CAST(doc_id AS STRING)
    || '","description":"LD ' || source || '","datePublished":"2024-01-01","dateModified":"2024-01-02","main":'
    || repeat('{"n":', CAST(doc_id % 13 AS INT)) || '{"articleBody":"b<i>ody</i> ' || CAST(doc_id AS STRING) || '"}' || repeat('}', CAST(doc_id % 13 AS INT))
    || ',"keywords":["A b","C"],"articleSection":"Local"}</script>' ELSE '' END
  || '</head><body><a href="/x/">x</a>'
  || CASE WHEN doc_id % 10 = 6 THEN '' ELSE '<p>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</p><p>para' || CAST(doc_id AS STRING) || ' 1 < 2 &middot; caf&eacute; &#8364;&#146;</p>' END
  || '</body></html>' AS html
FROM documents""",
    # Home pages whose anchors show their host.
    "media_pages_fx": """
SELECT page_id, url, '<html><body><a href="' || url || '">' || split_part(url, '/', 3) || '</a><a href="/a.php">read more</a></body></html>' AS html
FROM pages""",
    # Region hrefs.
    "region_hrefs_fx": """
SELECT CASE doc_id % 4 WHEN 0 THEN '/' || source || '.php' WHEN 1 THEN 'https://www.example.com/' || source || '.php'
  WHEN 2 THEN '/radio-' || source || '.php' ELSE '/' || lang || '/' END AS href
FROM documents""",
    # Section hrefs of many shapes, with the page they are on.
    "section_hrefs_fx": """
SELECT 'https://' || source || '.example.com/portada/hoy' AS page_url, source || '.example.com' AS domain,
  CASE doc_id % 11
    WHEN 0 THEN '/' || lang || '-sport' WHEN 1 THEN '//' || source || '.example.com/Cultura/'
    WHEN 2 THEN 'www.' || source || '.example.com/motor#top' WHEN 3 THEN '/opinion/'
    WHEN 4 THEN 'https://other.example.org/moda' WHEN 5 THEN '/a-b-c/' WHEN 6 THEN '/p' || CAST(1000 + doc_id AS STRING)
    WHEN 7 THEN 'https://' || source || '.example.com/' || lang WHEN 8 THEN '/aviso-legal'
    WHEN 9 THEN source || '.example.com/vela' ELSE '/x?y=' || lang END AS href
FROM documents""",
    # Sections that are the fetched pages themselves.
    "page_sections_fx": """
SELECT url, 'https://' || split_part(url, '/', 3) AS media_url, CAST(page_id % 10 AS DOUBLE) AS score FROM pages""",
    # Responses of a text service.
    "responses_fx": """
SELECT 'u' || CAST(doc_id AS STRING) AS url, text,
  CASE doc_id % 4 WHEN 0 THEN 'Tokens: ' || CAST(n_chars AS STRING) || ' Body Summary: s' || CAST(doc_id AS STRING) || ' ' || text
    WHEN 1 THEN 'Body Summary: s' || CAST(doc_id AS STRING)
    WHEN 2 THEN 'Tokens: 5 Body Summary: BodyNotFound' END AS response,
  n_chars % 9 = 0 AS failed
FROM documents""",
    # Long responses, one field per line.
    "long_responses_fx": """
SELECT 'u' || CAST(doc_id AS STRING) AS url,
  'Tokens: ' || CAST(n_chars AS STRING) || chr(10) || 'Headline: H ' || source || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Topics: ' || lang || ', news' || chr(10) END
  || 'Creation DateTime: 2024-01-01' || chr(10) || 'Update DateTime: 2024-01-0' || CAST(1 + doc_id % 9 AS STRING) || chr(10)
  || 'Body Summary:' || text AS response
FROM documents""",
    # Publication times in many spellings.
    "times_fx": """
SELECT event_id, CASE event_id % 9
    WHEN 0 THEN d || 'T' || t || '+02:00' WHEN 1 THEN d || 'T' || t || 'Z' WHEN 2 THEN d || 'T' || t || '+0200'
    WHEN 3 THEN d || 'T' || t || '.25-05:00' WHEN 4 THEN replace(d, '-', '') || 'T' || replace(t, ':', '') || '+00:00'
    WHEN 5 THEN d || 'T' || t WHEN 6 THEN d WHEN 7 THEN t ELSE d || ' ' || t || '+01' END AS published
FROM (SELECT event_id, substr(CAST(ts AS STRING), 1, 10) AS d, substr(CAST(ts AS STRING), 12, 8) AS t FROM events) e""",
    # Nested JSON objects.
    "json_fx": """
SELECT doc_id, '{"id":' || CAST(doc_id AS STRING) || ',"meta":{"lang":"' || lang || '","origin":{"name":"' || source
  || '","size":' || CAST(n_chars AS STRING) || '}},"tags":["a","b"],"ok":true,"deep":'
  || repeat('{"n":', CAST(doc_id % 13 AS INT)) || '"x"' || repeat('}', CAST(doc_id % 13 AS INT)) || '}' AS block
FROM documents""",
    # JSON blocks, some broken, some lists.
    "blocks_fx": """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"lang":"' || lang || '"}' WHEN 1 THEN '[{"lang":"' || lang || '"},{"lang":"xx"}]'
  WHEN 2 THEN '{"lang":"' || lang ELSE 'no json ' || source END AS block
FROM documents""",
    # Raw topic lists.
    "topics_fx": """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Fútbol Sala, ¿' || source || '?, Real Madrid' WHEN 1 THEN 'Two Words'
  WHEN 2 THEN '#' || lang || '(x)' ELSE source || ',' || lang || '%' END AS topics
FROM documents""",
}


def needs(name: str) -> list[str]:
    """Recipes that ``name`` uses, in the order of use, itself last."""
    order: list[str] = []

    def visit(n: str) -> None:
        for other in re.findall(r"\b(\w+_fx)\b", RECIPES[n]):
            if other != n:
                visit(other)
        if n not in order:
            order.append(n)

    visit(name)
    return order


def cte(*names: str) -> str:
    """``WITH`` clause that defines the recipes."""
    order: list[str] = []
    for name in names:
        order += [n for n in needs(name) if n not in order]
    return "WITH " + ",\n".join(f"{n} AS ({RECIPES[n].strip()})" for n in order)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Rows of a recipe over the tables of ``sf_dir``."""
    sql = f"{cte(name)} SELECT * FROM {name}"
    for t in TABLES:
        if re.search(rf"(FROM|JOIN) {t}\b", sql):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)
