"""Registered queries: page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import dates, html, jsonld
from newsloom.operators import articles, links
from newsloom.plans.check_sql import PAGE_HREFS, TAG, VISIBLE, decoded, decoded_article
from newsloom.plans.fixtures import AS_OF, cte, fixture, table
from newsloom.plans.registry import query

A = cte("article_pages_fx")
c = F.col


def pages(spark, sf):
    return table(spark, sf, "pages")


def article_pages(spark, sf):
    return fixture(spark, sf, "article_pages_fx")


def as_of():
    return dates.instant_literal(AS_OF)


TOKENS = f"""tokens AS (SELECT page_id, u.pos - 1 AS pos, lower(regexp_extract(u.t, '{TAG}', 1)) AS tag,
    regexp_extract(u.t, '{TAG}', 2) AS attributes, regexp_extract(u.t, '{TAG}', 3) AS text
  FROM (SELECT page_id, regexp_extract_all(regexp_replace({VISIBLE}, '<([^a-zA-Z/!?])', '&lt;\\1', 'g'), '{TAG}', 0) AS ts FROM pages) p,
    unnest(p.ts) WITH ORDINALITY AS u(t, pos))"""


@query("page_tags", f"""WITH {TOKENS}
SELECT page_id, CAST(pos AS INT) AS pos, tag, replace(array_to_string(regexp_extract_all(attributes, '[a-z]+="[^"]*"', 0), '|'), '"', '') AS attrs,
  {decoded('text')} AS text FROM tokens""")
def page_tags(spark, sf):
    attrs = F.transform(
        F.map_entries("t.attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return pages(spark, sf).select("page_id", F.explode(html.page_tags(c("html"))).alias("t")).select(
        "page_id", "t.pos", "t.tag", F.array_join(attrs, "|").alias("attrs"), "t.text")


@query("page_links", f"WITH {PAGE_HREFS} SELECT page_id, url, CAST(pos AS INT) AS pos, href FROM page_hrefs")
def page_links(spark, sf):
    return links.page_links(pages(spark, sf))


def text_check(*tags: str) -> str:
    """Text of the elements by a fold over the tags, the open ones kept as a list."""
    wanted = ", ".join(f"'{t}'" for t in tags)
    return f"""WITH {TOKENS},
per_page AS (SELECT page_id, list({{'n': tag, 't': text}} ORDER BY pos) AS ts FROM tokens GROUP BY page_id),
folded AS (SELECT page_id, list_reduce(ts, lambda s, x: {{
  'o': CASE WHEN x.n IN ('br', 'meta') THEN s.o
    WHEN NOT starts_with(x.n, '/') THEN list_concat([x.n], s.o)
    WHEN list_contains(s.o, x.n[2:]) THEN s.o[list_position(s.o, x.n[2:]) + 1:] ELSE s.o END,
  'r': s.r || CASE WHEN list_has_any(CASE WHEN x.n IN ('br', 'meta') THEN s.o
    WHEN NOT starts_with(x.n, '/') THEN list_concat([x.n], s.o)
    WHEN list_contains(s.o, x.n[2:]) THEN s.o[list_position(s.o, x.n[2:]) + 1:] ELSE s.o END, [{wanted}]) THEN x.t ELSE '' END
  }}, {{'o': CAST([] AS VARCHAR[]), 'r': ''}}).r AS body FROM per_page)
SELECT p.page_id, coalesce(regexp_replace({decoded('f.body')}, '\\n+', chr(10), 'g'), '') AS body
FROM pages p LEFT JOIN folded f ON p.page_id = f.page_id"""


@query("page_paragraph_body", text_check("p"))
def page_paragraph_body(spark, sf):
    return articles.paragraph_body(pages(spark, sf))


@query("page_heading_text", text_check("p", "h1", "h2"))
def page_heading_text(spark, sf):
    return articles.paragraph_body(pages(spark, sf), tags=("p", "h1", "h2"))


@query("page_lang", "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS country FROM pages")
def page_lang(spark, sf):
    return pages(spark, sf).select(
        "page_id", html.page_lang(html.visible_markup(c("html"))).alias("country"))


META = """m AS (SELECT page_id, doc.*, regexp_extract(html, '(?s)<head>(.*?)</head>', 1) AS head, html, url, media_url, score, fetch_error
  FROM article_pages_fx, LATERAL (SELECT page_id % 10 AS slot) doc)"""


def meta(name: str) -> str:
    return f"nullif(regexp_extract(html, '<meta (?:property|name)=\"{name}\" content=\"([^\"]*)\"', 1), '')"


META_COLUMNS = f"""{meta('og:title')} AS title, {meta('description')} AS description,
  {meta('article:published_time')} AS creation_datetime, {meta('article:modified_time')} AS modified_datetime,
  lower({meta('article:section')}) AS main_topic, lower(replace({meta('keywords')}, ', ', ',')) AS other_topic,
  {meta('og:image')} AS image_url"""


@query("page_meta_fields", f"""{A}
SELECT page_id, {META_COLUMNS} FROM article_pages_fx WHERE contains(html, '<head>')
UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM article_pages_fx WHERE NOT contains(html, '<head>')""")
def page_meta_fields(spark, sf):
    return articles.page_meta_fields(article_pages(spark, sf))


# The article body lies at a depth that differs by page.
LD_TEXT = """regexp_replace(nullif(regexp_extract(j, '"articleBody":"([^"]*)"', 1), ''), '<.*?>', '', 'g')"""
LD = "regexp_extract(html, '(?s)<script type=\"application/ld[+]json\">(.*?)</script>', 1)"


@query("page_jsonld_fields", f"""{A}, ld AS (SELECT page_id, nullif({LD}, '') AS j FROM article_pages_fx)
SELECT page_id, json_extract_string(j, '$.headline') AS title, json_extract_string(j, '$.description') AS description,
  {LD_TEXT} AS body,
  json_extract_string(j, '$.datePublished') AS creation_datetime, json_extract_string(j, '$.dateModified') AS modified_datetime,
  lower(json_extract_string(j, '$.articleSection')) AS main_topic,
  lower(replace(json_extract_string(j, '$.keywords[0]') || ',' || json_extract_string(j, '$.keywords[1]'), ' ', '-')) AS other_topic FROM ld""")
def page_jsonld_fields(spark, sf):
    return articles.page_jsonld_fields(article_pages(spark, sf), only_body=False)


@query("page_jsonld_body", f"""{A}, ld AS (SELECT page_id, nullif({LD}, '') AS j FROM article_pages_fx)
SELECT page_id, {LD_TEXT} AS body FROM ld""")
def page_jsonld_body(spark, sf):
    return articles.page_jsonld_fields(article_pages(spark, sf))


GATE_1 = "CASE WHEN NOT contains(html, '<html') THEN '5_8' WHEN NOT contains(html, '<head>') THEN '5_9' WHEN NOT contains(html, 'content=\"article\"') THEN '5_7' ELSE '0' END"
GATE_2 = f"""CASE WHEN NOT contains(html, 'published_time') OR NOT contains(html, '<head>') THEN '5_2'
  WHEN contains(html, 'published_time" content=""') THEN '5_3'
  WHEN NOT regexp_matches(html, 'published_time" content="[0-9T:-]+([+-][0-9:]+|Z)"') OR right({meta('article:published_time')}, 6) NOT LIKE '+%' THEN '5_1'
  WHEN epoch(TIMESTAMPTZ '{AS_OF}' - CAST({meta('article:published_time')} AS TIMESTAMPTZ)) > 86400 THEN '5_4' ELSE '0' END"""


@query("article_gate", f"{A} SELECT page_id, {GATE_1} AS status_code FROM article_pages_fx")
def article_gate(spark, sf):
    staged = article_pages(spark, sf).select("page_id", html.visible_markup(c("html")).alias("m"))
    staged = staged.select("*", html.named_tags(html.head_region(c("m"))).alias("h"))
    return staged.select("page_id", articles.article_gate(c("m"), c("h")).alias("status_code"))


@query("freshness_gate", f"{A} SELECT page_id, {GATE_2} AS status_code FROM article_pages_fx")
def freshness_gate(spark, sf):
    staged = article_pages(spark, sf).select("page_id", html.visible_markup(c("html")).alias("m"))
    staged = staged.select("page_id", html.named_tags(html.head_region(c("m"))).alias("h"))
    staged = staged.select("page_id", articles.published_meta(c("h")).alias("p"))
    return staged.select("page_id", articles.freshness_gate(c("p"), as_of()).alias("status_code"))


REQUEST = """CASE fetch_error WHEN 'too_many_redirects' THEN '1_1' WHEN 'unicode_error' THEN '1_3' WHEN 'timeout' THEN '1_2' ELSE '0' END"""


@query("request_status", f"{A} SELECT page_id, {REQUEST} AS status_code FROM article_pages_fx")
def request_status(spark, sf):
    return article_pages(spark, sf).select(
        "page_id", articles.request_status(c("fetch_error")).alias("status_code"))


PARAGRAPHS = decoded_article("""regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>.*?<p>(.*)</p>', 1), '</p><p>', '', 'g'), '\\n+', chr(10), 'g')""")
LD_BODY = LD_TEXT.replace("(j,", f"({LD},")
BODY = f"coalesce({LD_BODY}, {PARAGRAPHS})"
# The record of each page with its status; '' stands for a missing text.
RECORDS = f"""gated AS (SELECT *, CASE WHEN {REQUEST} <> '0' THEN {REQUEST} WHEN {GATE_1} <> '0' THEN {GATE_1} ELSE {GATE_2} END AS gate,
  {meta('og:title')} AS t, {BODY} AS b FROM article_pages_fx),
records AS (SELECT page_id, url, media_url, score, html, CASE WHEN gate <> '0' THEN gate WHEN t IS NULL THEN '5_5' WHEN b = '' THEN '5_6' ELSE '0' END AS status_code,
  t AS title, {meta('description')} AS description, b AS body, {meta('article:published_time')} AS creation_datetime,
  coalesce({meta('article:modified_time')}, '') AS modified_datetime,
  lower({meta('article:section')}) AS main_topic, lower(replace({meta('keywords')}, ', ', ',')) AS other_topic,
  {meta('og:image')} AS image_url, regexp_extract(html, '<html lang="([^"]*)"', 1) AS country FROM gated)"""
RECORD_COLUMNS = (
    "url, media_url, score, title, description, body, creation_datetime, modified_datetime, "
    "main_topic, other_topic, image_url, country, -1 AS n_tokens"
)


@query("required_fields_gate", f"""{A}
SELECT page_id, CASE WHEN {meta('og:title')} IS NULL OR {meta('article:published_time')} IS NULL THEN '5_5'
  WHEN {LD_BODY} IS NULL THEN '5_6' ELSE '0' END AS status_code FROM article_pages_fx WHERE contains(html, '<head>')
UNION ALL SELECT page_id, '5_5' FROM article_pages_fx WHERE NOT contains(html, '<head>')""")
def required_fields_gate(spark, sf):
    """The gate over meta fields and JSON-LD bodies alone."""
    rows = article_pages(spark, sf)
    metas = articles.page_meta_fields(rows, ("page_id", "html"))
    staged = jsonld.with_article_fields(metas, c("html"), "ld")
    return staged.select("page_id", articles.required_fields_gate(
        c("title"), c("creation_datetime"), c("ld.body")).alias("status_code"))


@query("article_record", f"""{A},{RECORDS}
SELECT page_id, status_code, {RECORD_COLUMNS} FROM records WHERE status_code = '0'
UNION ALL SELECT page_id, status_code, url, media_url, score, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM records WHERE status_code <> '0'""")
def article_record(spark, sf):
    return articles.article_outcomes(article_pages(spark, sf), as_of(), keep=("page_id",))


@query("article_columns", f"""{A},{RECORDS} SELECT {RECORD_COLUMNS} FROM records WHERE status_code = '0'""")
def article_columns(spark, sf):
    outcomes = articles.article_outcomes(article_pages(spark, sf), as_of())
    return articles.article_columns(outcomes.filter("status_code = '0'"))


@query("media_links_by_text", f"""{cte('media_pages_fx')}
SELECT page_id, url AS href FROM media_pages_fx WHERE contains(split_part(url, '/', 3), 'www.')""")
def media_links_by_text(spark, sf):
    return fixture(spark, sf, "media_pages_fx").select(
        "page_id", F.explode(html.anchors_with_text(c("html"), "www.")).alias("href"))


@query("tags_with_http_attr", f"""{A},
t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>', '', 'g'), '<[a-z][^>]*>', 0)) AS t FROM article_pages_fx)
SELECT page_id, count(*) AS n FROM t WHERE regexp_matches(t, '="[^"]*https?://') GROUP BY page_id""")
def tags_with_http_attr(spark, sf):
    tags = F.filter(
        html.page_tags(c("html")),
        lambda t: F.exists(F.map_values(t["attrs"]), lambda v: v.rlike("https?://")))
    return article_pages(spark, sf).select("page_id", F.explode(tags).alias("t")).groupBy(
        "page_id").agg(F.count("*").alias("n"))


@query("decode_entities", f"SELECT page_id, {decoded('html')} AS text FROM pages")
def decode_entities(spark, sf):
    return pages(spark, sf).select("page_id", html.decode_entities(c("html")).alias("text"))
