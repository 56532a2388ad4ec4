"""Registered queries: url rules, text functions, JSON and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import dates, fixed, jsonld, text, urls
from newsloom.operators import articles, links
from newsloom.plans.check_sql import CUT, PAGE_HREFS, absolute, status_of_url
from newsloom.plans.fixtures import AS_OF, cte, fixture, table
from newsloom.plans.registry import query
from newsloom.sources import tables

C = cte("candidates_fx")
H = f"WITH {PAGE_HREFS}"
c = F.col


def candidates(spark, sf):
    return fixture(spark, sf, "candidates_fx")


def hrefs(spark, sf):
    return links.page_links(table(spark, sf, "pages"))


# ---- url rules ---------------------------------------------------------------

@query("url_cut_query", f"SELECT page_id, {CUT.format('url')} AS cut FROM pages")
def url_cut_query(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.cut_query(c("url")).alias("cut"))


MEDIA_OF_PAGE = "(string_split(url, '/')[1] || '//' || string_split(url, '/')[3])"


@query("url_absolutise", f"""{H},
all_links AS (SELECT page_id, pos, href AS link, {MEDIA_OF_PAGE} AS media FROM page_hrefs
  UNION ALL SELECT page_id, -1, url, {MEDIA_OF_PAGE} FROM pages
  UNION ALL SELECT page_id, -2, '//' || string_split(url, '/')[3] || '/x', {MEDIA_OF_PAGE} FROM pages
  UNION ALL SELECT page_id, -3, 'www.' || string_split(url, '/')[3], {MEDIA_OF_PAGE} FROM pages)
SELECT page_id, CAST(pos AS INT) AS pos, {absolute('link', 'media')} AS link FROM all_links""")
def url_absolutise(spark, sf):
    pages = table(spark, sf, "pages")
    rows = hrefs(spark, sf).select("page_id", "url", "pos", c("href").alias("link"))
    for pos, link in ((-1, c("url")), (-2, F.concat(F.lit("//"), urls.host(c("url")), F.lit("/x"))),
                      (-3, F.concat(F.lit("www."), urls.host(c("url"))))):
        rows = rows.unionByName(pages.select("page_id", "url", F.lit(pos).alias("pos"), link.alias("link")))
    return rows.select(
        "page_id", "pos", urls.absolutise(c("link"), urls.origin(c("url"))).alias("link"))


CANONICAL = """canonical AS (SELECT page_url, domain, href,
  regexp_replace(CASE WHEN starts_with(lower(href), '//') THEN 'https:' || lower(href)
    WHEN starts_with(lower(href), '/') THEN array_to_string(string_split(page_url, '/')[1:3], '/') || lower(href)
    WHEN starts_with(lower(href), 'www.') THEN 'https://' || lower(href) ELSE lower(href) END, '(#.*)?$', '') AS bare
  FROM section_hrefs_fx),
closed AS (SELECT *, CASE WHEN ends_with(bare, '/') THEN bare ELSE bare || '/' END AS url FROM canonical)"""
BANNED = " OR ".join(f"contains(url, '{b}')" for b in fixed.SECTION_BANNED)
BANNED_WIDE = " OR ".join(f"contains(low, '{b}')" for b in fixed.SECTION_BANNED_WIDE)


def section_hrefs(spark, sf):
    return fixture(spark, sf, "section_hrefs_fx").withColumn(
        "url", urls.section_canonical(c("href"), c("page_url")))


@query("section_url_canonical", f"{cte('section_hrefs_fx')},{CANONICAL} SELECT page_url, href, url FROM closed")
def section_url_canonical(spark, sf):
    return section_hrefs(spark, sf).select("page_url", "href", "url")


@query("valid_section_url", f"""{cte('section_hrefs_fx')},{CANONICAL}
SELECT page_url, href, NOT (length(url) - length(replace(url, '-', '')) > 1 OR {BANNED}
  OR regexp_matches(url, '[0-9]{{3}}') OR contains(url, '?') OR contains(url, '=') OR contains(url, '%')
  OR NOT contains(url, domain)) AS valid FROM closed""")
def valid_section_url(spark, sf):
    return section_hrefs(spark, sf).select(
        "page_url", "href", urls.valid_section_url(c("url"), c("domain")).alias("valid"))


WIDE = f"""{cte('section_hrefs_fx')},
l AS (SELECT *, lower(href) AS low, regexp_replace(lower(href), '^(\\w*:?/{{1,2}})', '') AS bare FROM section_hrefs_fx)
SELECT page_url, href, (regexp_matches(href, '^(\\w*:?)/{{2}}[^/]+/[^/]*/?$')
    OR (NOT regexp_matches(href, '^\\w*:?/') AND regexp_matches(href, '^[^/]+/[^/]+/?$'))
    OR regexp_matches(href, '^/[^/-]+-?[^/-]*/?$'))
  AND NOT (length(low) - length(replace(low, '-', '')) > 1 OR {BANNED_WIDE} OR regexp_matches(low, '[0-9]{{3}}')
    OR contains(low, '?') OR contains(low, '=') OR contains(low, '%') OR (contains(low, 'aviso') AND contains(low, 'legal')))
  AND NOT (low = '' OR low = page_url OR low = domain)
  AND NOT ((starts_with(low, '//') OR NOT starts_with(low, '/')) AND NOT starts_with(bare, domain)) AS valid FROM l"""


@query("valid_section_url_wide", WIDE)
def valid_section_url_wide(spark, sf):
    return fixture(spark, sf, "section_hrefs_fx").select(
        "page_url", "href",
        urls.valid_section_url_wide(c("href"), c("page_url"), c("domain")).alias("valid"))


@query("section_url_canonical_wide", f"""{WIDE.replace("FROM l", "FROM l), ok AS (SELECT page_url, href, low FROM shaped WHERE valid)").replace("SELECT page_url, href, (regexp", ", shaped AS (SELECT page_url, href, low, (regexp")},
f AS (SELECT page_url, href, CASE WHEN starts_with(low, '//') THEN 'https:' || low
  WHEN starts_with(low, '/') AND contains(low, 'www.') THEN 'https:/' || low
  WHEN starts_with(low, '/') THEN left(page_url, length(page_url) - 1) || low
  WHEN starts_with(low, 'www.') THEN 'https://' || low ELSE low END AS u FROM ok)
SELECT page_url, href, rtrim(string_split(u, '#')[1], '/') || CASE WHEN contains(u, '/#') THEN '//' ELSE '/' END AS url FROM f""")
def section_url_canonical_wide(spark, sf):
    rows = fixture(spark, sf, "section_hrefs_fx").filter(
        urls.valid_section_url_wide(c("href"), c("page_url"), c("domain")))
    return rows.select("page_url", "href", urls.section_canonical_wide(c("href"), c("page_url")).alias("url"))


@query("classify_urls", f"{C} SELECT doc_id, url, {status_of_url()} AS status_code FROM candidates_fx")
def classify_urls(spark, sf):
    return links.classify_urls(candidates(spark, sf)).select("doc_id", "url", "status_code")


def _predicate(name, sql, column):
    @query(name, f"{C} SELECT doc_id, {sql} AS hit FROM candidates_fx")
    def run(spark, sf):
        return candidates(spark, sf).select("doc_id", column().alias("hit"))

    return run


PIECES = "list_filter(string_split(url, '/'), lambda x: x <> '')"
_predicate("has_invalid_file", "regexp_matches(url, '\\.(xml|pdf|lxml|jpg|png|gif)$')",
           lambda: urls.has_invalid_file(c("url")))
_predicate("has_invalid_section",
           " OR ".join(f"contains(url, '{s}')" for s in fixed.IRRELEVANT_SECTIONS),
           lambda: urls.has_invalid_section(c("url")))
_predicate("url_path_depth", f"CAST(greatest(len({PIECES}) - 2, 0) AS INT)",
           lambda: urls.path_depth(c("url")))
_predicate("short_slug", f"regexp_matches({PIECES}[-1], '^[.a-zA-Z0-9]+(-[.a-zA-Z0-9]+){{0,2}}$')",
           lambda: urls.has_short_slug(c("url")))
_predicate("outside_media", "NOT contains(url, rtrim(media_url, '/'))",
           lambda: urls.outside_media(c("url"), c("media_url")))
_predicate("has_http_scheme", "regexp_matches(url, 'https?://')",
           lambda: urls.has_http_scheme(c("url")))
_predicate("url_last_node",
           "string_split(string_split(regexp_replace(regexp_replace(url, '/{1,2}$', ''), '[^/][.][^/]$', ''), '/')[-1], '.')[1]",
           lambda: urls.last_node(c("url")))
_predicate("count_hyphens", "CAST(len(string_split(url, '-')) - 1 AS INT)",
           lambda: urls.count_hyphens(c("url")))


def _page_url(name, sql, column):
    @query(name, f"SELECT page_id, {sql} AS part FROM pages")
    def run(spark, sf):
        return table(spark, sf, "pages").select("page_id", column().alias("part"))

    return run


_page_url("url_domain", "regexp_extract(url, '^(?:https?://)?([^/]+)', 1)", lambda: urls.domain(c("url")))
_page_url("url_topic",
          "string_split(trim(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/'), '/')[1]",
          lambda: urls.topic(c("url")))
_page_url("url_origin", "array_to_string(string_split(url, '/')[1:3], '/') || '/'", lambda: urls.origin(c("url")))
_page_url("strip_www", "replace(regexp_replace(split_part(url, '/', 3), '^www\\.', ''), '/', '')",
          lambda: urls.strip_www(urls.host(c("url"))))


@query("url_contains", "SELECT page_id, url FROM pages WHERE contains(url, 'www')")
def url_contains(spark, sf):
    return table(spark, sf, "pages").filter(c("url").contains("www")).select("page_id", "url")


@query("one_segment_urls", f"""{cte('section_hrefs_fx')},{CANONICAL},
t AS (SELECT page_url, url, string_split(trim(regexp_replace(regexp_extract(url, '^(?:[a-z]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', ''), '/'), '/') AS p FROM closed)
SELECT page_url, url, p[1] AS topic FROM t WHERE len(p) = 1 AND p[1] <> ''""")
def one_segment_urls(spark, sf):
    return links.one_segment_urls(section_hrefs(spark, sf)).select("page_url", "url", "topic")


@query("region_links", f"""{cte('region_hrefs_fx')}
SELECT DISTINCT href, substr(href, 2, length(href) - 5) AS region FROM region_hrefs_fx
WHERE ends_with(href, '.php') AND starts_with(href, '/') AND NOT contains(href, 'radio')""")
def region_links(spark, sf):
    return links.region_links(fixture(spark, sf, "region_hrefs_fx"), ("radio",))


# ---- text --------------------------------------------------------------------

@query("strip_tags", "SELECT page_id, regexp_replace(html, '<[^\\n]*?>', '', 'g') AS text FROM pages")
def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_tags(c("html")).alias("text"))


@query("collapse_newlines", "SELECT doc_id, regexp_replace(text, '\\n+', chr(10), 'g') AS text FROM documents")
def collapse_newlines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.collapse_newlines(c("text")).alias("text"))


@query("clean_topics", f"""{cte('topics_fx')}
SELECT doc_id, regexp_replace(lower(CASE WHEN contains(topics, ', ') THEN replace(replace(topics, ', ', ','), ' ', '-') ELSE topics END),
  '[?¿!¡*&#()%]', '', 'g') AS topics FROM topics_fx""")
def clean_topics(spark, sf):
    return fixture(spark, sf, "topics_fx").select("doc_id", text.clean_topics(c("topics")).alias("topics"))


@query("keyword_list", f"{cte('topics_fx')} SELECT doc_id, lower(replace(topics, ', ', ',')) AS topics FROM topics_fx")
def keyword_list(spark, sf):
    return fixture(spark, sf, "topics_fx").select("doc_id", text.keyword_list(c("topics")).alias("topics"))


@query("join_list", f"{cte('topics_fx')} SELECT doc_id, lower(array_to_string(string_split(topics, ' '), ',')) AS topics FROM topics_fx")
def join_list(spark, sf):
    return fixture(spark, sf, "topics_fx").select(
        "doc_id", text.join_list(F.split("topics", " ")).alias("topics"))


@query("normalise_columns", f"""{cte('raw_ranking_fx')}
SELECT trim(Media) AS media, trim(Domain) AS domain, Country AS country, Region AS region, Language AS language,
  Overall AS overall, Global_rank AS global_rank FROM raw_ranking_fx""")
def normalise_columns(spark, sf):
    return tables.normalise_columns(fixture(spark, sf, "raw_ranking_fx"))


@query("edit_distance", "SELECT event_id, CAST(levenshtein(event_type, CAST(user_id AS STRING) || 'click') AS INT) AS d FROM events")
def edit_distance(spark, sf):
    other = F.concat(c("user_id").cast("string"), F.lit("click"))
    return table(spark, sf, "events").select("event_id", F.levenshtein("event_type", other).alias("d"))


# ---- JSON --------------------------------------------------------------------

@query("json_leaves", f"""{cte('json_fx')},
r AS (SELECT doc_id, block, json_extract_string(block, '$.meta.lang') AS lang, json_extract_string(block, '$.meta.origin.name') AS name,
  json_extract_string(block, '$.meta.origin.size') AS size FROM json_fx)
SELECT doc_id, u.pos, u.path, u.value FROM r,
 (VALUES (0, 'id'), (1, 'meta.lang'), (2, 'meta.origin.name'), (3, 'meta.origin.size'), (4, 'meta.origin'), (5, 'meta'), (6, 'tags'), (7, 'ok')) AS v(pos, path),
 LATERAL (SELECT v.pos AS pos, v.path AS path, CASE v.pos WHEN 4 THEN 'name,size' WHEN 5 THEN 'lang,origin'
   ELSE json_extract_string(r.block, '$.' || v.path) END AS value) u
UNION ALL SELECT doc_id, CAST(8 + i AS INT), 'deep' || repeat('.n', k - i), CASE WHEN i = 0 THEN 'x' ELSE 'n' END
  FROM (SELECT doc_id, CAST(doc_id % 13 AS INT) AS k, unnest(range(0, CAST(doc_id % 13 AS INT) + 1))::INT AS i FROM json_fx)
UNION ALL SELECT event_id + 1000000, 0, 'k', json_extract_string(props, '$.k') FROM events""")
def json_leaves(spark, sf):
    blocks = fixture(spark, sf, "json_fx").unionByName(
        table(spark, sf, "events").select((c("event_id") + 1000000).alias("doc_id"), c("props").alias("block")))
    objects = blocks.select("doc_id", jsonld.block_objects(F.array("block")).alias("objects"))
    return objects.select(
        "doc_id", F.posexplode(jsonld.json_leaves("objects")).alias("pos", "leaf")
    ).select("doc_id", "pos", "leaf.path", "leaf.value")


@query("json_depth", f"{cte('json_fx')} SELECT doc_id, CAST(greatest(2, doc_id % 13) AS INT) AS depth FROM json_fx")
def json_depth(spark, sf):
    objects = fixture(spark, sf, "json_fx").select(
        "doc_id", jsonld.block_objects(F.array("block")).alias("objects"))
    return objects.select("doc_id", jsonld.json_leaves("objects").alias("leaves")).select(
        "doc_id", jsonld.json_depth(c("leaves")).alias("depth"))


@query("valid_json_blocks", f"""{cte('blocks_fx')}
SELECT doc_id, CAST(CASE WHEN starts_with(block, '[') THEN json_array_length(block) ELSE 1 END AS INT) AS n_objects
FROM blocks_fx WHERE json_valid(block)""")
def valid_json_blocks(spark, sf):
    blocks = fixture(spark, sf, "blocks_fx").select(
        "doc_id", F.explode(jsonld.valid_blocks(F.array("block"))).alias("block"))
    return blocks.select("doc_id", F.size(jsonld.json_objects(c("block"))).alias("n_objects"))


# ---- dates -------------------------------------------------------------------

INSTANT = """i AS (SELECT event_id, published, CASE WHEN regexp_matches(published,
  '^[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T ][0-9]{2}:?[0-9]{2}:?[0-9]{2}(\\.[0-9]+)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)$')
  THEN epoch_us(CAST(regexp_replace(regexp_replace(published, '^([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})([0-9]{2})', '\\1-\\2-\\3T\\4:\\5:\\6'),
    '([+-][0-9]{2})([0-9]{2})$', '\\1:\\2') AS TIMESTAMPTZ)) END AS micros FROM times_fx)"""


@query("parse_iso_ts", f"{cte('times_fx')},{INSTANT} SELECT event_id, published, micros FROM i")
def parse_iso_ts(spark, sf):
    return fixture(spark, sf, "times_fx").select(
        "event_id", "published", F.unix_micros(dates.parse_instant(c("published"))).alias("micros"))


@query("age_days", f"""{cte('times_fx')},{INSTANT}
SELECT event_id, CAST(floor((epoch_us(TIMESTAMPTZ '{AS_OF}') - micros) / 86400000000.0) AS BIGINT) AS whole_days,
  round((epoch_us(TIMESTAMPTZ '{AS_OF}') - micros) / 1000000.0, 3) AS seconds FROM i""")
def age_days(spark, sf):
    days = dates.age_days(dates.parse_instant(c("published")), dates.instant_literal(AS_OF))
    return fixture(spark, sf, "times_fx").select(
        "event_id", F.floor(days).alias("whole_days"),
        F.round(days * dates.SECONDS_PER_DAY, 3).alias("seconds"))


@query("insert_time", f"""{cte('candidates_fx')}
SELECT url, media_url, {status_of_url()} AS status_code, epoch_us(TIMESTAMPTZ '{AS_OF}') AS inserted_micros
FROM candidates_fx WHERE {status_of_url()} <> '0'""")
def insert_time(spark, sf):
    """Rejects with the insert time of their run, which is given to it."""
    statused = links.classify_urls(candidates(spark, sf).select("url", "media_url"))
    rows = articles.to_garbage_rows(statused, dates.instant_literal(AS_OF))
    return rows.select("url", "media_url", "status_code", F.unix_micros("inserted_at").alias("inserted_micros"))
