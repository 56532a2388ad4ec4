"""Registered queries: candidate links, known urls, ingest runs, statistics, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import fixed
from newsloom.operators import links, stats
from newsloom.plans import ingest as job
from newsloom.plans.check_sql import CUT, PAGE_HREFS, absolute, status_of_url
from newsloom.plans.fixtures import RECIPES, cte, fixture, table
from newsloom.plans.page_queries import RECORDS, as_of
from newsloom.plans.registry import CHECKS, query
from newsloom.sources import keys
from newsloom.sources.workspace import new_path
from newsloom.streaming import jobs

c = F.col
CG = cte("candidates_fx", "garbage_fx")


def candidates(spark, sf):
    return fixture(spark, sf, "candidates_fx").select("media_url", "url", "score")


# ---- known urls --------------------------------------------------------------

@query("distinct_links", f"{cte('candidates_fx')} SELECT DISTINCT media_url, url FROM candidates_fx")
def distinct_links(spark, sf):
    return links.distinct_links(candidates(spark, sf))


@query("best_link_score", f"""{cte('candidates_fx')}
SELECT media_url, url, max(score) AS score FROM candidates_fx GROUP BY media_url, url""")
def best_link_score(spark, sf):
    return links.best_link_score(candidates(spark, sf))


@query("drop_known_garbage", f"""{CG}
SELECT DISTINCT media_url, url FROM candidates_fx c WHERE NOT EXISTS
  (SELECT 1 FROM garbage_fx g WHERE g.url = c.url AND g.media_url = c.media_url)""")
def drop_known_garbage(spark, sf):
    return links.drop_known_garbage(
        links.distinct_links(candidates(spark, sf)), fixture(spark, sf, "garbage_fx"))


@query("drop_known_news", f"""{cte('candidates_fx', 'known_urls_fx')}
SELECT DISTINCT url, media_url FROM candidates_fx WHERE url NOT IN (SELECT url FROM known_urls_fx)""")
def drop_known_news(spark, sf):
    return links.drop_known_news(
        links.distinct_links(candidates(spark, sf)), fixture(spark, sf, "known_urls_fx"))


@query("with_rejects", f"""{cte('candidates_fx')},
s AS (SELECT url, media_url, {status_of_url()} AS status_code FROM candidates_fx)
SELECT 'good' AS part, url, media_url, '0' AS status_code FROM s WHERE status_code = '0'
UNION ALL SELECT 'reject', url, media_url, status_code FROM s WHERE status_code <> '0'""")
def with_rejects(spark, sf):
    good, bad = links.with_rejects(
        links.classify_urls(candidates(spark, sf).select("url", "media_url")))
    return good.select(F.lit("good").alias("part"), "url", "media_url", F.lit("0").alias("status_code")).unionByName(
        bad.select(F.lit("reject").alias("part"), "url", "media_url", "status_code"))


# ---- links of section pages --------------------------------------------------

SCORED_LINKS = f"""scored_links AS (SELECT s.media_url, s.score, {CUT.format('href')} AS link
  FROM page_hrefs h JOIN page_sections_fx s ON h.url = s.url),
full_links AS (SELECT media_url, score, {absolute('link', 'media_url')} AS url FROM scored_links)"""
WITH_LINKS = f"WITH page_sections_fx AS ({RECIPES['page_sections_fx']}),\n{PAGE_HREFS},\n{SCORED_LINKS}"


def section_links(spark, sf):
    return links.section_links(table(spark, sf, "pages"), fixture(spark, sf, "page_sections_fx"))


@query("links_with_section_score", f"{WITH_LINKS} SELECT media_url, url, score FROM full_links")
def links_with_section_score(spark, sf):
    return section_links(spark, sf)


@query("links_with_section_score_large", f"{WITH_LINKS} SELECT media_url, url, score FROM full_links")
def links_with_section_score_large(spark, sf):
    """The same by the way taken when the catalogue is too large to broadcast."""
    return links.section_links(
        table(spark, sf, "pages"), fixture(spark, sf, "page_sections_fx"), broadcast_rows=0)


STATUS_COUNTS = f"""statused AS (SELECT DISTINCT media_url, url, {status_of_url()} AS status_code FROM full_links),
meanings(status_code, meaning) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in fixed.STATUS_MEANING.items())})
SELECT media_url, s.status_code, meaning, count(*) AS n FROM statused s JOIN meanings m ON s.status_code = m.status_code
WHERE s.status_code <> '0' GROUP BY media_url, s.status_code, meaning"""


@query("garbage_by_status", f"{WITH_LINKS},{STATUS_COUNTS}")
def garbage_by_status(spark, sf):
    """Section pages -> links -> distinct -> url rules -> counts per media and code."""
    found = links.distinct_links(section_links(spark, sf))
    return stats.garbage_by_status(links.classify_urls(found))


@query("garbage_by_all_codes", f"""{cte('candidates_fx')},
statused AS (SELECT DISTINCT media_url, url, {status_of_url()} AS status_code FROM candidates_fx),
{STATUS_COUNTS.split("," + chr(10), 1)[1]}""")
def garbage_by_all_codes(spark, sf):
    """Candidate links that meet each url rule -> counts per media and code."""
    found = links.distinct_links(candidates(spark, sf))
    return stats.garbage_by_status(links.classify_urls(found))


BANNED = " OR ".join(f"contains(url, '{b}')" for b in fixed.SECTION_BANNED)


@query("section_candidates", f"""WITH {PAGE_HREFS},
home AS (SELECT string_split(url, '/')[3] AS domain, array_to_string(string_split(url, '/')[1:3], '/') || lower(href) AS link FROM page_hrefs),
closed AS (SELECT domain, regexp_replace(regexp_replace(link, '#.*$', ''), '/$', '') || '/' AS url FROM home)
SELECT DISTINCT domain, url FROM closed WHERE NOT (len(string_split(url, '-')) > 2 OR {BANNED}
  OR regexp_matches(url, '[0-9]{{3}}|[?=%]') OR NOT contains(url, domain))""")
def section_candidates(spark, sf):
    return links.section_candidates(table(spark, sf, "pages"))


# ---- ingest ------------------------------------------------------------------

INGEST = cte("candidates_fx", "garbage_fx", "known_urls_fx", "article_pages_fx")
OUTCOMES = f"""{RECORDS},
wanted AS (SELECT media_url, url, max(score) AS score FROM (
  SELECT media_url, url, score FROM candidates_fx UNION ALL SELECT media_url, url, score FROM article_pages_fx) x GROUP BY media_url, url),
fresh AS (SELECT *, {status_of_url()} AS link_status FROM wanted c WHERE NOT EXISTS
  (SELECT 1 FROM garbage_fx g WHERE g.url = c.url AND g.media_url = c.media_url)),
outcomes AS (
  SELECT f.media_url, f.url, f.score, link_status AS status_code, 'link' AS stage, NULL AS title, NULL AS body FROM fresh f WHERE link_status <> '0'
  UNION ALL
  SELECT f.media_url, f.url, f.score, coalesce(r.status_code, '1_2'), 'page', CASE WHEN r.status_code = '0' THEN r.title END,
    CASE WHEN r.status_code = '0' THEN r.body END
  FROM fresh f LEFT JOIN records r ON f.url = r.url
  WHERE link_status = '0' AND f.url NOT IN (SELECT url FROM known_urls_fx)
  UNION ALL
  SELECT media_url, url, score, NULL, 'known', NULL, NULL FROM fresh
  WHERE link_status = '0' AND url IN (SELECT url FROM known_urls_fx))"""


def wanted(spark, sf):
    own = fixture(spark, sf, "article_pages_fx").select("media_url", "url", "score")
    return candidates(spark, sf).unionByName(own)


def fetched_pages(spark, sf):
    """Article pages, each with an earlier fetch that had failed to give an article."""
    last = fixture(spark, sf, "article_pages_fx").withColumn("fetched_at", F.timestamp_seconds(F.lit(2)))
    first = last.withColumn("fetched_at", F.timestamp_seconds(F.lit(1))).withColumn("html", F.lit("<div>busy</div>"))
    return last.unionByName(first)


def outcomes(spark, sf, **options):
    return job.ingest(
        wanted(spark, sf), fixture(spark, sf, "garbage_fx"), fixture(spark, sf, "known_urls_fx"),
        fetched_pages(spark, sf), as_of(), **options)


OUTCOME_COLUMNS = ("media_url", "url", "score", "status_code", "stage", "title", "body")
INGEST_CHECK = f"{INGEST},{OUTCOMES} SELECT media_url, url, score, status_code, stage, title, body FROM outcomes"


@query("ingest_articles", INGEST_CHECK)
def ingest_articles(spark, sf):
    return outcomes(spark, sf).select(*OUTCOME_COLUMNS)


@query("ingest_articles_large", INGEST_CHECK)
def ingest_articles_large(spark, sf):
    """The same by the way taken when the candidates are too many to broadcast."""
    return outcomes(spark, sf, broadcast_rows=0).select(*OUTCOME_COLUMNS)


COUNTERS = """count(*) FILTER (WHERE stage IN ('known', 'page')) AS n_scraped, count(*) FILTER (WHERE stage = 'stored') AS n_known,
  count(*) FILTER (WHERE stage = 'page') AS n_to_process,
  count(*) FILTER (WHERE stage = 'page' AND status_code = '0') AS n_inserted,
  count(*) FILTER (WHERE stage = 'page' AND status_code = '5_6') AS n_no_body"""
EVENTS = f"""{OUTCOMES},
ev AS (SELECT media_url, stage, status_code FROM outcomes UNION ALL SELECT media_url, 'stored', NULL FROM known_urls_fx
  WHERE media_url IN (SELECT media_url FROM outcomes))"""


def events(spark, sf):
    return stats.ingest_events(outcomes(spark, sf), fixture(spark, sf, "known_urls_fx"))


@query("media_ingest_stats", f"""{INGEST},{EVENTS}, per AS (SELECT media_url, {COUNTERS} FROM ev GROUP BY media_url)
SELECT *, CASE WHEN n_scraped > 0 AND n_inserted = 0 THEN '0 insertions to db' ELSE '' END AS warning FROM per""")
def media_ingest_stats(spark, sf):
    return stats.media_ingest_stats(events(spark, sf))


@query("run_summary", f"{INGEST},{EVENTS} SELECT {COUNTERS} FROM ev")
def run_summary(spark, sf):
    return stats.run_summary(events(spark, sf))


@query("media_and_run_stats", f"{INGEST},{EVENTS} SELECT media_url, {COUNTERS} FROM ev GROUP BY ROLLUP (media_url)")
def media_and_run_stats(spark, sf):
    return stats.media_and_run_stats(events(spark, sf))


# ---- streams -----------------------------------------------------------------

@query("stream_new_pages", f"""{cte('article_pages_fx')},{RECORDS}
SELECT 'news' AS part, url, media_url, '0' AS status_code, title, body FROM records r
  WHERE status_code = '0' AND {status_of_url('r.url', 'r.media_url')} = '0'
UNION ALL SELECT 'garbage', url, media_url, CASE WHEN {status_of_url('r.url', 'r.media_url')} <> '0' THEN {status_of_url('r.url', 'r.media_url')}
  ELSE status_code END, NULL, NULL FROM records r WHERE status_code <> '0' OR {status_of_url('r.url', 'r.media_url')} <> '0'""")
def stream_new_pages(spark, sf):
    """Article pages arrive as files; the stream stores news and garbage."""
    arriving, work = new_path(spark, "arriving"), new_path(spark, "stream")
    rows = fixture(spark, sf, "article_pages_fx")
    # Pages cost more to parse than to read: row groups let all cores share the few files of a micro-batch.
    rows.write.option("parquet.block.size", 8 << 20).parquet(arriving)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(arriving)
    news, garbage = f"{work}/news", f"{work}/garbage"
    jobs.stream_new_pages(stream, news, garbage, f"{work}/checkpoint", as_of()).awaitTermination()
    good = spark.read.parquet(news).select(
        F.lit("news").alias("part"), "url", "media_url", F.lit("0").alias("status_code"), "title",
        c("article_body").alias("body"))
    bad = spark.read.parquet(garbage).select(
        F.lit("garbage").alias("part"), "url", "media_url", "status_code",
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("body"))
    return good.unionByName(bad)


def arriving(spark, rows, name, extra=()):
    """Streams over a folder to which ``rows`` (with ``ts``) come part by part in the order of time.

    Each part has as many files as Spark makes of it, all of one micro-batch if the job runs
    to its end before the next part is asked for. The parts are cut at noon, so that days go
    over two of them; rows without a time are in the first, ``extra`` comes last.
    """
    path = new_path(spark, name)
    day = F.datediff(F.to_date(c("ts") + F.expr("INTERVAL 12 HOURS")), F.lit("2024-01-01"))
    early, late = F.coalesce(day < 8, F.lit(True)), F.coalesce(day >= 16, F.lit(False))
    for part in [rows.filter(early), rows.filter(~early & ~late), rows.filter(late), *extra]:
        part.write.mode("append").parquet(path)
        yield spark.readStream.schema(rows.schema).parquet(path)


@query("stream_dedup_links", """
SELECT DISTINCT event_type || '/' || CAST(user_id AS STRING) || '/' || CAST(CAST(ts AS DATE) AS STRING) AS url FROM events""")
def stream_dedup_links(spark, sf):
    """Links with their day in the url arrive in several batches, with repeats across
    them; each url passes once, and one that comes days late not at all."""
    path = new_path(spark, "dedup")
    rows = table(spark, sf, "events").select("ts", F.concat_ws(
        "/", "event_type", c("user_id").cast("string"), F.to_date("ts").cast("string")).alias("url"))
    late = rows.agg(F.min("ts").alias("ts")).select("ts", F.lit("late/row").alias("url"))
    for stream in arriving(spark, rows, "links-arriving", [late]):
        found = stream.select("url", c("ts").cast("timestamp").alias("published_at"))
        jobs.write_new_rows(
            jobs.stream_dedup_links(found), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("url")


@query("stream_media_stats", f"""{cte('ingest_events_fx')}, per AS (
SELECT date_trunc('hour', ts) AS hour, media_url, {COUNTERS} FROM ingest_events_fx GROUP BY 1, 2)
SELECT *, CASE WHEN n_scraped > 0 AND n_inserted = 0 THEN '0 insertions to db' ELSE '' END AS warning FROM per""")
def stream_media_stats(spark, sf):
    """The ingest statistics over several micro-batches equal those of one batch."""
    path = new_path(spark, "hourly")
    for stream in arriving(spark, fixture(spark, sf, "ingest_events_fx"), "outcomes-arriving"):
        rows = stream.withColumn("ts", c("ts").cast("timestamp"))
        jobs.write_updates(
            jobs.stream_media_stats(rows), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return jobs.latest_updates(spark, f"{path}/rows", ["hour", "media_url"])


# ---- key tables --------------------------------------------------------------

def key_table(spark, sf, recipe, on, keep=()):
    """The stored keys of a fixture as a key table, in as many buckets as the session shuffles to."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keys.write_keys(fixture(spark, sf, recipe), new_path(spark, f"keys-{recipe}"), on, buckets, keep)


@query("drop_known_garbage_by_keys", CHECKS["drop_known_garbage"])
def drop_known_garbage_by_keys(spark, sf):
    stored = key_table(spark, sf, "garbage_fx", ["url", "media_url"])
    return keys.drop_known(links.distinct_links(candidates(spark, sf)), stored, ["url", "media_url"])


@query("drop_known_news_by_keys", CHECKS["drop_known_news"])
def drop_known_news_by_keys(spark, sf):
    stored = key_table(spark, sf, "known_urls_fx", ["url"])
    return keys.drop_known(links.distinct_links(candidates(spark, sf)), stored, ["url"])
