"""Registered queries: release run, feed reads, text responses."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import articles, feed, release
from newsloom.plans.fixtures import cte, fixture, table
from newsloom.plans.page_queries import RECORDS, as_of
from newsloom.plans.registry import query
from newsloom.sources import releases
from newsloom.sources.tables import pending_news
from newsloom.sources.workspace import new_path

N = cte("news_fx")
SEED = "2024-01-02"
NOW = "TIMESTAMP '2024-02-02 00:00:00'"
c = F.col

PENDING = """pending AS (SELECT * FROM news_fx WHERE processed_at IS NULL AND NOT preprocessed),
described AS (SELECT url, description, score + 1 AS score FROM pending WHERE description <> '')"""
DRAWN = f"""{PENDING},
keyed AS (SELECT url, description, row_number() OVER (PARTITION BY description ORDER BY
  -ln((('0x' || substr(md5('{SEED}' || url), 1, 8))::BIGINT + 0.5) / 4294967296.0) / score, url) AS rn FROM described),
chosen AS (SELECT description, url FROM keyed WHERE rn = 1)"""


def news(spark, sf):
    return fixture(spark, sf, "news_fx")


def described(spark, sf):
    return release.described_news(pending_news(news(spark, sf)))


# ---- release -----------------------------------------------------------------

@query("described_news", f"{N},{PENDING} SELECT url, description, score FROM described")
def described_news(spark, sf):
    return described(spark, sf).select("url", "description", "score")


@query("pick_one_per_description", f"{N},{DRAWN} SELECT description, url FROM chosen")
def pick_one_per_description(spark, sf):
    return release.pick_one_per_description(described(spark, sf), SEED)


@query("split_released_held", f"""{N},{DRAWN}
SELECT url, CASE WHEN url IN (SELECT url FROM chosen) THEN 'release' ELSE 'hold' END AS decision FROM pending""")
def split_released_held(spark, sf):
    return release.split_released_held(pending_news(news(spark, sf)), SEED)


@query("held_rows", f"{N},{DRAWN} SELECT url, description, score FROM described WHERE url NOT IN (SELECT url FROM chosen)")
def held_rows(spark, sf):
    rows = described(spark, sf).select("url", "description", "score")
    return release.held_rows(rows, release.pick_one_per_description(rows, SEED))


@query("rows_to_mark", f"""{N},{DRAWN}
SELECT url FROM described WHERE url NOT IN (SELECT url FROM chosen)
UNION ALL SELECT url FROM pending WHERE description = ''""")
def rows_to_mark(spark, sf):
    return release.rows_to_mark(pending_news(news(spark, sf)), SEED)


@query("mark_processed", f"""{N},{DRAWN}
SELECT url, CASE WHEN url IN (SELECT url FROM pending) THEN {NOW} ELSE processed_at END AS processed_at,
  preprocessed OR url IN (SELECT url FROM chosen) AS preprocessed FROM news_fx""")
def mark_processed(spark, sf):
    rows = news(spark, sf).select("url", "description", "score", "processed_at", "preprocessed")
    return release.release_run(rows, SEED, F.expr(NOW)).select("url", "processed_at", "preprocessed")


@query("release_by_batches", f"""{N}, taken AS (SELECT *, hour(created_at) >= 2 AS run FROM news_fx WHERE hour(created_at) < 3),
pending AS (SELECT * FROM taken WHERE processed_at IS NULL AND NOT preprocessed),
chosen AS (SELECT url FROM (SELECT url, row_number() OVER (PARTITION BY run, description ORDER BY
  -ln((('0x' || substr(md5('{SEED}' || url), 1, 8))::BIGINT + 0.5) / 4294967296.0) / (score + 1), url) AS rn
  FROM pending WHERE description <> '') WHERE rn = 1)
SELECT url, CASE WHEN url IN (SELECT url FROM pending) THEN {NOW} ELSE processed_at END AS processed_at,
  preprocessed OR url IN (SELECT url FROM chosen) AS preprocessed FROM news_fx""")
def release_by_batches(spark, sf):
    """The hours arrive as batches; a run takes the first two, another one the third, and the rest waits."""
    rows, path = news(spark, sf).select("url", "description", "score", "processed_at", "preprocessed", "created_at"), new_path(spark, "releases")
    releases.create_store(spark, path, rows.schema)
    hour = F.hour("created_at")
    for batch, (part, run) in enumerate([(hour == 0, None), (hour == 1, "r1"), (hour == 2, "r2"), (hour >= 3, None)]):
        releases.add_batch(rows.filter(part), path, f"b{batch}")
        if run:
            releases.release_batches(spark, path, rows.schema, run, SEED, F.expr(NOW))
    return releases.snapshot(spark, path, rows.schema).select("url", "processed_at", "preprocessed")


# ---- feed --------------------------------------------------------------------

FEED = "url, created_at, inserted_at, title, description, article_body, image_url, score, preprocessed"
ORDER = "ORDER BY created_at DESC, score DESC, url"


@query("feed_visible", f"{N} SELECT url, preprocessed FROM news_fx WHERE preprocessed")
def feed_visible(spark, sf):
    return feed.feed_visible(news(spark, sf)).select("url", "preprocessed")


@query("feed_by_topic", f"{N} SELECT url, main_topic FROM news_fx WHERE contains(lower(main_topic), 'política')")
def feed_by_topic(spark, sf):
    return feed.feed_by_topic(news(spark, sf), "POLÍTICA").select("url", "main_topic")


@query("feed_columns", f"{N} SELECT {FEED} FROM news_fx")
def feed_columns(spark, sf):
    return feed.feed_columns(news(spark, sf))


@query("feed_top", f"{N} SELECT {FEED} FROM news_fx WHERE preprocessed {ORDER} LIMIT 10")
def feed_top(spark, sf):
    return feed.feed_page(news(spark, sf))


@query("feed_page", f"{N} SELECT {FEED} FROM news_fx WHERE preprocessed AND contains(lower(main_topic), 'econom') {ORDER} LIMIT 10 OFFSET 10")
def feed_page(spark, sf):
    return feed.feed_page(news(spark, sf), offset=10, topic="Econom")


@query("feed_after", f"""{N} SELECT {FEED} FROM news_fx WHERE preprocessed AND (created_at < TIMESTAMP '2024-01-01 02:00:00'
  OR (created_at = TIMESTAMP '2024-01-01 02:00:00' AND score < 20)) {ORDER} LIMIT 10""")
def feed_after(spark, sf):
    return feed.feed_after(news(spark, sf), datetime(2024, 1, 1, 2), 20.0, "~")



@query("topic_suggest", """
SELECT word, n FROM (SELECT word, count(*) AS n FROM
  (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) w GROUP BY word) v WHERE contains(word, 'tion')""")
def topic_suggest(spark, sf):
    """Suggestions out of the words of all documents."""
    words = table(spark, sf, "documents").select(
        F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return feed.topic_suggest(words.groupBy("word").agg(F.count("*").alias("n")), " TION ")


# ---- responses ---------------------------------------------------------------

R = cte("responses_fx")
TOKENS = "coalesce(TRY_CAST(regexp_extract(response, 'Tokens: ([0-9]+)', 1) AS INT), -1)"
SUMMARY = "coalesce(regexp_extract(response, '(?s)Body Summary:(.*)', 1), '')"


@query("summary_fields", f"""{R}
SELECT url, CASE WHEN contains({SUMMARY}, 'BodyNotFound') THEN text ELSE {SUMMARY} END AS body,
  CASE WHEN contains({SUMMARY}, 'BodyNotFound') THEN -1 ELSE {TOKENS} END AS n_tokens
FROM responses_fx""")
def summary_fields(spark, sf):
    rows = fixture(spark, sf, "responses_fx")
    return rows.select("url", text.summary_struct(c("text"), c("response")).alias("s")).select("url", "s.*")


@query("response_fields", f"""{cte('long_responses_fx')}
SELECT url, {TOKENS} AS n_tokens, regexp_extract(response, 'Headline: ([^\\n]*)', 1) AS title,
  regexp_extract(response, 'Topics: ([^\\n]*)', 1) AS other_topic,
  regexp_extract(response, 'Creation DateTime: ([^\\n]*)', 1) AS creation_datetime,
  regexp_extract(response, 'Update DateTime: ([^\\n]*)', 1) AS modified_datetime, {SUMMARY} AS body, '' AS image_url
FROM long_responses_fx""")
def response_fields(spark, sf):
    return fixture(spark, sf, "long_responses_fx").select(
        "url", text.response_struct(c("response")).alias("r")).select("url", "r.*")


@query("summary_passthrough", f"""{R}
SELECT url, CASE WHEN failed THEN '' WHEN response IS NULL OR contains({SUMMARY}, 'BodyNotFound') THEN text ELSE {SUMMARY} END AS body,
  CASE WHEN failed THEN 0 WHEN response IS NULL OR contains({SUMMARY}, 'BodyNotFound') THEN -1 ELSE {TOKENS} END AS n_tokens,
  CASE WHEN failed THEN '4' ELSE '0' END AS status_code FROM responses_fx""")
def summary_passthrough(spark, sf):
    s = text.summary_or_text(c("text"), c("response"), c("failed"))
    return fixture(spark, sf, "responses_fx").select("url", s.alias("s")).select("url", "s.*")


INSTRUCTION = (
    "Summarise the article in its own language and in the third person. "
    "Answer with the token count after 'Tokens:' and the summary after 'Body Summary:'."
)


@query("summary_request", f"""
SELECT doc_id, '{INSTRUCTION.replace("'", "''")}' AS instruction,
  regexp_replace(regexp_replace(text, '<[^\\n]*?>', '', 'g'), '\\n+', chr(10), 'g') AS content FROM documents""")
def summary_request(spark, sf):
    rows = table(spark, sf, "documents")
    content = text.collapse_newlines(text.strip_tags(c("text")))
    return rows.select("doc_id", F.lit(INSTRUCTION).alias("instruction"), content.alias("content"))


@query("summarizer", f"""{cte('article_pages_fx')},{RECORDS}
SELECT page_id, 'Summary: ' || body AS body, CAST(len(string_split(body, ' ')) AS INT) AS n_tokens FROM records WHERE status_code = '0'""")
def summarizer(spark, sf):
    """The article job with a summariser of the user's own in place of the identity."""

    def own(body):
        return F.struct(F.concat(F.lit("Summary: "), body).alias("body"), F.size(F.split(body, " ")).alias("n_tokens"))

    found = articles.article_outcomes(
        fixture(spark, sf, "article_pages_fx"), as_of(), summariser=own, keep=("page_id",))
    return found.filter("status_code = '0'").select("page_id", "body", "n_tokens")
