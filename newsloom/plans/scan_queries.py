"""Registered queries: scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import dates
from newsloom.functions.stemming import with_stem
from newsloom.operators import articles, catalog, links
from newsloom.plans import ingest as ingest_plan
from newsloom.plans.check_sql import part_of, status_of_url, stem_ctes
from newsloom.plans.fixtures import AS_OF, cte, fixture
from newsloom.plans.registry import query
from newsloom.sources import keys, schemas, sinks, tables
from newsloom.sources.workspace import new_path

MEDIA = "https://src1.example.com"

SCORED = f"""
counted AS (SELECT s.*, count(*) OVER (PARTITION BY topic) AS topic_score FROM sections_fx s),
joined AS (SELECT c.domain, c.url, c.topic, c.topic_score, r.overall
  FROM counted c JOIN ranking_fx r ON regexp_replace(c.domain, '^www\\.', '') = r.domain),
scored AS (SELECT domain, url, topic, overall, sqrt(power(coalesce((overall - (SELECT min(overall) FROM joined)) /
    nullif((SELECT max(overall) - min(overall) FROM joined), 0), 0), 2) + power(topic_score, 2)) AS score FROM joined)"""


def scored_sections(spark, sf):
    """Sections with their topic count and score (topics counted as they are)."""
    counted = catalog.with_count(fixture(spark, sf, "sections_fx"), "topic", "topic_score")
    return catalog.score_sections(counted, fixture(spark, sf, "ranking_fx"))


@query("scan_pages", "SELECT page_id, url, html FROM pages")
def scan_pages(spark, sf):
    return tables.scan_pages(spark, f"{sf}/pages.parquet")


@query("scan_sections", f"""{cte('sections_fx', 'ranking_fx')},{SCORED}
SELECT domain, url, topic, round(score, 6) AS score, count(*) AS copies FROM scored GROUP BY ALL""")
def scan_sections(spark, sf):
    path = new_path(spark, "sections")
    sinks.write_sections(catalog.domain_records(scored_sections(spark, sf)), path)
    return tables.scan_sections(spark, path).withColumn("score", F.round("score", 6))


@query("scan_section_documents", f"""{cte('sections_fx')}
SELECT domain, url, topic, CAST(length(topic) / 2.0 AS DOUBLE) AS score FROM sections_fx""")
def scan_section_documents(spark, sf):
    """Catalogue files of the form {domain: {"records": [[url, topic, score]]}}, one object per file."""
    path = new_path(spark, "section-documents")
    record = F.array(F.concat(F.lit(" "), "url"), "topic", (F.length("topic") / 2.0).cast("string"))
    entries = fixture(spark, sf, "sections_fx").groupBy("domain", (F.crc32(F.col("url").cast("binary")) % 64).alias("part")).agg(
        F.struct(F.collect_list(record).alias("records")).alias("entry"))
    objects = entries.select(F.to_json(F.create_map("domain", "entry")).alias("value"))
    objects.write.option("maxRecordsPerFile", 1).text(path)
    return tables.scan_section_documents(spark, path)


@query("scan_ranking", f"{cte('ranking_fx')} SELECT * FROM ranking_fx")
def scan_ranking(spark, sf):
    path = new_path(spark, "ranking")
    sinks.write_ranking(
        fixture(spark, sf, "ranking_fx").select(*[
            c.split()[0] for c in schemas.RANKING.split(", ")
        ]), path)
    return tables.scan_ranking(spark, path)


@query("general_media", f"""{cte('raw_ranking_fx')}
SELECT trim(Media) AS media, trim(Domain) AS domain, Country AS country, Region AS region,
  Language AS language, Overall AS overall FROM raw_ranking_fx""")
def general_media(spark, sf):
    return tables.general_media(fixture(spark, sf, "raw_ranking_fx"))


@query("special_media", f"""{cte('special_media_fx')}
SELECT trim(Media) AS media, trim(Domain) AS domain, CAST(1 AS DOUBLE) AS overall, 'Spain' AS country,
  'Western Europe' AS region, 'Spanish' AS language FROM special_media_fx""")
def special_media(spark, sf):
    path = new_path(spark, "special")
    fixture(spark, sf, "special_media_fx").write.csv(path, sep=";", header=True)
    return tables.scan_special_media(spark, path)


@query("scan_ranking_text", f"""{cte('ranking_text_fx')}
SELECT media, string_split(domain, '|')[1] AS domain, score FROM ranking_text_fx""")
def scan_ranking_text(spark, sf):
    path = new_path(spark, "ranking-text")
    fixture(spark, sf, "ranking_text_fx").write.csv(path, sep=";")
    return tables.scan_ranking_text(spark, path)


@query("latest_version", f"""{cte('files_fx')},
v AS (SELECT name, TRY_CAST(regexp_extract(name, '_v([0-9]+)\\.[a-z]+$', 1) AS INT) AS n,
  CAST(TRY_CAST(regexp_replace(regexp_extract(name, '_([0-9]{{8}})\\.[a-z]+$', 1), '(..)(..)(....)', '\\3-\\2-\\1') AS DATE) AS DATE) AS d
  FROM files_fx)
SELECT (SELECT max(n) FROM v) AS version,
  (SELECT max(name) FROM v WHERE n = (SELECT max(n) FROM v)) AS name_by_version,
  (SELECT max(d) FROM v) AS version_date,
  (SELECT max(name) FROM v WHERE d = (SELECT max(d) FROM v)) AS name_by_date""")
def latest_version(spark, sf):
    return tables.latest_version(fixture(spark, sf, "files_fx"))


@query("news_urls_of_media", f"{cte('news_fx')} SELECT url FROM news_fx WHERE media_url = '{MEDIA}'")
def news_urls_of_media(spark, sf):
    return tables.news_urls_of_media(fixture(spark, sf, "news_fx"), MEDIA)


@query("garbage_of_media", f"{cte('garbage_fx')} SELECT url, media_url FROM garbage_fx WHERE media_url = '{MEDIA}'")
def garbage_of_media(spark, sf):
    return tables.garbage_of_media(fixture(spark, sf, "garbage_fx"), MEDIA)


@query("pending_news", f"""{cte('news_fx')}
SELECT * FROM news_fx WHERE processed_at IS NULL AND NOT preprocessed""")
def pending_news(spark, sf):
    return tables.pending_news(fixture(spark, sf, "news_fx"))


# ---- sinks -------------------------------------------------------------------

def as_of():
    return dates.instant_literal(AS_OF)


@query("append_news", f"""{cte('news_fx')}
SELECT url, media_url, title, description, article_body, main_topic, country, n_tokens, score, preprocessed FROM news_fx""")
def append_news(spark, sf):
    """Two increments, the second one twice: every url is stored once."""
    path = new_path(spark, "news")
    rows = fixture(spark, sf, "news_fx").select(
        "*", F.lit("").alias("other_topic"), F.lit(None).cast("timestamp").alias("modified_at")
    ).select(*[c.split()[0] for c in schemas.NEWS.replace("\n", " ").split(",")])
    stored = ingest_plan.open_table(spark, path, schemas.NEWS)
    sinks.append_news(rows.filter("preprocessed"), stored, path, "b1")
    for _ in range(2):
        stored = ingest_plan.open_table(spark, path, schemas.NEWS)
        sinks.append_news(rows, stored.filter("batch_id <> 'b2'"), path, "b2")
    return ingest_plan.open_table(spark, path, schemas.NEWS).select(
        "url", "media_url", "title", "description", "article_body", "main_topic", "country",
        "n_tokens", "score", "preprocessed",
    )


@query("append_garbage", f"""{cte('candidates_fx', 'garbage_fx')}
SELECT url, media_url, status_code FROM garbage_fx
UNION ALL
SELECT url, media_url, min(status) FROM (SELECT url, media_url, {status_of_url()} AS status FROM candidates_fx) c
WHERE status <> '0' AND NOT EXISTS (SELECT 1 FROM garbage_fx g WHERE g.url = c.url AND g.media_url = c.media_url)
GROUP BY url, media_url""")
def append_garbage(spark, sf):
    path = new_path(spark, "garbage")
    old = fixture(spark, sf, "garbage_fx").select(
        "url", "media_url", as_of().alias("inserted_at"), "status_code")
    sinks.append_garbage(
        old, ingest_plan.open_table(spark, path, schemas.GARBAGE), path, "b1")
    _, bad = links.with_rejects(links.classify_urls(fixture(spark, sf, "candidates_fx")))
    sinks.append_garbage(
        articles.to_garbage_rows(bad, as_of()),
        ingest_plan.open_table(spark, path, schemas.GARBAGE), path, "b2")
    return ingest_plan.open_table(spark, path, schemas.GARBAGE).select(
        "url", "media_url", "status_code")


@query("write_sections", f"""{cte('sections_fx', 'ranking_fx')},{SCORED}
SELECT domain, {part_of('url')} AS part, CAST(count(DISTINCT url || topic) AS BIGINT) AS n_records, count(*) AS n_rows,
  string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics FROM scored GROUP BY domain, part""")
def write_sections(spark, sf):
    path = new_path(spark, "sections")
    sinks.write_sections(catalog.domain_records(scored_sections(spark, sf)), path)
    r = spark.read.schema(schemas.SECTION_RECORDS).json(path)
    total = F.aggregate("records", F.lit(0).cast("bigint"), lambda a, x: a + x["copies"])
    return r.select(
        "domain", "part", F.size("records").cast("bigint").alias("n_records"),
        total.alias("n_rows"), F.array_join(F.array_sort("records.topic"), ",").alias("topics"))


@query("write_stats", f"""{cte('candidates_fx')}
SELECT media_url, status, CAST(count(*) AS BIGINT) AS n FROM
  (SELECT media_url, {status_of_url()} AS status FROM candidates_fx) c GROUP BY ALL""")
def write_stats(spark, sf):
    path = new_path(spark, "stats")
    counts = links.classify_urls(fixture(spark, sf, "candidates_fx")).groupBy(
        "media_url", F.col("status_code").alias("status")).agg(F.count("*").alias("n"))
    sinks.write_stats(counts, path)
    return spark.read.csv(path, sep=";", header=True, schema="media_url string, status string, n bigint")


@query("write_ranking", f"""{cte('ranking_fx', 'special_media_fx')}
SELECT media, domain, country, region, language, overall FROM ranking_fx
UNION ALL SELECT trim(Media), trim(Domain), 'Spain', 'Western Europe', 'Spanish', 1.0 FROM special_media_fx""")
def write_ranking(spark, sf):
    path = new_path(spark, "ranking")
    merged = catalog.merge_rankings(
        fixture(spark, sf, "ranking_fx"),
        tables.special_media(fixture(spark, sf, "special_media_fx")))
    sinks.write_ranking(merged, path)
    return tables.scan_ranking(spark, path)


@query("write_top_media", f"""{cte('media_ranking_fx')}
SELECT media, domain, overall FROM media_ranking_fx ORDER BY overall, media, domain LIMIT 60""")
def write_top_media(spark, sf):
    path = new_path(spark, "top")
    sinks.write_top_media(catalog.top_media(fixture(spark, sf, "media_ranking_fx")), path)
    return spark.read.csv(path, sep=";", schema="media string, domain string, overall double")


@query("write_frequent_topics", f"""{cte('sections_fx')},{stem_ctes('sections_fx', 'topic')}
SELECT stem AS topic_stem FROM sections_fx s JOIN stems t ON s.topic = t.word GROUP BY stem HAVING count(*) > 5""")
def write_frequent_topics(spark, sf):
    path = new_path(spark, "topics")
    stemmed = with_stem(fixture(spark, sf, "sections_fx"), "topic", "topic_stem")
    sinks.write_frequent_topics(catalog.frequent_topics(stemmed), path)
    return spark.read.text(path).withColumnRenamed("value", "topic_stem")


@query("write_region_media", f"""{cte('ranking_fx')}
SELECT region, {part_of("'https://' || domain")} AS part, string_agg(DISTINCT 'https://' || domain, ',' ORDER BY 'https://' || domain) AS media_urls
FROM ranking_fx GROUP BY region, part""")
def write_region_media(spark, sf):
    path = new_path(spark, "regions")
    media = fixture(spark, sf, "ranking_fx").select(
        "region", F.concat(F.lit("https://"), "domain").alias("media_url"))
    sinks.write_region_media(media, path)
    written = spark.read.schema("region string, part bigint, media_urls array<string>").json(path)
    return written.withColumn("media_urls", F.array_join("media_urls", ","))




def keys_by_media(spark, sf, recipe):
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keys.write_keys(fixture(spark, sf, recipe), new_path(spark, f"media-{recipe}"), ["media_url"], buckets, ("url",))


@query("news_urls_of_media_by_keys", f"{cte('news_fx')} SELECT DISTINCT url FROM news_fx WHERE media_url = '{MEDIA}'")
def news_urls_of_media_by_keys(spark, sf):
    return keys.of_media(keys_by_media(spark, sf, "news_fx"), MEDIA)


@query("garbage_of_media_by_keys", f"{cte('garbage_fx')} SELECT DISTINCT url FROM garbage_fx WHERE media_url = '{MEDIA}'")
def garbage_of_media_by_keys(spark, sf):
    return keys.of_media(keys_by_media(spark, sf, "garbage_fx"), MEDIA)
