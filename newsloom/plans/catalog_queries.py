"""Registered queries: section catalogue (joins, counts, scores, similar topics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import stemming
from newsloom.operators import catalog, links
from newsloom.plans.check_sql import PAGE_HREFS, part_of, stem_ctes
from newsloom.plans.fixtures import cte, fixture, table
from newsloom.plans.registry import query
from newsloom.plans.scan_queries import SCORED, scored_sections
from newsloom.sources import tables


def sections(spark, sf):
    """Sections whose stem is the topic itself (the stemmer has its own query)."""
    return fixture(spark, sf, "sections_fx").withColumn("topic_stem", F.col("topic"))


def ranking(spark, sf):
    return fixture(spark, sf, "ranking_fx")


S = cte("sections_fx")
SR = cte("sections_fx", "ranking_fx")


@query("score_sections", f"""{SR},{SCORED}
SELECT domain, url, topic, overall, round(score, 6) AS score FROM scored""")
def score_sections(spark, sf):
    return scored_sections(spark, sf).withColumn("score", F.round("score", 6))


@query("merge_rankings", f"""{cte('ranking_fx', 'special_media_fx')},
general AS (SELECT media, domain, country, region, language, overall FROM ranking_fx
  UNION ALL SELECT trim(Media), trim(Domain), 'Spain', 'Western Europe', 'Spanish', 1.0 FROM special_media_fx WHERE Media LIKE ' en-%'),
special AS (SELECT trim(Media) AS media, trim(Domain) AS domain, 'Spain' AS country, 'Western Europe' AS region,
  'Spanish' AS language, 1.0 AS overall FROM special_media_fx)
SELECT media, domain, country, region, language, CAST(overall AS DOUBLE) AS overall FROM general
UNION SELECT * FROM special""")
def merge_rankings(spark, sf):
    special_raw = fixture(spark, sf, "special_media_fx")
    special = tables.special_media(special_raw)
    general = ranking(spark, sf).unionByName(
        tables.special_media(special_raw.filter("Media LIKE ' en-%'")))
    return catalog.merge_rankings(general, special)


@query("attach_frequencies", f"""{S},
t AS (SELECT topic, count(*) AS n FROM sections_fx GROUP BY topic),
d AS (SELECT domain, count(*) AS n FROM sections_fx GROUP BY domain)
SELECT url, s.topic, s.domain,
  round((t.n - (SELECT min(n) FROM t)) / CAST(nullif((SELECT max(n) - min(n) FROM t), 0) AS DOUBLE), 6) AS freq_topic,
  round((d.n - (SELECT min(n) FROM d)) / CAST(nullif((SELECT max(n) - min(n) FROM d), 0) AS DOUBLE), 6) AS freq_domain
FROM sections_fx s JOIN t ON s.topic = t.topic JOIN d ON s.domain = d.domain""")
def attach_frequencies(spark, sf):
    rows = fixture(spark, sf, "sections_fx")
    both = catalog.attach_frequencies(
        catalog.attach_frequencies(rows, "topic", "freq_topic"), "domain", "freq_domain")
    return both.select(
        "url", "topic", "domain", F.round("freq_topic", 6).alias("freq_topic"),
        F.round("freq_domain", 6).alias("freq_domain"))


@query("frequency_score", f"""{SR},
t AS (SELECT topic, count(*) AS n FROM sections_fx GROUP BY topic),
d AS (SELECT domain, count(*) AS n FROM sections_fx GROUP BY domain),
j AS (SELECT s.url, s.topic, s.domain, r.overall,
  (t.n - (SELECT min(n) FROM t)) / CAST(nullif((SELECT max(n) - min(n) FROM t), 0) AS DOUBLE) AS ft,
  (d.n - (SELECT min(n) FROM d)) / CAST(nullif((SELECT max(n) - min(n) FROM d), 0) AS DOUBLE) AS fd
  FROM sections_fx s JOIN t ON s.topic = t.topic JOIN d ON s.domain = d.domain
  JOIN ranking_fx r ON regexp_replace(s.domain, '^www\\.', '') = r.domain)
SELECT domain, url, topic, round(sqrt(coalesce(ft * ft, 0) + coalesce(fd * fd, 0) + coalesce(power((overall - (SELECT min(overall) FROM j)) /
  nullif((SELECT max(overall) - min(overall) FROM j), 0), 2), 0)), 6) AS score FROM j""")
def frequency_score(spark, sf):
    scored = catalog.frequency_score(sections(spark, sf), ranking(spark, sf))
    return scored.withColumn("score", F.round("score", 6))


@query("unmatched_media", f"""{SR}
SELECT * FROM ranking_fx r WHERE NOT EXISTS
  (SELECT 1 FROM sections_fx s WHERE regexp_replace(s.domain, '^www\\.', '') = r.domain)""")
def unmatched_media(spark, sf):
    return catalog.unmatched_media(fixture(spark, sf, "sections_fx"), ranking(spark, sf))


@query("frequent_topic_rows", f"""{S}
SELECT url, topic, domain FROM sections_fx WHERE topic IN
  (SELECT topic FROM sections_fx GROUP BY topic HAVING count(*) > 5)""")
def frequent_topic_rows(spark, sf):
    return catalog.frequent_topic_rows(sections(spark, sf)).drop("topic_stem")


@query("topic_substring_semi", f"""{S},{stem_ctes('sections_fx', 'topic')},
frequent AS (SELECT stem FROM sections_fx s JOIN stems t ON s.topic = t.word GROUP BY stem HAVING count(*) > 10)
SELECT url, topic, domain FROM sections_fx s WHERE EXISTS (SELECT 1 FROM frequent WHERE contains(s.topic, stem))""")
def topic_substring_semi(spark, sf):
    rows = fixture(spark, sf, "sections_fx")
    frequent = catalog.frequent_topics(stemming.with_stem(rows, "topic", "topic_stem"), above=10)
    return catalog.topic_substring_semi(rows, frequent)


EDIT_PAIRS = f"""{S},
w AS (SELECT DISTINCT topic FROM sections_fx),
p AS (SELECT a.topic AS word_a, b.topic AS word_b, CAST(levenshtein(a.topic, b.topic) AS INT) AS distance
  FROM w a JOIN w b ON a.topic < b.topic AND abs(length(a.topic) - length(b.topic)) < 3)
SELECT * FROM p WHERE distance < 3"""


@query("topic_edit_pairs", EDIT_PAIRS)
def topic_edit_pairs(spark, sf):
    return catalog.topic_edit_pairs(fixture(spark, sf, "sections_fx"))


@query("edit_pairs_sorted", EDIT_PAIRS)
def edit_pairs_sorted(spark, sf):
    return catalog.edit_pairs_sorted(catalog.topic_edit_pairs(fixture(spark, sf, "sections_fx")))


@query("topic_counts", f"{S} SELECT topic AS topic_stem, count(*) AS n FROM sections_fx GROUP BY topic")
def topic_counts(spark, sf):
    return catalog.topic_counts(sections(spark, sf))


@query("domain_counts", f"{S} SELECT domain, count(*) AS n FROM sections_fx GROUP BY domain")
def domain_counts(spark, sf):
    return catalog.domain_counts(sections(spark, sf))


@query("minmax_normalise", f"""{cte('news_fx')}
SELECT url, round((score - (SELECT min(score) FROM news_fx)) /
  nullif((SELECT max(score) - min(score) FROM news_fx), 0), 6) AS norm FROM news_fx""")
def minmax_normalise(spark, sf):
    rows = fixture(spark, sf, "news_fx").select("url", "score")
    return catalog.minmax_normalise(rows, "score", "norm").select(
        "url", F.round("norm", 6).alias("norm"))


@query("section_score", f"""{SR}
SELECT url, topic, round(sqrt(overall * overall + power(length(topic), 2)), 6) AS score
FROM sections_fx s JOIN ranking_fx r ON regexp_replace(s.domain, '^www\\.', '') = r.domain""")
def section_score(spark, sf):
    left = fixture(spark, sf, "sections_fx").withColumn(
        "_d", catalog.urls.strip_www(F.col("domain"))).drop("domain")
    joined = left.join(ranking(spark, sf), F.col("_d") == F.col("domain"))
    norm = catalog.euclid_norm(F.col("overall"), F.length("topic"))
    return joined.select("url", "topic", F.round(norm, 6).alias("score"))


@query("euclid_norm", """
SELECT event_id, round(sqrt(value * value + power(user_id, 2)), 6) AS norm FROM events""")
def euclid_norm(spark, sf):
    norm = catalog.euclid_norm(F.col("value"), F.col("user_id"))
    return table(spark, sf, "events").select("event_id", F.round(norm, 6).alias("norm"))


@query("frequent_topics", f"""{S}
SELECT topic AS topic_stem, count(*) AS n FROM sections_fx GROUP BY topic HAVING count(*) > 5""")
def frequent_topics(spark, sf):
    return catalog.frequent_topics(sections(spark, sf))


@query("domain_records", f"""{SR},{SCORED},
f AS (SELECT domain, url, topic, score, count(*) AS copies FROM scored GROUP BY ALL)
SELECT domain, {part_of('url')} AS part,
  string_agg(url || ' ' || topic || ' ' || CAST(CAST(round(score * 1000000) AS BIGINT) AS VARCHAR) || ' ' || CAST(copies AS VARCHAR), '|' ORDER BY url, topic, score) AS records
FROM f GROUP BY domain, part""")
def domain_records(spark, sf):
    records = catalog.domain_records(scored_sections(spark, sf))
    one = lambda r: F.concat_ws(
        " ", r["url"], r["topic"], F.round(r["score"] * 1000000).cast("bigint").cast("string"),
        r["copies"].cast("string"))
    return records.select(
        "domain", "part", F.array_join(F.transform("records", one), "|").alias("records"))


@query("distinct_domains", f"{S} SELECT count(DISTINCT domain) AS n_domains FROM sections_fx")
def distinct_domains(spark, sf):
    return catalog.distinct_domains(fixture(spark, sf, "sections_fx"))


@query("media_per_region", f"""{cte('ranking_fx')}
SELECT region, count(*) AS n_media, count(DISTINCT region) AS n_regions FROM ranking_fx GROUP BY ROLLUP (region)""")
def media_per_region(spark, sf):
    return catalog.media_per_region(ranking(spark, sf))


@query("topic_domain_scores", f"""{S}
SELECT url, topic, domain, count(*) OVER (PARTITION BY topic) AS topic_score,
  count(*) OVER (PARTITION BY domain) AS domain_score FROM sections_fx""")
def topic_domain_scores(spark, sf):
    return catalog.topic_domain_scores(sections(spark, sf)).select(
        "url", "topic", "domain", "topic_score", "domain_score")


@query("ranking_sorted", f"{cte('ranking_fx')} SELECT * FROM ranking_fx")
def ranking_sorted(spark, sf):
    return catalog.ranking_sorted(ranking(spark, sf))


@query("top_media", f"""{cte('media_ranking_fx')}
SELECT media, domain, overall FROM media_ranking_fx ORDER BY overall, media, domain LIMIT 60""")
def top_media(spark, sf):
    return catalog.top_media(fixture(spark, sf, "media_ranking_fx"))


@query("complete_rows", f"""{cte('news_fx')}
SELECT url, processed_at, score FROM news_fx WHERE processed_at IS NOT NULL""")
def complete_rows(spark, sf):
    return fixture(spark, sf, "news_fx").select("url", "processed_at", "score").dropna("any")


@query("all_section_links", f"""WITH {PAGE_HREFS}
SELECT count(*) AS n_links, count(DISTINCT link) AS n_unique FROM
  (SELECT string_split(url, '/')[1] || '//' || string_split(url, '/')[3] || href AS link FROM page_hrefs) x""")
def all_section_links(spark, sf):
    from newsloom.functions import urls

    found = links.page_links(table(spark, sf, "pages"))
    link = urls.absolutise(F.col("href"), urls.origin(F.col("url")))
    return found.select(link.alias("link")).agg(
        F.count("*").alias("n_links"), F.countDistinct("link").alias("n_unique"))


# ---- stems -------------------------------------------------------------------

@query("topic_stem", f"""WITH words AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS word FROM documents),
named AS (SELECT word FROM words WHERE word <> ''),{stem_ctes('named')}
SELECT stem, count(*) AS n_forms, min(word) AS first_form FROM stems GROUP BY stem""")
def topic_stem(spark, sf):
    """Stems of the distinct words of all documents, with the number of their forms."""
    words = table(spark, sf, "documents").select(
        F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")
    ).filter("word <> ''").distinct()
    return stemming.with_stem(words, "word", "stem").groupBy("stem").agg(
        F.count("*").alias("n_forms"), F.min("word").alias("first_form"))


@query("section_catalogue", f"""{SR},{stem_ctes('sections_fx', 'topic')},
counted AS (SELECT s.*, count(*) OVER (PARTITION BY stem) AS n FROM sections_fx s JOIN stems t ON s.topic = t.word),
joined AS (SELECT c.*, r.overall FROM counted c JOIN ranking_fx r ON regexp_replace(c.domain, '^www\\.', '') = r.domain WHERE n > 5)
SELECT domain, url, topic, overall, round(sqrt(power(coalesce((overall - (SELECT min(overall) FROM joined)) /
  nullif((SELECT max(overall) - min(overall) FROM joined), 0), 0), 2) + n * n), 6) AS score FROM joined""")
def section_catalogue(spark, sf):
    """The whole catalogue job: stems, frequent topics, ranking join, scores."""
    rows = fixture(spark, sf, "sections_fx").select("url")
    scored = catalog.section_catalogue(rows, ranking(spark, sf))
    return scored.withColumn("score", F.round("score", 6))
