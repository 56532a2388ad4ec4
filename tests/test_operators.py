"""Joins, counts, draws and jobs against plain Python on small tables."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates
from newsloom.operators import articles, catalog, feed, links, release, skew
from newsloom.plans import ingest
from newsloom.plans.fixtures import AS_OF, fixture
from newsloom.sources import schemas, sinks, tables
from newsloom.sources.workspace import new_path
from newsloom.streaming import jobs

c = F.col
SF = "/root/testdata/sf0.001"


def now():
    return dates.instant_literal(AS_OF)


@pytest.fixture(scope="module")
def keyed(spark):
    rng = random.Random(1)
    keys = ["hot"] * 400 + [f"k{rng.randrange(40)}" for _ in range(300)] + [None] * 50
    rng.shuffle(keys)
    return spark.createDataFrame(list(enumerate(keys)), "i int, k string").repartition(6)


@pytest.mark.parametrize("limit", [skew.BROADCAST_BYTES, 0])
def test_attach_by_key_both_ways(keyed, limit):
    counts = skew.count_per_key(keyed, "k", "n")
    got = skew.attach_by_key(keyed, counts, "k", "n", broadcast_bytes=limit).collect()
    expected = Counter(r["k"] for r in keyed.collect())
    assert len(got) == 750 and len({r["i"] for r in got}) == 750
    assert all(r["n"] == (expected[r["k"]] if r["k"] else None) for r in got)


def test_hot_key_is_split(keyed):
    counts = skew.count_per_key(keyed, "k", "n")
    parts = skew.attach_by_key(keyed, counts, "k", "n", broadcast_bytes=0)
    assert "_part" in parts._jdf.queryExecution().optimizedPlan().toString()


def test_collect_in_parts(spark):
    rows = spark.createDataFrame(
        [("big", f"u{i % 250}") for i in range(300)] + [("small", "u1")], "d string, url string")
    got = skew.collect_in_parts(rows, "d", ["url"], "url", parts=8).collect()
    parts = {(r["d"], x["url"]): r["part"] for r in got for x in r["records"]}
    big = [x for r in got if r["d"] == "big" for x in r["records"]]
    assert len([r for r in got if r["d"] == "big"]) == 8
    assert len(big) == 250 and sum(x["copies"] for x in big) == 300
    # The part of a record depends on the record alone.
    assert parts["small", "u1"] == parts["big", "u1"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("limit", [1, 2])
def test_edit_pairs_equal_brute_force(spark, limit):
    rng = random.Random(2)
    words = {"", "a", "ñ", "ab", "deporte", "deportes", "moda", "moto"} | {
        "".join(rng.choice("abñ") for _ in range(rng.randrange(7))) for _ in range(60)}
    df = spark.createDataFrame([(w,) for w in words] * 2, "topic string")
    got = {(r[0], r[1], r[2]) for r in catalog.topic_edit_pairs(df, limit=limit).collect()}
    brute = {(a, b, distance(a, b)) for a, b in itertools.product(words, words)
             if a.encode() < b.encode() and distance(a, b) <= limit}
    assert got == brute


@pytest.mark.parametrize("limit", [1, 2])
def test_edit_pairs_of_long_words_equal_brute_force(spark, limit):
    rng = random.Random(3)
    words = set()
    for size in (31, 32, 33, 34, 35, 60):
        for _ in range(4):
            word = "".join(rng.choice("abcñ") for _ in range(size))
            words.add(word)
            for _ in range(6):
                w = list(word)
                for _ in range(rng.randint(1, 3)):
                    i = rng.randrange(len(w))
                    w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
                words.add("".join(w))
    df = spark.createDataFrame([(w,) for w in words], "topic string")
    got = {(r[0], r[1], r[2]) for r in catalog.topic_edit_pairs(df, limit=limit).collect()}
    brute = {(a, b, distance(a, b)) for a, b in itertools.product(words, words)
             if a.encode() < b.encode() and abs(len(a) - len(b)) <= limit and distance(a, b) <= limit}
    assert got == brute and len(got) > 20


def test_edit_pairs_of_very_long_words(spark):
    words = ["ab" * 1000, "ab" * 1000 + "c", "x" + "ab" * 1000, "y" * 2000]
    df = spark.createDataFrame([(w,) for w in words], "topic string")
    got = catalog.topic_edit_pairs(df).collect()
    assert sorted(r[2] for r in got) == [1, 1, 2]


@pytest.mark.parametrize("limit", [1, 2])
def test_only_words_within_the_limit_share_an_edit_key(spark, limit):
    rng = random.Random(4)
    words = {"", "a", "b", "ab", "aab"} | {"x" + "".join(rng.choice("0123") for _ in range(rng.randrange(7))) for _ in range(120)}
    x, y = catalog._edit_keys(spark.createDataFrame([(w,) for w in words], "word string"), limit)
    met = x.withColumnRenamed("word", "x").join(y.withColumnRenamed("word", "y"), "form").select("x", "y").distinct()
    got = {tuple(sorted(r)) for r in met.collect() if r[0] != r[1]}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(words), 2) if distance(a, b) <= limit}


def test_edit_pairs_have_parts_by_the_number_of_words(spark, monkeypatch):
    """Parts of few bytes of keys, which make many pairs, are not merged."""
    monkeypatch.setattr(catalog, "WORDS_AT_ONCE", 5, raising=False)
    df = spark.createDataFrame([(f"x{i}",) for i in range(8, 2000, 9)], "topic string")
    many = df.count() // 5
    assert many > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    used = catalog.topic_edit_pairs(df).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > many // 2


def test_substring_semi_equals_brute_force(spark):
    topics = ["deportes", "sport", "a", "", "economia", "eco", "x", None]
    stems = ["eco", "port", "zz"]
    rows = spark.createDataFrame([(t,) for t in topics] * 3, "topic string")
    keys = spark.createDataFrame([(s,) for s in stems], "topic_stem string")
    got = sorted(r[0] for r in catalog.topic_substring_semi(rows, keys).collect())
    assert got == sorted([t for t in topics if t and any(s in t for s in stems)] * 3)


def test_minmax_of_equal_values_is_null(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r["n"] for r in catalog.minmax_normalise(df, "x", "n").collect()] == [None, None]


def test_ranked_twice_gives_two_rows(spark):
    sections = spark.createDataFrame([("www.a.com", "u", "t", 7)],
                                     "domain string, url string, topic string, topic_score bigint")
    ranking = spark.createDataFrame([("a.com", 10.0), ("a.com|b.com", 20.0), ("c.com", 5.0)],
                                    "domain string, overall double")
    got = sorted(r["score"] for r in catalog.score_sections(sections, ranking).collect())
    assert got == pytest.approx([7.0, math.sqrt(50)])


def test_draw(spark):
    rows = spark.createDataFrame(
        [(f"u{i}", f"d{i % 3}", float(i % 5)) for i in range(60)],
        "url string, description string, score double")
    first = release.pick_one_per_description(release.described_news(rows), "a").collect()
    again = release.pick_one_per_description(release.described_news(rows), "a").collect()
    other = release.pick_one_per_description(release.described_news(rows), "b").collect()
    assert len(first) == 3 and sorted(first) == sorted(again) and sorted(first) != sorted(other)


def test_draw_follows_the_weights(spark):
    seeds = spark.range(6000).select(c("id").cast("string").alias("seed"))
    rows = spark.createDataFrame([("light", 1.0), ("heavy", 3.0), ("never", 0.0)], "url string, w double")
    from newsloom.functions.util import hash32

    u = (hash32(F.concat("seed", "url")) + 0.5) / F.lit(4294967296.0)
    key = F.when(c("w") > 0, -F.ln(u) / c("w")).otherwise(F.lit(float("inf")))
    won = seeds.join(F.broadcast(rows)).groupBy("seed").agg(F.min_by("url", key).alias("url"))
    share = {r["url"]: r["n"] / 6000 for r in won.groupBy("url").agg(F.count("*").alias("n")).collect()}
    assert share["heavy"] == pytest.approx(0.75, abs=0.03) and "never" not in share


def test_release_partitions_pending(spark):
    news = fixture(spark, SF, "news_fx")
    pending = tables.pending_news(news)
    decided = release.split_released_held(pending, "s")
    counts = {r["decision"]: r["n"] for r in decided.groupBy("decision").agg(F.count("*").alias("n")).collect()}
    described = release.described_news(pending)
    assert counts["release"] == described.select("description").distinct().count()
    assert counts["release"] + counts["hold"] == pending.count()
    assert release.rows_to_mark(pending, "s").count() == counts["hold"]
    after = release.release_run(news, "s", F.current_timestamp())
    assert tables.pending_news(after).count() == 0


def test_feed_pages_join_up(spark):
    news = fixture(spark, SF, "news_fx")
    both = feed.feed_page(news, rows=20).collect()
    assert both[:10] == feed.feed_page(news).collect()
    second = feed.feed_page(news, offset=10).collect()
    last = both[9]
    assert second == both[10:] == feed.feed_after(
        news, last["created_at"], last["score"], last["url"]).collect()


def test_section_documents(spark):
    path = new_path(spark, "document")
    doc = '{"a.com":{"records":[["https://a.com/x/","x",8.5],["https://a.com/y/","y",7]]},"b.es":{"records":[]}}'
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.text(path)
    got = sorted(tuple(r) for r in tables.scan_section_documents(spark, path).collect())
    assert got == [("a.com", "https://a.com/x/", "x", 8.5), ("a.com", "https://a.com/y/", "y", 7.0)]


def test_list_files_and_latest(spark):
    path = new_path(spark, "versions")
    for n in (2, 10):
        spark.createDataFrame([("x",)], "v string").write.text(f"{path}/source_urls_v{n}.json")
    names = spark.createDataFrame([("source_urls_v2.json",), ("source_urls_v10.json",)], "name string")
    assert tables.latest_version(names).first()["version"] == 10
    assert tables.list_files(spark, f"{path}/source_urls_v*.json").count() >= 2


# ---- ingest ------------------------------------------------------------------

@pytest.fixture(scope="module")
def article_pages(spark):
    path = new_path(spark, "article-pages")
    fixture(spark, SF, "article_pages_fx").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def stored(spark, folder):
    news = spark.read.parquet(f"{folder}/news").select("url", "media_url", "title", "article_body")
    bad = spark.read.parquet(f"{folder}/garbage").select("url", "media_url", "status_code")
    return sorted(map(tuple, news.collect()), key=repr), sorted(map(tuple, bad.collect()), key=repr)


def test_both_ways_of_fetching_agree(spark, article_pages):
    new = article_pages.select("media_url", "url", "score").unionByName(
        spark.createDataFrame([("m", "u-without-page", 1.0)], "media_url string, url string, score double"))
    a = ingest.fetched_outcomes(new, article_pages, now())
    b = ingest.fetched_outcomes(new, article_pages, now(), broadcast_rows=0)
    columns = sorted(a.columns)
    rows = sorted(map(repr, a.select(columns).collect()))
    assert rows == sorted(map(repr, b.select(columns).collect())) and len(rows) == new.count()


def test_ingest_is_idempotent_and_streams_equal(spark, article_pages):
    folder = new_path(spark, "ingest")
    candidates = article_pages.select("media_url", "url", "score")
    run = lambda batch: ingest.run_ingest(
        candidates, article_pages, f"{folder}/news", f"{folder}/garbage", now(), batch)
    stats = run("b1")
    total = stats.agg(F.sum("n_scraped"), F.sum("n_inserted")).first()
    first = stored(spark, folder)
    urls = {r["url"] for r in article_pages.collect()}
    assert {r[0] for r in first[0]} | {r[0] for r in first[1]} == urls
    assert not {r[0] for r in first[0]} & {r[0] for r in first[1]}
    assert total[0] == len(urls) and total[1] == len(first[0])
    run("b1")
    assert stored(spark, folder) == first
    again = run("b2")
    assert stored(spark, folder) == first
    # The valid links are all stored now: scraped again, none inserted, so each media warns.
    repeats = again.agg(F.sum("n_scraped"), F.sum("n_to_process"), F.sum("n_inserted")).first()
    assert tuple(repeats) == (len(first[0]), 0, 0)
    assert not [r for r in again.collect() if r["n_scraped"] and r["warning"] != "0 insertions to db"]

    work = new_path(spark, "stream")
    arriving = (spark.readStream.schema(article_pages.schema).option("maxFilesPerTrigger", 1)
                .parquet(article_pages.inputFiles()[0].rsplit("/", 1)[0]))
    jobs.stream_new_pages(arriving, f"{work}/news", f"{work}/garbage", f"{work}/cp",
                          now()).awaitTermination()
    assert stored(spark, work) == first


def test_statistics_of_known_and_rejected_links(spark):
    """Known valid links are scraped links and warn; a media with rejects alone does not."""
    from newsloom.operators import stats

    pair = "url string, media_url string"
    site = "https://{}.example.com"
    known = [(f"{site.format('a')}/es/a-b-c-d-{i}", site.format("a")) for i in range(2)]
    rejected = [(f"{site.format('b')}/es/report-1.pdf", site.format("b"))]
    other = [(f"{site.format('z')}/es/a-b-c-d-1", site.format("z"))]
    candidates = spark.createDataFrame([(*x, 1.0) for x in known + rejected], f"{pair}, score double")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    news = spark.createDataFrame(known + other, pair)
    for rows in (10, 0):
        outcomes = ingest.ingest(candidates, spark.createDataFrame([], pair), news, pages, now(), broadcast_rows=rows)
        got = {r["media_url"]: (r["n_scraped"], r["n_known"], r["n_inserted"], r["warning"])
               for r in stats.media_ingest_stats(stats.ingest_events(outcomes, news)).collect()}
        assert got == {site.format("a"): (2, 2, 0, "0 insertions to db"), site.format("b"): (0, 0, 0, "")}


def test_last_of_several_fetches_counts(spark):
    url, media = "https://a.example.com/es/a-b-c-d-1", "https://a.example.com"
    new = spark.createDataFrame([(media, url, 1.0), (media, url + "2", 1.0)], "media_url string, url string, score double")
    rows = [(1, url, "<html><head></head></html>"), (3, url, "<div>"), (2, url, "<html>"), (3, url, "<div>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for limit in (10, 0):
        got = ingest.fetched_outcomes(new, pages, now(), broadcast_rows=limit).select("url", "status_code").collect()
        assert sorted(map(tuple, got)) == [(url, "5_8"), (url + "2", "1_2")]


def test_append_takes_each_url_once(spark):
    path = new_path(spark, "garbage")
    rows = spark.createDataFrame(
        [("u1", "m", "3_2"), ("u1", "m", "3_2"), ("u1", "n", "3_6")],
        "url string, media_url string, status_code string").withColumn("inserted_at", now())
    from newsloom.sources import schemas

    for batch in ("b1", "b2"):
        others = ingest.open_table(spark, path, schemas.GARBAGE).filter(c("batch_id") != batch)
        sinks.append_garbage(rows.select("url", "media_url", "inserted_at", "status_code"), others, path, batch)
    assert ingest.open_table(spark, path, schemas.GARBAGE).count() == 2


def test_classify_is_total(spark):
    rows = links.classify_urls(fixture(spark, SF, "candidates_fx"))
    codes = {r[0] for r in rows.select("status_code").distinct().collect()}
    assert codes == {"0", "3_1", "3_2", "3_3", "3_4", "3_5", "3_6"}
    good, bad = links.with_rejects(rows)
    assert good.count() + bad.count() == rows.count()


def test_article_columns_have_no_null_text(spark, article_pages):
    good = articles.article_outcomes(article_pages, now()).filter("status_code = '0'")
    assert all(v is not None for r in articles.article_columns(good).collect() for v in r)


def test_shared_folder(spark, monkeypatch):
    from newsloom.sources import workspace

    assert workspace.new_path(spark, "x") != workspace.new_path(spark, "x")
    monkeypatch.setattr(workspace, "SETTING", "spark.newsloom.unset")
    assert workspace.shared_folder(spark) == workspace.shared_folder(spark)


def test_section_links_both_ways(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    sections = fixture(spark, SF, "page_sections_fx")
    a = links.section_links(pages, sections)
    b = links.section_links(pages, sections, broadcast_rows=0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_known_urls_both_ways(spark):
    rows = fixture(spark, SF, "candidates_fx").select("media_url", "url").distinct()
    known = fixture(spark, SF, "known_urls_fx")
    ways = [links.drop_known_news(rows, links.stored_among(known, rows, ["url"], n)) for n in (0, 10**6)]
    plain = links.drop_known_news(rows, known)
    assert all(sorted(w.collect()) == sorted(plain.collect()) for w in ways)


def test_topic_suggest(spark):
    from newsloom.sources.schemas import suggested_topics

    def words(typed):
        return sorted(r[0] for r in feed.topic_suggest(suggested_topics(spark), typed).collect())

    assert words(" BALON ") == ["baloncesto", "balonmano"]
    assert words("  ") == [] and words("zzz") == []


def test_stream_of_five_batches_with_repeats_and_a_restart(spark, article_pages):
    """The state of the urls gives what the batch job finds in the stored tables."""
    pages = article_pages.filter("page_id < 70").select("page_id", "url", "media_url", "score", "html").collect()
    rng = random.Random(5)
    parts = [pages[i::5] + rng.sample(pages, 20) for i in range(5)]
    # Other media for known urls, a later fetch in one batch, a bad link, rows without media or score.
    other = "https://other.example.org"
    parts[1] += [(r.page_id + 1000, r.url, other, 2.0, r.html) for r in pages[:20]]
    parts[3] += [(r.page_id + 2000, r.url, r.media_url, None, "<html>") for r in pages[:30]]
    parts[4] += [(9000, f"{other}/report.pdf", other, 1.0, "<html>"), (9001, pages[3].url, None, 1.0, pages[3].html)]
    schema = "page_id bigint, url string, media_url string, score double, html string"
    folder, work, arriving = new_path(spark, "five"), new_path(spark, "five-stream"), new_path(spark, "five-arriving")
    tables = [spark.createDataFrame([tuple(r) for r in part], schema) for part in parts]
    for i, table in enumerate(tables):
        ingest.run_ingest(table.select("media_url", "url", "score"), table, f"{folder}/news", f"{folder}/garbage", now(), f"b{i}")

    def start():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arriving)
        query = jobs.stream_new_pages(stream, f"{work}/news", f"{work}/garbage", f"{work}/cp", now())
        query.awaitTermination()
        return query

    for table in tables[:3]:
        table.coalesce(1).write.mode("append").parquet(arriving)
    start()
    for table in tables[3:]:
        table.coalesce(1).write.mode("append").parquet(arriving)
    last = start()
    assert stored(spark, work) == stored(spark, folder)
    used = [o["customMetrics"] for p in last.recentProgress for o in p["stateOperators"]]
    assert used and all("rocksdbGetCount" in m for m in used)


def test_records_reach_the_state_as_one_column_and_come_back_whole(spark):
    """Columns of a group cost their time for every url; nulls, NaN and numbers stay as they are."""
    schema = ("url string, media_url string, score double, link_code string, status_code string, "
              "title string, n_tokens int, fetch_time double, fetch_order bigint")
    rows = [
        ("u1", "m", 0.1, "0", "0", "a,\"b\nñ", 7, 1.5, 2**53 + 1), ("u1", "m", 0.1, "0", "5_6", None, None, 1.5, 2**53),
        ("u2", None, float("nan"), "3_2", "0", "", -1, 1.7e9, -1), ("u3", "m", 1e-300, "0", "5_8", None, None, 0.0, 0),
    ]
    work = new_path(spark, "packed")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{work}/rows")
    fresh = jobs.first_outcomes(spark.readStream.schema(schema).parquet(f"{work}/rows"))
    node = re.search(r"FlatMapGroupsInPandasWithState.*", fresh._jdf.queryExecution().analyzed().toString()).group()
    assert "record" in node and "title" not in node
    assert fresh.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    with jobs.state_on_disk(spark):
        query = (fresh.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/cp")
                 .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    got = {tuple(r) for r in spark.read.schema(schema).parquet(f"{work}/out").collect()}
    assert got == {rows[0], ("u2", None, None, "3_2", "3_2", "", -1, 1.7e9, -1), rows[3]}


def test_known_rows_enter_the_state_under_a_timeout(spark, article_pages):
    from datetime import timedelta

    from newsloom.operators import links

    some = article_pages.filter("page_id < 40").select("page_id", "url", "media_url", "score", "html")
    valid = links.classify_urls(some).filter("status_code = '0'").drop("status_code")
    work = new_path(spark, "known")
    valid.write.parquet(f"{work}/pages")
    valid.select("url", "media_url", F.lit("0").alias("status_code")).write.parquet(f"{work}/known")
    read = lambda name: spark.readStream.schema(spark.read.parquet(f"{work}/{name}").schema).parquet(f"{work}/{name}")
    query = jobs.stream_new_pages(read("pages"), f"{work}/news", f"{work}/garbage", f"{work}/cp", now(),
                                  known=read("known"), keep_for=timedelta(days=30))
    assert query.awaitTermination(90)
    for name, schema in (("news", schemas.NEWS), ("garbage", schemas.GARBAGE)):
        assert ingest.open_table(spark, f"{work}/{name}", schema).isEmpty()
    rows = sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"])
    assert rows == valid.select("url").distinct().count() > 0
