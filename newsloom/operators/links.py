"""Candidate links: extraction, scoring, classification, known-url removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import html, urls
from newsloom.functions.util import settle

# Up to this many rows of keys, and this many bytes in them, are broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024
HASH_BUCKETS = 1 << 20


def page_links(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per non-empty href of the body of each page."""
    return pages.select(
        *keep, F.posexplode(html.body_hrefs(F.col("html"))).alias("pos", "href")
    )


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows and a broadcast holds its texts.

    Counting stops beyond that number of rows.
    """
    texts = [n for n, t in df.dtypes if t == "string"]
    n, size = df.limit(rows + 1).agg(
        F.count("*"), F.sum(F.octet_length(F.concat_ws("", *texts)))
    ).first()
    return n <= rows and (size or 0) <= BROADCAST_BYTES


def may_match(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``pages`` whose url falls into a hash bucket of a url of ``keys``.

    A filter ahead of a costly step, not a join: some rows without a partner pass. The
    broadcast has at most HASH_BUCKETS numbers, however many keys there are.
    """
    bucket = F.pmod(F.xxhash64("url"), F.lit(HASH_BUCKETS)).cast("int")
    wanted = keys.select(bucket.alias("_bucket")).distinct()
    marked = pages.withColumn("_bucket", bucket)
    return marked.join(F.broadcast(wanted), "_bucket", "left_semi").drop("_bucket")


def section_links(pages: DataFrame, sections: DataFrame,
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Links of section pages with the media and the score of their section.

    ``sections`` is (url, media_url, score). Page texts never move between
    machines: a small catalogue (counted) is broadcast and only section pages
    are parsed; for a larger one the pages whose urls may match are parsed where
    they lie and their link lists are joined.
    """
    hrefs = html.body_hrefs(F.col("html")).alias("hrefs")
    scored = sections.select("url", "media_url", "score")
    if fits_broadcast(scored, broadcast_rows):
        found = pages.select("url", "html").join(F.broadcast(scored), "url").select(
            "media_url", "score", hrefs)
    else:
        found = may_match(pages.select("url", "html"), scored).select("url", hrefs).join(scored, "url")
    link = urls.absolutise(urls.cut_query(F.col("href")), F.col("media_url"))
    return found.select("media_url", "score", F.explode("hrefs").alias("href")).select(
        "media_url", link.alias("url"), "score"
    )


def best_link_score(links: DataFrame) -> DataFrame:
    """One row per (media, url) with the best score; combined map-side."""
    return links.groupBy("media_url", "url").agg(F.max("score").alias("score"))


def distinct_links(links: DataFrame) -> DataFrame:
    return links.select("media_url", "url").distinct()


def stored_among(stored: DataFrame, batch: DataFrame, on: list[str],
                 broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Keys of ``stored`` that can meet ``batch``.

    A small batch (counted) is broadcast to the stored keys, so a large store is
    only read, not shuffled; beyond that all stored keys are kept.
    """
    keys = batch.select(*on)
    if fits_broadcast(keys, broadcast_rows):
        return stored.select(*on).join(F.broadcast(keys), on, "left_semi")
    return stored.select(*on)


def drop_known_garbage(candidates: DataFrame, garbage: DataFrame) -> DataFrame:
    """Candidates that are not yet rejected for their media."""
    known = garbage.select("url", "media_url")
    return candidates.join(known, ["media_url", "url"], "left_anti")


def drop_known_news(candidates: DataFrame, news: DataFrame) -> DataFrame:
    """Candidates whose url is not stored yet."""
    return candidates.join(news.select("url"), "url", "left_anti")


def classify_urls(candidates: DataFrame) -> DataFrame:
    """Add the status code of the url rules."""
    return candidates.withColumn(
        "status_code", urls.classify(F.col("url"), F.col("media_url"))
    )


def with_rejects(statused: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split one statused table: good rows, and rejects as garbage rows."""
    good = statused.filter(F.col("status_code") == "0").drop("status_code")
    bad = statused.filter(F.col("status_code") != "0").select(
        "url", "media_url", "status_code"
    )
    return good, bad


# ---- section pages of a media ------------------------------------------------

def section_candidates(pages: DataFrame) -> DataFrame:
    """Valid section urls of fetched home pages (page url, domain, section url)."""
    home = pages.select(F.col("url").alias("page_url"), "html").withColumn(
        "domain", urls.domain(F.col("page_url"))
    )
    links = home.select(
        "page_url", "domain", F.explode(html.body_hrefs(F.col("html"))).alias("href")
    ).withColumn("url", urls.section_canonical(F.col("href"), F.col("page_url")))
    return (
        links.filter(urls.valid_section_url(F.col("url"), F.col("domain")))
        .select("domain", "url")
        .distinct()
    )


def one_segment_urls(links: DataFrame) -> DataFrame:
    """Urls with exactly one path segment; the segment is the topic."""
    split = settle(links.withColumn("_segments", urls.path_segments(F.col("url"))))
    return (
        split.filter(F.size("_segments") == 1)
        .withColumn("topic", F.get("_segments", F.lit(0)))
        .filter(F.col("topic") != "")
        .drop("_segments")
    )


def region_links(links: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Region pages among links: root-relative ``.php`` hrefs; name without ends."""
    href = F.col("href")
    kept = links.filter(href.endswith(".php") & href.startswith("/"))
    for part in ignored:
        kept = kept.filter(~href.contains(part))
    return kept.select(
        "href", F.substr(href, F.lit(2), F.length(href) - 5).alias("region")
    ).distinct()
