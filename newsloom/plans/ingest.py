"""The ingest job: candidate links and fetched pages -> news and garbage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import articles, links, stats
from newsloom.sources import schemas, sinks
from newsloom.sources.workspace import write_through

MISSING_PAGE = "1_2"


# Of several fetches of a url the last is taken: by the first of these columns that differs,
# or by the hash of the text where the pages have none of them.
FETCH_ORDER = ("fetched_at", "page_id")


def fetched_outcomes(new: DataFrame, pages: DataFrame, as_of: Column,
                     broadcast_rows: int = links.BROADCAST_ROWS,
                     summariser: articles.Summariser = text.identity_summary) -> DataFrame:
    """Outcome of each new candidate (media_url, url, score) from its fetched page.

    Page texts never move between machines. Few candidates (counted) are
    broadcast to the pages, and only their pages are parsed. Beyond that the
    pages whose urls may match are parsed where they lie and the much smaller records
    are joined.
    Of a url that was fetched several times the last fetch counts; for few
    candidates it is chosen on the small columns before any text is read.
    Candidates without a page get the code of a failed request.
    """
    order = [F.col(c) for c in FETCH_ORDER if c in pages.columns] or [F.xxhash64("html").alias("text")]
    names = [c for c in ("url", "html", "fetch_error") if c in pages.columns]
    pages = pages.select(*names, F.struct(*order).alias("_order"))
    wanted = new.select("media_url", "url", "score")
    columns = ["media_url", "url"]
    if links.fits_broadcast(new, broadcast_rows):
        keys = pages.select("url", "_order").join(F.broadcast(new.select("url").distinct()), "url", "left_semi")
        last = write_through(keys.groupBy("url").agg(F.max("_order").alias("_order")), "last-fetch")
        # No more rows than candidates, so as small as these.
        chosen = pages.join(F.broadcast(last), ["url", "_order"]).join(F.broadcast(wanted), "url")
        found = articles.article_outcomes(chosen, as_of, summariser)
        reached = last.select("url")
    else:
        unscored = links.may_match(pages, wanted).select(
            "*", F.lit(None).cast("string").alias("media_url"),
            F.lit(None).cast("double").alias("score"),
        )
        parsed = articles.article_outcomes(unscored, as_of, summariser, keep=("_order",))
        found = parsed.drop("media_url", "score").join(wanted, "url")
        reached = pages.select("url")
        columns += ["_order"]
    # Fetches that are equal in all that orders them are the same; one of them stays.
    fields = [c for c in found.columns if c not in ("media_url", "url", "_order")]
    found = (
        found.groupBy("media_url", "url")
        .agg(F.max_by(F.struct(*fields), F.col("_order") if "_order" in columns else F.col("status_code")).alias("r"))
        .select("media_url", "url", "r.*")
    )
    missing = new.join(reached, "url", "left_anti").select(
        "media_url", "url", "score", F.lit(MISSING_PAGE).alias("status_code")
    )
    return found.unionByName(missing, allowMissingColumns=True)


def ingest(candidates: DataFrame, garbage: DataFrame, news: DataFrame, pages: DataFrame,
           as_of: Column, broadcast_rows: int = links.BROADCAST_ROWS,
           summariser: articles.Summariser = text.identity_summary) -> DataFrame:
    """Outcome of each candidate link that is not rejected already.

    ``stage`` tells which rules gave the status: 'link' for the url rules,
    'page' for the page; 'known' marks a valid link that is stored already, which
    has no status. Calling this runs jobs: the distinct, the classified and the new links are each
    written once to the shared folder (urls and scores only): several branches
    read them, and without that Spark would push the url rules below the joins
    and run them again.
    """
    best = write_through(links.best_link_score(candidates), "links")
    rejected = links.stored_among(garbage, best, ["url", "media_url"], broadcast_rows)
    fresh = links.drop_known_garbage(best, rejected)
    classified = write_through(links.classify_urls(fresh), "classified")
    good = F.col("status_code") == "0"
    valid = classified.filter(good).drop("status_code")
    known = write_through(links.stored_among(news, valid, ["url"], broadcast_rows).distinct(), "known")
    new = write_through(links.drop_known_news(valid, known), "new")
    by_page = fetched_outcomes(new, pages, as_of, broadcast_rows, summariser)
    stored = valid.join(known, "url", "left_semi").withColumn("stage", F.lit("known"))
    by_link = classified.filter(~good).withColumn("stage", F.lit("link"))
    return by_page.withColumn("stage", F.lit("page")).unionByName(
        by_link, allowMissingColumns=True
    ).unionByName(stored, allowMissingColumns=True)


def open_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table with its batch column; created empty on first use."""
    full = f"{schema}, batch_id string"
    spark.createDataFrame([], full).write.mode("append").partitionBy("batch_id").parquet(path)
    return spark.read.schema(full).parquet(path)


def run_ingest(candidates: DataFrame, pages: DataFrame, news_path: str, garbage_path: str,
               as_of: Column, batch_id: str,
               summariser: articles.Summariser = text.identity_summary) -> DataFrame:
    """One increment: stores news and garbage of the batch, returns the statistics of its media.

    The batch may be run again: rows of the same batch do not count as stored
    and are replaced.
    """
    spark = candidates.sparkSession
    others = F.col("batch_id") != batch_id
    news = open_table(spark, news_path, schemas.NEWS).filter(others)
    garbage = open_table(spark, garbage_path, schemas.GARBAGE).filter(others)
    outcomes = write_through(ingest(candidates, garbage, news, pages, as_of, summariser=summariser), "outcomes")
    sinks.append_news(articles.to_news_rows(outcomes, as_of), news, news_path, batch_id)
    sinks.append_garbage(articles.to_garbage_rows(outcomes, as_of), garbage, garbage_path, batch_id)
    return stats.media_ingest_stats(stats.ingest_events(outcomes, news))
