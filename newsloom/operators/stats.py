"""Ingest statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed
from newsloom.sources.schemas import status_table


def counters() -> list[Column]:
    code, stage = F.col("status_code"), F.col("stage")
    return [
        F.count_if(stage.isin("known", "page")).alias("n_scraped"),
        F.count_if(stage == "stored").alias("n_known"),
        F.count_if(stage == "page").alias("n_to_process"),
        F.count_if((stage == "page") & (code == "0")).alias("n_inserted"),
        F.count_if((stage == "page") & (code == "5_6")).alias("n_no_body"),
    ]


def ingest_events(outcomes: DataFrame, known: DataFrame) -> DataFrame:
    """Outcome rows and stored urls of their media as one table of (media_url, stage, status_code).

    Only media with an outcome in the batch are reported.
    """
    media = outcomes.select("media_url").distinct()
    stored = known.join(media, "media_url", "left_semi").select(
        "media_url", F.lit("stored").alias("stage"), F.lit(None).cast("string").alias("status_code")
    )
    return outcomes.select("media_url", "stage", "status_code").unionByName(stored)


def media_ingest_stats(events: DataFrame) -> DataFrame:
    """Per media: stored, scraped, processed, inserted urls, missing bodies, warning.

    Scraped are the distinct valid links, whether stored already or not; rejects of the
    url rules are not. The warning is for a media with scraped links and no insertion.
    """
    return with_warning(events.groupBy("media_url").agg(*counters()))


def with_warning(counted: DataFrame) -> DataFrame:
    warning = F.when(
        (F.col("n_scraped") > 0) & (F.col("n_inserted") == 0), fixed.NO_INSERT_WARNING
    ).otherwise("")
    return counted.withColumn("warning", warning)


def run_summary(events: DataFrame) -> DataFrame:
    """Totals over all media."""
    return events.agg(*counters())


def media_and_run_stats(events: DataFrame) -> DataFrame:
    """Both in one pass; the run total is the row of media_url null."""
    return events.rollup("media_url").agg(*counters())


def garbage_by_status(garbage: DataFrame) -> DataFrame:
    """Rejects per media and code, with the meaning of the code; good rows (code 0) are left out."""
    counts = garbage.filter(F.col("status_code") != "0").groupBy("media_url", "status_code").agg(F.count("*").alias("n"))
    codes = status_table(garbage.sparkSession)
    return counts.join(F.broadcast(codes), "status_code", "left").select(
        "media_url", "status_code", "meaning", "n"
    )
