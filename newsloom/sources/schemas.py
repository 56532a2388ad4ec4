"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.functions import fixed

NEWS = """
    url string, media_url string, created_at timestamp, inserted_at timestamp,
    modified_at timestamp, processed_at timestamp, title string, description string,
    article_body string, main_topic string, other_topic string, image_url string,
    country string, n_tokens int, score double, preprocessed boolean
"""
GARBAGE = "url string, media_url string, inserted_at timestamp, status_code string"
RANKING = "media string, domain string, country string, region string, language string, overall double"
SPECIAL_MEDIA = "media string, domain string"
RANKING_TEXT = "media string, domain string, score double"
SECTION_RECORDS = (
    "domain string, part bigint, "
    "records array<struct<url:string,topic:string,score:double,copies:bigint>>"
)


def status_table(spark: SparkSession) -> DataFrame:
    """Status codes with their meaning (a fixed table of 21 rows)."""
    return spark.createDataFrame(
        list(fixed.STATUS_MEANING.items()), "status_code string, meaning string"
    )


def suggested_topics(spark: SparkSession) -> DataFrame:
    """Topic words offered to the reader (a fixed list)."""
    return spark.createDataFrame([(w,) for w in fixed.SUGGESTED_TOPICS], "word string")
