"""Reads of the news feed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed

FEED_COLUMNS = (
    "url", "created_at", "inserted_at", "title", "description", "article_body",
    "image_url", "score", "preprocessed",
)


def feed_visible(news: DataFrame) -> DataFrame:
    return news.filter("preprocessed")


def feed_by_topic(news: DataFrame, topic: str) -> DataFrame:
    """Rows whose main topic holds ``topic``, letter case aside."""
    return news.filter(F.lower("main_topic").contains(topic.lower()))


def feed_columns(news: DataFrame) -> DataFrame:
    return news.select(*FEED_COLUMNS)


def feed_order() -> list[Column]:
    return [F.desc("created_at"), F.desc("score"), F.asc("url")]


def feed_page(news: DataFrame, offset: int = 0, rows: int = fixed.FEED_ROWS,
              topic: str | None = None) -> DataFrame:
    """Visible rows, newest and best first, ``rows`` of them after ``offset``."""
    chosen = news if topic is None else feed_by_topic(news, topic)
    page = feed_columns(feed_visible(chosen)).orderBy(*feed_order())
    return page.offset(offset).limit(rows) if offset else page.limit(rows)


def feed_after(news: DataFrame, created_at: datetime, score: float, url: str,
               rows: int = fixed.FEED_ROWS, topic: str | None = None) -> DataFrame:
    """The page after a given last row: deep pages cost no more than the first."""
    chosen = news if topic is None else feed_by_topic(news, topic)
    c, s, u = F.lit(created_at), F.lit(score), F.lit(url)
    later = (F.col("created_at") < c) | (
        (F.col("created_at") == c)
        & ((F.col("score") < s) | ((F.col("score") == s) & (F.col("url") > u)))
    )
    return feed_columns(feed_visible(chosen).filter(later)).orderBy(*feed_order()).limit(rows)


def topic_suggest(words: DataFrame, typed: str) -> DataFrame:
    """Vocabulary words that contain the typed text; none for an empty input."""
    part = typed.strip().lower()
    return words.filter(F.lower("word").contains(part) & F.lit(part != ""))
