"""Release run: one weighted draw per description, the rest is held back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.util import blank, hash32


def described_news(pending: DataFrame) -> DataFrame:
    """Rows with a description; the score plus one is their weight."""
    return pending.filter(~blank(F.col("description"))).withColumn("score", F.col("score") + 1)


def draw_key(url: Column, weight: Column, seed: str) -> Column:
    """Smallest key wins with a chance in proportion to the weight."""
    u = (hash32(F.concat(F.lit(seed), url)) + 0.5) / F.lit(4294967296.0)
    return F.when(weight > 0, -F.ln(u) / weight).otherwise(F.lit(float("inf")))


def pick_one_per_description(described: DataFrame, seed: str) -> DataFrame:
    """One url per description, drawn by weight (Efraimidis-Spirakis).

    A minimum per group is combined map-side, so a description shared by very
    many rows never gathers in one task as a window partition would.
    """
    key = draw_key(F.col("url"), F.col("score"), seed)
    best = F.min(F.struct(key.alias("k"), F.col("url").alias("url")))
    return described.groupBy("description").agg(best.alias("b")).select("description", "b.url")


def split_released_held(pending: DataFrame, seed: str) -> DataFrame:
    """Each pending url with its decision: 'release' for the drawn, 'hold' for the rest."""
    chosen = pick_one_per_description(described_news(pending), seed).select(
        "url", F.lit("release").alias("decision")
    )
    return pending.select("url").join(chosen, "url", "left").select(
        "url", F.coalesce("decision", F.lit("hold")).alias("decision")
    )


def held_rows(described: DataFrame, chosen: DataFrame) -> DataFrame:
    """Described rows that were not drawn."""
    return described.join(chosen.select("url"), "url", "left_anti")


def rows_to_mark(pending: DataFrame, seed: str) -> DataFrame:
    """Urls that are only marked: not drawn, or without a description."""
    described = described_news(pending)
    held = held_rows(described, pick_one_per_description(described, seed)).select("url")
    empty = pending.filter(blank(F.col("description"))).select("url")
    return held.unionByName(empty)


def mark_processed(news: DataFrame, decisions: DataFrame, processed_at: Column) -> DataFrame:
    """New snapshot of the news: decided rows get the time, released ones the flag."""
    marked = news.join(decisions.select("url", "decision"), "url", "left")
    decided = F.col("decision").isNotNull()
    return marked.select(
        *[
            F.when(decided, processed_at).otherwise(F.col(c)).alias(c) if c == "processed_at"
            else (F.col(c) | (F.coalesce(F.col("decision"), F.lit("")) == "release")).alias(c)
            if c == "preprocessed"
            else F.col(c)
            for c in news.columns
        ]
    )


def release_run(news: DataFrame, seed: str, processed_at: Column) -> DataFrame:
    """Pending rows -> draw -> new snapshot of the news."""
    from newsloom.sources.tables import pending_news

    return mark_processed(news, split_released_held(pending_news(news), seed), processed_at)
