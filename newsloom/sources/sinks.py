"""Sinks: appends that can be repeated, catalogue and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.links import stored_among
from newsloom.operators.skew import collect_in_parts


def append_batch(fresh: DataFrame, path: str, batch_id: str) -> None:
    """Write one batch to its own partition; the same batch again replaces itself."""
    (
        fresh.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def append_news(news: DataFrame, stored: DataFrame, path: str, batch_id: str) -> None:
    """Append rows whose url is not stored, one row per url.

    ``stored`` holds the rows of the *other* batches, so a repeated batch gives
    the same result.
    """
    columns = [c for c in news.columns if c != "url"]
    fresh = (
        news.join(stored_among(stored, news, ["url"]), "url", "left_anti")
        .groupBy("url")
        .agg(F.max(F.struct("score", *[c for c in columns if c != "score"])).alias("r"))
        .select("url", "r.*")
        .select(*news.columns)
    )
    append_batch(fresh, path, batch_id)


def append_garbage(garbage: DataFrame, stored: DataFrame, path: str, batch_id: str) -> None:
    """Append rejects whose (url, media_url) is not stored, one row per pair."""
    keys = ["url", "media_url"]
    rest = [c for c in garbage.columns if c not in keys]
    fresh = (
        garbage.join(stored_among(stored, garbage, keys), keys, "left_anti")
        .groupBy(*keys)
        .agg(F.min(F.struct(*rest)).alias("r"))
        .select(*keys, "r.*")
        .select(*garbage.columns)
    )
    append_batch(fresh, path, batch_id)


def write_sections(records: DataFrame, path: str) -> None:
    """Catalogue as JSON lines, one per domain and part."""
    records.write.json(path)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("append").csv(path, sep=";", header=True)


def write_ranking(ranking: DataFrame, path: str) -> None:
    ranking.write.csv(path, sep=";", header=True)


def write_top_media(top: DataFrame, path: str) -> None:
    """The (already limited) top media, without a header."""
    top.select("media", "domain", "overall").write.csv(path, sep=";")


def write_frequent_topics(stems: DataFrame, path: str) -> None:
    """One stem per line."""
    stems.select(F.col("topic_stem").alias("value")).write.text(path)


def write_region_media(media: DataFrame, path: str) -> None:
    """Media urls per region as JSON lines (arrays by parts, see ``collect_in_parts``)."""
    unique = media.select("region", "media_url").distinct()
    collect_in_parts(unique, "region", ["media_url"], "media_url").select(
        "region", "part", F.col("records.media_url").alias("media_urls")
    ).write.json(path)


__all__ = [
    "append_batch", "append_news", "append_garbage", "write_sections", "write_stats", "write_ranking",
    "write_top_media", "write_frequent_topics", "write_region_media",
]
