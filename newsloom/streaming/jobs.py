"""Incremental forms of the jobs with Structured Streaming."""

from __future__ import annotations

import math
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from newsloom.functions import text
from newsloom.operators import articles, links, stats
from newsloom.operators.articles import Summariser
from newsloom.plans.ingest import open_table
from newsloom.sources import schemas, sinks
from newsloom.sources.workspace import write_through

FRESH = "1 day"


# What is remembered of a url: whether it is stored as news, and the media it was rejected for.
_SEEN = "news boolean, rejected array<string>"
_DISK_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_on_disk(spark: SparkSession):
    """Queries started inside keep their state in RocksDB and so need not hold it in memory."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _DISK_STATE)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def page_records(pages: DataFrame, as_of: Column, summariser: Summariser = text.identity_summary) -> DataFrame:
    """Outcome of each arriving page (url, media_url, score, html) with the code of its link and the order of its fetch.

    A page is parsed whatever the link of its row, since it may be the last fetch of a url that
    another media links as well. The markup does not go on.
    """
    times = [F.col(c).cast("timestamp").cast("double") for c in ("fetched_at",) if c in pages.columns]
    order = F.col("page_id").cast("bigint") if "page_id" in pages.columns else F.xxhash64("html")
    marked = links.classify_urls(pages).withColumnRenamed("status_code", "link_code").select(
        "*", F.coalesce(*times, F.lit(0.0)).alias("fetch_time"), F.coalesce(order, F.lit(-1)).alias("fetch_order")
    )
    return articles.article_outcomes(marked, as_of, summariser, keep=("link_code", "fetch_time", "fetch_order"))


def first_outcomes(records: DataFrame, known: DataFrame | None = None, keep_for: timedelta | None = None) -> DataFrame:
    """The records that are new: rejects once per url and media, news once per url.

    ``records`` is a stream of :func:`page_records`. The state is keyed by url, so a micro-batch
    looks up its own urls only. Of several fetches of a url in a micro-batch the last counts,
    for each of its media with the best score of that media. ``known`` is a stream of rows
    (url, media_url, status_code) that are stored already and only enter the state. A url that
    did not arrive for the time of ``keep_for`` is forgotten; without it, none is.

    A record goes to Python and back as one array of strings: each url is a group of its own
    there, and the time of a group goes with its columns, of which a record has some twenty.
    """
    rows = records.withColumn("is_known", F.lit(False))
    if known is not None:
        rows = rows.unionByName(known.select("url", "media_url", "status_code", F.lit(True).alias("is_known")), allowMissingColumns=True)
    columns = records.columns
    names = [*columns, "is_known"]

    def read(row) -> dict:
        r = dict(zip(names, row))
        score = None if r["score"] is None else float(r["score"])
        r["is_known"] = r["is_known"] == "true"
        if score is None or score != score:
            r["score"], score = None, -math.inf
        return {**r, "rank": score}

    def order(r: dict) -> tuple[float, int]:
        return float(r["fetch_time"]), int(r["fetch_order"])

    def decide(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        news, rejected = state.get if state.exists else (False, [])
        rejected, latest = set(rejected), None
        arrived = []
        for frame in frames:
            arrived += map(read, frame["record"])
            if keep_for is not None:
                latest = max(t for t in (latest, frame["seen_at"].max()) if t is not None)
        for row in arrived:
            if row["is_known"]:
                news = news or row["status_code"] == "0"
                rejected |= {row["media_url"]} if row["status_code"] != "0" else set()
        fetched = [r for r in arrived if not r["is_known"]]
        last = max(fetched, key=order, default=None)
        best: dict[str | None, dict] = {}
        for row in fetched:
            if row["media_url"] not in best or row["rank"] > best[row["media_url"]]["rank"]:
                best[row["media_url"]] = {**last, **{k: row[k] for k in ("rank", "media_url", "score", "link_code")}}
        out, good = [], []
        for media, row in best.items():
            if row["link_code"] != "0":
                row["status_code"] = row["link_code"]
            if media in rejected or (news and row["link_code"] == "0"):
                continue
            (good if row["status_code"] == "0" else out).append(row)
        rejected |= {r["media_url"] for r in out}
        if good:
            out.append(max(good, key=lambda r: (r["rank"], r["media_url"] or "")))
            news = True
        state.update((news, sorted(rejected, key=str)))
        if keep_for is not None:
            now = latest.timestamp()
            state.setTimeoutTimestamp(max(int((now + keep_for.total_seconds()) * 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"record": [[r[k] for k in columns] for r in out]})

    rows = rows.select("url", F.array(*[F.col(k).cast("string") for k in names]).alias("record"))
    timeout = GroupStateTimeout.NoTimeout
    if keep_for is not None:
        # By the times of the micro-batches as event time: a timeout by processing time never lets availableNow end.
        rows = rows.withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", "1 second")
        timeout = GroupStateTimeout.EventTimeTimeout
    decided = rows.groupBy("url").applyInPandasWithState(decide, "record array<string>", _SEEN, "append", timeout)
    return decided.select(*[F.col("record")[i].cast(f.dataType).alias(f.name) for i, f in enumerate(records.schema)])


def stream_new_pages(arriving: DataFrame, news_path: str, garbage_path: str, checkpoint: str, as_of: Column,
                     known: DataFrame | None = None, keep_for: timedelta | None = None) -> StreamingQuery:
    """Process each url once as pages (url, media_url, score, html) arrive.

    What was seen before is in the state of the query, on disk and in the checkpoint: no
    stored table is read. ``known`` and ``keep_for`` are those of :func:`first_outcomes`. A
    micro-batch owns a batch id, so one that is repeated after a failure replaces its own rows.
    """
    spark = arriving.sparkSession
    fresh = first_outcomes(page_records(arriving, as_of), known, keep_for)
    for path, schema in ((news_path, schemas.NEWS), (garbage_path, schemas.GARBAGE)):
        open_table(spark, path, schema)

    def one(batch: DataFrame, number: int) -> None:
        found = write_through(batch, "fresh-outcomes")
        sinks.append_batch(articles.to_news_rows(found, as_of), news_path, f"s{number:012d}")
        sinks.append_batch(articles.to_garbage_rows(found, as_of), garbage_path, f"s{number:012d}")

    with state_on_disk(spark):
        return (
            fresh.writeStream.foreachBatch(one).outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def stream_dedup_links(links: DataFrame) -> DataFrame:
    """First arrival of each url; the state of a url is kept for the freshness limit.

    A row that is older than that limit when it arrives is left out.
    """
    return links.withWatermark("published_at", FRESH).dropDuplicatesWithinWatermark(["url"])


def stream_media_stats(events: DataFrame, time: str = "ts") -> DataFrame:
    """The ingest statistics per hour and media over arriving outcome rows.

    ``events`` has (media_url, stage, status_code) as ``ingest_events`` gives them, and
    the time; the counters are those of ``media_ingest_stats``.
    """
    counted = (
        events.withWatermark(time, FRESH)
        .groupBy(F.window(time, "1 hour"), "media_url")
        .agg(*stats.counters())
        .withColumn("hour", F.col("window.start")).drop("window")
    )
    return stats.with_warning(counted)


def write_updates(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep each batch of updated rows under its batch number."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        updates.writeStream.outputMode("update").foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Last state of each key from the written updates."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "batch").alias("r"))
        .select(*keys, "r.*")
    )


def write_new_rows(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of a stream to a parquet table."""
    return (
        rows.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
