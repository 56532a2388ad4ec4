"""Scans: fetched pages, catalogue files, stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import fixed
from newsloom.sources import schemas


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages (page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")


# ---- section catalogue -------------------------------------------------------

def scan_sections(spark: SparkSession, path: str) -> DataFrame:
    """Section catalogue as JSON lines (one per domain and part) -> one row per section.

    ``copies`` tells how often the same record was found.
    The files split at line ends, so a catalogue of any size reads in parallel.
    """
    lines = spark.read.schema(schemas.SECTION_RECORDS).json(path)
    return lines.select("domain", F.explode("records").alias("r")).select("domain", "r.*")


def scan_section_documents(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue files that are one JSON object ``{domain: {"records": [[url, topic, score]]}}``.

    Such a file cannot be split, so this is for importing hand-sized catalogues
    (several files read in parallel); ``scan_sections`` is the form for work.
    """
    shape = "map<string,struct<records:array<array<string>>>>"
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(F.from_json("value", shape)).alias("domain", "entry"))
        .select("domain", F.explode("entry.records").alias("r"))
        .select(
            "domain",
            F.trim(F.get("r", F.lit(0))).alias("url"),
            F.get("r", F.lit(1)).alias("topic"),
            F.get("r", F.lit(2)).try_cast("double").alias("score"),
        )
    )


# ---- media lists -------------------------------------------------------------

def scan_ranking(spark: SparkSession, path: str) -> DataFrame:
    """Media ranking, ``;`` separated with a header."""
    return spark.read.csv(path, sep=";", header=True, schema=schemas.RANKING)


def normalise_columns(df: DataFrame, trimmed: tuple[str, ...] = ("media", "domain")) -> DataFrame:
    """Lower-case column names, trim the given text columns."""
    low = df.toDF(*[c.lower() for c in df.columns])
    return low.select(
        *[F.trim(c).alias(c) if c in trimmed else F.col(c) for c in low.columns]
    )


def general_media(raw: DataFrame) -> DataFrame:
    """General ranking: clean names, without the global rank, by ``overall``."""
    return normalise_columns(raw).drop("global_rank").orderBy("overall")


def special_media(raw: DataFrame) -> DataFrame:
    """Special media with the constant columns of the ranking."""
    return normalise_columns(raw).select(
        "*", *[F.lit(v).alias(k) for k, v in fixed.SPECIAL_MEDIA.items()]
    )


def scan_special_media(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep=";", header=True, schema=schemas.SPECIAL_MEDIA)
    return special_media(raw)


def scan_ranking_text(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``name;domain;score`` lines; first of ``a|b`` domains."""
    raw = spark.read.csv(path, sep=";", schema=schemas.RANKING_TEXT)
    return raw.select(
        "media", F.trim(F.substring_index("domain", "|", 1)).alias("domain"), "score"
    )


# ---- versions ----------------------------------------------------------------

def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Names of the files that match a glob (contents are not read)."""
    return spark.read.format("binaryFile").load(pattern).select(
        "path", F.substring_index("path", "/", -1).alias("name")
    )


def version_number(name: Column) -> Column:
    return F.regexp_extract(name, r"_v([0-9]+)\.[a-z]+$", 1).try_cast("int")


def version_date(name: Column) -> Column:
    digits = F.regexp_extract(name, r"_([0-9]{8})\.[a-z]+$", 1)
    return F.try_to_timestamp(digits, F.lit("ddMMyyyy")).cast("date")


def latest_version(files: DataFrame) -> DataFrame:
    """Newest file by number (``…_v12.json``) and by date (``…_31122023.csv``)."""
    number, date = version_number(F.col("name")), version_date(F.col("name"))
    return files.agg(
        F.max(number).alias("version"),
        F.max_by("name", F.when(number.isNotNull(), F.struct(number, F.col("name"))))
        .alias("name_by_version"),
        F.max(date).alias("version_date"),
        F.max_by("name", F.when(date.isNotNull(), F.struct(date, F.col("name"))))
        .alias("name_by_date"),
    )


# ---- stored tables -----------------------------------------------------------

def news_urls_of_media(news: DataFrame, media_url: str) -> DataFrame:
    return news.filter(F.col("media_url") == media_url).select("url")


def garbage_of_media(garbage: DataFrame, media_url: str) -> DataFrame:
    return garbage.filter(F.col("media_url") == media_url).select("url", "media_url")


def pending_news(news: DataFrame) -> DataFrame:
    """Rows no release run has looked at yet."""
    return news.filter(F.col("processed_at").isNull() & ~F.col("preprocessed"))
