"""Fetched article pages -> article records with a status code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import dates, fixed, html, jsonld, text
from newsloom.functions.util import blank, first_where, settle

Summariser = Callable[[Column], Column]

ARTICLE_COLUMNS = (
    "url", "media_url", "creation_datetime", "modified_datetime", "title",
    "description", "body", "main_topic", "other_topic", "image_url", "country",
    "n_tokens", "score",
)
_TEXT_COLUMNS = tuple(c for c in ARTICLE_COLUMNS if c not in ("n_tokens", "score"))


# ---- gates -------------------------------------------------------------------

def request_status(fetch_error: Column) -> Column:
    """Status of a fetch outcome: null is a success."""
    return (
        F.when(fetch_error.isNull(), "0")
        .when(fetch_error == "too_many_redirects", "1_1")
        .when(fetch_error == "unicode_error", "1_3")
        .otherwise("1_2")
    )


def article_gate(markup: Column, head_tags: Column) -> Column:
    """5_8, 5_9 or 5_7 for a page that is no article, else '0'."""
    marked = F.exists(head_tags, lambda t: (t["tag"] == "meta") & (t["content"] == "article"))
    return (
        F.when(~html.has_tag(markup, "html"), "5_8")
        .when(~html.has_tag(markup, "head"), "5_9")
        .when(~F.coalesce(marked, F.lit(False)), "5_7")
        .otherwise("0")
    )


def published_meta(head_tags: Column) -> Column:
    return first_where(
        head_tags,
        lambda t: (t["tag"] == "meta")
        & F.coalesce(t["property"].rlike(fixed.PUBLISHED_META), F.lit(False)),
    )


def freshness_gate(published: Column, as_of: Column) -> Column:
    """5_2 no publication meta, 5_3 empty, 5_1 unreadable or naive, 5_4 too old, else '0'."""
    content = published["content"]
    instant = dates.parse_instant(content)
    return (
        F.when(published.isNull(), "5_2")
        .when(content == "", "5_3")
        .when(content.isNull() | instant.isNull(), "5_1")
        .when(dates.age_days(instant, as_of) > fixed.MAX_AGE_DAYS, "5_4")
        .otherwise("0")
    )


def required_fields_gate(title: Column, created: Column, body: Column) -> Column:
    return (
        F.when(blank(title) | blank(created), "5_5").when(blank(body), "5_6").otherwise("0")
    )


# ---- fields ------------------------------------------------------------------

def meta_fields(metas: Column) -> dict[str, Column]:
    """Article fields from the meta candidates (null when absent)."""
    return {
        "title": html.first_meta(metas, lambda k: k.contains("title")),
        "description": html.first_meta(metas, lambda k: k.contains("description")),
        "creation_datetime": html.first_meta(metas, lambda k: k.rlike(fixed.PUBLISHED_META)),
        "modified_datetime": html.first_meta(metas, lambda k: k.rlike(fixed.MODIFIED_META)),
        "main_topic": F.lower(html.first_meta(metas, lambda k: k.contains("section"))),
        "other_topic": text.keyword_list(html.first_meta(metas, lambda k: k.contains("keyword"))),
        "image_url": html.first_meta(metas, lambda k: k.endswith("image")),
    }


def page_meta_fields(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Meta fields of each page."""
    staged = (
        pages.select(*keep, html.visible_markup(F.col("html")).alias("_markup"))
        .select(
            *keep,
            html.meta_candidates(
                html.named_tags(html.head_region(F.col("_markup"))),
                html.named_tags(html.after_head(F.col("_markup"))),
            ).alias("_metas"),
        )
    )
    return staged.select(
        *keep, *[c.alias(n) for n, c in meta_fields(F.col("_metas")).items()]
    )


def page_jsonld_fields(
    pages: DataFrame, keep: tuple[str, ...] = ("page_id",), only_body: bool = True
) -> DataFrame:
    """JSON-LD fields of each page (null where the page has no article block)."""
    wanted = ("body",) if only_body else jsonld.FIELDS
    found = jsonld.with_article_fields(pages, F.col("html"), "_f", only_body)
    return found.select(*keep, *[F.col(f"_f.{f}").alias(f) for f in wanted])


def paragraph_body(pages: DataFrame, keep: tuple[str, ...] = ("page_id",),
                   tags: tuple[str, ...] = ("p",)) -> DataFrame:
    markup = html.visible_markup(F.col("html"))
    return pages.select(*keep, html.element_text(markup, tags).alias("body"))


def article_outcomes(
    pages: DataFrame,
    as_of: Column,
    summariser: Summariser = text.identity_summary,
    keep: tuple[str, ...] = (),
    jsonld_only_body: bool = True,
) -> DataFrame:
    """Each fetched page with its status code and, where '0', the article fields.

    ``pages`` has url, media_url, score, html and, if fetches can fail,
    fetch_error. Row by row without any shuffle: the cheap gates come first and
    the costly fields are computed only for rows that pass them.
    """
    base = ("url", "media_url", "score", *keep)
    c = F.col
    passed = c("_gate") == "0"
    fetched = (
        request_status(c("fetch_error")) if "fetch_error" in pages.columns else F.lit("0")
    )
    gated = (
        pages.select(*base, "html", fetched.alias("_fetch"))
        .select(
            *base, "html", "_fetch",
            F.when(c("_fetch") == "0", html.visible_markup(c("html"))).alias("_markup"),
        )
        .select("*", html.named_tags(html.head_region(c("_markup"))).alias("_head"))
        .select("*", published_meta(c("_head")).alias("_published"))
        .select("*", article_gate(c("_markup"), c("_head")).alias("_kind"))
        .select(
            "*",
            F.when(c("_fetch") != "0", c("_fetch"))
            .when(c("_kind") != "0", c("_kind"))
            .otherwise(freshness_gate(c("_published"), as_of)).alias("_gate"),
        )
    )
    metas = html.meta_candidates(c("_head"), html.named_tags(html.after_head(c("_markup"))))
    parsed = jsonld.with_article_fields(
        gated.select(
            *base, "_gate", "_markup", F.when(passed, c("html")).alias("_article"),
            F.when(passed, metas).alias("_metas"),
        ),
        c("_article"), "_ld", jsonld_only_body,
    )
    from_meta = meta_fields(c("_metas"))

    def field(name: str) -> Column:
        own = from_meta.get(name, F.lit(None).cast("string"))
        from_ld = name in jsonld.FIELDS and (name == "body" or not jsonld_only_body)
        return F.coalesce(c(f"_ld.{name}"), own) if from_ld else own

    fields = parsed.select(
        *base, "_gate", "_markup",
        *[field(n).alias(n) for n in _TEXT_COLUMNS if n not in ("url", "media_url", "body", "country")],
        c("_ld.body").alias("_ld_body"),
    )
    complete = passed & ~blank(c("title")) & ~blank(c("creation_datetime"))
    bodies = fields.select(
        "*",
        F.when(
            complete,
            F.when(~blank(c("_ld_body")), c("_ld_body")).otherwise(html.element_text(c("_markup"))),
        ).alias("_text"),
        F.when(complete, html.page_lang(c("_markup"))).alias("country"),
    ).select("*", F.when(~blank(c("_text")), summariser(c("_text"))).alias("_summary"))
    status = F.when(~passed, c("_gate")).otherwise(
        required_fields_gate(c("title"), c("creation_datetime"), c("_summary.body"))
    )
    good = c("status_code") == "0"
    out = bodies.withColumn("status_code", status).select(
        *keep, "status_code", "url", "media_url", "score",
        *[
            F.when(good, F.coalesce(c(n), F.lit(""))).alias(n)
            for n in _TEXT_COLUMNS if n not in ("url", "media_url", "body")
        ],
        F.when(good, c("_summary.body")).alias("body"),
        F.when(good, c("_summary.n_tokens")).alias("n_tokens"),
    )
    return settle(out)


def article_columns(outcomes: DataFrame) -> DataFrame:
    """Stored column order; missing texts are ''."""
    return outcomes.select(
        *[
            F.coalesce(c, F.lit("")).alias(c) if c in _TEXT_COLUMNS else F.col(c)
            for c in ARTICLE_COLUMNS
        ]
    )


def to_news_rows(outcomes: DataFrame, inserted_at: Column) -> DataFrame:
    """Good outcomes in the schema of the news table."""
    c = F.col
    return outcomes.filter(c("status_code") == "0").select(
        "url", "media_url",
        dates.parse_instant(c("creation_datetime")).alias("created_at"),
        inserted_at.alias("inserted_at"),
        dates.parse_instant(c("modified_datetime")).alias("modified_at"),
        F.lit(None).cast("timestamp").alias("processed_at"),
        "title", "description", c("body").alias("article_body"), "main_topic",
        "other_topic", "image_url", "country", "n_tokens", "score",
        F.lit(False).alias("preprocessed"),
    )


def to_garbage_rows(statused: DataFrame, inserted_at: Column) -> DataFrame:
    """Rejects in the schema of the garbage table."""
    return statused.filter(F.col("status_code") != "0").select(
        "url", "media_url", inserted_at.alias("inserted_at"), "status_code"
    )
