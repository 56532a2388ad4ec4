"""Tag grammar of fetched pages as Column builders.

Supported: double-quoted, single-quoted and bare attribute values (a quoted
value may hold ``>``), valueless attributes, void tags, unclosed tags, a bare
``<`` in text. Comments, scripts and styles are taken out first. A tag cut off
by the end of the page is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import decode_entities
from newsloom.functions.util import any_of, first_where, let

HIDDEN = r"(?is)<(?:!--.*?(?:-->|\z)|(script|style)\b.*?(?:</\1\s*>|\z))"
BARE_LESS = r"<(?![a-zA-Z/!?])"
ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
TAG = rf"<(/?[a-zA-Z][^\s/>]*)({ATTRIBUTES})>([^<]*)"
ATTRIBUTE = r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?"""
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr", "!doctype",
)
PARAGRAPH_MARK = "\x01"


def visible_markup(html: Column) -> Column:
    """Page without comments, scripts and styles; bare ``<`` escaped."""
    return F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BARE_LESS, "&lt;")


def attribute_entries(attributes: Column) -> Column:
    """array<struct<name,value>> of an attribute string, in page order."""

    def group(i: int) -> Column:
        return F.regexp_extract_all(attributes, F.lit(ATTRIBUTE), i)

    def joined(a: Column, b: Column) -> Column:
        return F.concat(a, b)

    values = F.zip_with(F.zip_with(group(2), group(3), joined), group(4), joined)
    return F.zip_with(
        group(1),
        values,
        lambda name, value: F.struct(
            F.lower(name).alias("name"), decode_entities(value).alias("value")
        ),
    )


def entry_value(entries: Column, name: str) -> Column:
    """Value of an attribute (the last one wins), null when absent."""
    return F.try_element_at(F.filter(entries, lambda e: e["name"] == name), F.lit(-1))["value"]


def entry_map(entries: Column) -> Column:
    """map<name,value>; the last of equal names wins whatever the session policy."""
    return let(
        entries,
        lambda all_: F.map_from_entries(
            F.filter(
                all_,
                lambda e, i: ~F.exists(
                    F.slice(all_, i + 2, F.size(all_)), lambda later: later["name"] == e["name"]
                ),
            )
        ),
    )


def page_tags(html: Column) -> Column:
    """Tags in page order with attributes and the text up to the next tag.

    End tags are kept with a leading slash in their name.
    """
    found = F.regexp_extract_all(visible_markup(html), F.lit(TAG), 0)

    def one(item: Column, pos: Column) -> Column:
        return F.struct(
            pos.alias("pos"),
            F.lower(F.regexp_extract(item, TAG, 1)).alias("tag"),
            entry_map(attribute_entries(F.regexp_extract(item, TAG, 2))).alias("attrs"),
            decode_entities(F.regexp_extract(item, TAG, 3)).alias("text"),
        )

    return F.transform(found, one)


# ---- regions ---------------------------------------------------------------

def has_tag(markup: Column, tag: str) -> Column:
    return markup.rlike(rf"(?i)<{tag}[\s>]")


def head_region(markup: Column) -> Column:
    return F.regexp_extract(markup, r"(?is)<head(?:\s[^>]*)?>(.*?)(?:</head\s*>|\z)", 1)


def after_head(markup: Column) -> Column:
    return F.regexp_extract(markup, r"(?is)</head\s*>(.*)\z", 1)


def body_region(markup: Column) -> Column:
    return F.regexp_extract(markup, r"(?is)<body(?:\s[^>]*)?>(.*?)(?:</body\s*>|\z)", 1)


def page_lang(markup: Column) -> Column:
    """``lang`` of the html tag, '' when absent."""
    attributes = F.regexp_extract(markup, rf"(?i)<html({ATTRIBUTES})>", 1)
    return F.coalesce(entry_value(attribute_entries(attributes), "lang"), F.lit(""))


# ---- links -----------------------------------------------------------------

def body_hrefs(html: Column) -> Column:
    """Non-empty hrefs of the anchors of the body, in page order."""
    anchors = F.regexp_extract_all(
        body_region(visible_markup(html)), F.lit(rf"(?i)<a(?=[\s/])({ATTRIBUTES})>"), 1
    )
    hrefs = F.transform(anchors, lambda a: entry_value(attribute_entries(a), "href"))
    return F.filter(hrefs, lambda h: h.isNotNull() & (h != ""))


def anchors_with_text(html: Column, part: str) -> Column:
    """Hrefs of anchors whose text contains ``part``."""
    pattern = rf"(?i)<a(?=[\s/])({ATTRIBUTES})>([^<]*)</a\s*>"
    markup = visible_markup(html)
    pairs = F.zip_with(
        F.regexp_extract_all(markup, F.lit(pattern), 1),
        F.regexp_extract_all(markup, F.lit(pattern), 2),
        lambda a, t: F.struct(a.alias("attributes"), t.alias("text")),
    )
    kept = F.filter(pairs, lambda p: decode_entities(p["text"]).contains(part))
    hrefs = F.transform(
        kept, lambda p: entry_value(attribute_entries(p["attributes"]), "href")
    )
    return F.filter(hrefs, lambda h: h.isNotNull())


# ---- meta tags -------------------------------------------------------------

def named_tags(region: Column) -> Column:
    """Tags of a region that have a content, property or name attribute."""
    found = F.regexp_extract_all(region, F.lit(rf"<([a-zA-Z][^\s/>]*{ATTRIBUTES})>"), 1)
    marked = F.filter(found, lambda t: t.rlike(r"(?i)[\s\"'/](?:content|property|name)\s*="))

    def one(item: Column) -> Column:
        attributes = F.regexp_replace(item, r"^[^\s/>]*", "")
        return let(
            attribute_entries(attributes),
            lambda e: F.struct(
                F.lower(F.regexp_extract(item, r"^[^\s/>]*", 0)).alias("tag"),
                entry_value(e, "property").alias("property"),
                entry_value(e, "name").alias("name"),
                entry_value(e, "content").alias("content"),
            ),
        )

    return F.transform(marked, one)


def meta_candidates(head_tags: Column, other_tags: Column) -> Column:
    """array<struct<key,content>>: head metas with a property, any tag with a name."""

    def keyed(tags: Column) -> Column:
        return F.transform(
            tags,
            lambda t: F.struct(
                F.lower(
                    F.coalesce(F.nullif(t["property"], F.lit("")), t["name"], F.lit(""))
                ).alias("key"),
                t["content"].alias("content"),
            ),
        )

    in_head = F.filter(
        head_tags,
        lambda t: ((t["tag"] == "meta") & t["property"].isNotNull()) | t["name"].isNotNull(),
    )
    elsewhere = F.filter(other_tags, lambda t: t["name"].isNotNull())
    return F.filter(
        F.concat(keyed(in_head), keyed(elsewhere)),
        lambda m: (m["key"] != "") & (F.coalesce(m["content"], F.lit("")) != ""),
    )


def first_meta(metas: Column, test) -> Column:
    """Content of the first candidate whose key passes ``test``, null when none."""
    return first_where(metas, lambda m: test(m["key"]))["content"]


# ---- text of paragraphs and headings ---------------------------------------

def element_text(markup: Column, tags: tuple[str, ...] = ("p",)) -> Column:
    """Text inside the given elements, each piece once, in page order.

    The open elements are followed as a stack (innermost first, as ``/b/p/body/``):
    an end tag closes the nearest open element of its name and all inside it, an
    end tag without an open element is ignored. So text after an unclosed ``<p>``
    belongs to it up to the end of its container. Newline runs are collapsed
    within one element, not across two.
    """
    pieces = F.zip_with(
        F.regexp_extract_all(markup, F.lit(TAG), 1),
        F.regexp_extract_all(markup, F.lit(TAG), 3),
        lambda name, text: F.struct(F.lower(name).alias("name"), text.alias("text")),
    )
    # The state keeps one letter per piece, not the pieces: copying it stays cheap.
    start = F.struct(F.lit("/").alias("open"), F.lit("").alias("taken"))

    def stack_after(stack: Column, name: Column) -> Column:
        nearest = F.instr(stack, F.concat(name, F.lit("/")))
        closed = F.when(nearest > 0, F.substr(stack, nearest + F.length(name))).otherwise(stack)
        return (
            F.when(name.startswith("/"), closed)
            .when(name.isin(*VOID_TAGS), stack)
            .otherwise(F.concat(F.lit("/"), name, stack))
        )

    def step(state: Column, piece: Column) -> Column:
        def taken(stack: Column) -> Column:
            inside = any_of(stack.contains(f"/{t}/") for t in tags)
            return F.struct(
                stack.alias("open"),
                F.concat(state["taken"], F.when(inside, "1").otherwise("0")).alias("taken"),
            )

        return let(stack_after(state["open"], piece["name"]), taken)

    def text_of(all_: Column) -> Column:
        letters = F.split(F.aggregate(all_, start, step, lambda s: s["taken"]), "")
        kept = F.zip_with(all_, letters, lambda piece, letter: F.when(
            letter == "1",
            F.when(piece["name"].isin(*tags), F.concat(F.lit(PARAGRAPH_MARK), piece["text"]))
            .otherwise(piece["text"]),
        ))
        return F.array_join(kept, "")

    joined = let(pieces, text_of)
    collapsed = F.regexp_replace(decode_entities(joined), r"\n+", "\n")
    return F.replace(collapsed, F.lit(PARAGRAPH_MARK), F.lit(""))
