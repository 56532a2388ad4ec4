"""URL rules as Column -> Column builders (all of them stay in the JVM)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import fixed
from newsloom.functions.util import contains_any, let


# ---- shaping ---------------------------------------------------------------

def cut_query(url: Column) -> Column:
    """Keep the part before the first query or fragment symbol."""
    stop = re.escape(fixed.URL_CUT_CHARS)
    return F.regexp_extract(url, f"^[^{stop}]*", 0)


def without_end_slash(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def absolutise(url: Column, media_url: Column) -> Column:
    """Absolute form of a link found on a page of ``media_url``."""
    return (
        F.when(url.startswith("//"), F.concat(F.lit("https:"), url))
        .when(url.startswith("/"), F.concat(without_end_slash(media_url), url))
        .when(url.startswith("https://") | url.startswith("http://"), url)
        .otherwise(F.concat(F.lit("https://"), url))
    )


def origin(url: Column) -> Column:
    """Scheme and host, closed by a slash."""
    return F.concat(F.array_join(F.slice(F.split(url, "/"), 1, 3), "/"), F.lit("/"))


def host(url: Column) -> Column:
    """Host of an absolute url (third piece between slashes)."""
    return F.get(F.split(url, "/"), F.lit(2))


def domain(url: Column) -> Column:
    """Host of a url with or without a scheme."""
    return F.regexp_extract(url, r"^(?:https?://)?([^/]+)", 1)


def strip_www(name: Column) -> Column:
    return F.replace(F.regexp_replace(name, r"^www\.", ""), F.lit("/"), F.lit(""))


def section_canonical(href: Column, page_url: Column) -> Column:
    """Lower-case absolute section url without fragment, closed by a slash."""
    page_origin = F.array_join(F.slice(F.split(page_url, "/"), 1, 3), "/")

    def full(link: Column) -> Column:
        return (
            F.when(link.startswith("//"), F.concat(F.lit("https:"), link))
            .when(link.startswith("/"), F.concat(page_origin, link))
            .when(link.startswith("www."), F.concat(F.lit("https://"), link))
            .otherwise(link)
        )

    bare = F.substring_index(let(F.lower(href), full), "#", 1)
    return F.concat(F.regexp_replace(bare, r"/\z", ""), F.lit("/"))


def section_canonical_wide(link: Column, page_url: Column) -> Column:
    """Exploratory section url of a link that ``valid_section_url_wide`` lets pass.

    A root link with ``www.`` in it names its host; another one is put behind the page
    url without its last character.
    """

    def full(low: Column) -> Column:
        return (
            F.when(low.startswith("//"), F.concat(F.lit("https:"), low))
            .when(low.startswith("/") & low.contains("www."), F.concat(F.lit("https:/"), low))
            .when(low.startswith("/"), F.concat(F.substring(page_url, F.lit(1), F.length(page_url) - 1), low))
            .when(low.startswith("www."), F.concat(F.lit("https://"), low))
            .otherwise(low)
        )

    def closed(url: Column) -> Column:
        cut = F.when(url.contains("#"), F.concat(F.substring_index(url, "#", 1), F.lit("/"))).otherwise(url)
        return F.when(cut.endswith("/"), cut).otherwise(F.concat(cut, F.lit("/")))

    return let(let(F.lower(link), full), closed)


# ---- parts -----------------------------------------------------------------

def path_pieces(url: Column) -> Column:
    """Non-empty pieces after scheme and host."""
    pieces = F.filter(F.split(url, "/"), lambda x: x != "")
    return let(pieces, lambda p: F.slice(p, F.lit(3), F.size(p)))


def path_depth(url: Column) -> Column:
    pieces = F.filter(F.split(url, "/"), lambda x: x != "")
    return F.greatest(F.size(pieces) - 2, F.lit(0))


def last_piece(url: Column) -> Column:
    return F.regexp_extract(url, r"([^/]*)/*\z", 1)


def path_segments(url: Column) -> Column:
    """Path split at slashes; scheme, host, parameters, query, fragment left out."""
    path = F.regexp_extract(
        url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1
    )
    return F.split(F.trim(F.regexp_replace(path, r";[^/]*\z", ""), F.lit("/")), "/")


def topic(url: Column) -> Column:
    """First path segment, empty when there is none."""
    return F.get(path_segments(url), F.lit(0))


def last_node(url: Column) -> Column:
    """Last path node without end slashes and without what follows a dot."""
    bare = F.regexp_replace(F.regexp_replace(url, r"/{1,2}\z", ""), r"[^/][.][^/]\z", "")
    node = F.substring_index(F.substring_index(bare, "/", -1), ".", 1)
    return F.when(bare.contains("/"), node)


def count_hyphens(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("-"), F.lit("")))


# ---- predicates ------------------------------------------------------------

def has_invalid_file(url: Column) -> Column:
    return url.rlike(r"\.(?:" + "|".join(fixed.FILE_ENDINGS) + r")\z")


def has_invalid_section(url: Column) -> Column:
    return contains_any(url, fixed.IRRELEVANT_SECTIONS)


def has_short_slug(url: Column) -> Column:
    return last_piece(url).rlike(fixed.SHORT_SLUG)


def outside_media(url: Column, media_url: Column) -> Column:
    return ~url.contains(without_end_slash(media_url))


def has_http_scheme(url: Column) -> Column:
    return url.contains("http://") | url.contains("https://")


def classify(url: Column, media_url: Column) -> Column:
    """Status of a candidate url: the first rule that fails, or '0'."""
    return (
        F.when(url == media_url, "3_1")
        .when(has_invalid_file(url), "3_2")
        .when(has_invalid_section(url), "3_3")
        .when(path_depth(url) <= 1, "3_4")
        .when(has_short_slug(url), "3_5")
        .when(outside_media(url, media_url), "3_6")
        .otherwise("0")
    )


def _alternation(parts: tuple[str, ...]) -> str:
    return "|".join(re.escape(p) for p in parts)


def valid_section_url(url: Column, domain_name: Column) -> Column:
    """True for a canonical url that can be a section page of the domain."""
    return ~(
        (count_hyphens(url) > fixed.MAX_HYPHENS)
        | url.rlike(_alternation(fixed.SECTION_BANNED) + r"|[0-9]{3}|[?=%]")
        | ((url.startswith("//") | ~url.startswith("/")) & ~url.contains(domain_name))
    )


def valid_section_url_wide(link: Column, page_url: Column, domain_name: Column) -> Column:
    """Exploratory section rule on the link as written in the page."""
    low = F.lower(link)
    bare = F.regexp_replace(low, fixed.LINK_SCHEME, "")
    shaped = (
        link.rlike(fixed.LINK_SHAPE_ABSOLUTE)
        | link.rlike(fixed.LINK_SHAPE_RELATIVE)
        | link.rlike(fixed.LINK_SHAPE_NODE)
    )
    banned = (
        (count_hyphens(low) > fixed.MAX_HYPHENS)
        | low.rlike(_alternation(fixed.SECTION_BANNED_WIDE) + r"|[0-9]{3}|[?=%]")
        | (low.contains("aviso") & low.contains("legal"))
    )
    is_self = (low == "") | (low == page_url) | (low == domain_name)
    foreign = (low.startswith("//") | ~low.startswith("/")) & ~bare.startswith(domain_name)
    return shaped & ~banned & ~is_self & ~foreign
