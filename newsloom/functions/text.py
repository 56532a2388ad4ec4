"""Text clean-up, entity decoding and response parsing as Column builders."""

from __future__ import annotations

import json
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import fixed
from newsloom.functions.util import blank, let


def strip_tags(text: Column) -> Column:
    """Remove ``<...>`` runs that lie on one line."""
    return F.regexp_replace(text, r"<[^\n]*?>", "")


def collapse_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n+", "\n")


def keyword_list(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit(", "), F.lit(",")))


def _drop_symbols(text: Column) -> Column:
    return F.translate(text, "".join(fixed.TOPIC_SYMBOLS), "")


def clean_topics(text: Column) -> Column:
    """Comma list of topics: lower case, inner spaces to hyphens, symbols dropped."""
    spaced = F.replace(F.replace(text, F.lit(", "), F.lit(",")), F.lit(" "), F.lit("-"))
    return _drop_symbols(F.lower(F.when(text.contains(", "), spaced).otherwise(text)))


def clean_topic_array(items: Column) -> Column:
    joined = F.replace(F.array_join(items, ","), F.lit(" "), F.lit("-"))
    return _drop_symbols(F.lower(joined))


def join_list(items: Column) -> Column:
    return F.lower(F.array_join(items, ","))


# ---- entities --------------------------------------------------------------

_ENTITY_PIECE = r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&"
# Names that count without a semicolon, also at the start of a longer word.
_OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
# Numbers 128 to 159 mean the letters of the Windows character set.
_WINDOWS = [
    bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)
]


def _names(table: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _named(piece: Column) -> tuple[Column, Column]:
    """Values of ``&name;`` and of a name without its semicolon: the few names of HTML 4 are tried before the long list."""
    name = F.regexp_extract(piece, "^&([a-zA-Z0-9]+);$", 1)
    usual = _names({n: html5[f"{n};"] for n in name2codepoint})
    every = _names({n[:-1]: c for n, c in html5.items() if n.endswith(";")})
    opened = rf"^&({'|'.join(_OPEN_NAMES)})"
    start = F.regexp_extract(piece, opened, 1)
    short = _names({n: html5[n] for n in _OPEN_NAMES})
    rest = F.substr(piece, F.length(start) + 2)
    return F.when(
        piece.endswith(";"), F.coalesce(F.try_element_at(usual, name), F.try_element_at(every, name))
    ), F.when(start != "", F.concat(F.try_element_at(short, start), rest))


def _code_point(digits: Column, base: int) -> Column:
    """Character of a number in ``base``; what is no number of a character gives U+FFFD or nothing."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    number = F.when(F.length(short) <= 7, F.conv(short, base, 10).cast("bigint"))
    control = number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127)
    no_character = number.between(0xFDD0, 0xFDEF) | ((number % 0x10000) >= 0xFFFE)
    return (
        F.when(number.between(128, 159), F.get(F.array(*map(F.lit, _WINDOWS)), number - 128))
        .when(number.between(0, 0x10FFFF) & (control | no_character), "")
        .when(
            number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF),
            F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"),
        )
        .otherwise("\ufffd")
    )


def _decode_piece(piece: Column) -> Column:
    whole, opened = _named(piece)
    return (
        F.when(~piece.startswith("&"), piece)
        .when(piece.rlike("^&#[xX]"), _code_point(F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]+)", 1), 16))
        .when(piece.startswith("&#"), _code_point(F.regexp_extract(piece, "^&#([0-9]+)", 1), 10))
        .otherwise(F.coalesce(whole, opened, piece))
    )


def decode_entities(text: Column) -> Column:
    """One pass over named and numeric entities; unknown names stay as written."""

    def decode(t: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(t, F.lit(_ENTITY_PIECE), 0), _decode_piece)
        return F.when(t.contains("&"), F.array_join(pieces, "")).otherwise(t)

    return let(text, decode)


# ---- responses of a text service -------------------------------------------

def response_tokens(response: Column) -> Column:
    number = F.regexp_extract(response, r"Tokens: ([0-9]+)", 1).try_cast("int")
    return F.coalesce(number, F.lit(-1))


def response_summary(response: Column) -> Column:
    return F.coalesce(F.regexp_extract(response, r"(?s)Body Summary:(.*)", 1), F.lit(""))


def summary_struct(text: Column, response: Column) -> Column:
    """(body, n_tokens) of a response; the text itself where no body was found."""
    body = response_summary(response)
    lost = body.contains(fixed.BODY_NOT_FOUND)
    return F.struct(
        F.when(lost, text).otherwise(body).alias("body"),
        F.when(lost, F.lit(-1)).otherwise(response_tokens(response)).alias("n_tokens"),
    )


def summary_or_text(text: Column, response: Column, failed: Column) -> Column:
    """As ``summary_struct``; no call keeps the text, a failed call gives ('', 0) and code 4."""
    parsed = summary_struct(text, response)
    return (
        F.when(failed, F.struct(F.lit("").alias("body"), F.lit(0).alias("n_tokens"),
                                F.lit("4").alias("status_code")))
        .when(response.isNull(), F.struct(text.alias("body"), F.lit(-1).alias("n_tokens"),
                                          F.lit("0").alias("status_code")))
        .otherwise(F.struct(parsed["body"].alias("body"), parsed["n_tokens"].alias("n_tokens"),
                            F.lit("0").alias("status_code")))
    )


def response_line(response: Column, label: str) -> Column:
    """Text after ``label:`` up to the end of its line, '' when absent."""
    return F.coalesce(F.regexp_extract(response, rf"{label}: ([^\n]*)", 1), F.lit(""))


def response_struct(response: Column) -> Column:
    return F.struct(
        response_tokens(response).alias("n_tokens"),
        response_line(response, "Headline").alias("title"),
        response_line(response, "Topics").alias("other_topic"),
        response_line(response, "Creation DateTime").alias("creation_datetime"),
        response_line(response, "Update DateTime").alias("modified_datetime"),
        response_summary(response).alias("body"),
        F.lit("").alias("image_url"),
    )


def identity_summary(text: Column) -> Column:
    """The default summariser: the text itself, token count unknown."""
    return F.struct(text.alias("body"), F.lit(-1).alias("n_tokens"))


def or_empty(text: Column) -> Column:
    return F.when(blank(text), F.lit("")).otherwise(text)
