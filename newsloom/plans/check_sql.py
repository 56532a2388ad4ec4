"""Pieces of SQL that the checks share."""

from __future__ import annotations

from newsloom.functions import fixed
from newsloom.operators.skew import ARRAY_PARTS

VISIBLE = (
    r"regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)"
    r"|<style\b.*?(?:</style\s*>|\z)', '', 'g')"
)
TAG = r"""<(/?[a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|''[^'']*'')?)*)>([^<]*)"""


def decoded(text: str) -> str:
    return (
        "regexp_replace(regexp_replace(regexp_replace(regexp_replace("
        f"{text}, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '\"', 'g'), "
        "'&amp;?', '&', 'g')"
    )


def decoded_article(text: str) -> str:
    """Text of the derived article pages, whose entities are these."""
    for entity, char in (("&lt;", "<"), ("&eacute;", "é"), ("&#8364;", "€"), ("&#146;", "’")):
        text = f"replace({text}, '{entity}', '{char}')"
    return decoded(text)


def part_of(text: str, parts: int = ARRAY_PARTS) -> str:
    """Part of a record by the hash of ``text``."""
    return f"CAST(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {parts} AS BIGINT)"


def status_of_url(url: str = "url", media: str = "media_url") -> str:
    pieces = f"list_filter(string_split({url}, '/'), lambda x: x <> '')"
    sections = " OR ".join(f"contains({url}, '{s}')" for s in fixed.IRRELEVANT_SECTIONS)
    return (
        f"CASE WHEN {url} = {media} THEN '3_1' "
        f"WHEN regexp_matches({url}, '\\.(xml|pdf|lxml|jpg|png|gif)$') THEN '3_2' "
        f"WHEN {sections} THEN '3_3' "
        f"WHEN len({pieces}) <= 3 THEN '3_4' "
        f"WHEN regexp_matches({pieces}[-1], '^[.a-zA-Z0-9]+(-[.a-zA-Z0-9]+){{0,2}}$') THEN '3_5' "
        f"WHEN NOT contains({url}, rtrim({media}, '/')) THEN '3_6' ELSE '0' END"
    )


PAGE_HREFS = f"""page_hrefs AS (
  SELECT page_id, url, u.pos - 1 AS pos, {decoded('u.h')} AS href
  FROM (SELECT page_id, url, regexp_extract_all(regexp_extract({VISIBLE}, '(?is)<body[^>]*>(.*)', 1),
          '<a href="([^"]*)"', 1) AS hs FROM pages) p,
    unnest(p.hs) WITH ORDINALITY AS u(h, pos)
  WHERE u.h <> '')"""

CUT = r"regexp_extract({0}, '^[^?!)(=&+%@#]*', 0)"


def absolute(url: str, media: str) -> str:
    return (
        f"CASE WHEN starts_with({url}, '//') THEN 'https:' || {url} "
        f"WHEN starts_with({url}, '/') THEN rtrim({media}, '/') || {url} "
        f"WHEN starts_with({url}, 'https://') OR starts_with({url}, 'http://') THEN {url} "
        f"ELSE 'https://' || {url} END"
    )


def stem_ctes(source: str, word: str = "word") -> str:
    """CTEs ``st_*`` that end in ``stems(word, stem)`` over the distinct words of ``source``."""
    from newsloom.functions import stemming as s

    vowels, other = f"[{s.VOWELS}]", f"[^{s.VOWELS}]"
    action = ", ".join(f"'{a}'" for a in s.ACTION)
    tail = "substr({0}, {1} + 1)"
    rest = tail.format("b", "p2")

    def end(text: str, suffixes: str) -> str:
        return f"regexp_extract({text}, '(?:{suffixes})$', 0)"

    return f"""
st_0 AS (SELECT DISTINCT {word} AS word, lower({word}) AS w FROM {source}),
st_1 AS (SELECT word, w, regexp_extract(w, '(?s)^.*?{vowels}{other}(.*)$', 1) AS r1,
  length(w) - length(regexp_extract(w, '(?s)^(?:.{other}{other}*{vowels}|{vowels}{vowels}{vowels}*{other}|{other}{vowels}.)(.*)$', 1)) AS pv FROM st_0),
st_2 AS (SELECT word, w, pv, length(w) - length(r1) AS p1,
  length(w) - length(regexp_extract(r1, '(?s)^.*?{vowels}{other}(.*)$', 1)) AS p2 FROM st_1),
st_3 AS (SELECT *, {end(tail.format('w', 'pv'), s.PRONOUNS)} AS s FROM st_2),
st_4 AS (SELECT * EXCLUDE (w, s), CASE WHEN s <> '' AND (regexp_matches(substr(left(w, length(w) - length(s)), pv + 1), '(?:{s.PRONOUN_AFTER})$')
    OR (regexp_matches(substr(left(w, length(w) - length(s)), pv + 1), 'yendo$') AND regexp_matches(left(w, length(w) - length(s)), 'uyendo$')))
  THEN translate(left(w, length(w) - length(s)), 'áéíóú', 'aeiou') ELSE w END AS w FROM st_3),
st_5 AS (SELECT *, {end('w', s.STANDARD)} AS s FROM st_4),
st_6 AS (SELECT *, left(w, length(w) - length(s)) AS b,
  CASE WHEN s = 'amente' THEN p1 + 6 <= length(w) WHEN s <> '' THEN p2 + length(s) <= length(w) ELSE false END AS done FROM st_5),
st_7 AS (SELECT *, CASE WHEN s = 'amente' THEN {end(rest, 'ativ|iv|os|ic|ad')} WHEN s IN ({action}) THEN {end(rest, 'ic')}
  WHEN s = 'mente' THEN {end(rest, 'ante|able|ible')} WHEN s IN ('idad', 'idades') THEN {end(rest, 'abil|ic|iv')}
  WHEN s IN ('iva', 'ivo', 'ivas', 'ivos') THEN {end(rest, 'at')} ELSE '' END AS x FROM st_6),
st_8 AS (SELECT word, p1, p2, pv, done, CASE WHEN NOT done THEN w WHEN s IN ('logía', 'logías') THEN b || 'log'
  WHEN s IN ('ución', 'uciones') THEN b || 'u' WHEN s IN ('encia', 'encias') THEN b || 'ente'
  ELSE left(b, length(b) - length(x)) END AS w FROM st_7),
st_9 AS (SELECT *, regexp_extract(w, 'u({s.Y_VERBS})$', 1) AS s FROM st_8),
st_10 AS (SELECT word, p1, p2, pv, done, CASE WHEN NOT done AND pv + length(s) <= length(w) THEN left(w, length(w) - length(s)) ELSE w END AS w FROM st_9),
st_11 AS (SELECT *, CASE WHEN done THEN '' ELSE {end(tail.format('w', 'pv'), s.VERBS)} END AS s FROM st_10),
st_12 AS (SELECT word, pv, regexp_replace(left(w, length(w) - length(s)),
  CASE WHEN s IN ('en', 'es', 'éis', 'emos') THEN 'gu$' ELSE '^$' END, CASE WHEN s IN ('en', 'es', 'éis', 'emos') THEN 'g' ELSE '' END) AS w FROM st_11),
st_13 AS (SELECT *, {end(tail.format('w', 'pv'), s.RESIDUAL)} AS s FROM st_12),
st_14 AS (SELECT word, pv, s, left(w, length(w) - length(s)) AS b FROM st_13),
stems AS (SELECT word, translate(CASE WHEN s IN ('e', 'é') AND ends_with(b, 'gu') AND pv + 1 <= length(b)
  THEN left(b, length(b) - 1) ELSE b END, 'áéíóú', 'aeiou') AS stem FROM st_14)"""
