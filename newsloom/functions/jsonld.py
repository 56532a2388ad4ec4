"""JSON-LD blocks of a page -> ordered leaves -> article fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import clean_topic_array, clean_topics, strip_tags

CODE_OR_COMMENT = r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>"
LD_SCRIPT = r"""(?i)^<script\b[^>]*\btype\s*=\s*["']?[^"'>]*application/ld\+json"""
OBJECT, LIST = r"^\s*\{", r"^\s*\["
# What may open an object in a JSON text, also inside its strings.
OPENINGS = r"\{|\\u007[bB]"


def ld_blocks(html: Column) -> Column:
    """Contents of the JSON-LD scripts of a page, comments left out."""
    found = F.filter(
        F.regexp_extract_all(html, F.lit(CODE_OR_COMMENT), 0), lambda s: s.rlike(LD_SCRIPT)
    )
    return F.transform(
        found, lambda s: F.regexp_extract(s, r"(?is)^<script\b[^>]*>(.*)</script\s*>\z", 1)
    )


def _readable(text: Column) -> Column:
    """JSON text with raw control characters inside it made harmless."""
    return F.regexp_replace(text, r"[\x00-\x1f]", " ")


def json_object(text: Column) -> Column:
    """map<string,string> of a JSON object, null when the text is not one."""
    return F.when(text.rlike(OBJECT), F.from_json(text, "map<string,string>"))


def _parsed(text: Column, kind: str) -> Column:
    return F.coalesce(F.from_json(text, kind), F.from_json(_readable(text), kind))


def json_objects(text: Column) -> Column:
    """Objects of a block as JSON texts: the one object, or those of a top-level list."""
    one = F.when(F.from_json(text, "map<string,string>").isNotNull(), F.array(text)).when(
        F.from_json(_readable(text), "map<string,string>").isNotNull(), F.array(_readable(text))
    )
    many = F.filter(_parsed(text, "array<string>"), lambda o: json_object(o).isNotNull())
    parts = F.when(text.rlike(OBJECT), one).when(text.rlike(LIST), many)
    return F.coalesce(parts, F.array().cast("array<string>"))


def valid_blocks(blocks: Column) -> Column:
    """Blocks that parse as an object or a list."""
    return F.filter(
        blocks,
        lambda b: F.when(b.rlike(OBJECT), _parsed(b, "map<string,string>").isNotNull())
        .when(b.rlike(LIST), _parsed(b, "array<string>").isNotNull())
        .otherwise(False),
    )


def block_objects(blocks: Column) -> Column:
    """array<array<string>>: the objects of each block."""
    return F.transform(blocks, json_objects)


# The rows below are SQL text: one nested expression per level, parsed in one go.

def _entries(text: str) -> str:
    """Entries of an object in key order (of equal keys: first place, last value)."""
    return f"""transform(array(from_json({text}, 'map<string,string>')), m ->
      CASE WHEN size(array_distinct(map_keys(m))) = size(m) THEN map_entries(m)
      ELSE transform(array_distinct(map_keys(m)), k -> named_struct('key', k, 'value',
        element_at(filter(map_entries(m), d -> d.key = k), -1).value)) END)[0]"""


def _rows(entries: str, block: str, item: str, path: str, depth: str) -> str:
    return f"""transform({entries}, e -> named_struct('block', {block}, 'item', {item},
      'path', {path}e.key, 'key', e.key, 'value', e.value, 'depth', {depth}, 'parent', false,
      'open', coalesce(startswith(e.value, '{{'), false)))"""


def json_leaves(objects: str) -> Column:
    """Key/value rows of nested objects, depth first, from the column ``objects``.

    ``objects`` names a column made by ``block_objects``. The rows of a nested
    object come before the row of its own key; that row (``parent`` true) holds
    the names of the child keys. Lists are not entered. A pass opens one level;
    there are as many passes as a text has openings at most, and once no row is
    open the rest do nothing. Depth ends only where the JSON parser's does.
    """
    rows = f"""flatten(transform({objects}, (b, i) -> flatten(transform(b, (o, j) ->
      {_rows(_entries('o'), 'i', 'j', '', '0')}))))"""
    inside = _rows("c", "x.block", "x.item", "x.path || '.' || ", "x.depth + 1")
    own = """array(named_struct('block', x.block, 'item', x.item, 'path', x.path, 'key', x.key,
      'value', coalesce(array_join(transform(c, n -> n.key), ','), x.value), 'depth', x.depth,
      'parent', c IS NOT NULL, 'open', false))"""
    opened = f"""transform(array({_entries('x.value')}), c ->
      CASE WHEN c IS NULL THEN {own} ELSE concat({inside}, {own}) END)[0]"""
    openings = f"""aggregate(flatten({objects}), 0, (n, o) -> n + regexp_count(o, '{OPENINGS.replace(chr(92), chr(92) * 2)}'))"""

    def state(of: str) -> str:
        return f"named_struct('rows', {of}, 'open', exists({of}, y -> y.open))"

    more = "flatten(transform(s.rows, x -> CASE WHEN x.open THEN " + opened + " ELSE array(x) END))"
    step = f"CASE WHEN s.open THEN transform(array({more}), r -> {state('r')})[0] ELSE s END"
    return F.expr(f"""aggregate(slice(sequence(0, {openings}), 2, {openings} + 1),
      transform(array({rows}), r -> {state('r')})[0], (s, k) -> {step}, s -> s.rows)""")


def json_depth(leaves: Column) -> Column:
    """Number of object levels entered."""
    return F.coalesce(
        F.array_max(F.transform(leaves, lambda x: x["depth"])), F.lit(0)
    )


# ---- article fields --------------------------------------------------------

FIELDS = (
    "title", "description", "body", "creation_datetime", "modified_datetime",
    "main_topic", "other_topic",
)
_STATE = (
    "struct<typed:boolean,stop_block:int,cut_block:int,cut_item:int,"
    + ",".join(f"{f}:string" for f in FIELDS)
    + ">"
)


def _topics_of(value: Column) -> Column:
    """Topic list of a JSON value: a text, or a list of texts."""
    items = F.from_json(value, "array<string>")
    cleaned = F.when(value.rlike(LIST) & items.isNotNull(), clean_topic_array(items))
    return F.nullif(F.coalesce(cleaned, clean_topics(value)), F.lit(""))


def article_fields(leaves: Column, only_body: bool = True) -> Column:
    """First matching value per field over the ordered leaves.

    A key with ``type`` in it decides: a value with ``media`` ends its object
    and keeps later blocks out; one that starts with ``news`` or ends with
    ``article`` marks the page as an article. Without such a mark the result
    is null.
    """
    start = F.from_json(F.lit('{"typed":false}'), _STATE)

    def step(s: Column, x: Column) -> Column:
        key, value = x["key"], x["value"]
        usable = ~x["parent"] & value.isNotNull()
        cut = F.coalesce(
            (s["cut_block"] == x["block"]) & (s["cut_item"] == x["item"]), F.lit(False)
        )
        live = F.coalesce(x["block"] <= s["stop_block"], F.lit(True)) & ~cut
        kind = F.lower(value)
        asks = live & usable & ~s["typed"] & key.contains("type")
        media = asks & kind.contains("media")
        hit = asks & ~media & (kind.startswith("news") | kind.endswith("article"))
        reads = live & usable & ~media & ~hit

        def first(field: str, test: Column, new: Column) -> Column:
            return F.coalesce(s[field], F.when(reads & test, new))

        found = {f: s[f] for f in FIELDS}
        found["body"] = first("body", key.contains("articleBody"), strip_tags(value))
        if not only_body:
            found["description"] = first("description", key.contains("description"), value)
            found["creation_datetime"] = first(
                "creation_datetime", key.contains("datePublished"), value)
            found["modified_datetime"] = first(
                "modified_datetime", key.contains("dateModified"), value)
            found["title"] = first("title", key.contains("headline"), value)
            found["main_topic"] = first(
                "main_topic",
                (key.contains("articleSection") & ~value.contains("list"))
                | key.contains("list"),
                kind,
            )
            found["other_topic"] = first(
                "other_topic",
                (key.contains("keywords") | key.contains("tags")) & (value != ""),
                _topics_of(value),
            )
        full = F.lit(False)
        if not only_body:
            full = F.lit(True)
            for f in FIELDS:
                full = full & found[f].isNotNull()
        ends = media | (reads & full)
        return F.struct(
            (s["typed"] | hit).alias("typed"),
            F.coalesce(s["stop_block"], F.when(ends, x["block"])).alias("stop_block"),
            F.when(ends, x["block"]).otherwise(s["cut_block"]).alias("cut_block"),
            F.when(ends, x["item"]).otherwise(s["cut_item"]).alias("cut_item"),
            *[found[f].alias(f) for f in FIELDS],
        )

    def finish(s: Column) -> Column:
        return F.when(s["typed"], F.struct(*[s[f].alias(f) for f in FIELDS]))

    return F.aggregate(leaves, start, step, finish)


def with_article_fields(df: DataFrame, html: Column, out: str, only_body: bool = True) -> DataFrame:
    """Add the JSON-LD article fields of a page as struct ``out`` (null without an article)."""
    columns = df.columns
    return (
        df.select("*", block_objects(ld_blocks(html)).alias("_objects"))
        .select(*columns, json_leaves("_objects").alias("_leaves"))
        .select(*columns, article_fields(F.col("_leaves"), only_body).alias(out))
    )
