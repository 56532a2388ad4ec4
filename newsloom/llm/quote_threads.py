"""Chat formatting by quotation linking.

A message is parted into its own words and the passages it quotes, by nested quote
levels. Normalised passages are hashed and joined to the first message of the
conversation that wrote them. The links give threads, and a conversation is its
threads in order, each message after the one it replies to, without quotes. One
conversation may be large: its messages are never gathered in one task.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_rows, running_total
from newsloom.sources.workspace import write_through

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
# How mail programs introduce a quote.
_INTRODUCTION = re.compile(r"(?:\bwrote|\bschrieb\b.*|\ba écrit|\bescribió)\s*:\s*$", re.IGNORECASE)
_SPACE = re.compile(r"\s+")


def parse_message(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its quoted passages with their levels.

    A passage is a run of lines of one level. A line that introduces a quote goes with it.
    """
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    current = 0
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        level = marks[1].count(">") if marks else 0
        if not level:
            own.append(line)
        else:
            if not current and (place := next((i for i in range(len(own) - 1, -1, -1) if own[i].strip()), None)) is not None:
                if _INTRODUCTION.search(own[place]):
                    del own[place:]
            if level != current:
                passages.append((level, []))
            passages[-1][1].append(line[marks.end() :])
        current = level
    body = "\n".join(own)
    if passages:
        body = re.sub(r"\n{3,}", "\n\n", body).strip("\n")
    return body, [(level, "\n".join(lines)) for level, lines in passages]


def normalised(passage: str) -> str:
    return _SPACE.sub(" ", passage).strip().casefold()


def _hash(passage: str) -> int:
    return xxhash.xxh64_intdigest(passage.encode("utf-8", "surrogatepass")) - 2**63


def pieces(text: str) -> set[int]:
    """Hashes of what may be quoted of a text: the whole, its paragraphs and its lines."""
    parts = [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]
    return {_hash(n) for p in parts if (n := normalised(p))}


def parse_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, written (hashes of its own pieces) and quoted (level, hash)."""

    def per_batch(batch: pa.RecordBatch):
        bodies, written, quoted = [], [], []
        for text in batch.column(3).to_pylist():
            body, passages = parse_message(text or "")
            bodies.append(body)
            written.append(sorted(pieces(body)))
            # A passage is looked for as a whole and by its paragraphs and lines.
            quoted.append([{"level": level, "hash": h} for level, p in passages for h in sorted(pieces(p))])
        quote = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64())]))
        yield pa.RecordBatch.from_arrays([
            *batch.columns[:3], pa.array(bodies, pa.string()), pa.array(written, pa.list_(pa.int64())), pa.array(quoted, quote),
        ], ["conv_id", "turn", "role", "body", "written", "quoted"])

    rows = messages.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    return map_rows(
        rows, per_batch,
        "conv_id bigint, turn bigint, role string, body string, written array<bigint>, quoted array<struct<level:int,hash:bigint>>",
    )


def reply_links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn and parent: the message each one replies to, where a quote shows it.

    A quoted hash belongs to the first message of the conversation that wrote it, if that is
    earlier. Of the originals of the lowest level that has any, the latest is the parent.
    """
    quotes = parsed.filter(F.size("quoted") > 0).select("conv_id", "turn", F.explode("quoted").alias("q"))
    wanted = quotes.select("conv_id", "turn", "q.level", "q.hash").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    # Only what is quoted at all is looked up among what was written.
    asked = wanted.select("conv_id", "hash").distinct()
    first = (
        parsed.select("conv_id", "turn", F.explode("written").alias("hash")).groupBy("conv_id", "hash")
        .agg(F.min("turn").alias("original")).join(asked, ["conv_id", "hash"], "left_semi")
    )
    linked = wanted.join(first, ["conv_id", "hash"]).filter(F.col("original") < F.col("turn"))
    best = F.max(F.struct((-F.col("level")).alias("level"), "original")).alias("best")
    return linked.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", F.col("best.original").alias("parent"))


def thread_roots(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent, root and depth per linked message, by doubling the steps up."""
    steps = write_through(links.withColumn("root", F.col("parent")).withColumn("depth", F.lit(1).cast("bigint")), "threads")
    while True:
        up = steps.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moved = steps.join(up, ["conv_id", "root"], "left").select(
            "conv_id", "turn", "parent", F.coalesce("next", "root").alias("root"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"),
        )
        moved = write_through(moved, "threads")
        steps = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return steps


def chat_messages(messages: DataFrame) -> DataFrame:
    """Rows of ``messages`` (conv_id, turn, role, text) in reply order, without quotes.

    Columns: conv_id, turn, role, parent, root, depth, n_quotes, position (from 1 within the
    conversation: by thread, then turn) and text. Without a link a message is the root of
    its own thread. Null texts are empty; rows with a null conversation form one, rows with
    a null turn come first in theirs and take part in no link; rows that repeat a turn
    share its links and stand side by side.
    """
    parsed = write_through(parse_messages(messages), "messages")
    threads = thread_roots(reply_links(parsed))
    joined = (
        parsed.select("conv_id", "turn", "role", F.col("body").alias("text"), F.size("quoted").cast("bigint").alias("n_quotes"))
        .join(threads, ["conv_id", "turn"], "left")
        .withColumn("root", F.coalesce("root", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)))
        .withColumn("one", F.lit(1).cast("bigint"))
    )
    ranked = write_through(running_total(joined, [F.col(c) for c in ("conv_id", "root", "turn", "role", "text")], "one", "rank"), "ranked")
    starts = ranked.groupBy("conv_id").agg((F.min("rank") - 1).alias("start")).withColumnRenamed("conv_id", "of")
    return ranked.join(starts, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", "turn", "role", "parent", "root", "depth", "n_quotes", (F.col("rank") - F.col("start")).alias("position"), "text"
    )


def chat_line(role, text):
    """A message as a line block of a chat text."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))
