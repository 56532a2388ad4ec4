"""Line deduplication by pairwise alignment.

The hash of a line leads to the first document that has it. A document is paired with
the first owners of its shared lines, rare ones included and frequent ones too, so a
line of n documents makes n - 1 pairs and not n squared. A pair holds the lines of the
later document around those that the earlier one owns, and no more, so a document of
many lines with as many first owners is sent about once. It is aligned by patience
diff over its line hashes, and what that leaves by passages. Passages that no pair
settles lead by their hash to the first document with the whole passage. An aligned
block of enough words is deleted from the later document. Documents are ordered by id.

A passage is a shortest run of lines with enough words that all have an earlier first
owner. It goes if its lines stand in the same order in the first owner of one of its
lines (or of a line of the passages that overlap it), others between them allowed; or
if they follow one another in any earlier document, where lines that no other document
has do not count. Lines and passages are known by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import free_names, map_rows, row_key, words_of
from newsloom.sources.workspace import write_through

# A block of fewer words stays: heads, feet and licence lines are not passages.
MIN_BLOCK_WORDS = 30
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_KEY = "struct<id:bigint,hash:bigint>"


def real_lines(text: str) -> list[tuple[int, str]]:
    """Place and content of the lines with a word; white space around a line does not count."""
    return [(i, x) for i, line in enumerate(text.split("\n")) if (x := line.strip(_SPACE))]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two line sequences by patience diff.

    Equal ends of a range are aligned, then its lines that are unique in both ranges
    along their longest increasing run, then the ranges between them in the same way.
    """
    out: list[tuple[int, int]] = []
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and in_a[x] == 1}
        pairs = [(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if x in place]
        # Longest increasing run of the places in b.
        ends: list[int] = []
        last: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(pairs):
            at = bisect_left(ends, j)
            back.append(last[at - 1] if at else -1)
            ends[at : at + 1] = [j]
            last[at : at + 1] = [k]
        k, anchors = last[-1] if last else -1, []
        while k >= 0:
            anchors.append(pairs[k])
            k = back[k]
        if not anchors:
            continue
        out += anchors
        stops = [(a0 - 1, b0 - 1), *reversed(anchors), (a1, b1)]
        waiting += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(stops, stops[1:])]
    return sorted(out)


def passages(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """[start, end) of the shortest runs of ``min_words`` from each line on and up to each line.

    A line that is inside any run of so many words is also inside one of these within that run.
    """
    upto = [0, *accumulate(words)]
    ends = [(i, bisect_left(upto, x + min_words)) for i, x in enumerate(upto[:-1])]
    starts = [(bisect_right(upto, x - min_words) - 1, j) for j, x in enumerate(upto) if x >= min_words]
    return sorted({(i, j) for i, j in ends if j < len(upto)} | {(i, j) for i, j in starts if i < j})


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[tuple[int, int]]:
    """[start, end) places of the lines of ``a`` that are in runs of ``min_words`` and more that ``b`` has too.

    ``b`` has the lines of a run in the same order; it may have others between them. Runs are
    those that patience diff aligns; what it leaves, for want of lines that are unique in both
    or since two runs stand in ``b`` the other way round, is looked up passage by passage.
    """
    inside, start, last = [False] * len(a), None, -2
    for i in [*(i for i, _ in patience(a, b)), -2]:
        if i != last + 1:
            if start is not None and sum(words[start : last + 1]) >= min_words:
                inside[start : last + 1] = [True] * (last + 1 - start)
            start = i
        last = i
    if not all(inside):
        places: dict[int, list[int]] = {x: [] for x in a}
        for j, x in enumerate(b):
            if x in places:
                places[x].append(j)
        for i, j in passages(words, min_words):
            if not all(inside[i:j]):
                k, at = i, -1
                while k < j and (n := bisect_right(places[a[k]], at)) < len(places[a[k]]):
                    k, at = k + 1, places[a[k]][n]
                if k == j:
                    inside[i:j] = [True] * (j - i)
    edges = [i for i in range(len(a) + 1) if (i > 0 and inside[i - 1]) != (i < len(a) and inside[i])]
    return list(zip(edges[::2], edges[1::2]))


def line_sequences(docs: DataFrame) -> DataFrame:
    """key, lines (hashes of the lines with a word) and words (their numbers) per distinct document."""

    def per_batch(batch: pa.RecordBatch):
        lines, words = [], []
        for text in batch.column(1).to_pylist():
            real = [x for _, x in real_lines(text)]
            lines.append(np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in real], np.uint64).view(np.int64))
            words.append([len(words_of(x)) for x in real])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lines, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))],
            ["key", "lines", "words"],
        )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(row_key(F.col("doc_id"), text).alias("key"), text.alias("text"))
    return map_rows(rows, per_batch, f"key {_KEY}, lines array<bigint>, words array<int>").dropDuplicates(["key"])


def _later_stretches(lines: DataFrame, sequences: DataFrame, min_words: int) -> DataFrame:
    """Stretches of the lines of a document that others have too, up to a line that it has first itself.

    key, and per line its place, hash, words and first owner. Lines that no other document has are left out.
    """
    # Written, so that the join below deals out both sides anew and can split a frequent line.
    owners = write_through(
        lines.groupBy("line").agg(F.min("key").alias("owner"), F.count("*").alias("n")).filter("n > 1").drop("n"), "line-owners"
    )
    shared = lines.join(owners, "line").groupBy("key").agg(F.collect_list(F.struct("line", "owner")).alias("shared"))

    def per_batch(batch: pa.RecordBatch):
        out = []
        for row in batch.to_pylist():
            known = {s["line"]: s["owner"] for s in row["shared"]}
            stretch: list[tuple] = []
            for place, (line, words) in enumerate([*zip(row["lines"], row["words"]), (None, 0)]):
                owner = known.get(line)
                if line is not None and owner != row["key"]:
                    if owner:
                        stretch.append((place, line, words, owner))
                else:
                    # No block in a shorter one can be long enough.
                    if sum(x[2] for x in stretch) >= min_words:
                        out.append((row["key"], *map(list, zip(*stretch))))
                    stretch = []
        columns = list(zip(*out)) or [[]] * 5
        key = pa.struct([("id", pa.int64()), ("hash", pa.int64())])
        types = (key, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(key))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)], ["key", "places", "lines", "words", "owners"]
        )

    return map_rows(
        sequences.join(shared, "key"), per_batch,
        f"key {_KEY}, places array<int>, lines array<bigint>, words array<int>, owners array<{_KEY}>",
    )


def owned_windows(starts: list[int], ends: list[int], owned: list[int]) -> list[tuple[int, int]]:
    """[start, end) of the passages that have one of the lines ``owned``, joined where they overlap.

    The passages are those of a run, in order: their starts ascend and so do their ends.
    """
    out: list[tuple[int, int]] = []
    for at in owned:
        first, last = bisect_right(ends, at), bisect_right(starts, at)
        if first < last:
            start, end = starts[first], ends[last - 1]
            if out and start < out[-1][1]:
                start, end = out.pop()[0], max(end, ends[last - 1])
            out.append((start, end))
    return out


def _solid_runs(places: list[int]) -> list[tuple[int, int]]:
    """[start, end) of the parts of a stretch whose lines follow one another in the document."""
    cuts = [0, *(k for k in range(1, len(places)) if places[k] != places[k - 1] + 1), len(places)]
    return list(zip(cuts, cuts[1:]))


def owner_pairs(stretches: DataFrame, min_words: int) -> DataFrame:
    """key, owner, start, and lines and words of the document around the lines that the owner has first."""

    def per_batch(batch: pa.RecordBatch):
        out = []
        for row in batch.to_pylist():
            for a, b in _solid_runs(row["places"]):
                owned: dict[tuple, list[int]] = {}
                for k, owner in enumerate(row["owners"][a:b]):
                    owned.setdefault((owner["id"], owner["hash"]), []).append(k)
                words = row["words"][a:b]
                starts, ends = zip(*(passages(words, min_words) or [(0, 0)]))
                for (id_, hash_), at in owned.items():
                    for i, j in owned_windows(starts, ends, at):
                        owner = {"id": id_, "hash": hash_}
                        out.append((row["key"], owner, row["places"][a + i], row["lines"][a + i : a + j], words[i:j]))
        columns = list(zip(*out)) or [[]] * 5
        key = batch.schema.field("key").type
        types = (key, key, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)], ["key", "owner", "start", "lines", "words"]
        )

    return map_rows(stretches, per_batch, f"key {_KEY}, owner {_KEY}, start int, lines array<bigint>, words array<int>")


def _passage_rows(stretches: DataFrame, blocks: DataFrame, min_words: int) -> DataFrame:
    """Passages of more than one line: passage (hash), key, [start, end) places, words, and whether the lines
    follow one another in the document and the ``blocks`` leave one of them."""
    gone = blocks.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("gone"))

    def per_batch(batch: pa.RecordBatch):
        out = []
        for key, places, lines, words, gone in zip(*(c.to_pylist() for c in batch.columns)):
            deleted = {i for b in gone or () for i in range(b["start"], b["end"])}
            kept = [0, *accumulate(x not in deleted for x in places)]
            upto = [0, *accumulate(words)]
            hashes = np.array(lines, np.int64)
            for i, j in passages(words, min_words):
                if j - i > 1:
                    left = places[j - 1] - places[i] == j - 1 - i and kept[j] > kept[i]
                    name = xxhash.xxh64_intdigest(hashes[i:j].tobytes())
                    out.append((name, key, places[i], places[j - 1] + 1, upto[j] - upto[i], left))
        columns = list(zip(*out)) or [[]] * 6
        columns[0] = np.array(columns[0], np.uint64).view(np.int64)
        types = (pa.int64(), batch.schema.field("key").type, pa.int32(), pa.int32(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["passage", "key", "start", "end", "words", "left"]
        )

    rows = stretches.join(gone, "key", "left").select("key", "places", "lines", "words", "gone")
    return map_rows(rows, per_batch, f"passage bigint, key {_KEY}, start int, end int, words bigint, left boolean")


def repeated_blocks(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """key, and blocks (array of start, end, owner, words) per document with aligned blocks.

    Places count the lines with a word. ``owner`` is the id of the earlier document.
    """
    sequences = write_through(line_sequences(docs), "line-sequences")
    others = sequences.select(F.col("key").alias("owner"), F.col("lines").alias("other"))
    lines = sequences.select("key", F.explode(F.array_distinct("lines")).alias("line"))
    stretches = write_through(_later_stretches(lines, sequences, min_words), "line-stretches")

    def per_batch(batch: pa.RecordBatch):
        out = []
        for key, owner, start, lines, words, other in zip(*(c.to_pylist() for c in batch.columns)):
            for a, b in common_blocks(lines, other, words, min_words):
                out.append((key, start + a, start + b, owner["id"], sum(words[a:b])))
        columns = list(zip(*out)) or [[]] * 5
        types = (batch.schema.field("key").type, pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)], ["key", "start", "end", "owner", "words"]
        )

    pairs = owner_pairs(stretches, min_words).join(others, "owner").select("key", "owner", "start", "lines", "words", "other")
    blocks = write_through(map_rows(pairs, per_batch, f"key {_KEY}, start int, end int, owner bigint, words bigint"), "line-blocks")

    # Passages that first owners of lines leave lead to the first document with the whole passage.
    rows = write_through(_passage_rows(stretches, blocks, min_words), "passages")
    first = rows.groupBy("passage").agg(F.min("key").alias("first"), F.max("left").alias("any")).filter("any").drop("any")
    more = (
        rows.filter("left").join(first, "passage").filter(F.col("first") < F.col("key"))
        .select("key", "start", "end", F.col("first.id").alias("owner"), "words")
    )
    return (
        blocks.unionByName(more).groupBy("key")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end", "owner", "words"))).alias("blocks"))
    )


def delete_blocks(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``docs`` without the repeated blocks in its texts, and with two more columns.

    ``_lines`` is the number of lines with a word before, ``_blocks`` the deleted blocks
    (start, end, owner, words), which may overlap; both names get more underscores where
    ``docs`` has them. Null and empty texts have no lines; documents without an id are the
    latest of all; rows equal in id and text are one document and are edited alike; lines
    equal within one document are not touched.
    """
    n_lines, blocks, id_, hash_ = free_names(docs, "_lines", "_blocks", "_id", "_hash")
    key = row_key(F.col("doc_id"), F.col("text"))
    found = repeated_blocks(docs, min_words).select(F.col("key.id").alias(id_), F.col("key.hash").alias(hash_), F.col("blocks").alias(blocks))
    joined = (
        docs.withColumn(id_, key["id"]).withColumn(hash_, key["hash"]).join(found, [id_, hash_], "left")
        .select(*docs.columns, F.lit(0).cast("bigint").alias(n_lines), blocks)
    )
    names = joined.columns
    place, at_lines, at_blocks = names.index("text"), len(names) - 2, len(names) - 1

    def per_batch(batch: pa.RecordBatch):
        texts, counts = [], []
        for text, gone_blocks in zip(batch.column(place).to_pylist(), batch.column(at_blocks).to_pylist()):
            real = real_lines(text or "")
            counts.append(len(real))
            if gone_blocks:
                inside = {k for b in gone_blocks for k in range(b["start"], b["end"])}
                # Blank lines between two deleted ones go with them.
                gone = {i for k in inside for i in range(real[k][0], real[k + 1][0] if k + 1 in inside else real[k][0] + 1)}
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            texts.append(text)
        new = {place: pa.array(texts, batch.column(place).type), at_lines: pa.array(counts, pa.int64())}
        yield pa.RecordBatch.from_arrays([new.get(i, c) for i, c in enumerate(batch.columns)], names)

    return map_rows(joined, per_batch, joined.schema)


def without_repeats(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``docs`` with repeated blocks deleted; a document of nothing but such blocks goes."""
    edited = delete_blocks(docs, min_words)
    left = F.col(edited.columns[-1]).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return edited.filter(left).select(*docs.columns)
