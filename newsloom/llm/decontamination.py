"""Benchmark decontamination by an FM-index per shard of training text.

Words become numbers of the test phrases' vocabulary; all other words are one
foreign symbol, and of them only that they part the text is kept. A shard's
sequence gets a suffix array, its Burrows-Wheeler transform a wavelet matrix
whose ranks drive the backward search of all windows at once, and sampled suffix
positions locate the occurrences. Texts stay where they are: a task indexes and
searches the shards of its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from newsloom.llm.common import count_words, free_names, in_blocks, in_slices, map_rows, row_key
from newsloom.sources.workspace import write_through

WINDOW_WORDS = 10
# Words of a shard; a longer text is a shard alone.
SHARD_WORDS = 500_000
# Bytes of test items searched in one pass; more items are searched in more passes.
BLOCK_BYTES = 4 * 1024 * 1024
# Hits of several blocks are broadcast to their rows up to this size, which is measured.
BROADCAST_BYTES = 32 * 1024 * 1024
PHRASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SAMPLE_EVERY = 8
FOREIGN = 1

# Letters to lower case, what parts words to a blank, bytes above 7F as they are.
_FOLD = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)


def phrase_words(text: str) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class _Vocabulary(dict):
    def __missing__(self, word):
        return FOREIGN


class Phrases:
    """Windows of a block of test items, as numbers, with the items that have them."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW_WORDS):
        self.vocabulary = _Vocabulary()
        self.items: list[str | None] = []
        found: dict[tuple[int, ...], set[int]] = {}
        for item_id, text in items:
            words = phrase_words(text or "")
            if not words:
                continue
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + FOREIGN + 1) for w in words]
            self.items.append(item_id)
            for i in range(max(1, len(numbers) - window + 1)):
                found.setdefault(tuple(numbers[i : i + window]), set()).add(len(self.items) - 1)
        by_length: dict[int, list] = {}
        for numbers, owners in found.items():
            by_length.setdefault(len(numbers), []).append((numbers, sorted(owners)))
        # Per length: the windows, and their owners as one array with its cuts.
        self.windows = {
            n: (
                np.array([w for w, _ in ws], np.int64),
                np.array([o for _, os in ws for o in os], np.int64),
                np.cumsum([0] + [len(os) for _, os in ws]),
            )
            for n, ws in by_length.items()
        }
        self.shortest = min(by_length, default=0)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` in order, by prefix doubling; ``s`` ends with its only smallest symbol."""
    n, h = len(s), 1
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    while True:
        second = np.zeros(n, np.int64)
        second[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        h *= 2


class FmIndex:
    """FM-index of a sequence of numbers above 0."""

    def __init__(self, text: np.ndarray, symbols: int):
        s = np.concatenate([text, [0]])
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))])
        # Wavelet matrix, high bit first: zeros up to each place of each level.
        self.zeros = []
        self.n_bits = max(1, int(symbols - 1).bit_length())
        level = bwt
        for bit in reversed(range(self.n_bits)):
            ones = (level >> bit) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - ones)]).astype(np.int32))
            level = np.concatenate([level[ones == 0], level[ones == 1]])
        self.bwt = bwt
        self.sampled = sa % SAMPLE_EVERY == 0
        self.samples = sa[self.sampled]
        self.sample_at = np.cumsum(self.sampled) - 1

    def _down(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, zeros in zip(reversed(range(self.n_bits)), self.zeros):
            left = zeros[at].astype(np.int64)
            at = np.where((c >> bit) & 1, zeros[-1] + at - left, left)
        return at

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``c`` in the transform before ``at``."""
        return self._down(c, at) - self._down(c, np.zeros_like(at))

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that occur, with their ranges of suffixes."""
        alive = np.arange(len(windows))
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.bwt), np.int64)
        for column in reversed(range(windows.shape[1])):
            c = windows[alive, column]
            low, high = self.before[c] + self.rank(c, low), self.before[c] + self.rank(c, high)
            some = high > low
            alive, low, high = alive[some], low[some], high[some]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to a sampled one."""
        out = np.empty(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            hit = self.sampled[rows]
            out[left[hit]] = self.samples[self.sample_at[rows[hit]]] + steps
            left, rows = left[~hit], rows[~hit]
            c = self.bwt[rows]
            rows = self.before[c] + self.rank(c, rows)
            steps += 1
        return out


def _shard_hits(words: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Which words of the shard, text after text, are hit; and (text, item) pairs."""
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    hit = np.zeros(total + 1, np.int64)
    none = np.empty((0, 2), np.int64)
    if not phrases.windows or not total:
        return hit[:-1] > 0, none
    number = phrases.vocabulary.__getitem__
    ids = np.fromiter((number(w) for ws in words for w in ws), np.int64, total)
    text = np.repeat(np.arange(len(words)), sizes)
    # Stretches of known words within a text, as long as the shortest window at least.
    known = ids != FOREIGN
    start = known & np.concatenate([[True], ~known[:-1] | (text[1:] != text[:-1])])
    stretch = np.cumsum(start)
    long_enough = known & (np.bincount(stretch[known], minlength=stretch[-1] + 1)[stretch] >= phrases.shortest)
    at = np.nonzero(long_enough)[0]
    if not len(at):
        return hit[:-1] > 0, none
    # A foreign symbol stands before each stretch.
    place = np.arange(len(at)) + np.cumsum(start[at])
    sequence = np.full(place[-1] + 1, FOREIGN, np.int64)
    sequence[place] = ids[at]
    origin = np.zeros(len(sequence), np.int64)
    origin[place] = at
    index = FmIndex(sequence, len(phrases.vocabulary) + FOREIGN + 1)
    pairs = [none]
    for n, (windows, owners, cuts) in phrases.windows.items():
        found, low, high = index.search(windows)
        count = high - low
        if not len(found):
            continue
        rows = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        began = origin[index.locate(rows)]
        np.add.at(hit, began, 1)
        np.add.at(hit, began + n, -1)
        seen = np.unique(np.stack([text[began], np.repeat(found, count)], 1), axis=0)
        n_owners = cuts[seen[:, 1] + 1] - cuts[seen[:, 1]]
        each = np.repeat(cuts[seen[:, 1]] - np.cumsum(n_owners) + n_owners, n_owners) + np.arange(n_owners.sum())
        pairs.append(np.stack([np.repeat(seen[:, 0], n_owners), owners[each]], 1))
    return np.cumsum(hit[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


def _runs(mask: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges.reshape(-1, 2).tolist()


def blocks_of_items(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str]]]:
    """Test items in blocks of bounded size, each fetched by itself when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter(F.length("text") > 0).withColumn("bytes", F.octet_length("text") + 16)
    for block in in_blocks(items, [F.col("item_id"), F.col("text")], "bytes", block_bytes):
        yield [(r["item_id"], r["text"]) for r in block]


def _search(docs: DataFrame, shared, shard_words: int) -> DataFrame:
    """``docs`` with hit word ranges, hit items and number of words behind its own columns, for one block of items."""
    place, n_columns = docs.columns.index("text"), len(docs.columns)
    empty = F.array().cast
    marked = docs.select(
        "*", empty("array<array<int>>").alias("_1"), empty("array<string>").alias("_2"), F.lit(0).cast("bigint").alias("_3")
    )
    names_of = [f"c{i}" for i in range(n_columns + 3)]

    def per_batch(batch: pa.RecordBatch):
        phrases = shared.value
        texts = [t or "" for t in batch.column(place).to_pylist()]
        for first, end in in_slices([len(t) // 5 for t in texts], shard_words):
            words = [phrase_words(t) for t in texts[first:end]]
            hit, pairs = _shard_hits(words, phrases)
            part = batch.slice(first, end - first)
            spans, names = [[] for _ in words], [[] for _ in words]
            cuts = np.cumsum([0] + [len(w) for w in words])
            # Pairs are sorted by text.
            hit_texts, begin = np.unique(pairs[:, 0], return_index=True)
            for i, items in zip(hit_texts.tolist(), np.split(pairs[:, 1], begin[1:])):
                spans[i] = _runs(hit[cuts[i] : cuts[i + 1]])
                names[i] = [phrases.items[j] for j in items]
            columns = part.columns[:n_columns] + [
                pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(names, pa.list_(pa.string())),
                pa.array(np.diff(cuts), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names_of)

    schema = StructType([StructField(n, f.dataType) for n, f in zip(names_of, marked.schema)])
    return map_rows(marked.toDF(*names_of), per_batch, schema)


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS,
              block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with three columns behind its own: hit word ranges, hit items and number of words.

    The ranges are [start, end) pairs of word positions. Items of one block are searched
    while the rows stay in place. Of more blocks one at a time is on the driver and with
    the tasks: its hits are written with the keys of their rows, and merged by key behind
    the last. A null text has no words and no hits; null and empty items are not searched;
    items without an id are, and stand as null among the hit items.
    """
    context = docs.sparkSession.sparkContext
    names = [*docs.columns, *free_names(docs, "_hit_spans", "_hit_items", "_n_words")]
    blocks = blocks_of_items(benchmark, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _search(docs, context.broadcast(Phrases(first, window)), shard_words).toDF(*names)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(row_key(F.col("doc_id"), text).alias("key"), text.alias("text"))
    hits = None
    for items in chain([first, second], blocks):
        shared = context.broadcast(Phrases(items, window))
        found = _search(rows, shared, shard_words).toDF("key", "text", "spans", "items", "n").filter(F.size("spans") > 0)
        # Equal rows have equal hits.
        part = write_through(found.select("key", "spans", "items").dropDuplicates(["key"]), "block-hits")
        hits = part if hits is None else hits.unionByName(part)
        shared.destroy()
    merged_hits = write_through(hits.groupBy("key").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    ), "merged-hits")
    size = F.octet_length(F.concat_ws("", "items")) + 8 * F.size("spans") + 64
    n_bytes = merged_hits.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    right = F.broadcast(merged_hits) if n_bytes <= BROADCAST_BYTES else merged_hits
    spans, items, n_words, key = *names[-3:], *free_names(docs, "_key")
    none = F.array().cast
    joined = docs.withColumn(key, row_key(F.col("doc_id"), text)).alias("d").join(right.alias("h"), F.col(f"d.{key}") == F.col("h.key"), "left")
    return joined.select(
        *(F.col(f"d.`{c}`") for c in docs.columns), F.coalesce("h.spans", none("array<array<int>>")).alias(spans),
        F.coalesce("h.items", none("array<string>")).alias(items), count_words(F.col("d.text"), PHRASE_WORD).alias(n_words),
    )


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Overlapping and touching [start, end) ranges as one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), spans and contaminated per row of ``docs``.

    Items without an id hit like all others and count as one item, which ``items`` leaves out.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def per_batch(batch: pa.RecordBatch):
        spans = [merged(s) for s in batch.column(1).to_pylist()]
        hits = [sum(b - a for a, b in s) for s in spans]
        found = [set(i) for i in batch.column(2).to_pylist()]
        items = [sorted(i - {None}) for i in found]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(3), pa.array(hits, pa.int64()), pa.array([len(i) for i in found], pa.int64()),
            pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int32()))),
            pa.array([h > 0 for h in hits]),
        ], ["doc_id", "n_words", "n_hit", "n_items", "items", "spans", "contaminated"])

    marked = with_hits(rows, benchmark, **options).drop("text")
    return map_rows(
        marked, per_batch,
        "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items array<string>, "
        "spans array<array<int>>, contaminated boolean",
    )


def cut_words(text: str, spans: list[list[int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    # A word starts at a word byte after another byte.
    is_word = np.frombuffer(raw.translate(_FOLD), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[0], is_word.astype(np.int8), [0]]))).reshape(-1, 2)
    kept, last = [], 0
    for start, end in merged(spans):
        kept.append(raw[last : edges[start, 0]])
        last = edges[end - 1, 1]
    return b"".join([*kept, raw[last:]]).decode("utf-8", "surrogatepass")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with the hit words cut from its texts; a text of nothing but hits goes with its row."""
    names = docs.columns
    place = names.index("text")

    def per_batch(batch: pa.RecordBatch):
        spans = [merged(s) for s in batch.column(len(names)).to_pylist()]
        sizes = batch.column(len(names) + 2).to_pylist()
        keep = [not s or sum(b - a for a, b in s) < n for s, n in zip(spans, sizes)]
        texts = batch.column(place)
        if any(spans):
            cut = [t if not s else cut_words(t, s) for t, s in zip(texts.to_pylist(), spans)]
            texts = pa.array(cut, texts.type)
        columns = [texts if i == place else batch.column(i) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return map_rows(with_hits(docs, benchmark, **options), per_batch, docs.schema)
