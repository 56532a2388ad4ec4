"""Ranked lexical search by presence masks.

Per item, bitmaps of its terms over the documents of a shard are turned by bit
into one mask per document, which says what terms the document has. Documents
with one mask form a group, and the largest shares of the mask's terms bound the
score of the group. Groups are scored in descending order of their bounds, until
no bound reaches the last score that is kept. A task carries the kept scores of
its items from shard to shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import NO_ID, in_blocks, in_slices, map_rows
from newsloom.llm.decontamination import phrase_words as terms_of
from newsloom.sources.workspace import write_through

RANKS = 50
# Bytes of items searched in one pass; more items are searched in more passes.
BLOCK_BYTES = 256 * 1024
# Documents whose bitmaps are held at once.
SHARD_DOCS = 8192
# Documents scored between two looks at the bounds.
_DOCS_AT_ONCE = 256
_SALTS = 64
_RESULT = "item int, doc_id bigint, score bigint"


class Items:
    """Terms of a block of items, as numbers."""

    def __init__(self, texts: list[str]):
        self.number: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        for text in texts:
            found = dict.fromkeys(terms_of(text or ""))
            self.terms.append(np.array([self.number.setdefault(t, len(self.number)) for t in found], np.int64))


def document_terms(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n (terms with repeats), and terms and counts of those that ``items`` have, per row of ``docs``."""
    number = docs.sparkSession.sparkContext.broadcast(items.number)

    def per_batch(batch: pa.RecordBatch):
        get, texts = number.value.get, batch.column(1).to_pylist()
        for start, end in in_slices([1 + len(t or "") // 1000 for t in texts], SHARD_DOCS):
            words = [terms_of(t or "") for t in texts[start:end]]
            sizes = np.array([len(w) for w in words], np.int64)
            flat = np.fromiter((x for ws in words for x in map(get, ws, repeat(-1))), np.int64, sizes.sum())
            width = len(number.value) + 1
            keys, counts = np.unique((np.repeat(np.arange(len(words)), sizes) * width + flat)[flat >= 0], return_counts=True)
            cuts = np.searchsorted(keys, np.arange(len(words) + 1) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (keys % width, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, end - start), pa.array(sizes), *lists], ["doc_id", "n", "terms", "counts"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return map_rows(rows, per_batch, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _groups(has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First document of each distinct mask, and the mask's number per document; ``has`` is terms x documents."""
    packed = np.packbits(has, axis=0).T
    masks = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    masks[:, : packed.shape[1]] = packed
    masks = masks.view(np.uint64)
    _, first, group = np.unique(masks[:, 0], return_index=True, return_inverse=True)
    for column in range(1, masks.shape[1]):
        values, more = np.unique(masks[:, column], return_inverse=True)
        _, first, group = np.unique(group * len(values) + more, return_index=True, return_inverse=True)
    return first, group


class Kept:
    """The best documents of an item so far."""

    def __init__(self, ranks: int):
        self.ranks = ranks
        self.score = np.empty(0, np.int64)
        self.doc = np.empty(0, np.int64)
        self.named = np.empty(0, bool)

    def least(self) -> int:
        """A score below this one can't be kept any more."""
        return int(self.score[-1]) if len(self.score) == self.ranks else 1

    def add(self, score: np.ndarray, doc: np.ndarray, named: np.ndarray) -> None:
        good = score >= self.least()
        score, doc, named = (
            np.concatenate([a, b[good]]) for a, b in ((self.score, score), (self.doc, doc), (self.named, named))
        )
        order = np.lexsort((doc, ~named, -score))[: self.ranks]
        self.score, self.doc, self.named = score[order], doc[order], named[order]


class Shard:
    """Postings of some documents by term, with the share of each: the term's part of a score at weight 1."""

    def __init__(self, batch: pa.RecordBatch, n_docs: int, n_terms: int):
        ids, n, terms, counts = batch.columns
        self.named = ids.is_valid().to_numpy(False)
        self.doc = ids.fill_null(NO_ID).to_numpy()
        mean = 100 - 50 + 50 * n.to_numpy() * n_docs // max(1, n_terms)
        place = np.repeat(np.arange(len(batch)), terms.value_lengths().to_numpy())
        term, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
        order = np.argsort(term, kind="stable")
        self.term, starts = np.unique(term[order], return_index=True)
        self.cuts = np.append(starts, len(order))
        self.place = place[order]
        self.share = (1_000_000_000 * tf // (1000 * tf + 20 * mean[place]))[order]
        self.largest = np.maximum.reduceat(self.share, starts) if len(starts) else starts

    def search(self, terms: np.ndarray, weights: np.ndarray, kept: Kept) -> None:
        at = np.searchsorted(self.term, terms)
        here = at < len(self.term)
        here[here] = self.term[at[here]] == terms[here]
        at, weights = at[here], weights[here]
        if not len(at) or int((weights * self.largest[at]).sum()) < kept.least():
            return
        has = np.zeros((len(at), len(self.doc)), bool)
        for row, k in zip(has, at):
            row[self.place[self.cuts[k] : self.cuts[k + 1]]] = True
        some = np.flatnonzero(has.any(axis=0))
        first, group = _groups(has[:, some])
        bound = (weights * self.largest[at]) @ has[:, some[first]]
        by_bound = np.argsort(-bound[group], kind="stable")
        bounds, some = bound[group][by_bound], some[by_bound]
        # Masks end where the group changes; equal bounds are looked at together.
        ends = np.append(np.flatnonzero(bounds[1:] != bounds[:-1]) + 1, len(bounds))
        start = 0
        place_in = np.full(len(self.doc), -1)
        while start < len(some) and bounds[start] >= kept.least():
            end = ends[np.searchsorted(ends, min(start + _DOCS_AT_ONCE, len(some)))]
            docs = some[start:end]
            place_in[docs] = np.arange(len(docs))
            score = np.zeros(len(docs), np.int64)
            for k, weight in zip(at, weights):
                to = place_in[self.place[self.cuts[k] : self.cuts[k + 1]]]
                score[to[to >= 0]] += weight * self.share[self.cuts[k] : self.cuts[k + 1]][to >= 0]
            place_in[docs] = -1
            kept.add(score, self.doc[docs], self.named[docs])
            start = end


def _best_of_tasks(index: DataFrame, terms: list[np.ndarray], ranks: int) -> DataFrame:
    """item (place in ``terms``), doc_id and score of the best documents of each task for each item."""
    n_docs, n_terms = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = np.zeros(1 + max((t.max() for t in terms if len(t)), default=0), np.int64)
    for term, df in counted.collect():  # one row per term of the block
        weight[term] = term_weight(n_docs, df)
    shared = index.sparkSession.sparkContext.broadcast((terms, weight))

    def run(batches: Iterator[pa.RecordBatch]):
        terms, weight = shared.value
        kept = [Kept(ranks) for _ in terms]
        for batch in batches:
            for start in range(0, len(batch), SHARD_DOCS):
                shard = Shard(batch.slice(start, SHARD_DOCS), n_docs, n_terms)
                for item, own in enumerate(terms):
                    shard.search(own, weight[own], kept[item])
        for item, best in enumerate(kept):
            if len(best.score):
                ids = pa.array(best.doc, pa.int64(), mask=~best.named)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), item, np.int32)), ids, pa.array(best.score)], ["item", "doc_id", "score"]
                )

    return index.mapInArrow(run, _RESULT)


def ranked_search(docs: DataFrame, items: DataFrame, ranks: int = RANKS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the best ``ranks`` documents (doc_id, text) per row of ``items`` (item_id, text).

    Only scores above 0 count; equal scores go by ascending doc_id, those without an id
    last. Rows of ``docs`` that are equal or share an id are documents each, and rows of
    ``items`` are items each, so an id twice in ``items`` has two rankings. Null and empty
    texts have no terms: such a document is found by nothing, such an item finds nothing.
    Other columns are not read.
    """
    kind = dict(items.dtypes)["item_id"]
    asked = items.select("item_id", F.col("text").cast("string").alias("text"))
    asked = asked.filter(F.length("text") > 0).withColumn("bytes", F.octet_length("text") + 16)
    found = items.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for block in in_blocks(asked, [F.col("item_id"), F.col("text")], "bytes", block_bytes):
        phrases = Items([r["text"] for r in block])
        index = write_through(document_terms(docs, phrases), "document-terms")
        best = _best_of_tasks(index, phrases.terms, ranks)
        ids = items.sparkSession.createDataFrame(
            [(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {kind}"
        )
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        # First within parts of an item's rows, of which each task has brought some.
        part = F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))
        first = best.withColumn("rank", F.row_number().over(Window.partitionBy("item", part).orderBy(*order)))
        last = first.filter(F.col("rank") <= ranks).withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
        ranked = last.filter(F.col("rank") <= ranks).join(F.broadcast(ids), "item")
        found = found.unionByName(write_through(ranked.select("item_id", "rank", "doc_id", "score"), "ranked"))
    return found
