"""Near-duplicate groups by SimHash and vantage-point trees.

A bounded sample of the distinct fingerprints builds the upper tree: each node
has a vantage point and a radius, each leaf is a shard. A fingerprint goes down
to the side of the radius it is on, and also to the outer side if the triangle
inequality allows a partner there, so two fingerprints within the distance meet
in at least one shard. A shard is searched by a tree of its own. The links of a
shard leave it as a star per local group; groups that span shards are joined by
star contraction over tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import NO_ID, components, free_names, map_rows, row_key
from newsloom.sources.workspace import write_through

SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42
# Fingerprints drawn to place the upper tree's nodes; all fingerprints go through it.
TREE_SAMPLE = 16_384
# Fingerprints a shard should have.
SHARD_ROWS = 32_768
# Fingerprints that are compared with each other without a further split.
BUCKET_ROWS = 512
_HASHES_AT_ONCE = 100_000
_POINTS_AT_ONCE = 50_000


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of the XXH64 of the word shingles, as an unsigned number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[min(shingle_words, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts, last)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[i : i + _HASHES_AT_ONCE].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """key and fingerprint (``fp``, the 64 bits as a signed number) per row of ``docs`` (key, text)."""

    def per_batch(batch: pa.RecordBatch):
        fps = np.array([fingerprint(t or "", shingle_words) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["key", "fp"])

    return map_rows(docs.select("key", "text"), per_batch, "key struct<id:bigint,hash:bigint>, fp bigint")


def _distance(fps: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ point).astype(np.int64)


def _split(fps: np.ndarray, bits: int) -> tuple[np.uint64, int] | None:
    """Vantage point and radius that cut ``fps`` with the smallest overlap, if any do."""
    best = None
    for point in fps[np.linspace(0, len(fps) - 1, 4).astype(int)]:
        upto = np.cumsum(np.bincount(_distance(fps, point), minlength=65))
        for radius in range(64):
            inner, outer = upto[radius], len(fps) - (upto[radius - bits] if radius >= bits else 0)
            larger = max(inner, outer)
            if larger <= 0.8 * len(fps):
                cost = (inner + outer) / len(fps) + larger / len(fps)
                if best is None or cost < best[0]:
                    best = (cost, point, radius)
    return best and best[1:]


def build_tree(sample: np.ndarray, shards: int, bits: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, radius, inner, outer) of the upper tree, node 0 first.

    A child below 0 is the shard -1 - child. No node means one shard.
    """
    nodes: list[list[int]] = []
    leaf_rows = max(2, len(sample) // max(1, shards))
    n_shards = 0
    waiting = [(np.sort(sample), None)]
    while waiting:
        fps, parent = waiting.pop()
        cut = _split(fps, bits) if len(fps) > leaf_rows and shards > 1 else None
        if cut is None:
            child = -1 - n_shards
            n_shards += 1
        else:
            child = len(nodes)
            point, radius = cut
            nodes.append([int(point), int(radius), 0, 0])
            d = _distance(fps, point)
            waiting += [(fps[d <= radius], (child, 2)), (fps[d > radius - bits], (child, 3))]
        if parent is not None:
            nodes[parent[0]][parent[1]] = child
    return [tuple(n) for n in nodes]


def route(fps: np.ndarray, nodes: list[tuple[int, int, int, int]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and position in ``fps``, once for each shard a fingerprint belongs to."""
    if not nodes:
        return np.zeros(len(fps), np.int64), np.arange(len(fps))
    shards, places = [], []
    waiting = [(0, np.arange(len(fps)))]
    while waiting:
        node, at = waiting.pop()
        if not len(at):
            continue
        if node < 0:
            shards.append(np.full(len(at), -1 - node))
            places.append(at)
            continue
        point, radius, inner, outer = nodes[node]
        d = _distance(fps[at], np.uint64(point))
        waiting += [(inner, at[d <= radius]), (outer, at[d > radius - bits])]
    return np.concatenate(shards), np.concatenate(places)


def _stars(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = components(len(fps), a, b)
    moved = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[moved], fps[label[moved]]


def _by_common_point(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links at up to 2 bits in a ball that no radius splits.

    Two fingerprints are within 2 bits exactly if some value is within 1 bit of
    both: each one names the 65 values around it, and equal names are linked.
    """
    masks = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    passes = np.uint64(-(-len(fps) // _POINTS_AT_ONCE))
    out_a, out_b = [], []
    for i in range(int(passes)):
        names, at = [], []
        for mask in masks:
            near = fps ^ mask
            mine = np.nonzero((near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % passes == i)[0]
            names.append(near[mine])
            at.append(mine)
        names, at = np.concatenate(names), np.concatenate(at)
        order = np.argsort(names, kind="stable")
        same = names[order][1:] == names[order][:-1]
        out_a.append(at[order][1:][same])
        out_b.append(at[order][:-1][same])
    return _stars(fps, np.concatenate(out_a), np.concatenate(out_b))


def link_shard(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between distinct fingerprints of one shard, as a star per local group."""
    out_a, out_b = [], []
    waiting = [np.sort(fps)]
    while waiting:
        part = waiting.pop()
        if len(part) > BUCKET_ROWS and (cut := _split(part, bits)):
            d = _distance(part, cut[0])
            waiting += [part[d <= cut[1]], part[d > cut[1] - bits]]
            continue
        if len(part) > 4 * BUCKET_ROWS and bits == 2:
            a, b = _by_common_point(part)
        else:
            a, b = [], []
            for i in range(0, len(part), BUCKET_ROWS):
                rows = part[i : i + BUCKET_ROWS]
                for j in range(i, len(part), BUCKET_ROWS):
                    x, y = np.nonzero(np.bitwise_count(rows[:, None] ^ part[None, j : j + BUCKET_ROWS]) <= bits)
                    keep = x + i < y + j
                    a.append(x[keep] + i)
                    b.append(y[keep] + j)
            a, b = _stars(part, np.concatenate(a), np.concatenate(b)) if a else (part[:0], part[:0])
        out_a.append(a)
        out_b.append(b)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    if not len(a):
        return a, b
    points, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    return _stars(points, back[: len(a)], back[len(a) :])


def fingerprint_links(fps: DataFrame, bits: int = MAX_BITS, sample: int = TREE_SAMPLE,
                      shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) that connect the groups of distinct ``fps`` within ``bits``."""
    spark = fps.sparkSession
    shards = -(-fps.count() // shard_rows)
    nodes: list = []
    if shards > 1:
        drawn = fps.orderBy(F.xxhash64("fp", F.lit(7)), "fp").limit(sample).collect()
        nodes = build_tree(np.array([r[0] for r in drawn], np.int64).view(np.uint64), shards, bits)

    def routed(batch: pa.RecordBatch):
        values = batch.column(0).to_numpy()
        shard, at = route(values.view(np.uint64), nodes, bits)
        yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(values[at])], ["shard", "fp"])

    def linked(shard: pd.DataFrame) -> pd.DataFrame:
        a, b = link_shard(shard["fp"].to_numpy().view(np.uint64), bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    placed = map_rows(fps.repartition(spark.sparkContext.defaultParallelism), routed, "shard bigint, fp bigint")
    return placed.groupBy("shard").applyInPandas(linked, "a bigint, b bigint")


def connected(links: DataFrame) -> DataFrame:
    """Node and smallest node of its component (node, root), for nodes with links (a, b).

    Large and small stars in turn, each round written to the shared folder, until
    the links stay the same. A node's smallest neighbour is a combined minimum and
    is joined to its links, so the centre of a large star splits like any skewed join.
    """

    def stars(edges: DataFrame) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = (
            both.join(low, "a").filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").filter(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        return small.unionByName(least.select("a", F.col("low").alias("b"))).filter("a > b").distinct()

    def mark(edges: DataFrame):
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    up = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges = write_through(up, "links")
    now = mark(edges)
    while now[0]:
        before, edges = now, write_through(stars(edges), "links")
        now = mark(edges)
        if now == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _grouped(docs: DataFrame, shingle_words: int, bits: int, sample: int, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """Key and fingerprint (key, fp) per row of ``docs``, and the smallest key of its group per fingerprint (fp, first)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(row_key(F.col("doc_id"), text).alias("key"), text.alias("text"))
    marked = write_through(fingerprints(rows, shingle_words), "fingerprints")
    ids = write_through(marked.groupBy("fp").agg(F.min("key").alias("low")), "distinct-fingerprints")
    groups = connected(fingerprint_links(ids.select("fp"), bits, sample, shard_rows))
    rooted = ids.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("low").alias("first"))
    return marked, rooted.join(smallest, "root").select("fp", "first")


def simhash_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, bits: int = MAX_BITS,
                   sample: int = TREE_SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id per row of ``docs``.

    A text without words, null included, has the fingerprint 0 and is linked like any
    other. component_id is the smallest id of the group, null if no row of it has an id.
    Rows that share an id give a row each. Other columns are not read.
    """
    marked, per_fp = _grouped(docs, shingle_words, bits, sample, shard_rows)
    # Rows without an id have the largest key.
    return marked.join(per_fp, "fp").select(
        F.nullif("key.id", F.lit(NO_ID)).alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.nullif("first.id", F.lit(NO_ID)).alias("component_id"),
    )


def one_per_group(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, bits: int = MAX_BITS,
                  sample: int = TREE_SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row of each group: that with the smallest id, of several with that id the one with the smallest text hash.

    A row without an id stays only where no row of its group has one; of rows that are
    equal in id and text one stays, with the other columns of any one of them.
    """
    _, per_fp = _grouped(docs, shingle_words, bits, sample, shard_rows)
    id_, hash_ = free_names(docs, "_id", "_hash")
    kept = per_fp.select(F.col("first.id").alias(id_), F.col("first.hash").alias(hash_)).distinct()
    key = row_key(F.col("doc_id"), F.col("text").cast("string"))
    named = docs.withColumn(id_, key["id"]).withColumn(hash_, key["hash"])
    return named.join(kept, [id_, hash_], "left_semi").dropDuplicates([id_, hash_]).select(*docs.columns)
