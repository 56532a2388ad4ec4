"""Small helpers of the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.sources.workspace import write_through

# A word is a run of characters other than the six ASCII white-space characters.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD_CLASS)
# White space to str.split() that is part of a word here.
_OTHER_SPACE = re.compile(
    "[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
)
# Rows without an id sort behind all others.
NO_ID = 2**63 - 1


def words_of(text: str) -> list[str]:
    """Words between ASCII white space."""
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def count_words(text: Column, word: str = WORD_CLASS) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(word)), F.lit(0)).cast("bigint")


def row_key(doc_id: Column, text: Column) -> Column:
    """Key of a document row: its id and the hash of its text.

    Rows with one id and one text are the same document; rows that share only
    the id are two. A missing id counts as the largest.
    """
    return F.struct(
        F.coalesce(doc_id.cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"),
    )


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to be new in ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_rows(
    df: DataFrame, per_batch: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``df`` through ``per_batch``, batch by batch, without a shuffle."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from per_batch(batch)

    return df.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "1m"):
    """Jobs that run inside hand batches of at most so many rows and about ``size`` bytes to Python: for rows of many kilobytes.

    A batch stands in buffers of twice its size and more, on either side, outside the heap.
    """
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def running_total(rows: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over all rows up to each one in ``order``.

    The rows are sorted by ranges into as many parts as the session shuffles to and
    written; a part then adds the sums of the parts before it, of which there is
    one row per part. No task sees more than its range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = write_through(
        rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
        .select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(F.broadcast(before), "_part")
        .withColumn(out, F.col("_before") + F.sum(value).over(within))
        .drop("_part", "_before")
    )


def in_blocks(rows: DataFrame, order: list[Column], size: str, block_size: int) -> Iterator[list[Row]]:
    """Rows in ``order``, in lists whose ``size`` sums to about ``block_size``, each fetched when it is asked for."""
    total, block = free_names(rows, "_total", "_block")
    placed = running_total(rows, order, size, total)
    numbered = write_through(placed.withColumn(block, F.floor((F.col(total) - F.col(size)) / block_size)), "blocks")
    for (number,) in numbered.select(block).distinct().orderBy(block).toLocalIterator():
        yield numbered.filter(F.col(block) == number).orderBy(total).select(*rows.columns).collect()


def in_slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose sizes sum to ``limit`` or to one row above it."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of about ``limit`` bytes of text, or of one longer text, with their texts (null as empty)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for start, end in in_slices([n + 1 for n in sizes], limit):
        yield start, end, [t or "" for t in texts.slice(start, end - start).to_pylist()]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of the component of each of ``n`` nodes, for edges a-b in memory."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(label, before):
            return label
