"""Joins and collections that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.util import hash32
from newsloom.sources.workspace import write_through

# A per-key table up to this size (measured) is broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024
BYTES_PER_ROW = 48
# A key with more than 1/HOT_SHARE of the rows is hot, so there are at most
# HOT_SHARE hot keys whatever the data: the list is safe to broadcast.
HOT_SHARE = 1000
# Number of parts a hot key is split into.
HOT_PARTS = 64
# Side of the grid for a key that is hot on both sides of a join of rows.
GRID_SIDE = 8
# Arrays that the records of a key are dealt out to.
ARRAY_PARTS = 64


def count_per_key(rows: DataFrame, key: str, out: str) -> DataFrame:
    """Rows per non-null key; combined map-side, so a hot key costs one row per task.

    Null keys are left out by their count: a filter on the key itself would be
    pushed down and compute a derived key twice.
    """
    return rows.groupBy(key).agg(F.count(key).alias(out)).filter(F.col(out) > 0)


def attach_by_key(rows: DataFrame, per_key: DataFrame, key: str, weight: str,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left join of ``rows`` with a table that has one row per key.

    ``weight`` is the column of ``per_key`` with the number of rows of the key.
    The per-key table is written once and measured. A small one is broadcast,
    so the rows stay where they are. For a large one hot keys are split: their
    rows go to HOT_PARTS parts by the number of the map task (the same again if
    the task is retried), their row of ``per_key`` to each part. Rows without a
    key are spread in the same way.
    """
    per_key = write_through(per_key, "per-key")
    n, size, total = per_key.agg(
        F.count("*"), F.sum(F.octet_length(F.col(key).cast("string"))), F.sum(weight)
    ).first()
    if (size or 0) + n * BYTES_PER_ROW <= broadcast_bytes:
        return rows.join(F.broadcast(per_key), key, "left")
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    hot = per_key.filter(is_hot).select(key, F.lit(True).alias("_hot"))
    part = F.spark_partition_id() % HOT_PARTS
    spread = F.col("_hot").isNotNull() | F.col(key).isNull()
    left = (
        rows.join(F.broadcast(hot), key, "left")
        .withColumn("_part", F.when(spread, part).otherwise(0))
        .drop("_hot")
    )
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(
        F.array(F.lit(0))
    )
    right = per_key.withColumn("_part", F.explode(parts))
    return left.join(right, [key, "_part"], "left").drop("_part")


def join_rows(left: DataFrame, right: DataFrame, key: str,
              broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Inner join where either side may hold very many rows of one key.

    The right side is written once and measured with all its columns; a small one is
    broadcast. For a large one each hot key gets a grid of parts: a row of the left goes
    to all parts of one grid row, a row of the right to all parts of one grid column, so
    each pair meets once and no part has more than its share of either side. A key that
    is hot on one side only has that side split and the few rows of the other repeated.
    """
    right = write_through(right, "joined-rows")
    text_bytes = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in right.columns), F.lit(0))
    n, size = right.agg(F.count("*"), F.sum(text_bytes)).first()
    if (size or 0) + n * BYTES_PER_ROW <= broadcast_bytes:
        return left.join(F.broadcast(right), key)
    counts = write_through(count_per_key(left, key, "_l").join(count_per_key(right, key, "_r"), key), "counts")
    all_left, all_right = counts.agg(F.sum("_l"), F.sum("_r")).first()
    hot_left, hot_right = F.col("_l") * HOT_SHARE > F.lit(all_left), F.col("_r") * HOT_SHARE > F.lit(all_right)
    whole, side, one = F.lit(HOT_PARTS), F.lit(GRID_SIDE), F.lit(1)
    hot = counts.filter(hot_left | hot_right).select(
        key,
        F.when(hot_left & hot_right, side).when(hot_left, whole).otherwise(one).alias("_rows"),
        F.when(hot_left & hot_right, side).when(hot_right, whole).otherwise(one).alias("_cols"),
    )

    def dealt(rows: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        # Equal rows of different map tasks go to different parts, and to the same ones on a retry.
        number = F.xxhash64(F.spark_partition_id(), *rows.columns)
        return (
            rows.join(F.broadcast(hot), key, "left")
            .withColumn(own, F.pmod(number, F.coalesce(F.col(n_own), F.lit(1))).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n_other), F.lit(1)) - 1)))
            .drop("_rows", "_cols")
        )

    return dealt(left, "_row", "_rows", "_col", "_cols").join(
        dealt(right, "_col", "_cols", "_row", "_rows"), [key, "_row", "_col"]
    ).drop("_row", "_col")


def with_count(rows: DataFrame, key: str, out: str) -> DataFrame:
    """Add the number of rows that share ``key`` (null for a null key)."""
    return attach_by_key(rows, count_per_key(rows, key, out), key, out)


def keep_matching_keys(rows: DataFrame, key: str, matching: DataFrame) -> DataFrame:
    """Rows whose key is in ``matching`` (one column named as the key, distinct)."""
    counts = count_per_key(rows, key, "_n")
    flags = counts.join(matching.withColumn("_match", F.lit(True)), key, "left")
    columns = rows.columns
    return attach_by_key(rows, flags, key, "_n").filter("_match").select(*columns)


def collect_in_parts(
    rows: DataFrame, key: str, fields: list[str], spread_by: str, out: str = "records",
    parts: int = ARRAY_PARTS,
) -> DataFrame:
    """Records per key as sorted arrays (key, part, records).

    Equal records are folded into one with a ``copies`` count. The hash of ``spread_by``
    deals them out to ``parts`` arrays per key, the same for every number of rows; a part
    without records has no row. Take more parts where keys have many millions of records.
    """
    folded = rows.groupBy(key, *fields).agg(F.count("*").alias("copies"))
    part: Column = hash32(F.col(spread_by)) % parts
    return (
        folded.withColumn("part", part).groupBy(key, "part")
        .agg(F.sort_array(F.collect_list(F.struct(*fields, "copies"))).alias(out))
    )
