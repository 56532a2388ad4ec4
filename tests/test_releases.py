"""The store parted by release state, and joins of rows with hot keys on both sides."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType, TimestampType

from newsloom.operators import skew
from newsloom.sources import releases

NEWS = (
    StructType().add("url", StringType()).add("description", StringType()).add("score", DoubleType())
    .add("processed_at", TimestampType()).add("preprocessed", BooleanType())
)
NOW = "TIMESTAMP '2024-02-02 00:00:00'"


def batch(spark, first, n=12):
    rows = [(f"u{i}", None if i % 6 == 5 else f"d{i % 3}", float(i % 4), None, False) for i in range(first, first + n)]
    return spark.createDataFrame(rows, NEWS)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def state(spark, path):
    return {r["url"]: (r["preprocessed"], r["processed_at"] is not None) for r in releases.snapshot(spark, path, NEWS).collect()}


def test_release_touches_its_own_batches(spark, tmp_path):
    path = str(tmp_path / "store")
    releases.create_store(spark, path, NEWS)
    assert releases.snapshot(spark, path, NEWS).count() == 0
    releases.release_batches(spark, path, NEWS, "r0", "s", F.expr(NOW))
    assert releases.finished_runs(spark, path).count() == 0

    releases.add_batch(batch(spark, 0), path, "2024-01-01")
    releases.add_batch(batch(spark, 0), path, "2024-01-01")
    releases.add_batch(batch(spark, 100), path, "2024-01-02")
    assert releases.pending(spark, path, NEWS).count() == 24
    releases.release_batches(spark, path, NEWS, "r1", "s", F.expr(NOW))
    first, kept = state(spark, path), files(path)
    assert len(first) == 24 and all(done for _, done in first.values())
    # One of each description; those without one are held back.
    assert sum(released for released, _ in first.values()) == 3
    assert releases.pending(spark, path, NEWS).count() == 0

    releases.create_store(spark, path, NEWS)
    releases.add_batch(batch(spark, 200), path, "2024-01-03")
    pending = releases.pending(spark, path, NEWS)
    assert pending.count() == 12 and state(spark, path)["u200"] == (False, False)
    releases.release_batches(spark, path, NEWS, "r2", "s", F.expr(NOW))
    after = files(path)
    assert all(after[f] == t for f, t in kept.items())
    second = state(spark, path)
    assert all(second[u] == x for u, x in first.items()) and sum(r for r, _ in second.values()) == 6

    # A repeated run gives the same, and a batch that was taken cannot change.
    releases.release_batches(spark, path, NEWS, "r1", "s", F.expr(NOW))
    releases.release_batches(spark, path, NEWS, "r3", "s", F.expr(NOW))
    assert state(spark, path) == second and releases.snapshot(spark, path, NEWS).count() == 36
    with pytest.raises(ValueError):
        releases.add_batch(batch(spark, 0), path, "2024-01-02")


def test_unfinished_run_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "store")
    releases.create_store(spark, path, NEWS)
    releases.add_batch(batch(spark, 0), path, "b1")
    # A run that ended before its row in ``runs``.
    batch(spark, 0).withColumn("run_id", F.lit("r1")).write.mode("append").partitionBy("run_id").parquet(f"{path}/decided")
    assert releases.snapshot(spark, path, NEWS).count() == 12
    assert releases.pending(spark, path, NEWS).count() == 12
    releases.release_batches(spark, path, NEWS, "r2", "s", F.expr(NOW))
    assert releases.snapshot(spark, path, NEWS).count() == 12 and releases.pending(spark, path, NEWS).count() == 0
    plan = releases.pending(spark, path, NEWS)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in plan


@pytest.mark.parametrize("limit", [skew.BROADCAST_BYTES, 0])
def test_join_rows_with_hot_keys(spark, limit):
    left = ["both"] * 200 + ["l"] * 150 + [f"k{i % 900}" for i in range(1800)] + [None] * 40
    right = ["both"] * 90 + ["r"] * 80 + ["l"] + [f"k{i}" for i in range(950)] + [None] * 9
    a = spark.createDataFrame([(i, k) for i, k in enumerate(left + ["r"])], "i int, k string").repartition(5)
    b = spark.createDataFrame([(k, i % 7) for i, k in enumerate(right)], "k string, j int").repartition(3)
    got = Counter((r["k"], r["i"], r["j"]) for r in skew.join_rows(a, b, "k", broadcast_bytes=limit).collect())
    of_key = {}
    for i, k in enumerate(right):
        of_key.setdefault(k, []).append(i % 7)
    want = Counter((k, i, j) for i, k in enumerate(left + ["r"]) if k is not None for j in of_key.get(k, []))
    assert got == want
    empty = a.filter("false")
    assert skew.join_rows(empty, b, "k", broadcast_bytes=limit).count() == skew.join_rows(a, b.filter("false"), "k", broadcast_bytes=limit).count() == 0


def test_join_rows_deals_a_hot_key_out(spark):
    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"), "id")
    right = spark.range(900).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"), F.col("id").alias("j"))
    joined = skew.join_rows(left, right, "k", broadcast_bytes=0)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per_task = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert sum(per_task) >= 2000 * 300 and max(per_task) < 0.4 * sum(per_task)
