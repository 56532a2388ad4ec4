"""News parted by release state, so that a release run reads and writes its own batches only.

``arrived`` has a part per batch of new rows. ``decided`` has a part per release run: the
rows of its batches as the run left them. ``runs`` has a row per finished run with the
batches it took (behind ``after``, up to ``through``); it is written last and publishes the
run. Until then readers see the batches as they arrived, and a run that is repeated
replaces its own part. No run touches the files of another one. Batch ids are taken in
text order, as those of dates are; one run works at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from newsloom.operators.release import release_run
from newsloom.sources import sinks
from newsloom.sources.tables import pending_news

RUNS = StructType([StructField(name, StringType()) for name in ("after", "through")])


def _with(schema: StructType, part: str) -> StructType:
    return StructType([*schema.fields, StructField(part, StringType())])


def create_store(spark: SparkSession, path: str, schema: StructType) -> None:
    """Folders of an empty store; one that is there stays as it is."""
    for name, columns, part in (("arrived", schema, "batch_id"), ("decided", schema, "run_id"), ("runs", RUNS, "run_id")):
        rows = spark.createDataFrame([], _with(columns, part))
        rows.write.mode("append").partitionBy(part).parquet(f"{path}/{name}")


def finished_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_with(RUNS, "run_id")).parquet(f"{path}/runs")


def _last_released(spark: SparkSession, path: str) -> str | None:
    return finished_runs(spark, path).agg(F.max("through")).first()[0]


def _arrived(spark: SparkSession, path: str, schema: StructType, after: str | None, through: str | None = None) -> DataFrame:
    """Batches behind ``after`` up to ``through``; the others are pruned."""
    rows = spark.read.schema(_with(schema, "batch_id")).parquet(f"{path}/arrived")
    if after is not None:
        rows = rows.filter(F.col("batch_id") > after)
    return rows if through is None else rows.filter(F.col("batch_id") <= through)


def add_batch(rows: DataFrame, path: str, batch_id: str) -> None:
    """Store a batch of new rows; the same batch again replaces itself until a run has taken it."""
    last = _last_released(rows.sparkSession, path)
    if last is not None and batch_id <= last:
        raise ValueError(f"batch {batch_id} is not behind {last}, up to which a release run has taken the batches")
    sinks.append_batch(rows, f"{path}/arrived", batch_id)


def pending(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows no release run has looked at; batches of earlier runs are not read."""
    return pending_news(_arrived(spark, path, schema, _last_released(spark, path)).select(*schema.names))


def snapshot(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All news: the parts of the finished runs, and the batches behind them as they arrived."""
    last = _last_released(spark, path)
    rows = _arrived(spark, path, schema, last).select(*schema.names)
    if last is None:
        return rows
    runs = finished_runs(spark, path).filter(F.col("through") <= last).select("run_id")
    decided = spark.read.schema(_with(schema, "run_id")).parquet(f"{path}/decided").join(runs, "run_id", "left_semi")
    return decided.select(*schema.names).unionByName(rows)


def release_batches(spark: SparkSession, path: str, schema: StructType, run_id: str, seed: str, processed_at: Column) -> None:
    """Decide on the rows of all batches that no run has taken.

    A finished run that is repeated takes the same batches again. Without a new batch nothing is written.
    """
    own = finished_runs(spark, path).filter(F.col("run_id") == run_id).select("after", "through").first()
    after, through = own if own else (_last_released(spark, path), None)
    if through is None:
        through = _arrived(spark, path, schema, after).agg(F.max("batch_id")).first()[0]
        if through is None:
            return
    rows = _arrived(spark, path, schema, after, through).select(*schema.names)

    def put(part: DataFrame, name: str) -> None:
        (
            part.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")
        )

    put(release_run(rows, seed, processed_at), "decided")
    if not own:
        put(spark.createDataFrame([(after, through)], RUNS), "runs")
