"""Key tables of a store: the keys alone, in buckets, so that joins leave them where they are.

A store is looked up by url (is this link known?) or by media (what is known of this
media?). A key table holds its distinct keys in a fixed number of buckets by their hash,
each bucket one sorted file. A join on all the keys then shuffles the other side only,
and a filter on one value reads one bucket. The table covers the batches up to a stated
one; later batches are read from the store itself, whose partitions are pruned.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# A join keeps the buckets in place where there are as many of them as the session shuffles to, or more.
BUCKETS = 1024


def _name(path: str) -> str:
    return f"keys_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}"


def write_keys(rows: DataFrame, path: str, on: list[str], buckets: int = BUCKETS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Write the distinct ``on`` and ``keep`` columns of ``rows`` to a new ``path``, one file per bucket of ``on``.

    Rows with a null in ``on`` meet nothing in a join and are left out.
    """
    spark = rows.sparkSession
    keys = rows.dropna(subset=on).select(*on, *keep).distinct().repartition(buckets, *on)
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    keys.write.mode("errorifexists").bucketBy(buckets, *on).sortBy(*on).option("path", path).format("parquet").saveAsTable(_name(path))
    return spark.table(_name(path))


def open_keys(spark: SparkSession, path: str, on: list[str], schema: StructType, buckets: int = BUCKETS) -> DataFrame:
    """The key table at ``path``, written with the same ``on`` and ``buckets`` by any session."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = ", ".join(f"`{c}`" for c in on)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def drop_known(candidates: DataFrame, keys: DataFrame, on: list[str], recent: DataFrame | None = None) -> DataFrame:
    """Candidates whose ``on`` are neither in the key table nor among the ``recent`` rows of the store.

    Only the candidates are shuffled, into the buckets of the keys.
    """
    left = candidates.join(keys.select(*on), on, "left_anti")
    return left if recent is None else left.join(recent.select(*on), on, "left_anti")


def of_media(keys: DataFrame, media_url: str) -> DataFrame:
    """Urls of one media from a key table by media_url: one bucket is read."""
    return keys.filter(F.col("media_url") == F.lit(media_url)).select("url")


def since(store: DataFrame, batch_id: str) -> DataFrame:
    """Rows of the batches behind ``batch_id``, up to which a key table was written; earlier ones are not read."""
    return store.filter(F.col("batch_id") > batch_id)
