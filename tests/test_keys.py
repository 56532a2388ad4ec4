"""Key tables: the store side of a join stays where it is, a media reads its own bucket."""

import random
import re

import pytest
from pyspark.sql import functions as F

from newsloom.operators import links
from newsloom.sources import keys
from newsloom.sources.workspace import new_path

PAIR = "url string, media_url string"


@pytest.fixture(scope="module")
def store(spark):
    r = random.Random(2)
    rows = [(f"u{i % 700}", None if i % 50 == 0 else f"m{r.choice([0, 0, 0, i % 40])}") for i in range(900)] + [(None, "m1")]
    return rows, spark.createDataFrame(rows, PAIR)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_the_candidates_are_shuffled(spark, store, no_broadcast):
    rows, table = store
    asked = [(f"u{i}", f"m{i % 3}") for i in range(600, 800)] + [(None, "m1"), ("u1", None)]
    candidates = spark.createDataFrame(asked, PAIR)
    for on, drop in ((["url"], links.drop_known_news), (["url", "media_url"], links.drop_known_garbage)):
        stored = keys.write_keys(table, new_path(spark, "keys"), on, 8)
        for left in (keys.drop_known(candidates, stored, on), drop(candidates, stored)):
            plan = physical(left)
            assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 1 and "Bucketed: true" in plan
            # The exchange is above the candidates, not above the scan of the keys.
            scan = plan.index("FileScan")
            assert "Exchange" not in plan[plan.rindex("Sort [", 0, scan) : scan] and "SortMergeJoin" in plan
            known = {tuple(r[k] for k in range(len(on))) for r in rows}
            known = {k for k in known if None not in k}
            want = [a for a in asked if a[: len(on)] not in known]
            assert sorted(map(repr, ((r["url"], r["media_url"]) for r in left.collect()))) == sorted(map(repr, want))


def test_each_bucket_is_one_file_and_a_media_reads_its_own(spark, store):
    rows, table = store
    path = new_path(spark, "keys")
    stored = keys.write_keys(table, path, ["media_url"], 16, ("url",))
    files = stored.inputFiles()
    assert len(files) == len({re.search(r"_(\d{5})\.c000", f)[1] for f in files}) <= 16
    one = keys.of_media(stored, "m0")
    # Without this the plan reads the same files but does not say so.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        assert "SelectedBucketsCount: 1 out of 16" in physical(keys.of_media(stored, "m0"))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert {r[0] for r in one.collect()} == {u for u, m in rows if m == "m0"}


def test_a_table_opens_without_the_catalogue_that_wrote_it(spark, store, no_broadcast):
    rows, table = store
    path = new_path(spark, "keys")
    schema = keys.write_keys(table, path, ["url"], 8).schema
    spark.sql(f"DROP TABLE {keys._name(path)}")
    again = keys.open_keys(spark, path, ["url"], schema, 8)
    assert {r[0] for r in again.collect()} == {u for u, _ in rows} - {None}
    plan = physical(keys.drop_known(spark.createDataFrame([("u1", "m"), ("new", "m")], PAIR), again, ["url"]))
    assert "Bucketed: true" in plan and len(re.findall(r"\bExchange hashpartitioning", plan)) == 1


def test_recent_batches_come_from_the_store(spark, store):
    batches = spark.createDataFrame([("a", "b1"), ("b", "b2"), ("c", "b3")], "url string, batch_id string")
    stored = keys.write_keys(batches.filter("batch_id <= 'b2'"), new_path(spark, "keys"), ["url"], 8)
    candidates = spark.createDataFrame([(x, "m") for x in "abcd"], PAIR)
    left = keys.drop_known(candidates, stored, ["url"], keys.since(batches, "b2"))
    assert [r["url"] for r in left.collect()] == ["d"]
    empty = keys.write_keys(batches.limit(0), new_path(spark, "keys"), ["url"], 8)
    assert keys.drop_known(candidates, empty, ["url"]).count() == 4
    assert keys.since(batches, "b2").select(F.max("batch_id")).first()[0] == "b3"
