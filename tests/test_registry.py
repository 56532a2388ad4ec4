"""Registered queries against their SQL checks on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
import check
from newsloom.plans.registry import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"
# One or two of each family; ``check.py`` runs all of them.
CHOSEN = (
    "scan_sections", "append_garbage", "write_region_media", "score_sections",
    "merge_rankings", "topic_substring_semi", "topic_edit_pairs", "section_catalogue",
    "classify_urls", "valid_section_url_wide", "page_tags", "page_links", "article_record",
    "json_leaves", "parse_iso_ts", "garbage_by_status", "ingest_articles",
    "media_and_run_stats", "mark_processed", "feed_page", "summary_passthrough",
    "stream_dedup_links", "stream_media_stats",
)


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_check(spark, con, name):
    verdict, note = check.compare(spark, con, SF, name)
    assert verdict == "same" and "TYPES" not in note, note


def test_checks_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(CHECKS)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_no_local_checkpoint_in_the_package():
    import pathlib

    for path in pathlib.Path(check.__file__).parent.glob("newsloom/**/*.py"):
        assert not re.search(r"localCheckpoint|crossJoin|toPandas", path.read_text()), path
