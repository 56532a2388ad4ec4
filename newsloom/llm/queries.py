"""Importing this module registers the queries of the corpus operators."""

from newsloom.llm import (  # noqa: F401
    chat_queries,
    decontamination_queries,
    join_queries,
    line_queries,
    mixing_queries,
    quality_queries,
    run_queries,
    search_queries,
    secret_queries,
    simhash_queries,
    token_queries,
    toxicity_queries,
    warc_queries,
)
from newsloom.llm.registry import CHECKS, QUERIES  # noqa: F401
