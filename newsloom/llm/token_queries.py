from pyspark.sql import functions as F

from newsloom.llm.registry import query, table
from newsloom.llm.token_rollup import Rollup, count_tokens, deleted, inserted, later_copies, revised
from newsloom.sources.workspace import new_path, write_through

OLD_VERSION, NEW_VERSION, BYTE_VERSION = "words-1", "letters-1", "byte_bpe_50k"


@query("op2_token_rollup")
def op2_token_rollup(spark, sf_dir):
    """All documents come in, one tokenizer is revised, exact copies go out; the second batch comes twice."""
    docs = table(spark, sf_dir, "documents")
    counts = write_through(count_tokens(docs, [OLD_VERSION, NEW_VERSION, BYTE_VERSION]), "token-counts")
    of = F.col("tokenizer")
    rollup = Rollup(spark, new_path(spark, "token-rollup"))
    rollup.commit("1-load", inserted(counts.filter(of != NEW_VERSION)))
    for _ in range(2):
        rollup.commit("2-revise", revised(counts.filter(of == OLD_VERSION), counts.filter(of == NEW_VERSION)))
    rollup.commit("3-copies", deleted(later_copies(counts.filter(of != OLD_VERSION))))
    return rollup.totals()
