from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.llm.registry import query, table
from newsloom.llm.toxicity import THRESHOLD, score_toxicity, train


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


@query("op8_counterfactual_toxicity")
def op8_counterfactual_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    weights, bias = train(docs, labels, ~held_out(F.col("doc_id")))
    return score_toxicity(docs, weights, bias).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
