from pyspark.sql import functions as F

from newsloom.llm.line_dedup import delete_blocks
from newsloom.llm.registry import query, table


@query("op3_patience_alignment")
def op3_patience_alignment(spark, sf_dir):
    edited = delete_blocks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    block = F.transform("_blocks", lambda b: F.concat_ws(":", b["start"], b["end"], b["owner"]))
    return edited.select(
        "doc_id", F.col("_lines").alias("n_lines"), F.coalesce(F.size("_blocks"), F.lit(0)).alias("n_blocks"),
        F.coalesce(F.array_join(block, ","), F.lit("")).alias("blocks"), F.md5("text").alias("text_md5"),
        F.length("text").cast("bigint").alias("n_chars"),
    )
