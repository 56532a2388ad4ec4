from pyspark.sql import functions as F

from newsloom.llm.quote_threads import chat_line, chat_messages
from newsloom.llm.registry import query, table


@query("op9_quotation_linking")
def op9_quotation_linking(spark, sf_dir):
    rows = chat_messages(table(spark, sf_dir, "conversations"))
    return rows.withColumn("message", chat_line(F.col("role"), F.col("text"))).drop("text")
