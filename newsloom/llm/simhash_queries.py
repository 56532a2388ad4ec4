from newsloom.llm.registry import query, table
from newsloom.llm.simhash_groups import simhash_groups


@query("op1_simhash_vp_trees")
def op1_simhash_vp_trees(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))
