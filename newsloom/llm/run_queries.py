from pyspark.sql import functions as F

from newsloom.llm.common import WORD_CLASS
from newsloom.llm.registry import query, table
from newsloom.llm.word_runs import MIN_RUN_WORDS, periodic_runs

CHECK = rf"""
WITH words AS (
  SELECT doc_id, w, len(w) AS n, xor(4294967295::UBIGINT, list_reduce(
    list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda c, b: list_reduce(
      list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)))::BIGINT AS h
  FROM (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents)
),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, h // 10 AS g FROM words),
tiled AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
word AS (
  SELECT doc_id, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM tiled)
),
matches AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM word x JOIN word y USING (doc_id, word) WHERE x.i < y.i),
stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM matches)
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({MIN_RUN_WORDS}, 2 * q)
),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY 1, 2, 3),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first({{'s': start, 'l': length, 'p': period}} ORDER BY length DESC, start, period) AS top
  FROM runs GROUP BY 1
),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN dropped USING (doc_id, i) GROUP BY 1
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.l::BIGINT AS length, top.p::BIGINT AS period,
  (1000 * top.l // top.p)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM words LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def planted(docs):
    """Documents (doc_id, text), of which one in ten by its id has a tail that repeats words of its own."""
    words = F.regexp_extract_all("text", F.lit(WORD_CLASS), 0)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.expr("h div 10"), F.size("w")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    some = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("a", F.when(n > 0, g % n))
    some = some.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    tiled = F.transform(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1), lambda i: F.get("w", place(i).cast("int")))
    return some.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(tiled, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_recompression_runs", CHECK)
def op12_recompression_runs(spark, sf_dir):
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    top = found.withColumn("top", first).withColumn("length", -F.col("top.less")).withColumn("period", F.col("top.period"))
    return top.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("top.start").alias("start"), "length", "period",
        F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
