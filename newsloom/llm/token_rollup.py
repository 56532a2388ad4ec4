"""Token counts in delta-maintained rollups.

Documents are counted once per tokenizer version; the counts are kept per document.
Inserts, deletes and revised counts are signed counts, summed by source, language
and tokenizer version into a batch of the rollup. The sums of a try go to a folder of
their own, and one row of a table of commits, written last as one file, publishes it in
place of an earlier try. So committing a batch again changes nothing, a try that fails
leaves what was there, and readers meet whole batches only. The totals are the sums over
the batches; old batches can be folded into one folder.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import map_rows, row_key, words_of
from newsloom.llm.decontamination import phrase_words

TOKENIZER_FOLDER = "/opt/tokenizers"
# Fixed value: how a text is cut before the merges of the byte-level vocabularies.
CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "tokenizer")


@cache
def _byte_bpe(path: str) -> Callable[[str], int]:
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=CUT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def counter(version: str, folder: str = TOKENIZER_FOLDER) -> Callable[[str], int]:
    """Token counter of a version: ``words-1``, ``letters-1``, or a ``.tiktoken`` file of the folder."""
    if version == "words-1":
        return lambda text: len(words_of(text))
    if version == "letters-1":
        return lambda text: len(phrase_words(text))
    return _byte_bpe(f"{folder.rstrip('/')}/{version}.tiktoken")


def count_tokens(docs: DataFrame, versions: list[str], folder: str = TOKENIZER_FOLDER) -> DataFrame:
    """key, text_hash, source, lang, tokenizer and n_tokens per row of ``docs`` and version.

    A null or empty text has no tokens; null sources and languages stay null.
    """
    key = "struct<id:bigint,hash:bigint>"

    def per_batch(batch: pa.RecordBatch):
        texts = batch.column(4).to_pylist()
        for version in versions:
            count = counter(version, folder)
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:4], pa.array([version] * len(texts), pa.string()),
                pa.array([count(t) for t in texts], pa.int64()),
            ], ["key", "text_hash", "source", "lang", "tokenizer", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        row_key(F.col("doc_id"), text).alias("key"), F.md5(text.cast("binary")).alias("text_hash"),
        F.col("source").cast("string"), F.col("lang").cast("string"), text.alias("text"),
    )
    return map_rows(rows, per_batch, f"key {key}, text_hash string, source string, lang string, tokenizer string, n_tokens bigint")


def inserted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("bigint").alias("docs"), F.col("n_tokens").alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("bigint").alias("docs"), (-F.col("n_tokens")).alias("tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts ``before`` taken back and ``after`` put in their place."""
    return deleted(before).unionByName(inserted(after))


class Rollup:
    """Totals of docs and tokens by source, language and tokenizer version in ``folder``.

    One writer works at a time; readers may read at any time. Folders that no commit
    points to any more are not deleted.
    """

    _SUMS = "source string, lang string, tokenizer string, docs bigint, tokens bigint, try string"
    _COMMITS = "batch string, number bigint, try string, folded boolean"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.createDataFrame([], self._COMMITS).write.mode("ignore").parquet(f"{self.folder}/commits")
        spark.createDataFrame([], self._SUMS).write.mode("append").partitionBy("try").parquet(f"{self.folder}/sums")

    def _last(self) -> DataFrame:
        """batch, try and whether it is folded, by the last commit of each batch."""
        commits = self.spark.read.schema(self._COMMITS).parquet(f"{self.folder}/commits")
        return commits.groupBy("batch").agg(F.max_by(F.struct("number", "try", "folded"), "number").alias("c")).select("batch", "c.*")

    def _published(self) -> DataFrame:
        # The commits are listed first: what they point to is there by then.
        tries = self._last().select("try").distinct()
        return self.spark.read.schema(self._SUMS).parquet(f"{self.folder}/sums").join(tries, "try", "left_semi").drop("try")

    def _write(self, sums: DataFrame, batches: DataFrame, folded: bool) -> None:
        name = uuid.uuid4().hex
        sums.write.parquet(f"{self.folder}/sums/try={name}")
        number = (self._last().agg(F.max("number")).first()[0] or 0) + 1
        rows = batches.select("batch", F.lit(number).cast("bigint").alias("number"), F.lit(name).alias("try"), F.lit(folded).alias("folded"))
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def commit(self, batch: str, signed: DataFrame) -> None:
        """Publish the sums of a batch of signed counts in place of an earlier try of it.

        A batch that has been folded can't be replaced; to commit it again is an error.
        """
        if not re.fullmatch(r"[A-Za-z0-9.-]+", batch):
            raise ValueError("a batch is named by letters, digits, dots and hyphens")
        if not self._last().filter((F.col("batch") == batch) & F.col("folded")).isEmpty():
            raise ValueError(f"batch {batch} has been folded")
        sums = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        self._write(sums, self.spark.createDataFrame([(batch,)], "batch string"), False)

    def fold(self) -> None:
        """Put the sums of all batches in one folder; the totals stay as they are."""
        sums = self._published().groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        self._write(sums, self._last().select("batch"), True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens; what has come to nothing is left out.

        Null sources and languages are groups of their own. A rollup without a batch has no rows.
        """
        return (
            self._published().groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
            .filter("n_docs <> 0 OR n_tokens <> 0")
        )


def later_copies(counts: DataFrame) -> DataFrame:
    """Counts of documents whose text an earlier document (by id) has too."""
    first = counts.groupBy("text_hash", "tokenizer").agg(F.min("key").alias("first"))
    return counts.join(first, ["text_hash", "tokenizer"]).filter(F.col("key") != F.col("first")).select(*counts.columns)
