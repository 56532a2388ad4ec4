"""Mix of sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a fixed shuffled order, offered
``epochs`` times. A document's virtual finish time is the number of its source's
words up to and with it, divided by the weight of the source. A document longer
than the quantum, a thousandth of the budget over the number of sources, is offered
in slices of that many words, each with its own finish time, so that no source waits
for a long document of another one. All offers are sorted by finish time over ranges,
and the queue ends where the budget of words is used up. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import count_words, free_names, row_key, running_total
from newsloom.sources.workspace import write_through

EPOCHS = 3
# The quantum is the budget divided by this and by the number of sources.
QUANTA = 1000
SEED = "mix-1"


def cyclic_weight(number: Column) -> Column:
    """1, 2, 3, 1, ... by the number of the source, from 0."""
    return (1 + number % 3).cast("double")


def source_table(sized: DataFrame, weight=cyclic_weight, epochs: int = EPOCHS,
                 budget: int | None = None) -> tuple[DataFrame, int]:
    """One row per source, and the budget in words.

    Columns: source, source_size, number (by code point from 0, null last), start
    (words of the sources before it), weight, target. A target is the source's
    weighted share of the budget (default: all words), at most ``epochs`` times its
    size; what is above goes to the others by weight until none is above.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(1).alias("one"))
    order = [F.col("source").asc_nulls_last()]
    ranked = running_total(running_total(sums, order, "source_size", "end"), order, "one", "rank")
    sources = write_through(ranked.select(
        "source", "source_size", (F.col("rank") - 1).alias("number"),
        (F.col("end") - F.col("source_size")).alias("start"),
        weight(F.col("rank") - 1).alias("weight"), (F.lit(epochs) * F.col("source_size")).alias("most"),
    ), "sources")
    if budget is None:
        budget = sources.agg(F.sum("source_size")).first()[0] or 0
    # Words per unit of weight; it only rises, and with it the number of full sources.
    level, full = 0.0, -1
    while True:
        is_full = F.col("weight") * level > F.col("most")
        n, used, rest = sources.agg(
            F.coalesce(F.count_if(is_full), F.lit(0)),
            F.coalesce(F.sum(F.when(is_full, F.col("most"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == full:
            break
        full = n
        level = (budget - used) / rest if rest else float("inf")
    target = F.least(F.col("weight") * level, F.col("most").cast("double"))
    return sources.withColumn("target", target).drop("most"), budget


def mix(docs: DataFrame, weight=cyclic_weight, epochs: int = EPOCHS, budget: int | None = None,
        seed: str = SEED) -> DataFrame:
    """What the mix takes of each row of ``docs`` (doc_id, text, source).

    Columns: key (``row_key``), doc_id, source, size, source_size, target, taken (words,
    repeats counted) and copies (begun ones). ``weight`` gives a source's weight by its
    number. Documents are taken whole, but for those in service when the budget ends, at
    most one per source: of their last copy the mix takes the first slices only, so taken
    is less than size * copies. A source is off its target by a few quanta. A null text has
    size 0 and is taken no time; a null source is a source of its own, the last; a null id
    is shuffled as the empty one; equal rows are queued one after the other, so they may be
    taken a different number of times. The same rows give the same mix.
    """
    sized = write_through(docs.select(
        row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("shuffle"),
    ), "sized")
    sources, budget = source_table(sized, weight, epochs, budget)
    quantum = max(1, budget // (QUANTA * max(1, sources.count())))
    order = [F.col("source").asc_nulls_last(), F.col("shuffle"), F.col("key"), F.col("size")]
    queued = write_through(
        running_total(sized, order, "size", "at").alias("d")
        .join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("d.key", "d.doc_id", "d.source", "size", "source_size", "number", "weight", "target",
                (F.col("at") - F.col("size") - F.col("start")).alias("before")),
        "queued",
    )
    # Slices behind the first ``budget`` words of a document are never reached.
    slices = F.ceil(F.least(F.col("size"), F.lit(max(1, budget))) / quantum)

    def upto(slice_: Column) -> Column:
        return F.least(slice_ * quantum, F.col("size"))

    def finish(epoch: Column, slice_: Column) -> Column:
        words = epoch * F.col("source_size") + F.col("before") + upto(slice_)
        return words.cast("double") / F.col("weight")

    offers = queued.filter("size > 0").select(
        "size", "number", "source_size", "before", "weight", slices.alias("slices"),
        F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"),
    ).filter(
        # Nor are documents with more words of their own source before them.
        F.col("epoch") * F.col("source_size") + F.col("before") < budget
    ).select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("slices"))).alias("slice")).select(
        (upto(F.col("slice")) - upto(F.col("slice") - 1)).alias("words"), "number",
        finish(F.col("epoch"), F.col("slice")).alias("finish"),
    )
    served = running_total(offers, [F.col("finish"), F.col("number")], "words", "total").filter(F.col("total") <= budget)
    last = served.agg(F.max(F.struct("finish", "number")).alias("last")).first()["last"]
    taken = copies = F.lit(0).cast("bigint")
    if last is not None:
        end = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["number"]).alias("number"))

        def is_served(epoch: Column, slice_: Column) -> Column:
            place = F.struct(finish(epoch, slice_).alias("finish"), F.col("number").cast("bigint").alias("number"))
            return (F.col("size") > 0) & (place <= end)

        first = F.lit(1).cast("bigint")

        def words_served(epoch: Column) -> Column:
            head = F.filter(F.sequence(first, slices), lambda j: is_served(epoch, j))
            part = F.when(is_served(epoch, first), upto(F.size(head).cast("bigint"))).otherwise(0)
            return F.when(is_served(epoch, slices), upto(slices)).otherwise(part)

        for epoch in map(F.lit, range(epochs)):
            taken = taken + words_served(epoch)
            copies = copies + F.when(is_served(epoch, first), 1).otherwise(0)
    return queued.select(
        "key", "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that the mix takes, with ``mix_size``, ``mix_taken`` and ``mix_copies``.

    Texts stay whole: where ``mix_taken`` is less than ``mix_size * mix_copies``, a reader
    ends the last copy after the words that are left. Rows that
    are equal in id and text are joined by their greatest number of copies. Where ``docs``
    has one of these names already, the new one gets an underscore in front.
    """
    size, taken, copies, id_, hash_ = free_names(docs, "mix_size", "mix_taken", "mix_copies", "_id", "_hash")
    mixed = (
        mix(docs, **options).filter("taken > 0").groupBy("key")
        .agg(F.max("size").alias(size), F.max("taken").alias(taken), F.max("copies").alias(copies))
        .select(F.col("key.id").alias(id_), F.col("key.hash").alias(hash_), size, taken, copies)
    )
    key = row_key(F.col("doc_id"), F.col("text"))
    joined = docs.withColumn(id_, key["id"]).withColumn(hash_, key["hash"]).join(mixed, [id_, hash_])
    return joined.drop(id_, hash_)
