"""Jaccard join on word n-grams by a size-aware, heavy-light plan.

Linked sets share most of their elements, so they share one at least among the
first of each in any common order; rare elements come first here. Large sets scan
the inverted lists of these first elements. Small sets list all subsets of a fixed
size of somewhat more first elements, of which linked ones share one. The size that
parts small from large is the one with the least cost, of subsets written, list
entries written and entries met in scans, measured on this very input.

Copies of a set are one set. In a list, or under a subset, sets first meet its
smallest set of about their size; sets that are connected by then do not meet each
other again, so a group of n near copies makes about n pairs. The others meet one set
of the largest group, drawn in each bucket, and then all that are still apart.
Pairs are compared by sketches, which grow with the sets, before their elements move.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import in_slices, map_rows, small_batches, text_slices
from newsloom.llm.simhash_groups import connected
from newsloom.sources.workspace import write_through

NGRAM_WORDS = 4
# Percentage of the union that linked sets have in common.
PERCENT = 85
SUBSET = 2
# Most elements that are told apart by their frequency; all others count as rare. The
# order decides what is compared first and never what is linked.
FREQUENT = 200_000
# Lists are measured on the elements whose hash ends in so many zero bits.
SAMPLE_BITS = 5
# Most sets whose elements are looked up by a broadcast; beyond, by a shuffle.
BROADCAST_SETS = 1_000_000
# Words of 64 bits in the sketch of a set: the parities of its elements by hash.
SKETCH_WORDS = 16
# Words it is folded to where it moves with each member of a large bucket.
FOLDED_WORDS = 8
# Larger sets have a second one too, of a bit for each element at least, up to so many bits.
FINE_BITS = 1 << 20
# Classes of sizes that meet in a part of a bucket.
BAND = 4
# Orders, as a power of two, by which buckets draw the sets that the others meet.
DRAWS = 16
# Buckets of so many members compare them without a look at the sketches first.
FEW_MEMBERS = 8
# Bits, as a power of two, that tell which buckets may have two sets.
FILTER_BITS = 26
_ELEMENTS_AT_ONCE = 300_000
# Signatures take more than ten columns of that length.
_SIGNED_AT_ONCE = 100_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TEXT_AT_ONCE = 1 << 20
_VOCABULARY = 100_000
_ROWS = "bucket bigint, sid bigint, size int, place int, large boolean"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _VOCABULARY:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word) - (1 << 63)
        return value


def ngrams(text: str, hashes: dict, n: int = NGRAM_WORDS) -> np.ndarray:
    """Hashes of the distinct n-grams of lower-cased words, ascending; of all words if there are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    word = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words)).view(np.uint64)
    length = min(n, len(words))
    rolling = word
    for k in range(1, length):
        rolling = rolling[:-1] * _BASE + word[k:]
    return np.unique(_mixed(rolling + np.uint64(length)).view(np.int64))


def sketch(elements: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Parities of the number of elements by their upper bits, as words (a power of two) of 64 bits."""
    at = elements.view(np.uint64) >> np.uint64(64 - (64 * words - 1).bit_length())
    odd = np.bincount(at.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def fine_sketch(elements: np.ndarray) -> np.ndarray:
    """A sketch of a bit for each element at least; empty where :func:`sketch` has as many."""
    if len(elements) <= 64 * SKETCH_WORDS:
        return np.empty(0, np.int64)
    return sketch(elements, min(FINE_BITS, 1 << (len(elements) - 1).bit_length()) // 64)


def bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two fine sketches differ, the longer one folded to the shorter; 0 if one is empty."""
    x, y = sorted((x, y), key=len)
    if not len(x):
        return 0
    if len(x) < len(y):
        bits = np.unpackbits(y.view(np.uint8), bitorder="little").reshape(64 * len(x), -1)
        y = np.packbits(np.bitwise_xor.reduce(bits, 1), bitorder="little").view(np.int64)
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def ngram_sets(docs: DataFrame, n: int = NGRAM_WORDS) -> DataFrame:
    """doc_id, n (elements), sid (hash of the set, null if it is empty), sketches and elements per row of ``docs``."""

    hashes = _WordHashes()

    def per_batch(batch: pa.RecordBatch):
        for start, end, texts in text_slices(batch.column(1), _TEXT_AT_ONCE):
            sets = [ngrams(t, hashes, n) for t in texts]
            sizes = [len(s) for s in sets]
            sids = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            cuts = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
            words = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH_WORDS)
            fine = [fine_sketch(s) for s in sets]
            fine_cuts = pa.array(np.cumsum([0, *map(len, fine)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(start, end - start), pa.array(sizes, pa.int32()), pa.array(sids, pa.int64()),
                pa.ListArray.from_arrays(words, pa.array(np.concatenate([sketch(s) for s in sets]))),
                pa.ListArray.from_arrays(fine_cuts, pa.array(np.concatenate(fine))),
                pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(sets))),
            ], ["doc_id", "n", "sid", "sketch", "fine", "elements"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    schema = "doc_id bigint, n int, sid bigint, sketch array<bigint>, fine array<bigint>, elements array<bigint>"
    return map_rows(rows, per_batch, schema)


def frequent_elements(sets: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Frequent elements, ascending, and about how many sets have each; at most ``most``."""

    def per_batch(batch: pa.RecordBatch):
        for start, end in in_slices(batch.column(1).to_pylist(), _ELEMENTS_AT_ONCE):
            values, counts = np.unique(batch.column(0).slice(start, end - start).flatten().to_numpy(), return_counts=True)
            again = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(values[again]), pa.array(counts[again])], ["element", "n"])

    counted = map_rows(sets.select("elements", "n"), per_batch, "element bigint, n bigint").groupBy("element").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.col("n").desc(), "element").limit(most).toArrow().sort_by("element")
    return rows["element"].to_numpy().astype(np.int64), rows["n"].to_numpy().astype(np.int64)


def _least_common(size, percent: int):
    """Elements that a set of this size has in common with any linked one."""
    return -(-percent * size // 100)


def _first_elements(flat: np.ndarray, sizes: np.ndarray, weight: np.ndarray, take: np.ndarray):
    """(set, element, place) of the first ``take`` elements of each set: by weight, then value; ``flat`` ascends in each set."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    rare = weight == 0
    n_rare = np.bincount(own[rare], minlength=len(sizes))
    upto = np.cumsum(rare)
    first = np.concatenate([[0], np.cumsum(n_rare)])[:-1]
    place = np.where(rare, upto - 1 - first[own], len(flat))
    # Frequent ones are ordered only where the rare ones do not suffice.
    more = np.flatnonzero(~rare & (n_rare < take)[own])
    more = more[np.lexsort((flat[more], weight[more], own[more]))]
    begin = np.searchsorted(own[more], own[more])
    place[more] = n_rare[own[more]] + np.arange(len(more)) - begin
    chosen = np.flatnonzero(place < take[own])
    chosen = chosen[np.lexsort((place[chosen], own[chosen]))]
    return own[chosen], flat[chosen], place[chosen]


def signatures(
    sets: DataFrame, frequent: tuple[np.ndarray, np.ndarray], boundary: int | None, percent: int = PERCENT, marks: np.ndarray | None = None
) -> DataFrame:
    """List entries and subsets: bucket, sid, size, place of the element in its set, and whether the set is large.

    Sets above ``boundary`` enter the lists of their first elements, and so do smaller ones that may be linked with
    such a set; sets up to it list their subsets. Without a boundary, the entries of all sets for a sample of lists.
    With the bits of :func:`_marked`, only rows whose bucket is marked leave the task.
    """
    shared = sets.sparkSession.sparkContext.broadcast((*frequent, marks))

    def per_batch(batch: pa.RecordBatch):
        names, counts, bits = shared.value
        for start, end in in_slices(batch.column(1).to_pylist(), _SIGNED_AT_ONCE):
            part = batch.slice(start, end - start)
            sizes = part.column(1).to_numpy().astype(np.int64)
            sids = part.column(0).fill_null(0).to_numpy()
            flat = part.column(2).flatten().to_numpy()
            weight = np.zeros(len(flat), np.int64)
            if len(names):
                at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
                weight = np.where(names[at] == flat, counts[at], 0)
            spare = sizes - _least_common(sizes, percent)
            # Others can be linked with an equal set only.
            open_ = (sizes > 0) & ((spare > 0) | (100 * sizes // percent > sizes))
            limit = -1 if boundary is None else boundary
            listed = open_ & (sizes >= _least_common(limit + 1, percent))
            own, element, place = _first_elements(flat, sizes, weight, np.where(listed, spare + 1, 0))
            if boundary is None:
                few = _mixed(element.view(np.uint64)) >> np.uint64(64 - SAMPLE_BITS) == 0
                own, element, place = own[few], element[few], place[few]
            buckets, owners, places = [element], [own], [place]
            small = np.flatnonzero(open_ & (sizes <= limit))
            if len(small):
                own, element, place = _first_elements(flat, sizes, weight, np.where(open_ & (sizes <= limit), spare + SUBSET, 0))
                n_first = np.bincount(own, minlength=len(sizes))
                begin = np.cumsum(n_first) - n_first
                for n in np.unique(n_first[small]):
                    of = small[n_first[small] == n]
                    table = element[begin[of][:, None] + np.arange(n)].view(np.uint64)
                    x, y = np.triu_indices(n, 1)
                    # Not the value of any list: subsets and lists are apart.
                    names_of = _mixed(_mixed(table[:, x]) + table[:, y] + _BASE).view(np.int64)
                    buckets.append(names_of.ravel())
                    owners.append(np.repeat(of, len(x)))
                    places.append(np.full(names_of.size, -1))
            bucket, own, place = map(np.concatenate, (buckets, owners, places))
            if bits is not None:
                at = bucket.view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
                some = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                bucket, own, place = bucket[some], own[some], place[some]
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket), pa.array(sids[own]), pa.array(sizes[own].astype(np.int32)),
                pa.array(place.astype(np.int32)), pa.array(sizes[own] > limit),
            ], ["bucket", "sid", "size", "place", "large"])

    return map_rows(sets.select("sid", "n", "elements"), per_batch, _ROWS)


def size_class(size, percent: int = PERCENT):
    """Linked sets are in one class or in neighbouring ones."""
    return F.floor(F.log(F.col(size)) / -math.log(percent / 100) + 1e-9).cast("int")


def choose_boundary(sets: DataFrame, frequent, percent: int = PERCENT) -> int:
    """The size up to which listing subsets costs less than scanning lists, over all sets; -1 if none does."""
    # Sizes above 2 ** 20 count as that: their subsets are far too many in any case.
    hist = (
        sets.filter("n > 0").groupBy(F.least("n", F.lit(1 << 20)).alias("n"))
        .agg(F.count("*").alias("sets")).groupBy(F.when(F.col("n") < 200, F.col("n")).otherwise(size_class("n", percent) + 1000).alias("class"))
        .agg(F.max("n").alias("size"), F.sum("sets").alias("sets"))
    )
    entries = write_through(signatures(sets, frequent, None, percent).select("bucket", "sid", "size").distinct(), "sampled-lists")
    lists = entries.groupBy("bucket").agg(F.count("*").alias("length"))
    met = write_through(
        lists.filter("length > 1").join(entries, "bucket")
        .groupBy(F.when(F.col("size") < 200, F.col("size")).otherwise(size_class("size", percent) + 1000).alias("class"))
        .agg(F.sum(F.col("length") - 1).alias("met")), "list-costs",
    )
    rows = hist.join(met, "class", "left").fillna(0, ["met"]).orderBy("size").collect()  # some three hundred classes
    spare = [r["size"] - _least_common(r["size"], percent) for r in rows]
    scan = [r["sets"] * (s + 1) + (r["met"] << SAMPLE_BITS) for r, s in zip(rows, spare)]
    subsets = [r["sets"] * math.comb(s + SUBSET, SUBSET) for r, s in zip(rows, spare)]
    best, choice = sum(scan), -1
    for k, r in enumerate(rows):
        # Small sets that may be linked with a large one stand in the lists too.
        both = sum(
            x["sets"] * (s + 1) for x, s in zip(rows[: k + 1], spare) if x["size"] >= _least_common(r["size"] + 1, percent)
        )
        cost = sum(subsets[: k + 1]) + both + sum(scan[k + 1 :])
        if cost < best:
            best, choice = cost, r["size"]
    return choice


def _may_link(x: str, y: str, percent: int):
    """Whether sizes and places allow two sets of a bucket to be linked, and the bucket is theirs to compare in."""
    sx, sy = F.col(f"{x}.size").cast("bigint"), F.col(f"{y}.size").cast("bigint")
    px, py = F.col(f"{x}.place"), F.col(f"{y}.place")
    common = F.ceil((percent * (sx + sy)) / F.lit(100 + percent) - 1e-9)
    # No more in common than stands before both places, and from them on.
    bound = F.least(px, py) + F.least(sx - px, sy - py)
    sizes = 100 * F.least(sx, sy) >= percent * F.greatest(sx, sy)
    return sizes & ((px < 0) | ((F.col(f"{x}.large") | F.col(f"{y}.large")) & (bound >= common)))


def _folded(sketch: str):
    """A sketch as ``FOLDED_WORDS`` words: the parities of more elements each."""
    return F.array(*(
        reduce(lambda x, y: x.bitwiseXOR(y), [F.col(sketch)[j] for j in range(k, SKETCH_WORDS, FOLDED_WORDS)]) for k in range(FOLDED_WORDS)
    ))


def _apart(x: str, y: str, words: int = SKETCH_WORDS):
    """Bits in which two sketches differ; each stands for an element at least that only one of the sets has."""
    return sum(F.bit_count(F.col(f"{x}.sketch")[k].bitwiseXOR(F.col(f"{y}.sketch")[k])) for k in range(words))


def _in_common(x: str, y: str, percent: int, words: int = SKETCH_WORDS):
    """Whether the sketches of two sets allow a link."""
    both = F.col(f"{x}.size").cast("bigint") + F.col(f"{y}.size")
    return _apart(x, y, words) * (100 + percent) <= both * (100 - percent)


def _in_common_if_folded(x: str, y: str, percent: int):
    return _in_common(x, y, percent, FOLDED_WORDS)


def _of_paired(pairs: DataFrame, sets: DataFrame, firsts: DataFrame, column: str) -> DataFrame:
    """sid, size and ``column``, once for each set of the ``pairs`` (a, b)."""
    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid")))
    sids = write_through(ends.distinct(), "paired-sets")
    few = sids.count() <= BROADCAST_SETS

    def near(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if few else rows

    asked = near(firsts.join(near(sids), "sid", "left_semi").select("row"))
    return write_through(
        sets.select("row", "sid", F.col("n").alias("size"), column).join(asked, "row", "left_semi").drop("row"), f"set-{column}"
    )


def _not_apart(pairs: DataFrame, sets: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) that their sketches allow to be linked."""
    sketches = _of_paired(pairs, sets, firsts, "sketch")
    both = pairs.join(sketches.alias("x"), F.col("a") == F.col("x.sid")).join(sketches.alias("y"), F.col("b") == F.col("y.sid"))
    return both.filter(_in_common("x", "y", percent)).select("a", "b")


def _finely_near(pairs: DataFrame, sets: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) that their fine sketches allow to be linked."""
    fine = _of_paired(pairs, sets, firsts, "fine")
    both = (
        pairs.join(fine.alias("x"), F.col("a") == F.col("x.sid")).join(fine.alias("y"), F.col("b") == F.col("y.sid"))
        .select("a", "b", (F.col("x.size").cast("bigint") + F.col("y.size")).alias("size"), F.col("x.fine").alias("of_a"), F.col("y.fine").alias("of_b"))
    )

    def per_batch(batch: pa.RecordBatch):
        of_a, of_b = ([v.values.to_numpy() for v in batch.column(k)] for k in (3, 4))
        apart = np.array([bits_apart(x, y) for x, y in zip(of_a, of_b)])
        near = apart * (100 + percent) <= batch.column(2).to_numpy() * (100 - percent)
        yield batch.select(["a", "b"]).filter(pa.array(near))

    return map_rows(both, per_batch, "a bigint, b bigint")


def _linked(pairs: DataFrame, sets: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) that are linked, from their elements.

    Elements do not compress, so they move as little as may be: of a pair, the set with fewer pairs
    goes to the other one, straight from ``sets``; the other one goes there once for all its pairs.
    """
    pairs = write_through(pairs, "set-pairs")
    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid")))
    degrees = write_through(ends.groupBy("sid").agg(F.count("*").alias("degree")).join(firsts, "sid"), "set-degrees")
    of = lambda k: degrees.select(F.col("sid").alias(k), F.struct("degree", "sid", "row").alias(f"of_{k}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    low, high = F.least("of_a", "of_b"), F.greatest("of_a", "of_b")
    turned = write_through(both.select(low["row"].alias("row"), high["row"].alias("hub"), "a", "b"), "turned-pairs")
    few = turned.count() <= BROADCAST_SETS
    hubs = turned.select(F.col("hub").alias("row")).distinct()

    def near(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if few else rows

    elements = sets.select("row", "elements")
    left = elements.withColumnRenamed("elements", "of_row").join(near(turned), "row").drop("row")
    right = elements.withColumnRenamed("elements", "of_hub").join(near(hubs), "row", "left_semi").withColumnRenamed("row", "hub")
    common = F.size(F.array_intersect("of_row", "of_hub")).cast("bigint")
    size = F.size("of_row") + F.size("of_hub") - F.col("common")
    met = left.join(right, "hub").select("a", "b", "of_row", "of_hub", common.alias("common"))
    return met.filter(100 * F.col("common") >= percent * size).select("a", "b")


def _marked(buckets: DataFrame) -> np.ndarray:
    """Bits of the numbers that the lower bits of the ``buckets`` make; a fixed number of bytes for any number of buckets.

    Not the upper ones: rare elements come by value, so the first ones of all sets have them much alike.
    """
    bit = F.col("bucket").bitwiseAND((1 << FILTER_BITS) - 1) + 1
    rows = buckets.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for part, bits in rows.toLocalIterator():
        out[(part - 1) * len(bits) : part * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def _members(sets: DataFrame, frequent, boundary: int, percent: int) -> DataFrame:
    """Rows of :func:`signatures` whose bucket has two sets and more, with the class of the size."""
    rows = signatures(sets, frequent, boundary, percent)
    shared = write_through(
        rows.groupBy("bucket").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).filter("low < high").select("bucket"), "shared-buckets"
    )
    # Most buckets have one set: their rows stay where they are, in the Python worker that makes them.
    few = signatures(sets, frequent, boundary, percent, _marked(shared))
    return few.join(shared, "bucket").distinct().withColumn("class", size_class("size", percent))


def set_links(sets: DataFrame, percent: int = PERCENT, boundary: int | None = None, most: int = FREQUENT) -> DataFrame:
    """Node and root (node, root) of the sids that are linked with others; ``boundary`` as given, or by cost."""
    filled = sets.filter("n > 0")
    frequent = frequent_elements(filled, most)
    if boundary is None:
        boundary = choose_boundary(filled, frequent, percent)
    # A row for each sid: copies of a set have equal elements.
    firsts = write_through(filled.groupBy("sid").agg(F.min("row").alias("row")), "first-rows")
    members = write_through(_members(filled, frequent, boundary, percent), "bucket-members")

    def named(x: str, y: str):
        return F.least(f"{x}.sid", f"{y}.sid").alias("a"), F.greatest(f"{x}.sid", f"{y}.sid").alias("b")

    entry = F.struct("sid", "size", "place", "large")
    first = members.groupBy("bucket", "class").agg(F.min(entry).alias("y"))
    meeting = members.alias("x").join(first, ["bucket", "class"]).filter(F.col("x.sid") != F.col("y.sid"))
    seen = write_through(meeting.filter(_may_link("x", "y", percent)).select(*named("x", "y")).distinct(), "met-pairs")
    rough = write_through(_not_apart(seen, filled, firsts, percent), "rough-pairs")
    tried = write_through(_finely_near(rough, filled, firsts, percent), "first-pairs")
    links = write_through(_linked(tried, filled, firsts, percent), "first-links")
    groups = write_through(connected(links), "first-groups")
    open_ = write_through(_open_members(members, groups), "open-members")

    def fresh(pairs: DataFrame) -> DataFrame:
        unseen = pairs.distinct().join(seen, ["a", "b"], "left_anti")
        return _not_apart(write_through(unseen, "fresh-pairs"), filled, firsts, percent)

    def still_near(pairs: DataFrame) -> DataFrame:
        rest = write_through(_between_groups(pairs, groups).select("a", "b"), "other-pairs")
        return write_through(_finely_near(rest, filled, firsts, percent), "near-pairs")

    def regrouped(more: DataFrame) -> DataFrame:
        known = groups.select(F.col("node").alias("a"), F.col("root").alias("b"))
        return write_through(connected(known.unionByName(more)), "more-groups")

    # Most others belong to the largest group too, and meet few of its sets to join it.
    many = open_.filter("many").drop("many")
    drawn = many.groupBy("bucket", "class", (F.col("root") == F.col("main")).alias("of_main")).agg(
        F.min(F.struct(F.xxhash64(F.col("bucket").bitwiseAND(DRAWS - 1), "sid").alias("draw"), "sid", "size", "place", "large", "root")).alias("y")
    )
    others = many.filter("root != main")
    meeting = others.alias("x").join(drawn, ["bucket", "class"]).filter(F.col("x.root") != F.col("y.root"))
    rest = still_near(fresh(meeting.filter(_may_link("x", "y", percent)).select(*named("x", "y"))))
    if not rest.isEmpty():
        now = _nearest(_between_groups(rest, groups), filled, firsts)
        groups = regrouped(write_through(_linked(now, filled, firsts, percent), "drawn-links"))
        many = write_through(_open_members(many.select(*members.columns), groups).drop("many"), "still-open-members")

    def met(rows: DataFrame, *filters) -> DataFrame:
        band = lambda k: F.floor((F.col("class") + k) / BAND)
        # Sets of neighbouring classes may be in another band.
        others = rows.filter(F.col("root") != F.col("main")).withColumn("near", F.explode(F.array_distinct(F.array(band(-1), band(1)))))
        on = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.near") == F.col("y.band")) & (F.col("x.root") != F.col("y.root"))
        on &= (F.col("y.root") == F.col("y.main")) | (F.col("x.sid") < F.col("y.sid"))
        for f in (_may_link, *filters):
            on &= f("x", "y", percent)
        return others.alias("x").join(rows.withColumn("band", band(0)).alias("y"), on).select(*named("x", "y"))

    # Pairs of buckets with few members are few; in the others, sketches are compared before a pair is made.
    sids = many.select(F.col("sid").alias("a"), F.col("sid").alias("b")).distinct()
    sketches = _of_paired(sids, filled, firsts, "sketch").select("sid", _folded("sketch").alias("sketch"))
    sketched = write_through(many.join(sketches, "sid"), "sketched-members")
    rest = still_near(fresh(met(open_.filter("not many")).unionByName(met(sketched, _in_common_if_folded))))
    # One pair of two groups may join them and spare the others: the one whose sketches differ least goes first.
    for last in (False, False, True):
        rest = write_through(_between_groups(rest, groups), "open-pairs")
        if rest.isEmpty():
            break
        now = rest if last else _nearest(rest, filled, firsts)
        more = write_through(_linked(now.select("a", "b"), filled, firsts, percent), "more-links")
        if not last:
            rest = rest.select("a", "b").join(now.select("a", "b"), ["a", "b"], "left_anti")
        if not more.isEmpty():
            groups = regrouped(more)
    return groups


def _open_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``members`` of the buckets that have two groups and more, with their root, that of the bucket's largest group (main), and whether there are many.

    Members of the largest group meet the others only.
    """
    placed = members.join(groups.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    counts = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    main = (
        counts.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("groups"), F.sum("n").alias("n"))
        .filter("groups > 1").select("bucket", "main", (F.col("n") > FEW_MEMBERS).alias("many"))
    )
    return placed.join(main, "bucket")


def _between_groups(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in different groups, with the groups (of_a, of_b) in order."""
    for k in "ab":
        pairs = pairs.join(groups.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")), k, "left")
    root_a, root_b = F.coalesce("root_a", "a"), F.coalesce("root_b", "b")
    return pairs.filter(root_a != root_b).select("a", "b", F.least(root_a, root_b).alias("of_a"), F.greatest(root_a, root_b).alias("of_b"))


def _nearest(pairs: DataFrame, sets: DataFrame, firsts: DataFrame) -> DataFrame:
    """Per two groups (of_a, of_b) the pair (a, b) whose sketches differ least."""
    sketches = _of_paired(pairs, sets, firsts, "sketch")
    both = pairs.join(sketches.alias("x"), F.col("a") == F.col("x.sid")).join(sketches.alias("y"), F.col("b") == F.col("y.sid"))
    order = F.struct(_apart("x", "y").alias("apart"), "a", "b")
    return write_through(both.groupBy("of_a", "of_b").agg(F.min(order).alias("p")).select("p.a", "p.b"), "nearest-pairs")


def jaccard_groups(docs: DataFrame, n: int = NGRAM_WORDS, percent: int = PERCENT, **options) -> DataFrame:
    """doc_id, n_shingles and component_id per row of ``docs`` (doc_id, text).

    component_id is the smallest id that is reached by links, null if no row of the group
    has an id. Texts without words, null included, have no set and are linked with nothing:
    their component is their own id. Equal rows and rows that share an id are rows each.
    Other columns are not read. Sets and n-grams are known by 64-bit hashes.
    """
    with small_batches(docs.sparkSession):
        sets = write_through(ngram_sets(docs, n).withColumn("row", F.monotonically_increasing_id()), "ngram-sets")
        ids = sets.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("low"))
        groups = set_links(sets, percent, **options)
        rooted = write_through(
            ids.join(groups.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "rooted-sets"
        )
        smallest = rooted.groupBy("root").agg(F.min("low").alias("smallest"))
        per_set = rooted.join(smallest, "root").select("sid", "smallest")
    return sets.select("doc_id", "n", "sid").join(per_set, "sid", "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"),
    )
