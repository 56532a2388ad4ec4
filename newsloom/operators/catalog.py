"""Section catalogue: topic counts, frequent topics, ranking join, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import fixed, urls
from newsloom.functions.stemming import with_stem
from newsloom.operators.skew import (
    attach_by_key, collect_in_parts, count_per_key, join_rows, keep_matching_keys, with_count,
)
from newsloom.sources.workspace import write_through

RANKING_COLUMNS = ("media", "domain", "overall", "country", "region", "language")


# ---- rankings ----------------------------------------------------------------

def merge_rankings(general: DataFrame, special: DataFrame) -> DataFrame:
    """Full join on all common columns (nulls equal nulls)."""
    names = [c for c in general.columns if c in special.columns]
    a, b = general.alias("a"), special.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    rest_a = [F.col(f"a.{c}") for c in general.columns if c not in names]
    rest_b = [F.col(f"b.{c}") for c in special.columns if c not in names]
    return a.join(b, condition, "full").select(
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in names], *rest_a, *rest_b
    )


def ranking_sorted(ranking: DataFrame, by: str = "overall") -> DataFrame:
    return ranking.orderBy(by)


def top_media(ranking: DataFrame, by: str = "overall", rows: int = fixed.TOP_MEDIA_ROWS) -> DataFrame:
    """First media of the ranking in the order of ``by``."""
    return ranking.orderBy(by, "media", "domain").limit(rows).select("media", "domain", "overall")


def media_per_region(ranking: DataFrame) -> DataFrame:
    """Media per region with the totals as a row of region null."""
    return ranking.rollup("region").agg(
        F.count("*").alias("n_media"), F.countDistinct("region").alias("n_regions")
    )


# ---- counts ------------------------------------------------------------------

def topic_counts(sections: DataFrame, key: str = "topic_stem") -> DataFrame:
    return count_per_key(sections, key, "n")


def domain_counts(sections: DataFrame) -> DataFrame:
    return count_per_key(sections, "domain", "n").orderBy(F.desc("n"), "domain")


def distinct_domains(sections: DataFrame) -> DataFrame:
    return sections.agg(F.countDistinct("domain").alias("n_domains"))


def topic_domain_scores(sections: DataFrame) -> DataFrame:
    """Add the row counts of the topic stem and of the domain, both counted on the rows as given."""
    topics = count_per_key(sections, "topic_stem", "topic_score")
    domains = count_per_key(sections, "domain", "domain_score")
    stemmed = attach_by_key(sections, topics, "topic_stem", "topic_score")
    return attach_by_key(stemmed, domains, "domain", "domain_score")


def frequent_topics(sections: DataFrame, above: int = fixed.MIN_TOPIC_COUNT) -> DataFrame:
    """Stems that occur more than ``above`` times."""
    return count_per_key(sections, "topic_stem", "n").filter(F.col("n") > above)


def frequent_topic_rows(sections: DataFrame, above: int = fixed.MIN_TOPIC_COUNT) -> DataFrame:
    """Rows with a frequent stem."""
    columns = sections.columns
    return with_count(sections, "topic_stem", "_n").filter(F.col("_n") > above).select(*columns)


def topic_substring_semi(sections: DataFrame, stems: DataFrame) -> DataFrame:
    """Rows whose topic contains one of the stems.

    No row-by-stem loop: each *distinct* topic is cut into its substrings of
    the lengths that occur among the stems, which meet the stems by equality.
    """
    lengths = stems.agg(
        F.min(F.length("topic_stem")).alias("lo"), F.max(F.length("topic_stem")).alias("hi")
    )
    size = F.length("topic")
    topics = sections.select("topic").filter("topic IS NOT NULL").distinct().select(
        "topic",
        lengths.select("lo").scalar().alias("lo"),
        F.least(lengths.select("hi").scalar(), size).alias("hi"),
    )
    sizes = F.when(F.col("lo") <= F.col("hi"), F.sequence("lo", "hi")).otherwise(
        F.array().cast("array<int>")
    )
    pieces = F.array_distinct(
        F.flatten(
            F.transform(
                sizes,
                lambda n: F.transform(
                    F.sequence(F.lit(1), size - n + 1), lambda i: F.substring("topic", i, n)
                ),
            )
        )
    )
    matching = (
        topics.select("topic", F.explode(pieces).alias("topic_stem"))
        .join(stems.select("topic_stem"), "topic_stem", "left_semi")
        .select("topic").distinct()
    )
    return keep_matching_keys(sections, "topic", matching)


# ---- normalisation and scores ------------------------------------------------

def minmax_normalise(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Add (x - min) / (max - min) over all rows; null where all are equal.

    The bounds come from a one-row scalar subquery, not from a global window.
    """
    value = F.col(column).cast("double")
    bounds = rows.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    spread = F.nullif(F.col("_b.hi") - F.col("_b.lo"), F.lit(0))
    return rows.withColumn("_b", bounds).withColumn(
        out, (value - F.col("_b.lo")) / spread
    ).drop("_b")


def euclid_norm(*parts: Column) -> Column:
    """Square root of the sum of squares; a null part counts as zero."""
    total = F.lit(0.0)
    for p in parts:
        total = total + F.coalesce(F.pow(p, F.lit(2)), F.lit(0.0))
    return F.sqrt(total)


def score_sections(sections: DataFrame, ranking: DataFrame) -> DataFrame:
    """Sections of ranked domains with their score.

    Both sides are matched without ``www.`` and slashes; a domain that is
    ranked twice gives two rows. The score joins the normalised ranking value
    with the topic count. The joined rows are written once, since the bounds and
    the scores both read them; calling this runs jobs.
    """
    left = sections.withColumn("_d", urls.strip_www(F.col("domain"))).dropna("any")
    right = ranking.select(
        urls.strip_www(F.substring_index("domain", "|", 1)).alias("_d"), "overall"
    )
    joined = write_through(
        join_rows(left, right, "_d").select("domain", "url", "topic", "topic_score", "overall"),
        "ranked",
    )
    return minmax_normalise(joined, "overall", "_o").select(
        "domain", "url", "topic", "overall",
        euclid_norm(F.col("_o"), F.col("topic_score")).alias("score"),
    )


def attach_frequencies(sections: DataFrame, key: str, out: str) -> DataFrame:
    """Add the min-max normalised count of ``key``."""
    counts = count_per_key(sections, key, "_n")
    scaled = minmax_normalise(counts, "_n", out)
    return attach_by_key(sections, scaled, key, "_n").drop("_n")


def frequency_score(sections: DataFrame, ranking: DataFrame) -> DataFrame:
    """Exploratory score of three parts: ranking, domain and topic frequency."""
    both = attach_frequencies(
        attach_frequencies(sections, "topic_stem", "freq_topic"), "domain", "freq_domain"
    )
    right = ranking.select(urls.strip_www(F.col("domain")).alias("_d"), "overall")
    left = both.withColumn("_d", urls.strip_www(F.col("domain")))
    joined = write_through(join_rows(left, right, "_d"), "ranked")
    return minmax_normalise(joined, "overall", "_o").select(
        "domain", "url", "topic",
        euclid_norm(F.col("_o"), F.col("freq_domain"), F.col("freq_topic")).alias("score"),
    )


def unmatched_media(sections: DataFrame, ranking: DataFrame) -> DataFrame:
    """Ranked media without any section."""
    seen = sections.select(urls.strip_www(F.col("domain")).alias("_d")).distinct()
    left = ranking.withColumn("_d", urls.strip_www(F.substring_index("domain", "|", 1)))
    return left.join(seen, "_d", "left_anti").drop("_d")


def domain_records(scored: DataFrame) -> DataFrame:
    """Sections per domain as arrays of (url, topic, score, copies), see ``collect_in_parts``."""
    return collect_in_parts(scored, "domain", ["url", "topic", "score"], "url")


# ---- similar topics ----------------------------------------------------------

# Words up to this length meet by what two edits leave of them, longer ones by segments.
FORM_LETTERS = 32
# Words whose keys go to one part of the join.
WORDS_AT_ONCE = 500


def _edit_keys(words: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Keys of a word as the first and as the second one of a pair, the shorter one first.

    A key is what is left of a word without one or two letters, with the places that the other
    word may fill in its own way. Two words of one length are equal but for ``limit`` places, or
    without one letter each; a word with a letter more, without it, is equal to the other but for
    ``limit`` - 1 places; with two more, without these. So words that share a key are within the limit.
    """
    word, size = F.col("word"), F.length("word")

    def rest(i: Column) -> Column:
        return F.concat(F.substring(word, F.lit(1), i - 1), F.substr(word, i + 1))

    def rest_of_two(i: Column, j: Column) -> Column:
        return F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, j - i - 1), F.substr(word, j + 1))

    def key(left: Column, i: Column | int, j: Column | int) -> Column:
        return F.xxhash64(left, *(x if isinstance(x, Column) else F.lit(x) for x in (i, j)))

    def explode(*lists: Column) -> DataFrame:
        return parts.select("word", F.explode(F.array_distinct(F.concat(*lists))).alias("form"))

    def each(lists: str, of) -> Column:
        return F.transform(lists, of)

    # Places are counted from 1 and of Spark's int type, as the numbers in the keys are.
    one = F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(rest(i).alias("left"), i.alias("i"))))
    parts = words.select("word", F.coalesce(one, F.array().cast("array<struct<left:string,i:int>>")).alias("one"))
    if limit == 1:
        same = each("one", lambda x: key(x["left"], x["i"], 0))
        return explode(same, F.array(key(word, 0, -1))), explode(same, each("one", lambda x: key(x["left"], 0, -1)))

    def second(i: Column) -> Column:
        return F.transform(
            F.sequence(i + 1, size), lambda j: F.struct(rest_of_two(i, j).alias("left"), i.alias("i"), j.alias("j"))
        )

    two = F.when(size > 1, F.flatten(F.transform(F.sequence(F.lit(1), size - 1), second)))
    parts = parts.withColumn("two", F.coalesce(two, F.array().cast("array<struct<left:string,i:int,j:int>>")))
    same = F.concat(each("two", lambda x: key(x["left"], x["i"], x["j"])), each("one", lambda x: key(x["left"], 0, 0)))
    # A word without letters has no place that differs.
    nothing = F.when(size == 0, F.array(key(word, 0, -1))).otherwise(F.array().cast("array<bigint>"))
    letter = F.when(size == 1, F.array(key(F.lit(""), 0, -1))).otherwise(F.array().cast("array<bigint>"))
    return (
        explode(same, each("one", lambda x: key(x["left"], x["i"], -1)), nothing, F.array(key(word, 0, -2))),
        explode(
            same, letter, each("two", lambda x: key(x["left"], x["i"], -1)), each("two", lambda x: key(x["left"], x["j"] - 1, -1)),
            each("two", lambda x: key(x["left"], 0, -2)),
        ),
    )


def _segment_keys(words: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Keys of a word as the shorter and as the longer one of a pair.

    The shorter word is cut into ``limit`` + 1 segments. ``limit`` edits leave one of
    them as it is, and it stands in the longer word at most ``limit`` places away. So a
    word has as many keys as there are lengths, segments and shifts, however long it is.
    """
    n, word, size = limit + 1, F.col("word"), F.length("word")

    def key(length: Column, i: Column, shift: Column) -> Column:
        least, longer = F.floor(length / n).cast("int"), n - length % n
        start = i * least + F.greatest(F.lit(0), i - longer) + shift
        many = least + F.when(i >= longer, 1).otherwise(0)
        fits = (start >= 0) & (start + many <= size)
        return F.when(fits, F.xxhash64(F.substr(word, start + 1, many), i, length))

    def places(triples: list[tuple[int, int, int]]) -> Column:
        options = F.array(*[F.struct(*[F.lit(x) for x in t]) for t in triples])
        keys = F.transform(options, lambda t: key(size - t["col1"], t["col2"], t["col3"]))
        return F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())))

    as_shorter = [(0, i, 0) for i in range(n)]
    as_longer = [(d, i, s) for d in range(limit + 1) for i in range(n) for s in range(-limit, limit + 1)]
    return tuple(words.select("word", places(p).alias("form")) for p in (as_shorter, as_longer))


def topic_edit_pairs(
    sections: DataFrame, key: str = "topic", limit: int = fixed.MAX_EDIT_DISTANCE
) -> DataFrame:
    """Unordered pairs of distinct topics within an edit distance of ``limit`` (1 or 2).

    Short words within the limit share what one or two edits leave of them, with its places, so
    that no others meet; long ones share a segment near its place and meet others too. Pairs
    meet by the hash of one of these and only then is the distance computed: no pass over all
    pairs, none is missed. Calling this runs a job: the distinct words are written and counted,
    since pairs take much more than words, and the join has parts by the number of words.
    """
    if limit not in (1, 2):
        raise ValueError("limit must be 1 or 2")
    words = write_through(
        sections.select(F.col(key).alias("word")).filter(F.col("word").isNotNull()).distinct(), "edit-words"
    )
    parts = 1 + words.count() // WORDS_AT_ONCE
    words = words.repartition(parts, "word")
    # A pair whose shorter word is short has a longer one of at most so many letters.
    short = _edit_keys(words.filter(F.length("word") <= FORM_LETTERS + limit), limit)
    long = _segment_keys(words.filter(F.length("word") > FORM_LETTERS), limit)
    # A number of parts that is asked for stays: Spark would merge parts by the size of the keys.
    x, y = (
        s.unionByName(g).withColumnRenamed("word", k).repartition(parts, "form") for k, s, g in zip("xy", short, long)
    )
    in_order = F.struct(F.length("x"), F.col("x")) < F.struct(F.length("y"), F.col("y"))
    met = x.join(y, "form").filter(in_order).select(F.least("x", "y").alias("word_a"), F.greatest("x", "y").alias("word_b"))
    distance = F.levenshtein("word_a", "word_b", limit)
    return (
        met.repartition(parts, "word_a", "word_b").distinct()
        .select("word_a", "word_b", distance.alias("distance"))
        .filter(F.col("distance") >= 0)
    )


def edit_pairs_sorted(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy("word_a", "distance", "word_b")


# ---- the whole job -----------------------------------------------------------

def section_catalogue(links: DataFrame, ranking: DataFrame,
                      above: int = fixed.MIN_TOPIC_COUNT) -> DataFrame:
    """Section urls -> scored sections: one segment, stem, count, frequent, ranked.

    The sections are shaped once and each distinct topic is stemmed once; calling this runs jobs.
    """
    from newsloom.operators.links import one_segment_urls

    shaped = write_through(
        one_segment_urls(links).withColumn("domain", urls.domain(F.col("url"))), "sections")
    topics = write_through(
        with_stem(count_per_key(shaped, "topic", "_n"), "topic", "topic_stem"), "topics")
    scores = topics.groupBy("topic_stem").agg(F.sum("_n").alias("topic_score"))
    per_topic = topics.join(scores.filter(F.col("topic_score") > above), "topic_stem")
    frequent = attach_by_key(shaped, per_topic, "topic", "_n").filter(F.col("topic_score").isNotNull())
    return score_sections(frequent.select(*shaped.columns, "topic_stem", "topic_score"), ranking)
