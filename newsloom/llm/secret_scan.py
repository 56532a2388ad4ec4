"""Secret scan with corpus-wide ownership frequency.

Candidates of fixed forms are found in whole texts with their places. The hash of
each candidate's value is then counted over the corpus by distinct repositories
and owners: a value that many have is a copied example, one that a single owner
has looks live. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import row_key
from newsloom.sources.workspace import write_through


def either_case(pattern: str) -> str:
    """``pattern`` with each ASCII letter in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else c for c in pattern)


# Kind: pattern, group of the value, least length of the value. Equal runs of hex or
# access characters are found by their least length at once.
FORMS = {
    "assign": (
        "(" + either_case("password|passwd|secret|token|api_?key")
        + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
    ),
    "access": ("AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
    # Other long values; a span only if one owner has them.
    "owned": ("[A-Za-z0-9+/_=-]{20,}", 0, 20),
}
KINDS = list(FORMS)
MOST_OWNERS = 1
MOST_REPOSITORIES = 3


def _candidates(text: Column, kind: str) -> Column:
    """Matches of one kind in order: characters before it, its length, whether it counts, its value's hash."""
    pattern, group, least = FORMS[kind]
    n = KINDS.index(kind)
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def one(z: Column, i: Column) -> Column:
        good = F.length(z["value"]) >= least
        if kind == "owned":
            good &= z["value"].rlike("[0-9]") & z["value"].rlike("[a-z]") & z["value"].rlike("[A-Z]")
        return F.struct(
            F.lit(n).alias("kind"), i.alias("i"), F.length(z["before"]).alias("before"),
            F.length(z["found"]).alias("length"), good.alias("good"), F.sha2(z["value"], 256).alias("hash"),
        )

    # The piece after the last match has no match of its own.
    return F.when(text.rlike(pattern), F.filter(F.transform(parts, one), lambda x: x["length"].isNotNull()))


def find_candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """key, doc_id, owner, repository and found (all matches of all kinds) per row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kind = "array<struct<kind:int,i:int,before:int,length:int,good:boolean,hash:string>>"
    arrays = [F.coalesce(_candidates(text, k), F.array().cast(kind)) for k in KINDS]
    return docs.select(
        row_key(F.col("doc_id"), text).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"),
        F.concat(*arrays).alias("found"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners and repositories per hash of a candidate."""
    each = found.select("owner", "repository", F.explode("found").alias("c")).filter("c.good")
    per_repository = each.groupBy(F.col("c.hash").alias("hash"), "owner", "repository").agg(F.lit(1).alias("one"))
    per_owner = per_repository.groupBy("hash", "owner").agg(F.count("one").alias("n"))
    return per_owner.groupBy("hash").agg(F.count("n").alias("n_owners"), F.sum("n").alias("n_repositories"))


def scan_secrets(docs: DataFrame, owner: Column, repository: Column, most_owners: int = MOST_OWNERS,
                 most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Spans of secrets per row of ``docs`` (doc_id, text, and what ``owner`` and ``repository`` read).

    Columns: doc_id, base (spans of the kinds assign, access and hex) and every (these and
    ``owned``), each an array of structs (start, kind_no, end, live), by start and kind;
    starts count code points, ends are exclusive. ``live`` says that at most
    ``most_owners`` owners and ``most_repositories`` repositories have the value. A null or
    empty text has no spans; a null owner or repository is one of its own; rows equal in id
    and text get the same spans.
    """
    found = write_through(find_candidates(docs, owner, repository), "secret-candidates")
    one = found.filter(F.size("found") > 0).select("key", "found").dropDuplicates(["key"])
    each = one.select("key", F.explode("found").alias("c")).select("key", "c.*")
    order = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("before") + F.col("length")).over(order)).filter("good")
    live = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)
    judged = placed.join(ownership(found), "hash").select(
        "key", F.struct((F.col("end") - F.col("length")).alias("start"), F.col("kind").alias("kind_no"), "end", live.alias("live")).alias("span"),
    )
    owned = KINDS.index("owned")
    spans = judged.filter((F.col("span.kind_no") != owned) | F.col("span.live")).groupBy("key").agg(
        F.array_sort(F.collect_list("span")).alias("every")
    )
    none = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,live:boolean>>")
    return (
        found.select("key", "doc_id").join(spans, "key", "left")
        .withColumn("every", F.coalesce("every", none))
        .select("doc_id", F.filter("every", lambda s: s["kind_no"] != owned).alias("base"), "every")
    )


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"], s["end"])), ",")
