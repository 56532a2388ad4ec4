"""Ranked search, periodic runs and the n-gram join against plain versions."""

import math
import random
import re
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import ngram_join, presence_masks, run_queries, word_runs
from newsloom.sources.workspace import write_through

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# Names the operators use inside stand in the tables too.
DOCS = "doc_id bigint, text string, source string, n string, terms string, rank string, item string, key string, size string"
ITEMS = "item_id bigint, text string, bytes string, doc_id string, rank string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "s", "n", "t", "r", "i", "k", "z") for i, t in rows], DOCS)


def brute_search(docs, items, ranks):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n_docs, total = sum(map(bool, terms)), sum(map(len, terms))
    counts = [Counter(t) for t in terms]
    df = Counter(t for c in counts for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for (doc_id, _), t, c in zip(docs, terms, counts):
            m = 50 + (50 * len(t) * n_docs) // max(1, total)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 20 * m))
                for x in set(TERM.findall((text or "").translate(LOWER))) if c[x]
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, unnamed, doc_id) in enumerate(sorted(scores)[:ranks], 1):
            out.append((item_id, rank, None if unnamed else doc_id, -score))
    return out


def rows_in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: [(v is None, v if v is not None else 0) for v in r])


def search_rows():
    r = random.Random(11)
    words = [f"w{i}" for i in range(150)] + ["Über", "STRASSE", "naïve", "A1"]
    weights = [1 / (1 + i) for i in range(len(words))]
    docs = [(i, r.choice([" ", "-", "\n", "\x85"]).join(r.choices(words, weights, k=r.choice([0, 1, 5, 20, 200])))) for i in range(150)]
    docs += [(None, docs[20][1]), (None, docs[21][1]), (7, docs[30][1]), (30, docs[30][1]), (400, None), (401, ""), (402, "w3 " * 9000)]
    items = [(i, " ".join(r.choices(words, weights, k=r.choice([1, 3, 12, 160])))) for i in range(12)]
    items += [(None, "w1 w2 über"), (3, "w5 a1"), (100, None), (101, ""), (102, "unheard of"), (103, " ".join(words)), (104, "w1 W1 w1")]
    return docs, items


@pytest.mark.parametrize("block_bytes", [2500, 1 << 20])
def test_search_equals_brute_force(spark, block_bytes, monkeypatch):
    docs, items = search_rows()
    asked = spark.createDataFrame([(i, t, "b", "d", "r") for i, t in items], ITEMS)
    got = presence_masks.ranked_search(documents(spark, docs).repartition(3), asked, ranks=9, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_in_order(got.collect()) == rows_in_order(brute_search(docs, items, 9))


def test_masks_end_only_when_no_bound_reaches_the_kept_scores(monkeypatch):
    import pyarrow as pa

    docs, items = search_rows()
    monkeypatch.setattr(presence_masks, "_DOCS_AT_ONCE", 1)
    phrases = presence_masks.Items([t for _, t in items])
    counts = [Counter(phrases.number[w] for w in presence_masks.terms_of(t or "") if w in phrases.number) for _, t in docs]
    sizes = [len(presence_masks.terms_of(t or "")) for _, t in docs]
    columns = [
        pa.array([i for i, _ in docs], pa.int64()), pa.array(sizes, pa.int64()),
        pa.array([list(c) for c in counts], pa.list_(pa.int32())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32())),
    ]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])
    n_docs, n_terms = sum(map(bool, sizes)), sum(sizes)
    df = Counter(t for c in counts for t in c)
    weight = np.array([presence_masks.term_weight(n_docs, df[t]) for t in range(len(phrases.number))])
    want = brute_search(docs, [(k, t) for k, (_, t) in enumerate(items)], 4)
    for k, terms in enumerate(phrases.terms):
        kept = presence_masks.Kept(4)
        for start in range(0, len(batch), 40):
            presence_masks.Shard(batch.slice(start, 40), n_docs, n_terms).search(terms, weight[terms], kept)
        assert kept.score.tolist() == [s for i, _, _, s in want if i == k]
        assert [d if n else None for d, n in zip(kept.doc.tolist(), kept.named)] == [d for i, _, d, _ in want if i == k]


def test_search_in_empty_tables(spark):
    none, some = documents(spark, []), documents(spark, [(1, "a b"), (2, None)])
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert presence_masks.ranked_search(none, items).count() == 0
    assert presence_masks.ranked_search(some, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in presence_masks.ranked_search(some, items).collect()] == [(1, 1, 1)]


def brute_runs(words, min_words):
    """(start, length, smallest period) of all runs, by looking at each period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(min_words, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def run_texts(r, n_texts):
    texts = []
    for _ in range(n_texts):
        n, kinds = r.choice([0, 1, 5, 11, 12, 13, 30, 100, 300]), r.choice([1, 2, 3, 50])
        words = [f"w{r.randrange(kinds)}" for _ in range(n)]
        if n and r.random() < 0.5:
            a = r.randrange(n)
            p = 1 + (n - a) // r.randint(3, 10)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        texts.append(words)
    return texts


@pytest.mark.parametrize("min_words", [2, 3, 7, 12])
@pytest.mark.parametrize("at_once", [40, 10**6])
def test_runs_equal_brute_force(min_words, at_once, monkeypatch):
    monkeypatch.setattr(word_runs, "_PAIRS_AT_ONCE", at_once)
    r = random.Random(min_words)
    for _ in range(40):
        texts = run_texts(r, r.choice([1, 3, 8]))
        got = word_runs.runs_of(texts, min_words)
        assert [list(map(tuple, g.tolist())) for g in got] == [brute_runs(t, min_words) for t in texts]


def test_runs_in_words_of_nested_periods():
    a, b = "a", "ab"
    while len(b) < 700:
        a, b = b, b + a
    for words in (list(b), ["x"] * 500, list("abcabcab" * 40), list("aab" * 30 + "aab" * 30)):
        assert list(map(tuple, word_runs.runs_of([words])[0].tolist())) == brute_runs(words, 12)


def test_grammar_extension_equals_a_walk():
    r = random.Random(4)
    for kinds in (1, 2, 3, 40):
        s = np.array([r.randrange(kinds) for _ in range(400)] * 2 + [kinds])
        a = np.array([r.randrange(799) for _ in range(900)])
        b = np.array([r.randrange(x + 1, 800) for x in a])
        want = [next(k for k in range(800) if s[x + k] != s[y + k]) for x, y in zip(a.tolist(), b.tolist())]
        assert word_runs.Grammar(s).extension(a, b).tolist() == want


def test_periodic_runs_of_a_table(spark):
    r = random.Random(6)
    docs = [(i, r.choice([" ", "\n", " \t"]).join(t)) for i, t in enumerate(run_texts(r, 30))]
    docs += [(None, "a b " * 9), (3, None), (3, ""), (5, " \n "), (5, "é\x85 ü " * 8), (6, "long " * 60_000)]
    got = word_runs.periodic_runs(documents(spark, docs).repartition(2)).collect()
    want = []
    for i, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = [(0, 60_000, 1)] if i == 6 and len(words) > 50_000 else brute_runs(words, 12)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[3])
    rows = [(g["doc_id"], g["n_words"], list(map(tuple, g["runs"])), g["collapsed"]) for g in got]
    assert sorted(rows, key=key) == sorted(want, key=key)
    assert word_runs.periodic_runs(documents(spark, [])).count() == 0


def test_run_query_digests(spark):
    import hashlib
    import zlib

    docs = [(i, " ".join(f"w{k % 97}" for k in range(n))) for i, n in enumerate([0, 1, 40, 200, 333] * 12)] + [(None, "a " * 20), (60, None)]
    folder = tempfile.mkdtemp(prefix="newsloom-runs-")
    documents(spark, docs).write.parquet(f"{folder}/documents.parquet")
    got = {(r["doc_id"], r["collapsed_sha256"]): r for r in run_queries.op12_recompression_runs(spark, folder).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    planted = 0
    for i, t in docs:
        words = (t or "").split()
        n, h = len(words), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            planted += 1
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words, 12)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        row = got[i, sha(" ".join(w for k, w in enumerate(words) if k not in gone))]
        assert row["n_runs"] == len(runs) and row["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        top = min(((-m, s, q) for s, m, q in runs), default=None)
        want = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
        assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == want
    assert planted


def brute_sets(docs, n=4):
    out = []
    for _, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    return out


def brute_groups(docs, percent=85):
    sets, label = brute_sets(docs), list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    out = []
    for k, (doc_id, _) in enumerate(docs):
        ids = [d for (d, _), x in zip(docs, label) if x == label[k] and d is not None]
        out.append((doc_id, len(sets[k]), min(ids, default=None) if sets[k] else doc_id))
    return out


def near_copies(r, n):
    """Texts of many lengths with edited copies, chains of copies, and one passage that many have."""
    words = [f"w{i}" for i in range(2000)]
    passage = r.choices(words, k=60)
    texts = []
    for k in range(n):
        base = r.choices(words, k=r.choice([1, 2, 3, 4, 8, 9, 10, 12, 16, 20, 25, 40, 80, 150]))
        if k % 3 == 0:
            base = base[:10] + passage + base[10:20]
        texts.append(base)
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            copy = list(texts[-1])
            for _ in range(r.choice([0, 1, 1, 2])):
                copy[r.randrange(len(copy))] = r.choice(words)
            copy = copy[: len(copy) - r.choice([0, 0, 1, 3])] or copy
            texts.append(copy)
    base = r.choices(words, k=90)
    texts += [[*base[:k], "x" + str(k), *base[k:]] for k in range(40)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs += [(None, docs[5][1]), (None, "only nameless"), (None, "ONLY  nameless"), (3, docs[9][1]), (5000, None), (5001, ""), (5002, " \n"), (None, None)]
    docs += [(5003, "w1 " * 5000), (5004, "W1\n" * 4000), (5005, "a\x85b c"), (5006, "A\x85B C"), (2, docs[2][1])]
    return docs


def by_row(rows):
    return sorted(rows, key=lambda r: [(v is None, v or 0) for v in r])


@pytest.mark.parametrize("boundary, most", [(-1, 20), (30, 0), (10**6, 20), (None, 1000)])
def test_join_equals_brute_force(spark, boundary, most, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW_MEMBERS", 2 if boundary == 30 else 8)
    docs = near_copies(random.Random(13), 60)
    if boundary == 10**6:  # subsets of long sets are many
        docs = [(i, " ".join((t or "").split()[:60])) for i, t in docs]
    got = ngram_join.jaccard_groups(documents(spark, docs).repartition(3), boundary=boundary, most=most)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert by_row(map(tuple, got.collect())) == by_row(brute_groups(docs))


def test_join_without_broadcast_and_in_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_SETS", 0)
    docs = near_copies(random.Random(14), 20)
    got = ngram_join.jaccard_groups(documents(spark, docs), percent=70)
    assert by_row(map(tuple, got.collect())) == by_row(brute_groups(docs, 70))
    assert ngram_join.jaccard_groups(documents(spark, [])).count() == 0
    none = ngram_join.jaccard_groups(documents(spark, [(1, None), (None, "")])).collect()
    assert by_row(map(tuple, none)) == by_row([(1, 0, 1), (None, 0, None)])


def test_the_boundary_follows_the_cost(spark):
    r = random.Random(15)
    words = [f"w{i}" for i in range(9000)]
    apart = [(i, " ".join(r.choices(words, k=60))) for i in range(80)]
    # Sets of ten to thirty n-grams from a few: their lists are long, and subsets are few.
    dense = [(100 + i, " ".join(r.choices("ab", k=r.choice([16, 24, 32])))) for i in range(300)]
    sets = lambda docs: write_through(ngram_join.ngram_sets(documents(spark, docs)), "test-sets")
    chosen = lambda s: ngram_join.choose_boundary(s, ngram_join.frequent_elements(s))
    low, high = chosen(sets(apart)), chosen(sets(dense + apart))
    assert low < 57 and high >= low


def test_a_task_of_the_join_holds_one_worker_and_small_batches(spark, monkeypatch):
    from pyspark.sql import functions as F

    from newsloom.llm.common import map_rows, small_batches

    r = random.Random(20)
    words = [f"w{i}" for i in range(3000)]
    docs = [(i, " ".join(r.choices(words, k=40 + i % 3))) for i in range(40)]
    docs += [(100 + i, t) for i, t in docs[:10]] + [(200 + i, f"{t} end") for i, t in docs[:10]]
    sets = write_through(ngram_join.ngram_sets(documents(spark, docs)), "test-sets").filter("n > 0")
    frequent = ngram_join.frequent_elements(sets)
    members = ngram_join._members(sets, frequent, 20, 85)
    plan = members._jdf.queryExecution().executedPlan().toString()
    # Two in one stage are two Python processes for each core.
    assert plan.count("MapInArrow") == 1
    rows = ngram_join.signatures(sets, frequent, 20).distinct().collect()
    shared = {b for b in {x["bucket"] for x in rows} if len({x["sid"] for x in rows if x["bucket"] == b}) > 1}
    got = {tuple(x) for x in members.select(*rows[0].__fields__).collect()}
    assert got == {tuple(x) for x in rows if x["bucket"] in shared} and got

    def sizes(batch):
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["rows"])

    long = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("abcdefgh"), 2500).alias("text"))
    with small_batches(spark):
        assert max(x["rows"] for x in map_rows(long, sizes, "rows bigint").collect()) < 100


def test_folded_sketches_never_exceed_the_elements_apart(spark):
    r = np.random.default_rng(21)
    rows, apart = [], []
    for n, edits in ((50, 3), (400, 30), (900, 900)):
        both = np.unique(r.integers(-(2**63), 2**63 - 1, n + edits))
        x, y = both[:n], both[edits:]
        rows.append((n, ngram_join.sketch(x).tolist(), ngram_join.sketch(y).tolist()))
        apart.append(len(np.setxor1d(x, y)))
    table = spark.createDataFrame(rows, "n int, x array<bigint>, y array<bigint>")
    x = table.select("n", ngram_join._folded("x").alias("sketch")).alias("x")
    y = table.select("n", ngram_join._folded("y").alias("sketch")).alias("y")
    bits = ngram_join._apart("x", "y", ngram_join.FOLDED_WORDS)
    got = [k[0] for k in x.join(y, "n").orderBy("n").select(bits).collect()]
    assert all(0 < k <= n for k, n in zip(got, apart)) and got[2] > 200


def test_a_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    r = random.Random(16)
    base = [f"w{i}" for i in range(400)]
    made = []
    plain = ngram_join._linked
    monkeypatch.setattr(ngram_join, "_linked", lambda pairs, *a: made.append(pairs.count()) or plain(pairs, *a))

    def pairs_of(n):
        docs = []
        for i in range(n):
            copy = list(base)
            copy[r.randrange(400)] = f"x{i}"
            docs.append((i, " ".join(copy)))
        made.clear()
        got = ngram_join.jaccard_groups(documents(spark, docs)).collect()
        assert {g["component_id"] for g in got} == {0}
        return sum(made)

    few, many = pairs_of(60), pairs_of(240)
    assert many < 8 * few and many < 240 * 239 / 4


def test_elements_of_paired_sets_are_not_written_again(spark, monkeypatch):
    from pyspark.sql import functions as F

    from newsloom.llm import ngram_join

    base, far = list(range(20)), list(range(100, 120))
    rows = [(0, 10, base), (1, 20, [*base, 50]), (2, 30, [*base, 51]), (3, 40, far)]
    sets = spark.createDataFrame(rows, "row bigint, sid bigint, elements array<bigint>").withColumn("n", F.size("elements"))
    pairs = spark.createDataFrame([(10, 20), (10, 30), (10, 40), (20, 30)], "a bigint, b bigint")
    written, write = [], ngram_join.write_through
    monkeypatch.setattr(ngram_join, "write_through", lambda df, name: written.extend(df.columns) or write(df, name))
    got = ngram_join._linked(pairs, sets, sets.select("sid", "row"), 85).collect()
    assert {tuple(r) for r in got} == {(10, 20), (10, 30), (20, 30)}
    assert "elements" not in written


def test_others_of_a_large_group_join_it_before_all_meet(spark, monkeypatch):
    r = random.Random(17)
    base, hashes = [f"w{i}" for i in range(400)], ngram_join._WordHashes()

    def edited(n):
        copy = list(base)
        for k in r.sample(range(2, 398, 5), n):
            copy[k] = f"x{r.random()}"
        return " ".join(copy)

    # Six edits and two are linked, six and six are not; the set all meet first is one of six.
    sid = lambda t: ngram_join.xxhash.xxh3_64_intdigest(ngram_join.ngrams(t, hashes).tobytes())
    far = [edited(6) for _ in range(40)]
    close = [t for t in (edited(2) for _ in range(200)) if sid(t) - (1 << 63) > min(map(sid, far)) - (1 << 63)][:40]
    assert len(close) == 40
    met, write = [], ngram_join.write_through

    def counted(df, name):
        out = write(df, name)
        if name == "other-pairs":
            met.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "write_through", counted)
    got = ngram_join.jaccard_groups(documents(spark, list(enumerate(far + close))), boundary=-1).collect()
    assert {g["component_id"] for g in got} == {0}
    assert met[-1] < 40


def test_elements_of_long_sets_move_only_if_they_may_be_linked(spark, monkeypatch):
    r = random.Random(18)
    base = [f"w{i}" for i in range(3000)]

    def edited(n):
        copy = list(base)
        for k in r.sample(range(2, 2998, 5), n):
            copy[k] = f"x{r.random()}"
        return " ".join(copy)

    made, plain = [], ngram_join._linked
    monkeypatch.setattr(ngram_join, "_linked", lambda pairs, *a: made.append(pairs.count()) or plain(pairs, *a))
    docs = [(i, edited(130)) for i in range(6)] + [(6, edited(10)), (7, " ".join([*base[:1400], *(f"y{i}" for i in range(1600))]))]
    got = ngram_join.jaccard_groups(documents(spark, docs), boundary=-1).collect()
    assert by_row(map(tuple, got)) == by_row(brute_groups(docs))
    linked = sum(100 * len(a & b) >= 85 * len(a | b) for k, a in enumerate(brute_sets(docs)) for b in brute_sets(docs)[:k])
    assert sum(made) <= linked


def test_bits_apart_never_exceed_the_elements_apart():
    r = np.random.default_rng(19)
    for n, m, common in ((1500, 1400, 1300), (2100, 2000, 1900), (3000, 1200, 1200), (9000, 1100, 5), (1030, 900, 800)):
        both = np.unique(r.integers(-(2**63), 2**63 - 1, n + m - common))
        x, y = np.sort(both[r.permutation(len(both))[:n]]), both
        apart = ngram_join.bits_apart(ngram_join.fine_sketch(x), ngram_join.fine_sketch(y))
        assert apart <= len(y) - len(x) and apart % 2 == (len(y) - len(x)) % 2 or len(x) <= 1024
        assert apart == ngram_join.bits_apart(ngram_join.fine_sketch(y), ngram_join.fine_sketch(x))
