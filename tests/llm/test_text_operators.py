"""Quality rules, SimHash groups, line dedup, decontamination, mixing and the pipeline."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import decontamination, line_dedup, mixing, quality_rules, simhash_groups
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, key string, size string, kept string, _id string, words string"


def frame(spark, rows):
    """Rows (doc_id, text, source), with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, s, "k", None, "x", "y", "z") for i, t, s in rows], SCHEMA)


def odd_rows():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "naïve", "x\x85y", "a b", "😀", "#tag", "$5|6"]
    rows = []
    for i in range(60):
        words = r.choices(vocabulary, k=r.choice([0, 1, 2, 3, 49, 50, 51, 120, 300]))
        if i % 7 == 0:
            words = words[:12] * 9
        rows.append((i, " ".join(w + ("\n" if r.random() < 0.1 else "") for w in words), r.choice(["a", "b", None])))
    same = rows[13][1] * 2
    rows += [(100, None, "a"), (101, "", "b"), (102, " \n\t\r\x0b\x0c ", None), (103, same, "a"), (104, same, "b"), (105, same.upper(), "é")]
    rows += [(106, "line one\n" * 40, "a"), (107, " ".join(vocabulary * 40), "b")]
    return rows


def test_quality_equals_brute_force(spark):
    rows = odd_rows()
    got = quality_rules.quality_report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        want = brute.quality(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want, r["doc_id"]
    kept = quality_rules.keep_good(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in texts.items() if brute.quality(t)["kept"]}


def test_quality_does_not_depend_on_the_batch(monkeypatch):
    texts = [t or "" for _, t, _ in odd_rows()]
    whole = quality_rules.batch_kept(texts)
    assert whole == [quality_rules.batch_kept([t])[0] for t in texts]


def test_empty_tables(spark):
    none = frame(spark, [])
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert quality_rules.quality_report(none).count() == 0
    assert simhash_groups.simhash_groups(none).count() == 0
    assert line_dedup.delete_blocks(none).count() == 0
    assert decontamination.contamination(none, items).count() == 0
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    one = frame(spark, [(1, "some text", "a")])
    assert decontamination.contamination(one, items).first()["n_hit"] == 0


def near(fp, r, bits):
    for b in r.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def clustered(n, seed):
    r = random.Random(seed)
    fps = {r.getrandbits(64) for _ in range(n // 3)}
    for _ in range(3):
        fps |= {near(r.choice(sorted(fps)), r, r.randint(1, 4)) for _ in range(n // 3)}
    return sorted(fps)


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_trees_lose_no_link(shards):
    fps = clustered(900, shards)
    values = np.array(fps, np.uint64)
    nodes = simhash_groups.build_tree(values[::3], shards, 2)
    shard, at = simhash_groups.route(values, nodes, 2)
    assert len(nodes) >= min(1, shards - 1)
    assert set(at.tolist()) == set(range(len(fps)))
    where = [set() for _ in fps]
    for s, i in zip(shard.tolist(), at.tolist()):
        where[i].add(s)
    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= 2:
                assert where[i] & where[j]


@pytest.mark.parametrize("dense", [False, True])
def test_a_shard_equals_brute_force(dense, monkeypatch):
    monkeypatch.setattr(simhash_groups, "BUCKET_ROWS", 16)
    monkeypatch.setattr(simhash_groups, "_POINTS_AT_ONCE", 40)
    r = random.Random(5)
    fps = sorted({near(12345, r, r.randint(0, 6)) for _ in range(700)}) if dense else clustered(900, 1)
    for split in (True, False):
        if not split:
            monkeypatch.setattr(simhash_groups, "_split", lambda *_: None)
        a, b = simhash_groups.link_shard(np.array(fps, np.uint64), 2)
        place = {x: i for i, x in enumerate(fps)}
        label = simhash_groups.components(len(fps), np.array([place[x] for x in a.tolist()], int), np.array([place[x] for x in b.tolist()], int))
        assert label.tolist() == brute.groups(fps)


def test_simhash_equals_brute_force(spark):
    rows = odd_rows() + [(None, "no id here", "a"), (None, "NO id here", "b"), (0, odd_rows()[0][1], "a")]
    got = simhash_groups.simhash_groups(frame(spark, rows), sample=64, shard_rows=8).collect()
    want = brute.simhash_rows([(i, t) for i, t, _ in rows])
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    kept = simhash_groups.one_per_group(frame(spark, rows))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i, _, c in want if i is not None and i == c})
    assert ids.count(None) == 1 and kept.columns == frame(spark, rows).columns


def test_one_row_of_each_group_by_id_and_text(spark):
    r = random.Random(9)
    a, b, c = (" ".join(r.choices([f"q{i}" for i in range(500)], k=80)) for _ in range(3))
    rows = [(5, a, "s"), (5, b, "s"), (None, a, "s"), (None, a, "t"), (None, c, "s"), (None, c, "s"), (7, b, "s"), (9, None, "s"), (None, "", "s")]
    for order in (rows, rows[::-1]):
        kept = simhash_groups.one_per_group(frame(spark, order).repartition(2))
        assert sorted((x["doc_id"] or 0, x["text"] or "") for x in kept.collect()) == sorted([(5, a), (5, b), (0, c), (9, "")])
    assert simhash_groups.one_per_group(frame(spark, [])).count() == 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    r = random.Random(10)
    long = lambda: " ".join(r.choices([f"p{i}" for i in range(900)], k=120))
    a, b, c = long(), long(), long()
    rows = [(5, a, "s"), (5, b, "s"), (None, a, "s"), (None, c, None), (None, c, None), (8, None, "s"), (9, "", "s")]
    for k, docs in enumerate([rows, []]):
        folder = f"{tmp_path}/{k}"
        frame(spark, docs).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(None, " ".join(c.split()[:12]))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert {"key", "size", "_id", "words", "mix_size"} <= set(out.columns)
        got = [(x["doc_id"], x["text"].strip()) for x in out.collect()]
        assert {t for _, t in got} <= {a, b, " ".join(c.split()[12:])} and len(got) == len(set(got))
        assert bool(got) == bool(docs)


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1003)] + [(5000, i) for i in range(5001, 5400)]
    r = random.Random(1)
    r.shuffle(links)
    got = {x["node"]: x["root"] for x in simhash_groups.connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[1003] == 1000 and all(got[i] == 5000 for i in range(5001, 5400))


def passage(r, n, words=12):
    return [" ".join(f"p{r.randrange(10**6)}" for _ in range(words)) for _ in range(n)]


def line_rows():
    r = random.Random(9)
    shared, other = passage(r, 5), passage(r, 4, 20)
    head = "all rights reserved by the publisher of this page"
    docs = []
    for i in range(30):
        own = passage(r, 6)
        if i % 3 == 0:
            own[2:2] = shared
        if i % 4 == 0:
            own[5:5] = ["", *other[:2], " ", *other[2:]]
        docs.append((i, "\n".join([head, *own, head])))
    docs += [(40, docs[5][1]), (41, docs[5][1]), (42, "\n".join(shared)), (43, "\n".join(shared[::-1])), (44, None), (45, "")]
    docs += [(46, "\n".join([*shared[:2], "between", *shared[2:]])), (47, "\n".join(f"  {x}\t" for x in shared))]
    docs += [(48, "\n".join([shared[0]] * 4 + shared)), (49, "one long line " * 5000)]
    return docs


def test_line_dedup_equals_brute_force(spark):
    docs = line_rows()
    got = line_dedup.without_repeats(frame(spark, [(i, t, "s") for i, t in docs]))
    assert got.columns == frame(spark, []).columns
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    want = brute.line_dedup(docs)
    assert texts == {i: t for i, t in want.items() if t is not None or dict(docs)[i] is None}
    # The first copy stays, later ones go, heads and feet stay.
    assert texts[0] == docs[0][1] and 40 not in texts and 42 not in texts
    assert texts[1] == docs[1][1] and texts[3] != docs[3][1] and texts[3].count("rights") == 2


def test_line_dedup_of_equal_and_unnamed_rows(spark):
    text = "\n".join(passage(random.Random(2), 6))
    rows = [(1, text, "a"), (1, text, "b"), (2, text, "a"), (None, text, "a"), (1, "other text", "a")]
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.delete_blocks(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, text), (1, text), (2, ""), (None, ""), (1, "other text")], key=str)


def edited_lines(spark, docs):
    """doc_id -> lines left of documents that are given as lists of lines."""
    rows = [(i, "\n".join(lines), "s") for i, lines in docs.items()]
    return {r["doc_id"]: r["text"].split("\n") for r in line_dedup.delete_blocks(frame(spark, rows)).collect()}


def test_line_dedup_finds_the_whole_passage_behind_other_first_owners(spark):
    r = random.Random(12)
    one, two, three, four = passage(r, 2, 25) + passage(r, 2, 20)
    docs = {1: [one, "x"], 2: [two, "y"], **{i: [f"head {i}", one, two, f"foot {i}"] for i in range(3, 9)}}
    # The earlier document has another line inside the passage, and is the first owner of neither line.
    docs |= {11: [three], 12: [four], 13: [three, "between", four], 14: [three, four], 15: ["z", three, four]}
    want = docs | {i: [f"head {i}", f"foot {i}"] for i in range(4, 9)} | {14: [""], 15: ["z"]}
    assert edited_lines(spark, docs) == want


def test_line_dedup_of_passages_without_unique_lines_and_in_other_order(spark):
    p, q = passage(random.Random(13), 3), passage(random.Random(14), 4)
    twice = {1: ["h", *p, "m", *p, "t"], 2: ["a", *p, "b"], 3: [*p, *p, "c"]}
    assert edited_lines(spark, twice) == twice | {2: ["a", "b"], 3: ["c"]}
    once = {1: ["h", *p, "t"], 2: ["a", *p, *p, "b"]}
    assert edited_lines(spark, once) == once | {2: ["a", "b"]}
    swapped = {1: ["h", *q, *p, "t"], 2: ["a", *p, *q, "b"]}
    assert edited_lines(spark, swapped) == swapped | {2: ["a", "b"]}


def test_line_dedup_equals_a_look_at_every_earlier_document(spark):
    r = random.Random(15)
    pool = [" ".join(f"{chr(97 + k)}{n}" for n in range(r.choice([4, 7, 11, 16, 31]))) for k in range(26)]
    docs = {i: [r.choice(pool[: 9 if i % 3 else 26]) for _ in range(r.randrange(1, 14))] for i in range(90)}
    docs |= {i: [x for y in lines for x in (y, *[f"only {i}"] * (r.random() < 0.3))] for i, lines in docs.items() if i % 4 == 0}
    want = brute.line_dedup([(i, "\n".join(lines)) for i, lines in docs.items()])
    assert edited_lines(spark, docs) == {i: (t or "").split("\n") for i, t in want.items()}


def stretches_of(spark, docs):
    sequences = line_dedup.line_sequences(docs)
    lines = sequences.select("key", F.explode(F.array_distinct("lines")).alias("line"))
    return line_dedup._later_stretches(lines, sequences, 30)


def test_pairs_of_boilerplate_grow_with_the_documents(spark):
    r = random.Random(16)
    pool = passage(r, 150, 11)
    counts = []
    for n in (200, 400, 800):
        docs = frame(spark, [(i, "\n".join(r.sample(pool, 20)), "s") for i in range(n)])
        counts.append(line_dedup.owner_pairs(stretches_of(spark, docs), 30).count())
    assert counts[1] <= 2.2 * counts[0] and counts[2] <= 2.2 * counts[1] and counts[2] <= 20 * 800


def test_line_dedup_of_many_lines_with_as_many_first_owners(spark):
    n = 100_000
    text = F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), "id") for k in range(12)))
    single = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    long = single.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    docs = single.unionByName(long.selectExpr(f"{n}L AS doc_id", "text")).unionByName(long.selectExpr(f"{n + 1}L AS doc_id", "text"))
    pairs = line_dedup.owner_pairs(stretches_of(spark, docs), 30)
    assert pairs.agg(F.sum(F.size("lines"))).first()[0] <= 2 * 6 * n
    left = {x["doc_id"]: x["n"] for x in line_dedup.delete_blocks(docs).filter(f"doc_id >= {n}").selectExpr("doc_id", "length(text) AS n").collect()}
    assert left[n] > 0 and left[n + 1] == 0


def test_passages_hold_every_line_of_a_long_enough_run():
    assert line_dedup.passages([25, 25], 30) == [(0, 2)] and line_dedup.passages([30, 5], 30) == [(0, 1), (0, 2)]
    assert line_dedup.passages([29], 30) == line_dedup.passages([], 30) == []
    r = random.Random(8)
    for _ in range(200):
        words = [r.randrange(1, 15) for _ in range(r.randrange(12))]
        some = line_dedup.passages(words, 30)
        assert all(sum(words[i:j]) >= 30 for i, j in some)
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                if sum(words[a:b]) >= 30:
                    assert {k for i, j in some if a <= i and j <= b for k in range(i, j)} == set(range(a, b))


def test_patience_equals_brute_force():
    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.randrange(8) for _ in range(r.randrange(12))] for _ in range(2))
        assert line_dedup.patience(a, b) == sorted(brute.patience(a, b))


def contamination_rows():
    r = random.Random(6)
    words = [f"v{i}" for i in range(12)] + ["Élan", "x9"]
    items = [(i, " ".join(r.choices(words, k=r.choice([1, 3, 9, 10, 11, 25])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "..."), (93, items[3][1]), (None, "v1 v2"), (None, " ".join(words[:11]))]
    docs = []
    for i in range(40):
        text = r.choices([*words, "out", "side"], k=r.randrange(60))
        if i % 2:
            text[len(text) // 2 : 0] = r.choice(items)[1].upper().split() if (t := r.choice(items)[1]) and t else []
        docs.append((i, r.choice(["-", " ", "_,"]).join(text), "s"))
    docs += [(50, None, "s"), (51, "", "s"), (52, items[5][1], "s"), (53, " ".join(words * 800), "s"), (1, docs[1][1], "s"), (54, " ".join(["out", *words[:11], "side"]), "s")]
    return docs, items


@pytest.mark.parametrize("block_bytes, shard_words", [(10**6, 10**6), (150, 40)])
def test_contamination_equals_brute_force(spark, block_bytes, shard_words):
    docs, items = contamination_rows()
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contamination(frame(spark, docs), table, block_bytes=block_bytes, shard_words=shard_words).collect()
    assert len(got) == len(docs)
    texts = {i: t for i, t, _ in docs}
    for r in got:
        n, hit, found = brute.contamination(texts[r["doc_id"]], items)
        places = {k for a, b in r["spans"] for k in range(a, b)}
        assert (r["n_words"], r["n_hit"], places, r["contaminated"]) == (n, len(hit), hit, bool(hit)), r["doc_id"]
        assert (r["n_items"], r["items"]) == (len(found), sorted(found - {None}))
    cut = decontamination.without_benchmark(frame(spark, docs), table, block_bytes=block_bytes, shard_words=shard_words)
    assert cut.columns == frame(spark, docs).columns
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    for i, t in texts.items():
        n, hit, _ = brute.contamination(t, items)
        assert (i in left) == (not hit or len(hit) < n)
        if i in left:
            assert left[i] == (brute.cut(t, hit) if hit else t)


def test_one_block_of_items_is_held_at_a_time(spark, monkeypatch):
    """Items of fifty blocks: a block is fetched when its predecessor's hits are written."""
    r = random.Random(8)
    items = [(i, " ".join(f"b{i}x{r.randrange(40)}" for _ in range(12))) for i in range(50)]
    docs = [(i, f"head {items[i % 50][1]} foot" if i % 3 else "nothing here", "s") for i in range(120)]
    size, events = 16 + min(len(t) for _, t in items), []
    plain, write = decontamination.in_blocks, decontamination.write_through

    def fetched(*a):
        for block in plain(*a):
            events.append(len(block))
            yield block

    monkeypatch.setattr(decontamination, "in_blocks", fetched)
    monkeypatch.setattr(decontamination, "write_through", lambda df, name: events.append(name) or write(df, name))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contamination(frame(spark, docs), table, block_bytes=12 * size).collect()
    sizes = [e for e in events if e != "block-hits" and e != "merged-hits"]
    assert sum(sizes) == 50 and max(sizes) <= 13 and events.count("block-hits") == len(sizes) > 3
    # The second is looked for to see whether there is one; from then on one at a time.
    assert events[2:-1] == ["block-hits", "block-hits", *(x for n in sizes[2:] for x in (n, "block-hits"))]
    for g in got:
        assert (g["n_hit"], g["items"]) == ((12, [str(g["doc_id"] % 50)]) if g["doc_id"] % 3 else (0, []))


def test_fm_index_counts_and_places():
    r = np.random.default_rng(1)
    text = r.integers(1, 5, 400)
    index = decontamination.FmIndex(text, 6)
    for n in (1, 2, 5):
        windows = np.unique(r.integers(1, 6, (60, n)), axis=0)
        found, low, high = index.search(windows)
        for k, w in enumerate(windows):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == w).all()]
            at = np.nonzero(found == k)[0]
            got = sorted(index.locate(np.arange(low[at[0]], high[at[0]])).tolist()) if len(at) else []
            assert got == want


def test_mix_equals_brute_force(spark):
    rows = [(i, t, s) for i, t, s in odd_rows()]
    rows += [(200 + i, "word " * (i * 7 % 50), f"s{i % 5}") for i in range(60)]
    got = {r["doc_id"]: (r["size"], r["source_size"], pytest.approx(r["target"]), r["taken"]) for r in mixing.mix(frame(spark, rows)).collect()}
    assert got == brute.mix(rows)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(frame(spark, rows[::-1]).repartition(3)).collect()}
    assert again == {i: x[3] for i, x in got.items()}


def test_mix_comes_near_its_targets(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.choice([1, 40, 900]), r.choice("aaaabc")) for i in range(300)]
    rows += [(900, "w " * 60_000, "d"), (901, "w " * 500, "e"), (902, "w " * 40_000, None)]
    docs = frame(spark, rows)
    for options in ({}, {"budget": 20_000}, {"budget": 300_000, "epochs": 2}):
        mixed = mixing.mix(docs, **options).collect()
        for source in {x["source"] for x in mixed}:
            own = [x for x in mixed if x["source"] == source]
            assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= max(8, 0.01 * own[0]["target"]), (options, source)
            # Each of its documents is taken whole, but for one.
            assert sum(x["taken"] != x["size"] * x["copies"] for x in own) <= 1
        assert all((x["copies"] - 1) * x["size"] < x["taken"] <= x["copies"] * x["size"] for x in mixed if x["copies"])
    assert sum(x["taken"] for x in mixing.mix(docs, budget=0).collect()) == 0


def test_mix_of_equal_rows_and_no_words(spark):
    rows = [(1, "a b c", "x")] * 5 + [(None, "d e", None)] * 3 + [(2, None, "y"), (3, "", "y")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r["taken"] for r in got) <= 21
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert all(r["taken"] == 0 for r in mixing.mix(frame(spark, [(1, None, "x")])).collect())


def test_pipeline_equals_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    got = {r["doc_id"]: (r["text"], r["mix_size"], r["mix_taken"]) for r in corpus_pipeline.run(spark, SF).collect()}
    want = brute.pipeline(docs, items)
    assert got == want and len(got) > 50


def test_stages_keep_columns_and_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.filter("n_chars <> length(text)").isEmpty(), name
