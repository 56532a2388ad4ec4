"""Token rollups, web archives, secret scans, toxicity and quotation linking."""

import gzip
import hashlib
import io
import random
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import quote_threads, secret_scan, token_rollup, toxicity, zip_archives
from newsloom.llm.secret_queries import op6_ownership_frequency
from newsloom.llm.token_queries import op2_token_rollup
from newsloom.llm.toxicity_queries import held_out, op8_counterfactual_toxicity
from newsloom.sources.workspace import new_path
from tests.llm.brute import PHRASE, WORD

SF = "/root/testdata/sf0.001"

# -- token counts -------------------------------------------------------------


def counted(spark, rows, versions=("words-1", "letters-1", "byte_bpe_50k")):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, tokenizer string, key int")
    return token_rollup.count_tokens(docs, list(versions))


def doc(i, text, source="s", lang="en"):
    return (i, text, source, lang, "x", 1)


def test_counts_of_odd_texts(spark):
    import base64

    import tiktoken

    with open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    encoding = tiktoken.Encoding("own", pat_str=token_rollup.CUT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " \n", "a b-c", "Ünïcode 😀 x\x85y", "<|endoftext|>", "long " * 30000, "x" * 5000]
    got = {(r["key"]["id"], r["tokenizer"]): r["n_tokens"] for r in counted(spark, [doc(i, t) for i, t in enumerate(texts)]).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        assert got[i, "words-1"] == len(WORD.findall(t))
        assert got[i, "letters-1"] == len(PHRASE.findall(t))
        assert got[i, "byte_bpe_50k"] == len(encoding.encode_ordinary(t))


def test_rollup_keeps_signed_totals(spark):
    one = counted(spark, [doc(1, "a b c"), doc(2, "d", "t"), doc(3, "e f", None, None)], ["words-1"])
    rollup = token_rollup.Rollup(spark, new_path(spark, "test-rollup"))

    def totals():
        return {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}

    rollup.commit("1", token_rollup.inserted(one))
    first = totals()
    assert first == {("s", "en"): (1, 3), ("t", "en"): (1, 1), (None, None): (1, 2)}
    rollup.commit("1", token_rollup.inserted(one))
    assert totals() == first
    rollup.commit("2", token_rollup.deleted(one.filter("key.id = 2")))
    rollup.commit("3", token_rollup.revised(one.filter("key.id = 1"), counted(spark, [doc(1, "a b c d e")], ["words-1"])))
    assert totals() == {("s", "en"): (1, 5), (None, None): (1, 2)}
    # A second try of a batch with other content replaces it.
    rollup.commit("3", token_rollup.revised(one.filter("key.id = 1"), counted(spark, [doc(1, "")], ["words-1"])))
    assert totals() == {("s", "en"): (1, 0), (None, None): (1, 2)}
    rollup.commit("4", token_rollup.inserted(one.limit(0)))
    assert totals()["s", "en"] == (1, 0)
    with pytest.raises(ValueError):
        rollup.commit("../x", token_rollup.inserted(one))


def test_a_failed_try_of_a_batch_leaves_the_one_before(spark):
    one = counted(spark, [doc(1, "a b c"), doc(2, "d", "t")], ["words-1"])
    folder = new_path(spark, "test-rollup")
    rollup = token_rollup.Rollup(spark, folder)
    assert rollup.totals().count() == 0
    rollup.commit("1", token_rollup.inserted(one))
    reader = token_rollup.Rollup(spark, folder)
    open_, want = reader.totals(), sorted(reader.totals().collect())
    failing = token_rollup.inserted(one).withColumn("docs", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        rollup.commit("1", failing)
    assert sorted(reader.totals().collect()) == want
    rollup.commit("1", token_rollup.deleted(one))
    # Totals that were opened before the retry still read the try they found.
    assert sorted(open_.collect()) == want and sorted(tuple(x)[3:] for x in reader.totals().collect()) == [(-1, -3), (-1, -1)]


def test_folded_batches_keep_the_totals(spark):
    one = counted(spark, [doc(1, "a b c"), doc(2, "d", "t"), doc(3, "e", None, None)], ["words-1"])
    rollup = token_rollup.Rollup(spark, new_path(spark, "test-rollup"))
    rollup.fold()
    assert rollup.totals().count() == 0
    rollup.commit("1", token_rollup.inserted(one))
    rollup.commit("2", token_rollup.deleted(one.filter("key.id = 2")))
    want = sorted(map(str, rollup.totals().collect()))
    for _ in range(2):
        rollup.fold()
        assert sorted(map(str, rollup.totals().collect())) == want
        with pytest.raises(ValueError):
            rollup.commit("1", token_rollup.inserted(one))
    rollup.commit("3", token_rollup.inserted(one.filter("key.id = 2")))
    rollup.commit("3", token_rollup.inserted(one.filter("key.id = 2")))
    rollup.fold()
    assert {(r["source"], r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()} == {("s", 1, 3), ("t", 1, 1), (None, 1, 1)}


def test_op2_equals_brute_force(spark):
    want = defaultdict(lambda: [0, 0])
    seen = set()
    for text, source, lang in duckdb.sql(f"SELECT text, source, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall():
        if text not in seen:
            seen.add(text)
            for version in ("letters-1", "byte_bpe_50k"):
                want[source, lang, version][0] += 1
                want[source, lang, version][1] += token_rollup.counter(version)(text or "")
    got = {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"]] for r in op2_token_rollup(spark, SF).collect()}
    assert got == dict(want)


# -- archives -----------------------------------------------------------------

PAGES = "page_id bigint, url string, html string, digest string, path string, refers_to string"


def page(i, html, url="http://a.example/x"):
    return (i, url, html, "d", "p", "r")


def test_archives_round_trip(spark):
    r = random.Random(1)
    htmls = [None, "", "x", "<p>é😀</p>", "a\r\n\r\nb", "same", "same", "same", "WARC/1.1\r\n\r\n" * 50, "long " * 400_000]
    rows = [page(i, h, r.choice([None, "", "http://b.example/a b\r\nX: y", "http://c.example/é"])) for i, h in enumerate(htmls)]
    rows += [page(7, "same"), page(None, "same"), page(None, "nobody else"), page(None, "nobody else")]
    frame = spark.createDataFrame(rows, PAGES)
    got = [tuple(x[k] for k in ("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")) + (x["payload"],)
           for x in zip_archives.round_trip(frame, with_payload=True, package_bytes=2000).collect()]
    want = []
    for i, _, h, *_ in rows:
        data = (h or "").encode()
        ids = [j for j, _, x, *_ in rows if (x or "") == (h or "") and j is not None]
        first = max(ids, default=None)
        revisit = i != first
        want.append((i, "revisit" if revisit else "response", first if revisit else None, len(data), zip_archives.payload_digest(data), None if revisit else data))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_small_payloads_may_be_left_alone(spark):
    frame = spark.createDataFrame([page(1, "ab"), page(2, "ab"), page(3, "abcdef"), page(4, "abcdef")], PAGES)
    got = {r["page_id"]: r["record_type"] for r in zip_archives.round_trip(frame, revisit_from=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert zip_archives.round_trip(frame.limit(0)).count() == 0


def package(names_and_data, limit=None, comment=b"", method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    old = zipfile.ZIP64_LIMIT, zipfile.ZIP_FILECOUNT_LIMIT
    zipfile.ZIP64_LIMIT, zipfile.ZIP_FILECOUNT_LIMIT = (limit or old[0]), (limit or old[1])
    try:
        with zipfile.ZipFile(out, "w", method) as z:
            for name, data in names_and_data:
                with z.open(name, "w", force_zip64=bool(limit)) as member:
                    member.write(data)
            z.comment = comment
    finally:
        zipfile.ZIP64_LIMIT, zipfile.ZIP_FILECOUNT_LIMIT = old
    return out.getvalue()


def opened(data):
    return pa.PythonFile(io.BytesIO(data), "r")


@pytest.mark.parametrize("limit", [None, 1])
@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 in a comment" * 20])
def test_directory_equals_zipfile(limit, comment):
    content = [(f"f{i}.txt", bytes([i]) * i * 100) for i in range(20)] + [("ordner/ü.warc", b"x")]
    data = package(content, limit, comment)
    assert (zip_archives.LOCATOR_64 in data) == bool(limit)
    got = {m["name"]: data[m["data"] : m["data"] + m["packed"]] for m in zip_archives.members(opened(data))}
    assert got == dict(content)


def test_directory_with_zip64_offsets_and_sizes():
    # An entry whose sizes and offset stand in the ZIP64 field only.
    local = struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 3, 3, 5, 4) + b"a.txt" + b"\0\0\0\0" + b"abc"
    extra = struct.pack("<HHQQQ", 1, 24, 3, 3, 0)
    entry = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, *[2**32 - 1] * 2, 5, len(extra), 0, 0, 0, 0, 2**32 - 1) + b"a.txt" + extra
    end64 = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(entry), 1)
    end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 2**16 - 1, 2**16 - 1, 2**32 - 1, 2**32 - 1, 0)
    data = local + entry + end64 + locator + end
    (m,) = zip_archives.members(opened(data))
    assert (m["name"], m["size"], data[m["data"] : m["data"] + m["size"]]) == ("a.txt", 3, b"abc")


def test_broken_packages_are_errors():
    for data in (b"", b"no package at all", package([("a", b"x" * 100)])[:-30]):
        with pytest.raises(ValueError):
            list(zip_archives.members(opened(data)))


def test_archives_without_index_and_other_members():
    records = [zip_archives._record(i, f"http://x/{i}", b"p" * i * 1000, "D", None) for i in range(5)]
    plain, packed = b"".join(records), b"".join(gzip.compress(r) for r in records)
    data = package([("a.warc", plain), ("notes.txt", b"hello"), ("b.warc.gz", packed), ("empty.warc", b"")])
    ranges = list(zip_archives.record_ranges(opened(data)))
    assert len(ranges) == 10
    for start, n, zipped in ranges:
        raw = data[start : start + n]
        record = zip_archives.parse_record(gzip.decompress(raw) if zipped else raw)
        assert len(record["payload"]) == 1000 * record["page_id"]
    assert not list(zip_archives.record_ranges(opened(package([("a.warc", plain)], method=zipfile.ZIP_DEFLATED))))


# -- secrets --------------------------------------------------------------------


def brute_spans(text):
    forms = {
        "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24), "owned": (r"[A-Za-z0-9+/_=-]+", 0, 20),
    }
    for n, (kind, (pattern, group, least)) in enumerate(forms.items()):
        for m in re.finditer(pattern, text):
            v = m[group]
            if len(v) >= least and (kind != "owned" or all(re.search(c, v) for c in ("[0-9]", "[a-z]", "[A-Z]"))):
                yield m.start(), n, m.end(), kind, v


def secret_rows():
    r = random.Random(8)

    def some(letters, n):
        return "".join(r.choices(letters, k=n))

    hexes, mixed = [some("0123456789abcdef", 40) for _ in range(5)], [some("abcXYZ0189_-", 30) for _ in range(5)]
    parts = ["token=abc", "TOKEN: x1", "password = 'hunter22'", 'api_key":"a.b/c=d', "secret==abcdef", "token=token:abcdefgh",
             "passwd=" + "é", "AKIA" + "A" * 16, "AKIA" + "Z" * 15, "AKIAAKIA" + "B" * 12, "deadbeef" * 3, "deadbeef" * 2, "é😀", "\n", "apikey=abcdef"]
    rows = [(i, " ".join(r.choices(parts + hexes + mixed, k=r.randrange(12))), r.choice("abc"), r.choice(["en", None])) for i in range(60)]
    rows += [(70, None, "a", "en"), (71, "", None, None), (72, "😀 " * 3000 + hexes[0], "a", "en"), (73, mixed[0] + "q", "zz", "de"),
             (74, "deadbeef" * 4000, "a", "en"), (75, "token=" + mixed[1], None, None), (73, mixed[0] + "q", "zz", "de"), (None, hexes[1], "a", "en")]
    return rows


def test_secrets_equal_brute_force(spark, tmp_path):
    rows = secret_rows()
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    owners, repositories = defaultdict(set), defaultdict(set)
    for _, text, source, lang in rows:
        for *_, value in brute_spans(text or ""):
            owners[value].add(source or "")
            repositories[value].add("/".join(x for x in (source, lang) if x is not None))
    want = []
    for i, text, *_ in rows:
        spans = [(s, n, e, k, len(owners[v]) <= 1 and len(repositories[v]) <= 3) for s, n, e, k, v in sorted(brute_spans(text or ""))]
        spans = [x for x in spans if x[1] < 3 or x[4]]
        base = ",".join(f"{k}:{s}:{e}" for s, n, e, k, _ in spans if n < 3)
        counts = Counter(x[3] for x in spans)
        want.append((i, counts["assign"], counts["access"], counts["hex"], sum(x[4] for x in spans),
                     hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, n, e, k, _ in spans)))
    got = [tuple(r) for r in op6_ownership_frequency(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any("owned" in w[6] for w in want) and any(w[3] and not w[4] for w in want)


def test_secrets_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert secret_scan.scan_secrets(none, F.col("source"), F.col("source")).count() == 0


# -- toxicity --------------------------------------------------------------------


def sentences(n, seed, biased):
    r = random.Random(seed)
    plain, bad = [f"w{i}" for i in range(60)], ["vile", "nasty", "rotten"]
    rows = []
    for _ in range(n):
        y = int(r.random() < 0.3)
        words = r.choices(plain, k=12) + (r.choices(bad, k=2) if y and r.random() < 0.8 else [])
        # In the labelled texts one group is named mostly in toxic ones.
        if r.random() < 0.5:
            words.append("muslim" if (y if biased else r.random() < 0.5) and r.random() < 0.9 else "christian")
        rows.append((" ".join(words), y))
    return rows


def test_swapped_groups_get_like_scores():
    rows = [toxicity.example(t, y) for t, y in sentences(1500, 1, True)]
    neutral = toxicity.features("the muslim neighbours came by with w1 and w2")
    (swapped, *_) = [s for s in toxicity.swaps(neutral) if "christian" in s]

    def gap(strength):
        w, b = toxicity.fit(rows, counterfactual=strength)
        return abs(toxicity.score(neutral, w, b) - toxicity.score(swapped, w, b)), toxicity.score(neutral, w, b), w, b

    free, without, *_ = gap(0.0)
    held, score, w, b = gap(50.0)
    assert free > 0.2 and held < 0.05 and score < without
    test = [(toxicity.features(t), y) for t, y in sentences(800, 2, False)]
    named_neutral = [f for f, y in test if not y and "muslim" in f]
    assert sum(toxicity.score(f, w, b) >= 0.7 for f in named_neutral) <= 0.02 * len(named_neutral)
    found = [f for f, y in test if y and f & {"vile", "nasty", "rotten"}]
    assert sum(toxicity.score(f, w, b) >= 0.7 for f in found) >= 0.9 * len(found)


def test_fit_on_few_rows():
    assert toxicity.fit([]) == ({}, 0.0)
    assert toxicity.fit([({"a"}, 1, [])] * 3)[0] == {}
    w, b = toxicity.fit([(set(), 0, []), (set(), 1, [])])
    assert 0 < toxicity.score(set(), w, b) < 1


def test_held_out_accuracy_and_split(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op8_counterfactual_toxicity(spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    test = [(rows[i]["score"], y) for i, y in labels.items() if i in rows and rows[i]["held_out"]]
    pos, neg = [s for s, y in test if y], [s for s, y in test if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert auc > 0.9 and sum(q >= 0.7 for q in neg) <= 0.02 * len(neg)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(i, "vile" if i % 2 else "fine") for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(60)] + [(3, None, 0), (None, 1, 1), (4, 7, 1)], "doc_id bigint, toxic int, quality int")
    sample = toxicity.training_sample(docs, labels, ~held_out(F.col("doc_id")))
    rows = toxicity.training_rows(sample, toxicity.telling_features(sample))
    assert all(words == {("vile" if y else "fine")} for words, y, _ in rows)
    assert len(rows) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60))
    assert toxicity.training_sample(docs, labels, F.lit(True), limit=7).count() == 7
    assert toxicity.train(docs, labels.limit(0), F.lit(True)) == ({}, 0.0)
    empty = toxicity.score_toxicity(spark.createDataFrame([(1, None), (None, "")], "doc_id bigint, text string"), {}, 0.0).collect()
    assert [r["score"] for r in empty] == [0.5, 0.5]


# -- quotes -----------------------------------------------------------------------

CHAT = [
    (1, 0, "user", "Hello all.\n\nFirst point is here.\nSecond point."),
    (1, 1, "user", "Alice wrote:\n> First point  is HERE.\n\nI agree with it."),
    (1, 2, "user", "Unrelated new topic"),
    (1, 3, "user", "On Monday Bob wrote:\n> > First point is here.\n> I agree with it.\nMe too.\n> unknown words\nend"),
    (1, 4, "user", ">Unrelated new topic\nreply to it"),
    (1, 5, "user", "> Me too.\n> end\nlast"),
    (2, 0, "user", "Second point."),
    (2, 1, "assistant", "> First point is here.\nother conversation"),
    (2, 2, "assistant", "a > b is no quote\n  > Second point.\n"),
    (2, 3, "user", "> words that come later"),
    (2, 4, "user", "words that come later"),
    (3, 0, "user", None), (3, 1, None, ""), (None, 0, "user", "x"), (None, 1, "user", "> x\ny"), (4, None, "user", "> x"), (4, 1, "user", "z"),
    (5, 0, "user", "twice"), (5, 0, "user", "twice"), (5, 1, "user", "> twice\nreply"),
]


def test_quotes_are_linked_and_cut(spark):
    frame = spark.createDataFrame([(*r, "x", 1) for r in CHAT], "conv_id bigint, turn bigint, role string, text string, root string, rank int")
    got = quote_threads.chat_messages(frame).collect()
    assert len(got) == len(CHAT)
    of = {(r["conv_id"], r["turn"]): r for r in got}
    parents = {k: r["parent"] for k, r in of.items() if r["parent"] is not None}
    assert parents == {(1, 1): 0, (1, 3): 1, (1, 4): 2, (1, 5): 3, (2, 2): 0, (5, 1): 0}
    assert of[1, 5]["root"] == 0 and of[1, 5]["depth"] == 3 and of[1, 4]["root"] == 2
    assert of[1, 1]["text"] == "I agree with it." and of[1, 3]["text"] == "Me too.\nend"
    assert of[2, 2]["text"] == "a > b is no quote" and of[1, 0]["text"] == CHAT[0][3]
    order = sorted((r["position"], r["turn"]) for r in got if r["conv_id"] == 1)
    assert [t for _, t in order] == [0, 1, 3, 5, 2, 4] and [p for p, _ in order] == [1, 2, 3, 4, 5, 6]
    assert sorted(r["position"] for r in got if r["conv_id"] == 5) == [1, 2, 3]
    assert not any(re.search(r"^\s*>", r["text"], re.M) for r in got)
    assert quote_threads.chat_messages(frame.limit(0)).count() == 0


def test_threads_equal_brute_force(spark):
    r = random.Random(7)
    rows, parent = [], {}
    for c in range(4):
        said = {}
        for t in range(60):
            said[t] = f"message {c} {t} {r.random()}"
            text = said[t]
            if t and r.random() < 0.7:
                parent[c, t] = r.randrange(max(0, t - 5), t)
                text = f"> {said[parent[c, t]]}\n{text}"
            rows.append((c, t, "user", text))
    got = {(x["conv_id"], x["turn"]): x for x in quote_threads.chat_messages(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}

    def up(c, t):
        return [t] if (c, t) not in parent else [t, *up(c, parent[c, t])]

    for c in range(4):
        order = sorted(range(60), key=lambda t: (up(c, t)[-1], t))
        for p, t in enumerate(order, 1):
            x = got[c, t]
            assert (x["parent"], x["root"], x["depth"], x["position"]) == (parent.get((c, t)), up(c, t)[-1], len(up(c, t)) - 1, p)
