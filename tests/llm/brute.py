"""Plain, slow versions of the corpus operators, one document or pair at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))

    def windows(n):
        return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]

    def covered(n, starts):
        return {k for i in starts for k in range(i, i + n)}

    counts = Counter(windows(3))
    repeat = covered(3, [i for i, w in enumerate(windows(3)) if counts[w] > 1])
    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    base_failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    bad = 100 * sum(len(w) for x in again for w in WORD.findall(x)) > 30 * chars
    for n, percent in {5: 25, 6: 24, 7: 23, 8: 22, 9: 21, 10: 20}.items():
        seen, later = set(), []
        for i, w in enumerate(windows(n)):
            if w in seen:
                later.append(i)
            seen.add(w)
        bad = bad or 100 * sum(len(words[k]) for k in covered(n, later)) > percent * chars
    return {
        "n_words": len(words), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(again), "n_repeat_words": len(repeat), "base_failed": base_failed, "kept": not base_failed and not bad,
    }


def simhash(text, n=3):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, bits=2):
    """Component number of each fingerprint: the place of its first one."""
    label = list(range(len(fps)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= bits:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(len(fps))]


def simhash_rows(docs):
    """(doc_id, fingerprint, component_id) of (doc_id, text) rows."""
    fps = [simhash(t) for _, t in docs]
    comps = groups(fps)
    low = {}
    for (i, _), c in zip(docs, comps):
        if i is not None:
            low[c] = min(i, low.get(c, i))
    return [(i, f"{f:016x}", low.get(c)) for (i, _), f, c in zip(docs, fps, comps)]


def patience(a, b, a0=0, b0=0):
    out = []
    while a and b and a[0] == b[0]:
        out.append((a0, b0))
        a, b, a0, b0 = a[1:], b[1:], a0 + 1, b0 + 1
    tail = []
    while a and b and a[-1] == b[-1]:
        tail.append((a0 + len(a) - 1, b0 + len(b) - 1))
        a, b = a[:-1], b[:-1]
    common = [x for x in a if a.count(x) == 1 and b.count(x) == 1]
    best = []  # longest increasing run, by trying all ends; of equal ones that with the lowest end

    def rank(r):
        return len(r), -b.index(r[-1])

    for x in common:
        before = [r for r in best if b.index(r[-1]) < b.index(x)]
        best.append(max(before, key=rank, default=[]) + [x])
    run = max(best, key=rank, default=[])
    if run:
        la = lb = 0
        for x in [*run, None]:
            ia, ib = (a.index(x), b.index(x)) if x is not None else (len(a), len(b))
            out += patience(a[la:ia], b[lb:ib], a0 + la, b0 + lb)
            if x is not None:
                out.append((a0 + ia, b0 + ib))
            la, lb = ia + 1, ib + 1
    return out + tail


def in_order(lines, other):
    rest = iter(other)
    return all(x in rest for x in lines)


def follow(lines, other):
    return any(other[k : k + len(lines)] == lines for k in range(len(other) - len(lines) + 1))


def repeated_lines(i, docs, first, shared, min_words):
    """Places of the lines of document ``i`` in ``docs`` (id -> lines) that earlier ones have."""
    own, gone = docs[i], set()
    size = [len(WORD.findall(x)) for x in own]
    passages = []
    for a in range(len(own)):
        b = a
        while b < len(own) and first[own[b]] < i:
            b += 1
            if sum(size[a:b]) >= min_words:
                if min(sum(size[a + 1 : b]), sum(size[a : b - 1])) < min_words:
                    passages.append((a, b))
                elif sum(size[a + 1 : b]) >= min_words and sum(size[a : b - 1]) >= min_words:
                    break
    for f in {first[x] for x in own} - {i}:
        windows = []
        for a, b in passages:
            if any(first[x] == f for x in own[a:b]):
                if windows and a < windows[-1][1]:
                    windows[-1][1] = max(windows[-1][1], b)
                else:
                    windows.append([a, b])
        for a, b in passages:
            if any(x <= a and b <= y for x, y in windows) and in_order(own[a:b], docs[f]):
                gone.update(range(a, b))
    for e in docs:
        if e < i:
            other = [x for x in docs[e] if x in shared]
            for a, b in passages:
                if not gone.issuperset(range(a, b)) and own[a] in other and follow(own[a:b], other):
                    gone.update(range(a, b))
    return gone


def line_dedup(docs, min_words=30):
    """New text, or None where nothing is left, of (doc_id, text) rows with distinct ids."""
    real = {i: [(n, x.strip(SPACE)) for n, x in enumerate((t or "").split("\n")) if x.strip(SPACE)] for i, t in docs}
    lines = {i: [x for _, x in real[i]] for i in sorted(real)}
    first = {}
    for i in lines:
        for x in lines[i]:
            first.setdefault(x, i)
    shared = {x for x, n in Counter(x for ls in lines.values() for x in set(ls)).items() if n > 1}
    out = {}
    for i, text in docs:
        gone = set()
        inside = repeated_lines(i, lines, first, shared, min_words)
        for k in inside:
            gone.update(range(real[i][k][0], real[i][k + 1][0] if k + 1 in inside else real[i][k][0] + 1))
        new = "\n".join(x for n, x in enumerate((text or "").split("\n")) if n not in gone) if gone else text
        out[i] = None if gone and not WORD.search(new) else new
    return out


PHRASE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items, window=10):
    """n_words, hit word places and item ids (null for all items without one)."""
    words = PHRASE.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item_id, item in items:
        ws = PHRASE.findall((item or "").translate(LOWER))
        n = min(window, len(ws))
        wanted = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in wanted:
                hit.update(range(i, i + n))
                found.add(None if item_id is None else str(item_id))
    return len(words), hit, found


def cut(text, hit):
    spans = [m.span() for m in PHRASE.finditer(text.translate(LOWER))]
    out, last = "", 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out += text[last : spans[k][0]]
        last = spans[k][1]
    return out + text[last:]


def mix(docs, seed="mix-1", epochs=3):
    """size, source_size, target and taken of (doc_id, text, source) rows with distinct ids."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in docs}
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    weight = {s: 1.0 + k % 3 for k, s in enumerate(sources)}
    total = {s: sum(size[i] for i, _, x in docs if x == s) for s in sources}
    budget, full, target = sum(size.values()), set(), {}
    while True:
        rest = [s for s in sources if s not in full]
        left = budget - sum(epochs * total[s] for s in full)
        target = {s: epochs * total[s] if s in full else left * weight[s] / sum(weight[x] for x in rest) for s in sources}
        over = {s for s in rest if target[s] > epochs * total[s]}
        if not over:
            break
        full |= over
    offers, quantum = [], max(1, budget // (1000 * max(1, len(sources))))
    for k, s in enumerate(sources):
        order = sorted((i for i, _, x in docs if x == s), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
        at = 0
        for e in range(epochs):
            for i in order:
                for start in range(0, size[i], quantum):
                    words = min(quantum, size[i] - start)
                    at += words
                    offers.append((at / weight[s], k, i, words))
    taken, used = Counter(), 0
    for _, _, i, words in sorted(offers):
        used += words
        if used > budget:
            break
        taken[i] += words
    return {i: (size[i], total[s], target[s], taken[i]) for i, _, s in docs}


def pipeline(docs, items):
    """doc_id -> (text, size, taken) of (doc_id, text, source) rows with distinct ids."""
    docs = [d for d in docs if quality(d[1])["kept"]]
    source = {i: s for i, _, s in docs}
    new = line_dedup([(i, t) for i, t, _ in docs])
    rows = [(i, new[i]) for i, _, _ in docs if new[i] is not None or source[i] is None]
    rows = [(i, t) for (i, t), (_, _, c) in zip(rows, simhash_rows(rows)) if i == c]
    left = []
    for i, t in rows:
        n, hit, _ = contamination(t, items)
        if not hit or len(hit) < n:
            left.append((i, cut(t, hit) if hit else t, source[i]))
    mixed = mix(left)
    return {i: (t, mixed[i][0], mixed[i][3]) for i, t, _ in left if mixed[i][3]}
