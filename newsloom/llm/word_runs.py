"""Periodic runs of words by recompression.

The words of a slice of documents are compressed in rounds: maximal blocks of one
symbol become a symbol, then adjacent pairs whose symbols fall into the left and
the right half of the alphabet. Since a symbol depends on what it spells and on its
neighbours only, two equal stretches have equal symbols but for their ends, so the
common extension of two places is found by going up the rounds and down again. A run
of period q contains two neighbours of the grid 0, q, 2q, ...; such a pair that has
equal words is extended exactly in both directions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import in_slices, map_rows, words_of

# A run has so many words at least, and two periods.
MIN_RUN_WORDS = 12
# Words whose grammar is held at once; one longer text is held alone.
WORDS_AT_ONCE = 200_000
# Grid pairs looked at, and extended, at once.
_PAIRS_AT_ONCE = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
COLUMNS = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


class Grammar:
    """Rounds of block and pair compression of a sequence that ends with a symbol of its own."""

    def __init__(self, symbols: np.ndarray):
        # Per round: its symbols, the place of each one in the next round, the places where
        # a symbol of the next round starts, and whether the next round is one of blocks.
        self.rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []
        fresh, blocks, salt = int(symbols.max()) + 1, True, 0
        while len(symbols) > 1:
            if blocks:
                starts_here = np.concatenate([[True], symbols[1:] != symbols[:-1]])
            else:
                salt += 1
                left = _mixed(symbols.astype(np.uint64) + np.uint64(salt << 40)) >> np.uint64(63) == 1
                left = left if (left[:-1] & ~left[1:]).sum() >= (~left[:-1] & left[1:]).sum() else ~left
                starts_here = np.concatenate([[True], ~(left[:-1] & ~left[1:])])
            starts = np.flatnonzero(starts_here)
            if len(starts) < len(symbols):
                size = np.diff(np.append(starts, len(symbols)))
                new, long = symbols[starts].copy(), size > 1
                second = size[long] if blocks else symbols[starts[long] + 1]
                names = np.unique(new[long] * (int(second.max()) + 1) + second, return_inverse=True)[1]
                new[long] = fresh + names
                fresh += len(names)
                self.rounds.append((symbols, np.cumsum(starts_here) - 1, starts, blocks))
                symbols = new
            blocks = not blocks

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols from the places ``a`` and ``b`` on, where a < b."""
        a, b = a.copy(), b.copy()
        first = a.copy()
        stopped = np.full(len(a), -1)
        going = np.arange(len(a))
        for level, (symbols, up, starts, blocks) in enumerate(self.rounds):
            x, y = a[going], b[going]
            begun = (starts[up[x]] == x) & (starts[up[y]] == y)
            equal = symbols[x] == symbols[y]
            stop = ~begun & ~equal
            inside = ~begun & equal
            # From inside equal symbols of the next round both reach their ends at once, or one of two blocks goes on.
            ends = np.append(starts[1:], len(symbols))
            left_x, left_y = ends[up[x]] - x, ends[up[y]] - y
            step = np.where(inside, np.minimum(left_x, left_y) if blocks else 1, 0)
            x, y = x + step, y + step
            if blocks:
                stop |= inside & (left_x != left_y)
            stopped[going[stop]] = level
            a[going], b[going] = np.where(stop, x, up[x]), np.where(stop, y, up[y])
            going = going[~stop]
            if not len(going):
                break
        # The symbols at a and b differ; below, they have one common symbol or part of a block at most.
        for level in reversed(range(len(self.rounds))):
            symbols, up, starts, blocks = self.rounds[level]
            down = np.flatnonzero((stopped > level) | (stopped < 0))
            if len(down):
                x, y = starts[a[down]], starts[b[down]]
                equal = symbols[x] == symbols[y]
                step = 1
                if blocks:
                    ends = np.append(starts[1:], len(symbols))
                    step = np.minimum(ends[a[down]] - x, ends[b[down]] - y)
                a[down], b[down] = x + equal * step, y + equal * step
        return a - first


def _repeated(texts: list[list[str]], n: int) -> list[np.ndarray | None]:
    """Per text the places inside word windows of ``n`` that it has twice, None if it has none."""
    sizes = np.array([len(w) for w in texts], np.int64)
    total = int(sizes.sum())
    word = np.fromiter((hash(w) for ws in texts for w in ws), np.int64, total).view(np.uint64)
    if total < n:
        return [None] * len(texts)
    rolling = word.copy()
    for k in range(1, n):
        rolling = rolling[:-1] * _BASE + word[k:]
    text = np.repeat(np.arange(len(texts)), sizes)
    within = np.flatnonzero(text[: len(rolling)] == text[n - 1 :])
    keys = pd.Series(rolling[within] ^ _mixed(text[within].astype(np.uint64) + _BASE))
    twice = within[keys.duplicated(keep=False).to_numpy()]
    edge = np.zeros(total + 1, np.int64)
    edge[twice] += 1
    edge[twice + n] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return [part if (part := covered[i:j]).any() else None for i, j in zip(cuts, cuts[1:])]


def _grid(ids: np.ndarray, inside: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid places i with the period q, where the words at i and i + q are equal and ``inside`` holds for both."""
    periods = np.arange(1, len(ids) // 2 + 1)
    counts = (len(ids) - 1) // periods if len(periods) else periods
    for start, end in in_slices(counts.tolist(), _PAIRS_AT_ONCE):
        n = counts[start:end]
        q = np.repeat(periods[start:end], n)
        i = (np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)) * q
        good = np.flatnonzero(inside[i] & inside[i + q] & (ids[i] == ids[i + q]))
        if len(good):
            yield i[good], q[good]


def runs_of(texts: list[list[str]], min_words: int = MIN_RUN_WORDS) -> list[np.ndarray]:
    """Per text (a list of words) its runs as rows of start, length and smallest period, by start and period.

    A run is a stretch with period q of at least two periods and ``min_words`` words that
    can't be longer on either side. Since it has (min_words + 1) // 2 words and more that
    stand q further on again, texts without a repeated window of so many words have none.
    """
    none = np.empty((0, 3), np.int64)
    found = [none for _ in texts]
    inside = _repeated(texts, max(1, (min_words + 1) // 2))
    some = [k for k, places in enumerate(inside) if places is not None]
    if not some:
        return found
    number: dict[str, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in texts[k]], np.int64) for k in some]
    # A symbol of its own stands before each text and at the end.
    parts, starts, at = [], [], 0
    for n, own in enumerate(ids):
        parts += [[len(number) + n], own]
        starts.append(at + 1)
        at += len(own) + 1
    whole = np.concatenate([*parts, [len(number) + len(ids)]])
    last = len(whole) - 1
    forward, backward = Grammar(whole), Grammar(whole[::-1])

    def extended(k: np.ndarray, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        a = np.array(starts)[k] + i
        after = forward.extension(a, a + q)
        # In reverse, the later place comes first.
        before = backward.extension(last - (a + q - 1), last - (a - 1))
        length = after + before + q
        good = (after + before >= q) & (length >= min_words)
        return np.unique(np.stack([k, i - before, length, q], 1)[good], axis=0)

    rows, waiting, n_waiting = [], [], 0
    for k, own in enumerate(ids):
        for i, q in _grid(own, inside[some[k]]):
            waiting.append((np.full(len(i), k), i, q))
            n_waiting += len(i)
            if n_waiting >= _PAIRS_AT_ONCE:
                rows.append(extended(*map(np.concatenate, zip(*waiting))))
                waiting, n_waiting = [], 0
    if waiting:
        rows.append(extended(*map(np.concatenate, zip(*waiting))))
    if rows:
        # Multiples of a run's period give the same stretch.
        every = np.unique(np.concatenate(rows), axis=0)
        every = every[np.diff(every[:, :3], axis=0, prepend=-1).any(axis=1)]
        every = every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]
        cuts = np.searchsorted(every[:, 0], np.arange(len(some) + 1))
        for n, k in enumerate(some):
            found[k] = every[cuts[n] : cuts[n + 1], 1:]
    return found


def without_repeats_of_runs(words: list[str], runs: np.ndarray) -> list[str]:
    """``words`` without those that a run contains behind its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(edge) > 0
    return [w for w, drop in zip(words, gone.tolist()) if not drop]


def periodic_runs(docs: DataFrame, min_words: int = MIN_RUN_WORDS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start and period) and the collapsed text per row of ``docs``.

    The collapsed text has the words that no run repeats, between single spaces. A null,
    empty or blank text has no words, no runs and an empty collapsed text; a null id stays
    null; equal rows give equal results; other columns are not read and texts do not move.
    """

    def per_batch(batch: pa.RecordBatch):
        texts = batch.column(1).to_pylist()
        for first, end in in_slices([len(t or "") // 5 for t in texts], WORDS_AT_ONCE):
            words = [words_of(t or "") for t in texts[first:end]]
            runs = runs_of(words, min_words)
            flat = np.concatenate([*runs, np.empty((0, 3), np.int64)])
            structs = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(_RUNS.value_type))
            cuts = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, end - first), pa.array([len(w) for w in words], pa.int64()),
                pa.ListArray.from_arrays(pa.array(cuts), structs),
                pa.array([" ".join(without_repeats_of_runs(w, r)) for w, r in zip(words, runs)], pa.string()),
            ], ["doc_id", "n_words", "runs", "collapsed"])

    return map_rows(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), per_batch, COLUMNS)
