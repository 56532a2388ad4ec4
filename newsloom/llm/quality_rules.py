"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, taken over a whole batch of documents
at once, mark the n-grams a text has already had. The characters of the words
inside them, and of the lines a text has already had, are measured against the
characters of all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import in_slices, map_rows, words_of

# Most repetition of a kept text, in per cent of its characters, by the number of
# words of the n-gram. Ten points above the usual ones, since only later copies
# count here and a short text may carry one line as its head and its foot.
NGRAM_PERCENT = {5: 25, 6: 24, 7: 23, 8: 22, 9: 21, 10: 20}
LINE_PERCENT = 30
MIN_WORDS = 50
REPEAT_PERCENT = 50
REPEAT_WINDOW = 3
SYMBOLS = "#*$%&|<>"
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"

# Words whose hashes are held at once; one longer text is held alone.
WORDS_AT_ONCE = 100_000
_BASE = np.uint64(0x9E3779B97F4A7C15)

COLUMNS = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, dup_line_chars bigint, dup_ngram_chars array<bigint>, "
    "base_failed boolean, kept boolean"
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside the windows of ``n`` words at ``starts``."""
    edge = np.zeros(total + 1, np.int64)
    edge[starts] += 1
    edge[starts + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def _measure(texts: list[str], words: list[list[str]]) -> dict[str, np.ndarray]:
    n_words = np.array([len(w) for w in words], np.int64)
    total = int(n_words.sum())
    doc = np.repeat(np.arange(len(texts)), n_words)
    ends = np.repeat(np.cumsum(n_words), n_words)
    flat = [w for ws in words for w in ws]
    chars = np.fromiter(map(len, flat), np.int64, total)
    word = _mixed(np.fromiter(map(hash, flat), np.int64, total).view(np.uint64))
    seed = _mixed(doc.astype(np.uint64) + np.uint64(1))
    at = np.arange(total)

    def per_doc(mask, weights=None):
        return np.bincount(doc[mask], None if weights is None else weights[mask], len(texts)).astype(np.int64)

    every = np.ones(total, bool)
    out = {"n_words": n_words, "word_chars": per_doc(every, chars)}
    rolling, n, shares = word.copy(), 1, []
    for length in sorted({REPEAT_WINDOW, *NGRAM_PERCENT}):
        while n < length:
            rolling = rolling[:-1] * _BASE + word[n:] if len(rolling) else rolling
            n += 1
        starts = at[: len(rolling)][at[: len(rolling)] + n <= ends[: len(rolling)]]
        keys = pd.Series(rolling[starts] ^ seed[starts])
        if length == REPEAT_WINDOW:
            twice = starts[keys.duplicated(keep=False).to_numpy()]
            out["n_repeat_words"] = per_doc(_covered(twice, n, total))
        if length in NGRAM_PERCENT:
            later = starts[keys.duplicated().to_numpy()]
            shares.append(per_doc(_covered(later, n, total), chars))
    out["dup_ngram_chars"] = np.array(shares).T
    symbols, lines, line_chars = [], [], []
    for t in texts:
        symbols.append(sum(map(t.count, SYMBOLS)))
        real = [x for x in t.split("\n") if x.strip(ASCII_SPACE)]
        seen: set[str] = set()
        again = [x for x in real if x in seen or seen.add(x)] if len(set(real)) < len(real) else []
        lines.append(len(again))
        line_chars.append(sum(len(w) for x in again for w in words_of(x)))
    out |= {"n_symbols": np.array(symbols), "n_dup_lines": np.array(lines), "dup_line_chars": np.array(line_chars)}
    base = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * n_words)
    limits = np.array([NGRAM_PERCENT[k] for k in sorted(NGRAM_PERCENT)])
    repeated = (100 * out["dup_ngram_chars"] > limits * out["word_chars"][:, None]).any(axis=1)
    repeated |= 100 * out["dup_line_chars"] > LINE_PERCENT * out["word_chars"]
    return out | {"base_failed": base, "kept": ~base & ~repeated}


def _measured(column: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    texts = [t or "" for t in column.to_pylist()]
    for start, end in in_slices([len(t) // 5 for t in texts], WORDS_AT_ONCE):
        part = texts[start:end]
        yield start, end, _measure(part, [words_of(t) for t in part])


def quality_report(docs: DataFrame) -> DataFrame:
    """One row of measures and the verdict per row of ``docs`` (doc_id, text).

    A null or empty text has no words and fails; a null id stays null; repeated
    rows give repeated results; other columns are not read. ``dup_ngram_chars``
    has the characters inside repeated n-grams for 5 to 10 words.
    """

    def per_batch(batch: pa.RecordBatch):
        for start, end, m in _measured(batch.column(1)):
            arrays = [batch.column(0).slice(start, end - start)]
            for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"):
                arrays.append(pa.array(m[name], pa.int64()))
            arrays.append(pa.array(m["dup_ngram_chars"].tolist(), pa.list_(pa.int64())))
            arrays += [pa.array(m["base_failed"]), pa.array(m["kept"])]
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return map_rows(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), per_batch, COLUMNS)


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass, all columns as they are; texts do not move."""
    place = docs.columns.index("text")

    def per_batch(batch: pa.RecordBatch):
        for start, end, m in _measured(batch.column(place)):
            yield batch.slice(start, end - start).filter(pa.array(m["kept"]))

    return map_rows(docs, per_batch, docs.schema)


def batch_kept(texts: list[str]) -> list[bool]:
    """The verdict for texts in memory."""
    return pc.cast(pa.array(_measure(texts, [words_of(t) for t in texts])["kept"]), pa.bool_()).to_pylist()
