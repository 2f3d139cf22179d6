"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, in numpy, measure how many characters of a text lie inside n-grams or lines
that occur before or again in the same text. No shuffle: a text is judged alone.

Defined cases: a very long text is measured whole; an empty table gives no rows; a null or empty text has no words and fails the base rule (fewer than 50 words); repeated rows get equal
rows; ties cannot occur; other columns of the input are ignored by ``quality_report`` and kept by ``quality_filter``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import ASCII_SPACE, filter_rows, per_document

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Greatest share of word characters inside repeated n-grams (first occurrences included), by n. One line of boilerplate
#: that occurs twice in a short text stays below; shorter n-grams recur by chance more often, so they may cover more.
MAX_NGRAM_SHARE = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
#: Greatest share of characters inside lines that repeat an earlier line.
MAX_LINE_SHARE = 0.25
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(29)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each window of ``n`` word hashes."""
    size = len(hashes) - n + 1
    out = hashes[:size].copy()
    for k in range(1, n):
        out *= _BASE
        out ^= out >> _FOLD
        out += hashes[k : k + size]
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """True for positions inside a window of ``n`` that begins at one of ``starts``."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ngram_share, line_share."""
    raw = text.encode()
    words = raw.split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, ASCII_SPACE))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    n_dup_lines = dup_chars = 0
    for line in text.split("\n"):
        if line in seen:
            n_dup_lines += 1
            dup_chars += len(line)
        elif line.strip(ASCII_SPACE):
            seen.add(line)
    n_repeat, over, worst = 0, False, 0.0
    if n_words >= 3:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n_words)
        three = repeated(rolling(hashes, 3))
        starts = np.flatnonzero(three)
        if len(starts):
            n_repeat = int(covered(starts, 3, n_words).sum())
            lengths = None
            for n, most in MAX_NGRAM_SHARE.items():
                if n_words < n:
                    break
                # A repeated window of n words consists of repeated windows of three.
                run = np.convolve(three.astype(np.int64), np.ones(n - 2, np.int64), "valid") == n - 2
                at = np.flatnonzero(run)
                if len(at) < 2:
                    break
                at = at[repeated(rolling(hashes, n)[at])]
                if not len(at):
                    break
                if lengths is None:
                    lengths = np.fromiter((len(w.decode()) for w in words), np.int64, n_words)
                share = float(lengths[covered(at, n, n_words)].sum()) / word_chars
                worst, over = max(worst, share), over or share > most
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    line_share = dup_chars / len(text) if text else 0.0
    kept = not failed and not over and line_share <= MAX_LINE_SHARE
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat, failed, kept, worst, line_share


_COLUMNS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ngram_share", pa.float64()),
    ("line_share", pa.float64()),
]


def quality_report(docs: DataFrame) -> DataFrame:
    """The measures and the verdict for every row."""
    ddl = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ngram_share double, line_share double"
    return per_document(docs, measure, _COLUMNS, ddl)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows that the verdict keeps, with their columns."""
    return filter_rows(docs, lambda text: measure(text)[6])
