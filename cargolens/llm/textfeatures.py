"""Features of whole texts: hashed words and statistics of their structure."""

from __future__ import annotations

import numpy as np

from cargolens.llm.textbytes import lowered, runs, span_hashes

#: ASCII letters, digits and every byte of a longer character.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True

STATISTICS = (
    "bytes", "words", "word_length", "upper", "digits", "symbols", "exclamations",
    "lines", "repeated_words", "distinct_words", "marked_words", "repeated_lines",
)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first word of every text and the end) of words, A-Z as a-z."""
    low = lowered(data)
    starts, ends, first = runs(WORD[low], offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return span_hashes(low, starts, ends), row, first


def distinct_per_row(row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key) pairs; keys are below 2**32."""
    both = np.unique(row.astype(np.uint64) << np.uint64(32) | keys.astype(np.uint64))
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def hashed_words(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of the distinct words of every text, slots below 2**bits."""
    keys, row, _ = words_of(data, offsets)
    return distinct_per_row(row, keys >> np.uint64(64 - bits))


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the flags between neighbouring offsets."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(total[offsets])


def structure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS a text; sizes as binary logarithms, the rest as shares."""
    size = np.diff(offsets)
    at_least = np.maximum(size, 1)
    keys, row, first = words_of(data, offsets)
    n = len(size)
    n_words = np.diff(first)
    some = np.maximum(n_words, 1)
    member = WORD[data]
    repeats = np.zeros(len(keys), bool)
    repeats[1:] = (keys[1:] == keys[:-1]) & (row[1:] == row[:-1])
    distinct = np.bincount(distinct_per_row(row, keys >> np.uint64(32))[0], minlength=n)
    symbol = ~member & (data > 32) & (data != 127)
    common = np.isin(data, np.frombuffer(b".,;:'\"-()?", np.uint8))
    odd = symbol & ~common
    marked = odd.copy()
    if len(data):
        marked[1:] &= member[:-1] | common[:-1]
        marked[0] = False
    starts, ends, lines = runs(data != 10, offsets)
    line_row = np.repeat(np.arange(n), np.diff(lines))
    line_keys = span_hashes(data, starts, ends)
    _, kept = np.unique(np.stack([line_row.astype(np.uint64), line_keys]), axis=1, return_index=True) if len(starts) else (0, np.empty(0, np.int64))
    again = np.ones(len(starts), bool)
    again[kept] = False
    repeated = np.bincount(line_row, weights=(ends - starts) * again, minlength=n)
    share = lambda flags: sums(flags, offsets) / at_least
    return np.stack(
        [
            np.log2(size + 1),
            np.log2(n_words + 1),
            np.minimum(sums(member, offsets) / some / 16, 4),
            share((data >= 65) & (data <= 90)),
            share((data >= 48) & (data <= 57)),
            share(odd),
            share(data == 33),
            share(data == 10),
            sums(repeats, first) / some,
            distinct / some,
            sums(marked, offsets) / some,
            repeated / at_least,
        ],
        axis=1,
    )


