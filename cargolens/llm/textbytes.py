"""Array arithmetic over the bytes of a batch of texts.

An Arrow string column is one buffer of UTF-8 bytes and one of offsets. Words, hashes and
counts of a whole batch come from a few passes over that buffer, without a Python object
for each word.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
#: For work whose arrays take many times the text, in every worker.
SMALL_BYTES = 512 << 10

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random 64-bit value for every byte.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(16, int(n).bit_length())
        have = np.full(size + 1, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have
    return have[: n + 1]


#: What this worker remembers between tasks; other modules add their own.
caches: list[dict] = [_powers]


def give_back(*kept: dict) -> None:
    """Returns to the system what earlier tasks left in this worker, which Spark uses again.

    All caches but ``kept`` are emptied.
    """
    for cache in caches:
        if not any(cache is x for x in kept):
            cache.clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # other C libraries do this by themselves
        pass


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters close ones (splitmix64's finalizer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts with about ``limit`` bytes.

    Null is an empty text. A longer text makes a run of its own.
    """
    column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(n, max(stop, row + 1))
        at = offsets[row : stop + 1]
        yield row, stop, raw[at[0] : at[-1]], at - at[0]
        row = stop


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of bytes, the same wherever the span stands."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_BASE, n)[:n], out=total[1:])
        value = (total[ends] - total[starts]) * _power(_INVERSE, n)[starts]
        return mixed(value ^ mixed((ends - starts).astype(np.uint64)))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first run of every text and the end) of runs of member bytes.

    ``member`` has a flag for every byte. Runs end where a text ends.
    """
    n = len(member)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = member.copy()
    begins[1:] &= ~member[:-1] | edge[1:n]
    closes = member.copy()
    closes[:-1] &= ~member[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + counts[i] - 1, one after the other."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)
