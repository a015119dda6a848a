"""Documents that contain passages of a benchmark, by the q-gram lemma.

Texts are compared as runs of word bytes, without case, blanks and punctuation. Benchmark
items are cut into overlapping windows, long ones for passages with many edits and short
ones, a few bytes apart, for any part of an item. A text region within ``e`` edits of a window of
length m shares at least m - q + 1 - q * e of its q-grams, on diagonals at most e apart.
So shared q-grams are counted in overlapping bands of diagonals, each wide enough to hold
any such region; bands that reach the bound are verified by a banded alignment.

There is no shuffle: the benchmark goes to the documents, in blocks of bounded size, and what a
block finds is written before the next one is read. Texts and items that repeat a few syllables
share grams everywhere; they are counted and aligned in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.storage import saved
from cargolens.llm.textbytes import lowered, mixed, pieces
from cargolens.llm.textfeatures import WORD

Q = 10
#: Word bytes of the shortest item that is looked for.
LEAST_ITEM = 12
#: Bytes of a window and of the step to the next one.
WINDOW, STEP = 120, 60
#: Bytes of a short window, which stands for any part of an item, and of the step to the next one.
PART, PART_STEP = 60, 10
#: One edit is allowed for so many bytes of a window.
PER_EDIT = 15
#: Characters of benchmark text that one pass over the documents looks for; an index takes about
#: 200 bytes for each.
BLOCK_CHARS = 400_000
#: Shared q-grams counted, and regions aligned, at a time.
MOST_HITS, MOST_ALIGNED = 2_000_000, 20_000
FILTER_BITS = 22


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word bytes in lower case, Latin-1 capitals included; offsets into them)."""
    low = lowered(data)
    if len(low) > 1:
        capital = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][capital] += 32
    kept = WORD[low]
    return low[kept], np.concatenate([[0], np.cumsum(kept)])[offsets]


def grams(text: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes from every place of ``text`` on where that many follow."""
    n = len(text)
    if n < Q:
        return np.empty(0, np.uint64)
    words = np.empty(n - 7, np.uint64)
    for o in range(8):
        part = text[o : o + (n - o) // 8 * 8].view("<u8")
        words[o::8] = part
    with np.errstate(over="ignore"):
        return words[: n - Q + 1] * np.uint64(0x9E3779B97F4A7C15) + words[Q - 8 :] * np.uint64(0xC2B2AE3D27D4EB4F)


def slot(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class Index:
    """The q-grams of the windows of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        windows, self.item = [], []
        for item, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            body, _ = normal(data, np.array([0, len(data)]))
            n = len(body)
            if n < LEAST_ITEM:
                continue
            places = {}
            for size, step in ((WINDOW, STEP), (PART, PART_STEP)):
                for at in (*range(0, max(1, n - size), step), max(0, n - size)):
                    places[at, min(at + size, n)] = None
            for at, end in places:
                windows.append(body[at:end])
                self.item.append(item)
        self.length = np.array([len(w) for w in windows], np.int64)
        self.edits = np.minimum(self.length // PER_EDIT, (self.length - Q) // Q)
        self.least = self.length - Q + 1 - Q * self.edits
        self.bytes = np.zeros((len(windows), WINDOW), np.uint8)
        for row, w in zip(self.bytes, windows):
            row[: len(w)] = w
        keys = [grams(w) for w in windows]
        every = np.concatenate([np.empty(0, np.uint64), *keys])
        order = np.argsort(every, kind="stable")
        self.keys = every[order]
        self.window = np.repeat(np.arange(len(windows)), [len(k) for k in keys])[order]
        self.place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(k)) for k in keys]])[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[slot(self.keys)] = True

    #: Diagonals in half a band: one more than any window's edits.
    half = WINDOW // PER_EDIT + 1

    def hits(self, text: np.ndarray, offsets: np.ndarray):
        """(text number, window, diagonal, end) of the shared q-grams within a text, in slices.

        A slice has about MOST_HITS of them; texts that repeat a gram of a window again and again
        share hundreds at every byte. No later slice has a diagonal below ``end`` - WINDOW.
        """
        keys = grams(text)
        at = np.flatnonzero(self.filter[slot(keys)])
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[row + 1]
        at, row = at[inside], row[inside]
        first = np.searchsorted(self.keys, keys[at])
        count = np.searchsorted(self.keys, keys[at], "right") - first
        upto = np.cumsum(count)
        begin = 0
        while begin < len(at):
            done = int(upto[begin - 1]) if begin else 0
            stop = max(begin + 1, int(np.searchsorted(upto, done + MOST_HITS, "right")))
            some = slice(begin, stop)
            which = np.repeat(np.arange(begin, stop), count[some])
            before = upto[some] - count[some] - done
            post = np.repeat(first[some] - before, count[some]) + np.arange(len(which))
            end = int(at[stop]) if stop < len(at) else len(text) + 2 * WINDOW
            yield row[which], self.window[post], at[which] - self.place[post], end
            begin = stop

    def regions(self, text: np.ndarray, offsets: np.ndarray):
        """(text number, window, first diagonal, shared grams) of bands that reach the lemma's bound.

        Bands that no later slice can add to are settled slice by slice.
        """
        key, count = np.empty(0, np.int64), np.empty(0, np.int64)
        settled = []
        for row, window, diagonal, end in self.hits(text, offsets):
            shifted = diagonal + WINDOW
            # bands first, so that settled ones stand at the front
            own = ((shifted // self.half)[None, :] + np.array([[1], [0]])) * len(self.length) + window
            own = own * (len(offsets) - 1) + row
            found, n = np.unique(own, return_counts=True)
            key, place = np.unique(np.concatenate([key, found]), return_inverse=True)
            count = np.bincount(place, np.concatenate([count, n]), len(key)).astype(np.int64)
            open_from = (end // self.half) * len(self.length) * (len(offsets) - 1)
            ready = int(np.searchsorted(key, open_from))
            settled.append((key[:ready], count[:ready]))
            key, count = key[ready:], count[ready:]
        settled.append((key, count))
        out = []
        for key, count in settled:
            pair, row = np.divmod(key, len(offsets) - 1)
            band, window = np.divmod(pair, len(self.length))
            enough = count >= self.least[window]
            out.append((row[enough], window[enough], (band[enough] - 1) * self.half - WINDOW, count[enough]))
        return tuple(np.concatenate(parts) for parts in zip(*out))

    def aligned(self, text, offsets, row, window, first) -> np.ndarray:
        """The least edits that turn a window into a part of its text near these diagonals.

        Column c of the band stands for diagonal ``first - half + c``. A part may begin and
        end anywhere, so the first row is all zeros; what lies outside the text matches nothing.
        """
        width = 4 * self.half
        at = first[:, None] - self.half + np.arange(width)
        low, high = offsets[row][:, None], offsets[row + 1][:, None]
        cost = np.zeros((len(row), width), np.int32)
        answer = np.full(len(row), WINDOW, np.int32)
        ramp = np.arange(width, dtype=np.int32)
        for i in range(int(self.length[window].max(initial=0))):
            place = at + i
            there = (place >= low) & (place < high)
            seen = np.where(there, text[np.clip(place, 0, len(text) - 1)], 0)
            step = cost + (seen != self.bytes[window, i][:, None])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(step - ramp, axis=1) + ramp
            ended = self.length[window] == i + 1
            answer[ended] = cost[ended].min(axis=1)
        return answer

    def matches(self, text: np.ndarray, offsets: np.ndarray):
        """(text number, window, least edits) of every pair with a band that reaches the bound.

        Of a pair's bands the one with most shared grams is aligned first. Others follow, a
        bounded number at a time, unless the window was found without any edit.
        """
        row, window, first, shared = self.regions(text, offsets)
        pair = row * len(self.length) + window
        order = np.lexsort((first, -shared, pair))
        pair, first = pair[order], first[order]
        known, begin = np.unique(pair, return_index=True)
        width = np.diff(np.append(begin, len(pair)))
        nth = np.arange(len(pair)) - np.repeat(begin, width)
        which = np.repeat(np.arange(len(known)), width)
        edits = np.full(len(known), WINDOW, np.int64)
        low, high = 0, 1
        while low < int(width.max(initial=0)):
            todo = np.flatnonzero((nth >= low) & (nth < high) & (edits[which] > 0))
            for a in range(0, len(todo), MOST_ALIGNED):
                some = todo[a : a + MOST_ALIGNED]
                cost = self.aligned(text, offsets, *np.divmod(pair[some], len(self.length)), first[some])
                np.minimum.at(edits, which[some], cost)
            low, high = high, high * 8
        return *np.divmod(known, len(self.length)), edits

    def find(self, data: np.ndarray, offsets: np.ndarray):
        """(text number, item, windows found, least edits) of every item found in a text."""
        text, offsets = normal(data, offsets)
        if not len(self.length) or len(text) < Q:
            return np.empty(0, np.int64), [], np.empty(0, np.int64), np.empty(0, np.int64)
        row, window, edits = self.matches(text, offsets)
        good = edits <= self.edits[window]
        best: dict[tuple[int, int], dict[int, int]] = {}
        for r, w, e in zip(row[good].tolist(), window[good].tolist(), edits[good].tolist()):
            own = best.setdefault((r, self.item[w]), {})
            own[w] = min(e, own.get(w, e))
        pairs = sorted(best)
        return (
            np.array([r for r, _ in pairs], np.int64),
            [item for _, item in pairs],
            np.array([len(best[p]) for p in pairs], np.int64),
            np.array([min(best[p].values()) for p in pairs], np.int64),
        )


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[tuple[Index, bool]]:
    """Indexes of the items, dealt by a hash of the id into blocks of about ``block_chars``, and
    whether another follows. The driver holds one at a time."""
    items = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull())
    (total,) = items.agg(F.sum(F.length("text"))).first()
    n = -(-(total or 0) // block_chars)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Index([tuple(r) for r in part.orderBy("item_id", "text").collect()]), k + 1 < n


def contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, windows and edits for every document that contains a benchmark item.

    An item is found when one of its windows (120 word bytes every 60 and 60 word bytes every
    10, or the whole item if it is shorter) stands in the text with at most one edit for 15
    bytes. So any verbatim part of 69 word bytes is found. ``windows`` counts
    the windows found, ``edits`` is the least of their edits. Null and empty texts, and
    items with under 12 word bytes or no id, find nothing. Repeated documents give rows
    each; other columns are ignored. Either table empty gives an empty result.
    """
    schema = "doc_id long, item_id long, windows long, edits long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index, more in blocks(benchmark, block_chars):

        def scan(batches: Iterator[pa.RecordBatch], index: Index = index):
            for batch in batches:
                for first, _, data, offsets in pieces(batch.column(1)):
                    row, item, windows, edits = index.find(data, offsets)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": batch.column(0).take(pa.array(row + first)),
                            "item_id": pa.array(item, pa.int64()),
                            "windows": windows,
                            "edits": edits,
                        }
                    )

        found = docs.select("doc_id", "text").mapInArrow(scan, schema)
        out = out.unionByName(saved(found, "matches") if more else found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, all columns, in which no benchmark item is found."""
    for index, more in blocks(benchmark, block_chars):

        def clean(batches: Iterator[pa.RecordBatch], index: Index = index):
            for batch in batches:
                kept = np.ones(batch.num_rows, bool)
                for first, _, data, offsets in pieces(batch.column("text")):
                    kept[index.find(data, offsets)[0] + first] = False
                yield batch.filter(pa.array(kept))

        docs = docs.mapInArrow(clean, docs.schema)
        if more:
            docs = saved(docs, "clean-so-far")
    return docs
