"""Best-fit packing of documents into token sequences by linear grouping.

1. Lengths over ``small`` of the capacity are sorted and dealt into groups of equal
   cardinality; within a group every length counts as the group's largest.
2. Patterns of such few sizes that fit a sequence are found by column generation: a linear
   program over the patterns known so far prices the sizes, a knapsack finds the pattern
   worth most, until none improves. Whole multiples of each pattern are opened.
3. Actual documents take the places of their group, the longest first; the last place of a pattern
   takes the longest document that fits, so what rounding up had reserved is used.
4. Everything else, small lengths and what whole multiples left over, goes from the longest
   down into the opened sequence with the least room that suffices, or into a new one.

All of this works on the count of pieces of each length, at most ``capacity`` numbers
whatever the size of the corpus, and on runs of equal sequences. The result is a table of
runs; the pieces look up their place by their rank among pieces of equal length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargolens.llm.storage import saved
from cargolens.llm.textbytes import SMALL_BYTES, give_back, pieces
from cargolens.llm.tokens import _encoders, encoder, tokenizer_path

CAPACITY = 2048
#: Groups of equal cardinality that the large lengths are dealt into.
GROUPS = 80
#: Lengths up to this share of the capacity are small, so patterns have up to three places. Both
#: are tried, and the plan with fewer sequences is taken.
SMALL = (0.3, 0.35)


@dataclass
class Bins:
    """``count`` equal sequences, numbered from ``first``, filled up to ``used``."""

    first: int
    count: int
    used: int


@dataclass
class Run:
    """Pieces of one length in a row of ranks: ``each`` to a sequence, from ``offset`` on."""

    length: int
    rank: int
    count: int
    first: int
    each: int
    offset: int


def groups_of(counts: np.ndarray, small: int, k: int) -> list[tuple[int, int]]:
    """(largest length, pieces) of ``k`` groups of equal cardinality, the longest first."""
    lengths = np.flatnonzero(counts[: len(counts)])[::-1]
    lengths = lengths[lengths > small]
    total = int(counts[lengths].sum())
    if not total:
        return []
    size = -(-total // k)
    upto = np.cumsum(counts[lengths])
    groups = []
    for start in range(0, total, size):
        at = int(np.searchsorted(upto, start, "right"))
        groups.append((int(lengths[at]), min(size, total - start)))
    return groups


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size fill a sequence with the greatest worth (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sizes, worth = sizes[order], worth[order]
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for room in range(int(sizes[0]), capacity + 1):
        value = best[room - sizes[: fitting[room]]] + worth[: fitting[room]]
        top = int(np.argmax(value))
        if value[top] > best[room - 1] + 1e-12:
            best[room], take[room] = value[top], top
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if take[room] < 0:
            room -= 1
        else:
            pattern[order[take[room]]] += 1
            room -= sizes[take[room]]
    return pattern


def patterns(groups: list[tuple[int, int]], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(pattern, whole multiples) of the linear program over patterns of group sizes.

    A revised simplex: the basis starts with patterns of a single size; each round prices
    the sizes, lets the best pattern in and the tightest one out. Ends when no pattern
    is worth more than a sequence, or after ``rounds``: any basis gives a valid packing.
    """
    if not groups:
        return []
    sizes = np.array([size for size, _ in groups])
    demand = np.array([n for _, n in groups], float)
    basis = np.diag([float(capacity // size) for size in sizes])
    amount = np.linalg.solve(basis, demand)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        pattern = best_pattern(sizes, np.maximum(worth, 0), capacity)
        if pattern @ worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        amount = amount - ratio[out] * step
        amount[out] = ratio[out]
        basis[:, out] = pattern
    return [(basis[:, j].astype(int), int(amount[j] + 1e-9)) for j in range(len(sizes)) if amount[j] >= 1]


class Plan:
    """Runs of pieces in runs of equal sequences, from the count of pieces of each length."""

    def __init__(self, counts: np.ndarray, capacity: int, k: int, small: float):
        self.left = counts.astype(np.int64).copy()
        self._rank = np.zeros(len(counts), np.int64)
        self._capacity = capacity
        self.runs: list[Run] = []
        self.sequences = 0
        #: Sequences that patterns opened, by the number of a pattern's places.
        self.by_places: dict[int, int] = {}
        self._open: list[list[Bins]] = [[] for _ in range(capacity + 1)]
        self._fill_patterns(groups_of(self.left, int(capacity * small), k))
        self._best_fit()

    def _take(self, length: int, count: int, first: int, each: int, offset: int) -> None:
        self.runs.append(Run(length, int(self._rank[length]), count, first, each, offset))
        self._rank[length] += count
        self.left[length] -= count

    def _fill_patterns(self, groups: list[tuple[int, int]]) -> None:
        """Open the sequences of every pattern and give each place to an actual piece.

        Patterns go by their longest place. A place of a group takes the longest piece left that is
        not over the group's size. The last place of a pattern takes the longest that is not over
        the room that rounding up has left, so most sequences end up full.
        """
        self._lengths = np.flatnonzero(self.left).tolist()
        sizes = [size for size, _ in groups]
        for pattern, times in sorted(patterns(groups, self._capacity), key=lambda p: int(np.flatnonzero(p[0])[0])):
            places = [sizes[g] for g in np.flatnonzero(pattern) for _ in range(pattern[g])]
            opened = [Bins(self.sequences, times, 0)]
            for size in places[:-1]:
                opened = self._place(opened, size)
            opened = self._place(opened, self._capacity)
            for run in opened:
                if not run.used:  # no piece is left for it: it is not opened
                    continue
                self.sequences = max(self.sequences, run.first + run.count)
                self.by_places[len(places)] = self.by_places.get(len(places), 0) + run.count
                if run.used < self._capacity:
                    self._open[self._capacity - run.used].append(run)

    def _place(self, opened: list[Bins], size: int) -> list[Bins]:
        """The longest piece up to ``size`` into each sequence; where the length changes, runs split."""
        made = []
        for run in opened:
            first, count = run.first, run.count
            while count:
                at = bisect.bisect_right(self._lengths, min(size, self._capacity - run.used)) - 1
                if at < 0:
                    made.append(Bins(first, count, run.used))
                    break
                length = self._lengths[at]
                got = min(int(self.left[length]), count)
                self._take(length, got, first, 1, run.used)
                if not self.left[length]:
                    self._lengths.pop(at)
                made.append(Bins(first, got, run.used + length))
                first, count = first + got, count - got
        return made

    def _best_fit(self) -> None:
        rooms = [r for r in range(self._capacity + 1) if self._open[r]]
        for length in np.flatnonzero(self.left)[::-1].tolist():
            while self.left[length]:
                need = int(self.left[length])
                at = bisect.bisect_left(rooms, length)
                if at == len(rooms):
                    run = Bins(self.sequences, -(-need // (self._capacity // length)), 0)
                    self.sequences += run.count
                    room = self._capacity
                else:
                    room = rooms[at]
                    run = self._open[room].pop()
                    if not self._open[room]:
                        rooms.pop(at)
                each = min(room // length, need)
                full = need // each
                if full < run.count:  # the rest of the run stays as it is, or gets the last few
                    if not full:
                        full = 1
                    self._give_back(rooms, Bins(run.first + full, run.count - full, run.used))
                    run = Bins(run.first, full, run.used)
                self._take(length, run.count * each, run.first, each, run.used)
                self._give_back(rooms, Bins(run.first, run.count, run.used + each * length))

    def _give_back(self, rooms: list[int], run: Bins) -> None:
        room = self._capacity - run.used
        if room:
            if not self._open[room]:
                bisect.insort(rooms, room)
            self._open[room].append(run)


def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str | None, capacity: int, end_id: int):
    """Pieces of the documents, with their rank among this task's pieces of equal length."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId()
    give_back(_encoders)
    enc = encoder(tokenizer or tokenizer_path())
    seen = np.zeros(capacity + 1, np.int64)
    for batch in batches:
        doc_ids = batch.column(0)
        for first, stop, data, offsets in pieces(batch.column(1), SMALL_BYTES):
            ids, at = enc.encode(data, offsets)
            ids = np.insert(ids, at[1:], enc.dtype.type(end_id)).astype("<u4")
            n_tokens = np.diff(at) + 1
            begin = np.cumsum(n_tokens) - n_tokens
            n_pieces = -(-n_tokens // capacity)
            row = np.repeat(np.arange(len(n_tokens)), n_pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            short = n_tokens - (n_pieces - 1) * capacity
            start = np.where(piece > 0, short[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, short[row])
            order = np.argsort(length, kind="stable")
            sizes = length[order]
            fresh = np.flatnonzero(np.diff(sizes, prepend=-1))
            within = np.arange(len(sizes)) - np.repeat(fresh, np.diff(np.append(fresh, len(sizes))))
            rank = np.empty(len(sizes), np.int64)
            rank[order] = seen[sizes] + within
            seen += np.bincount(length, minlength=capacity + 1)
            places = (begin[row] + start).tolist()
            crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(places, length.tolist())]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": doc_ids.slice(first, stop - first).take(pa.array(row)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": start,
                    "length": length,
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "block": np.full(len(row), block),
                    "rank": rank,
                }
            )


def token_pieces(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0
) -> DataFrame:
    """The documents (doc_id, text) as pieces of at most ``capacity`` ids, written out.

    ``end_id`` ends every document; a null or empty text is that id alone. Documents over
    the capacity are cut so that only the first piece is shorter than it. ``rank`` counts
    the pieces of equal length within ``block``, the task that made them.
    """

    def cut(batches):
        return _cut(batches, tokenizer, capacity, end_id)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, rank long"
    return saved(docs.select("doc_id", "text").mapInArrow(cut, schema), "token-pieces")


def pack(
    found: DataFrame, capacity: int = CAPACITY, k: int = GROUPS, small: Sequence[float] = SMALL
) -> DataFrame:
    """``found`` (pieces with length, block and rank) with sequence_id and offset.

    The driver gets one count for each length, at most ``capacity`` of them, and sends
    the tasks a table of runs whose size depends on ``capacity`` and ``k`` alone. An empty
    table packs into no sequence.
    """
    by_block = found.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    bases = by_block.withColumn("base", F.coalesce(before, F.lit(0))).drop("n")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_block.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    plan = min((Plan(counts, capacity, k, x) for x in small), key=lambda x: x.sequences)
    runs = sorted(plan.runs, key=lambda r: (r.length, r.rank))
    lengths = np.array([r.length for r in runs], np.int64)
    table = np.array([(r.rank, r.first, r.each, r.offset) for r in runs], np.int64).reshape(-1, 4)
    edges = np.searchsorted(lengths, np.arange(capacity + 2))
    columns = [c for c in found.columns if c not in ("block", "rank")]

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            row = np.empty(len(length), np.int64)
            for size in np.unique(length):
                own = length == size
                a, b = edges[size], edges[size + 1]
                row[own] = a + np.searchsorted(table[a:b, 0], rank[own], "right") - 1
            from_rank, first, each, offset = table[row].T
            nth = rank - from_rank
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(first + nth // each), pa.array(offset + nth % each * length)],
                [*columns, "sequence_id", "offset"],
            )

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name in columns]
    schema = ", ".join([*kinds, "sequence_id long", "offset long"])
    return found.join(bases, ["length", "block"]).mapInArrow(place, schema)
