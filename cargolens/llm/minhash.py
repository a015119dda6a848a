"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's set of word shingles has a signature of ``CHUNKS * WIDTH`` values of 16 bits; the
distance of two signatures is the number of values that differ. The values are split into
``CHUNKS`` chunks. Two signatures at a distance of at most ``2 * CHUNKS - 1`` have, by the
pigeonhole principle, a chunk with at most one error, so they agree on one of the keys that
leave one value of one chunk out. Joining on these keys finds every such pair.

At the least similarity of 0.85, 7.2 of the 48 values differ on average and more than 23 in
less than one pair of 10 million. At 0.8 it is one of 300,000; lower similarities, at which it
would be more than one of 100,000, are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.components import components
from cargolens.llm.storage import saved
from cargolens.llm.textbytes import lowered, mixed, pieces, runs, span_hashes

CHUNKS, WIDTH = 12, 4
VALUES = CHUNKS * WIDTH
#: The sketch that is compared before sets are: two bits of each of 512 minima.
SKETCH = 512
#: Members of a key that one task compares with all others of the key.
PART = 256
WORDS = 5
#: Similarity in hundredths.
LEAST = 85

#: Columns of the sketch's two planes of bits, 64 to a column, and of the signature, one chunk of four values each.
HIGH, LOW = ([f"{plane}_{j}" for j in range(SKETCH // 64)] for plane in ("high", "low"))
SKETCHES = [*HIGH, *LOW]
LANES = [f"chunk_{j}" for j in range(CHUNKS)]

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(8)
_FACTOR = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of every text, by text.

    Words are runs of other bytes than blanks, A-Z as a-z. A text with fewer words is one
    shingle, one without words has none.
    """
    low = lowered(data)
    starts, ends, first = runs(~_BLANK[low], offsets)
    word = span_hashes(low, starts, ends)
    count = np.diff(first)
    made = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), made)
    begin = np.repeat(first[:-1], made) + np.arange(len(row)) - np.repeat(np.cumsum(made) - made, made)
    size = np.minimum(count, words)[row]
    keys = mixed(size.astype(np.uint64))
    for j in range(words):
        at = begin + j
        inside = j < size
        keys = np.where(inside, mixed(keys ^ word[np.where(inside, at, 0)]) if len(word) else keys, keys)
    _, kept = np.unique(mixed(keys ^ mixed(row.astype(np.uint64) + np.uint64(1))), return_index=True)
    kept.sort()
    return row[kept], keys[kept]


def _sign(batches: Iterator[pa.RecordBatch], words: int):
    for batch in batches:
        for first, stop, data, offsets in pieces(batch.column(1)):
            row, keys = shingles(data, offsets, words)
            n = stop - first
            count = np.bincount(row, minlength=n)
            some = np.flatnonzero(count)
            at = (np.cumsum(count) - count)[some]
            values = np.zeros((n, VALUES), np.uint16)
            bits = np.zeros((n, 2, SKETCH), np.uint8)
            one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            if len(some):
                with np.errstate(over="ignore"):
                    one[some] = np.add.reduceat(mixed(keys), at)
                    two[some] = np.add.reduceat(mixed(keys ^ np.uint64(0x5851F42D4C957F2D)), at)
                    for j in range(SKETCH):
                        least = mixed(np.minimum.reduceat((keys ^ _SHIFT[j]) * _FACTOR[j], at))
                        bits[some, 0, j] = least & np.uint64(1)
                        bits[some, 1, j] = least >> np.uint64(1) & np.uint64(1)
                        if j < VALUES:
                            values[some, j] = least >> np.uint64(48)
            packed = np.packbits(bits.reshape(n, 2 * SKETCH), axis=1).view("<i8")
            chunk = values.astype(np.uint64).reshape(n, CHUNKS, WIDTH)
            index = np.empty((n, CHUNKS, WIDTH), np.uint64)
            for out in range(WIDTH):
                key = np.full((n, CHUNKS), out + 1, np.uint64) + np.arange(CHUNKS, dtype=np.uint64) * np.uint64(64)
                key = mixed(key)
                for j in range(WIDTH):
                    if j != out:
                        key = mixed(key ^ chunk[:, :, j])
                index[:, :, out] = key
            lanes = values.view("<i8")
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * VALUES)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0).slice(first, n),
                    "text_hash": batch.column(2).slice(first, n),
                    "n_shingles": pa.array(count, pa.int64()),
                    "set_one": one.view(np.int64),
                    "set_two": two.view(np.int64),
                    **{c: packed[:, j].copy() for j, c in enumerate(SKETCHES)},
                    **{c: lanes[:, j].copy() for j, c in enumerate(LANES)},
                    "index": pa.ListArray.from_arrays(ends, pa.array(index.reshape(-1).view(np.int64))),
                }
            )


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Sizes, fingerprints, sketches and index keys of the documents, written out."""

    def sign(batches):
        return _sign(batches, words)

    longs = ", ".join(f"{c} long" for c in ("doc_id", "text_hash", "n_shingles", "set_one", "set_two", *SKETCHES, *LANES))
    schema = f"{longs}, index array<long>"
    return saved(docs.select("doc_id", "text", text_hash()).mapInArrow(sign, schema), "signatures")


def text_hash() -> Column:
    """What tells rows of one doc_id with different texts apart."""
    return F.xxhash64("text").alias("text_hash")


def _sets(batches: Iterator[pa.RecordBatch], words: int):
    for batch in batches:
        for first, stop, data, offsets in pieces(batch.column(1)):
            row, keys = shingles(data, offsets, words)
            order = np.lexsort((keys, row))
            keys = keys[order]
            cut = np.searchsorted(row, np.arange(stop - first + 1))
            yield pa.RecordBatch.from_pydict(
                {
                    "node": batch.column(0).slice(first, stop - first),
                    "members": pa.array([keys[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                }
            )


def _confirm(batches: Iterator[pa.RecordBatch], least: int):
    """The pairs whose full sets are similar enough."""
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("members_a"), batch.column("members_b")):
            one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            shared = len(np.intersect1d(one, two, assume_unique=True))
            linked.append(100 * shared >= least * (len(one) + len(two) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(linked))


def _apart() -> Column:
    """Of the sketches of ``a`` and ``b``, the minima whose two bits differ."""
    differ = lambda c: F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))
    return sum(F.bit_count(differ(h).bitwiseOR(differ(low))) for h, low in zip(HIGH, LOW))


def sketch_distance(least: int) -> int:
    """The most minima whose bits differ for a pair to be compared: 5 deviations above the mean.

    Of a pair at the least similarity, the share 3/4 of the different minima show in two bits:
    at 0.85, 57.6 of 512 on average (deviation 7.1), and more than 93 in less than one
    pair of a million.
    """
    share = 0.75 * (100 - least) / 100
    return int(SKETCH * share + 5 * math.sqrt(SKETCH * share * (1 - share)))


def checked(least: int) -> int:
    """``least`` if the keys find all but one of 100,000 pairs at it, else an error."""
    p = (100 - least) / 100
    beyond = range(2 * CHUNKS, VALUES + 1)
    missed = sum(math.comb(VALUES, k) * p**k * (1 - p) ** (VALUES - k) for k in beyond)
    if not 0 < least <= 100 or missed > 1e-5:
        raise ValueError(f"the signature does not find all pairs at a similarity of {least} hundredths")
    return least


def _similar_size(least: int) -> Column:
    a, b = F.col("n_shingles_a"), F.col("n_shingles_b")
    return (100 * b >= least * a) & (100 * a >= least * b)


def _first_shared() -> Column:
    """Whether ``key`` is the first of the keys that ``a`` and ``b`` share.

    A chunk with at least three equal values of four has a shared key: the one that leaves
    the different value out, or the first one if all are equal.
    """
    first = F.lit(-1)
    for j in reversed(range(CHUNKS)):
        x = F.col(f"{LANES[j]}_a").bitwiseXOR(F.col(f"{LANES[j]}_b"))
        equal = [F.shiftright(x, 16 * k).bitwiseAND(F.lit(65535)) == 0 for k in range(WIDTH)]
        out = F.when(~equal[0], 0).when(~equal[1], 1).when(~equal[2], 2).when(~equal[3], 3).otherwise(0)
        shared = sum(e.cast("int") for e in equal) >= WIDTH - 1
        first = F.when(shared, j * WIDTH + out).otherwise(first)
    return first == F.col("number_a")


class Candidates:
    """Pairs of different sets that agree on a key.

    Where thousands of near copies share a key, comparing each with the one among them that
    shares most keys with others links nearly all that are linked; only members that are
    still apart are compared with each other, and a pair only at the first of its keys.
    """

    def __init__(self, docs: DataFrame, sets: DataFrame, words: int, least: int):
        self._least = least
        keys = sets.select("node", F.posexplode("index").alias("number", "key"))
        common = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        self._shared = saved(keys.join(common, "key"), "shared-keys")
        degree = self._shared.groupBy("node").agg(F.sum(F.col("n") - 1).alias("degree"))
        # hints keep the plan the same at every size: these sides may be as large as any
        own = sets.drop("index", "set_one", "set_two").join(degree.hint("merge"), "node")
        self._info = saved(own, "candidates")
        first = ["doc_id", "text_hash"]
        texts = docs.select("doc_id", "text", text_hash()).join(self._info.select(*first, "node").hint("merge"), first)
        texts = texts.dropDuplicates(first).select("node", "text")
        self._members = saved(texts.mapInArrow(lambda x: _sets(x, words), "node long, members binary"), "sets")
        self._info = self._info.drop("text_hash")
        self._links: DataFrame | None = None

    def _with(self, pairs: DataFrame, info: DataFrame) -> DataFrame:
        for side in "ab":
            named = {c: f"{c}_{side}" for c in info.columns if c != "node"}
            pairs = pairs.join(info.withColumnsRenamed(named | {"node": side}), side)
        return pairs

    def _add(self, pairs: DataFrame) -> None:
        """Take those of the close ``pairs`` as links whose full sets are similar enough."""
        least = self._least
        links = saved(
            self._with(pairs, self._members).mapInArrow(lambda x: _confirm(x, least), "a long, b long"), "links"
        )
        self._links = links if self._links is None else self._links.unionByName(links)

    def _placed(self) -> DataFrame:
        """The shared keys with the component that each set has so far."""
        if self._links is None:
            return self._shared.withColumn("component", F.col("node"))
        found = components(self._links).withColumnRenamed("id", "node")
        return self._shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def _compare_with_centres(self, placed: DataFrame) -> None:
        """Compare the members of each key with the two of highest degree that are apart."""
        ranked = placed.join(self._info.select("node", "degree", "doc_id"), "node")
        # of equal degrees the smallest doc_id, which is the same under every key
        order = F.struct("degree", (-F.col("doc_id")).alias("id"))
        one = ranked.groupBy("key").agg(F.max_by(F.struct("node", "component"), order).alias("one"))
        rest = ranked.join(one, "key").where(F.col("component") != F.col("one.component"))
        two = rest.groupBy("key").agg(F.max_by("node", order).alias("two"))
        pairs = rest.join(two, "key").select("node", F.explode(F.array("one.node", "two")).alias("centre"))
        pairs = pairs.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        close = self._with(pairs.distinct(), self._info.drop("degree", "doc_id", *LANES))
        self._add(close.where(_similar_size(self._least) & (_apart() <= sketch_distance(self._least))).select("a", "b"))

    def _dealt(self, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Two sides to join on key and part, which meet in every pair of a key that is apart.

        One side has the members outside of the key's largest component, each in one part, the
        other all members in all parts, so members of a large component do not meet each other
        and no task compares more than PART members with the others.
        """
        sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
        several = sizes.groupBy("key").agg(
            F.max(F.struct("n", "component"))["component"].alias("major"),
            (F.sum("n") - F.max("n")).alias("minor"),
        )
        several = several.where("minor > 0").withColumn("parts", F.ceil(F.col("minor") / F.lit(PART)).cast("int"))
        apart = placed.drop("n").join(several.drop("minor"), "key")
        apart = saved(apart.join(self._info.drop("degree", "doc_id"), "node"), "apart")
        parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        one = apart.where("component <> major").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        return tuple(
            side.drop("parts").withColumnsRenamed({c: f"{c}_{x}" for c in apart.columns if c not in ("key", "parts")})
            for x, side in (("a", one), ("b", apart.withColumn("part", parts)))
        )

    def _compare_all_apart(self, placed: DataFrame) -> None:
        """Compare all members of a key that are in different components."""
        one, two = self._dealt(placed)
        pairs = one.join(two, ["key", "part"]).where(
            ((F.col("component_b") == F.col("major_b")) | (F.col("node_a") < F.col("node_b")))
            & (F.col("component_a") != F.col("component_b"))
            & _similar_size(self._least)
            & (_apart() <= sketch_distance(self._least))
            & _first_shared()
        )
        self._add(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))

    def components(self) -> DataFrame:
        """(id, component) of all sets that are linked to another, by their nodes."""
        self._compare_with_centres(self._placed())
        self._compare_all_apart(self._placed())
        return components(self._links)


def _grouped(docs: DataFrame, words: int, least: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, group (null without words) and component_id of every row."""
    checked(least)
    signed = signatures(docs, words)
    full = signed.where("n_shingles > 0")
    print_of = ["n_shingles", "set_one", "set_two"]
    # sets go by numbers of their own, since rows of one doc_id may have different texts
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash")))
    equal = full.groupBy(*print_of).agg(
        first.alias("first"),
        *(F.first(c).alias(c) for c in (*SKETCHES, *LANES, "index")),
    )
    equal = equal.select("*", "first.doc_id", "first.text_hash").drop("first")
    sets = saved(equal.withColumn("node", F.monotonically_increasing_id()), "different-sets")
    found = Candidates(docs.select("doc_id", "text"), sets, words, least).components()
    placed = sets.select(*print_of, "doc_id", "node").join(found.withColumnRenamed("id", "node"), "node", "left")
    placed = placed.select(*print_of, "doc_id", F.coalesce("component", "node").alias("group"))
    names = placed.groupBy("group").agg(F.min("doc_id").alias("named"))
    named = placed.drop("doc_id").join(names, "group")
    out = signed.select("doc_id", "text_hash", *print_of).join(named, print_of, "left")
    component = F.coalesce("named", "doc_id").alias("component_id")
    return out.select("doc_id", "text_hash", "n_shingles", "group", component)


def near_duplicates(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document (doc_id, text).

    Documents are linked when 100 times the shared shingles reach ``least`` times those of
    both together; a component is named by its smallest doc_id, which alone is kept. Texts
    without words, null ones included, link with nothing. Equal sets, whose fingerprints of
    128 bits agree, are one from the start, and links are confirmed on full sets. Rows that
    repeat a doc_id are compared by their texts, each for itself. A null doc_id is kept and
    names no component. Other
    columns are ignored. An empty table gives an empty result. A ``least`` too small for the
    signature raises ValueError.
    """
    found = _grouped(docs, words, least)
    return found.select("doc_id", "n_shingles", "component_id", _is_kept().alias("kept"))


def _is_kept() -> Column:
    return F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))


def without_near_duplicates(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """The documents, all columns, but of each component only the one that is kept.

    Rows that repeat a doc_id are told apart by their texts: of those in one component, or
    without words, one row stays. Rows without doc_id and texts without words stay.
    """
    found = saved(_grouped(docs, words, least).where(F.col("doc_id").isNotNull()), "groups")
    by_id = found.groupBy("doc_id").agg(F.max(_is_kept()).alias("kept"), F.count("*").alias("n"))
    changed = saved(by_id.where(~F.col("kept") | (F.col("n") > 1)), "not-as-they-are")
    # the hint keeps the plan the same at every size
    out = docs.join(changed.select("doc_id").hint("merge"), "doc_id", "left_anti")
    again = changed.where("kept AND n > 1").select("doc_id")
    if not again.isEmpty():
        known = found.join(again, "doc_id", "left_semi").where(_is_kept())
        known = known.select("doc_id", F.col("text_hash").alias("__text"), F.col("group").alias("__group")).distinct()
        rows = docs.withColumn("__text", F.xxhash64("text")).join(known, ["doc_id", "__text"])
        out = out.unionByName(rows.dropDuplicates(["doc_id", "__group"]).select(*docs.columns))
    return out.select(*docs.columns)
