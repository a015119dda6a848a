"""Ranked lexical search by the Best Position Algorithm.

The score of a document is a sum over the terms of an item: the term's weight times its impact
in the document, all in integers. Every text is read once and leaves its number of words
and its counts of the vocabulary, the terms of the items, in a stored table. Numbers over all
documents come from that table; then each task searches its own documents, a shard at a time:

* An impact list has the documents of a term from the highest impact down, equal ones by id.
  The lists of an item are read side by side, to a depth that doubles.
* A document that is met is scored at once, by direct access to its place in every other list,
  and all those places count as seen.
* The best position of a list ends its unbroken run of seen places. What comes behind it bounds
  every document not met yet, and the sum of these bounds is below the sum at the last places
  read, since direct accesses move best positions beyond them.
* An item is done with a shard when that sum is strictly below the score of the k-th document;
  an equal one could still belong to a smaller id.

The k-th score is carried from shard to shard within a task. A task hands on at most k documents
an item, and the best of these are the result. Copies of one text have equal scores and are
read as long as they tie with the k-th.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargolens.llm.storage import saved
from cargolens.llm.textbytes import lowered, pieces, ragged, runs, span_hashes
from cargolens.llm.textfeatures import WORD

#: What a term is, and the numbers of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 20
#: Terms of items that are searched for at a time; this bounds what reaches driver and tasks.
BLOCK_TERMS = 400_000
#: Postings and documents that a task searches at a time; one document may have more.
SHARD_POSTINGS, SHARD_DOCUMENTS = 2_000_000, 50_000
#: Depth to which lists are read first.
FIRST_DEPTH = 64


def terms_of(text: Column) -> Column:
    """The terms of a text, in order; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


@dataclass
class Vocabulary:
    """Terms by ascending hash, and their bytes."""

    hashes: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, terms: pa.Array) -> tuple[Vocabulary, np.ndarray]:
        """The vocabulary of distinct terms, and the number each of them has there."""
        encoded = [t.encode() for t in terms.to_pylist()]
        data = np.frombuffer(b"".join(encoded), np.uint8)
        sizes = np.array([len(t) for t in encoded], np.int64)
        starts = np.cumsum(sizes) - sizes
        hashes = span_hashes(data, starts, starts + sizes)
        order = np.argsort(hashes)
        if (np.diff(hashes[order]) == 0).any():
            raise ValueError("two terms have the same hash")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        return cls(hashes[order], data, starts[order], sizes[order]), number

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of every text, text, term number, count), the last three one for each pair."""
        low = lowered(data)
        starts, ends, first = runs(WORD[low], offsets)
        keys = span_hashes(low, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == keys) & (self.sizes[at] == ends - starts))
        at = at[hit]
        # a hash that agrees is not enough: the bytes have to
        same = low[ragged(starts[hit], self.sizes[at])] == self.data[ragged(self.starts[at], self.sizes[at])]
        wrong = np.concatenate([[0], np.cumsum(~same)])
        upto = np.cumsum(self.sizes[at])
        right = wrong[upto] == wrong[upto - self.sizes[at]]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[hit[right]]
        pairs, count = np.unique(row << 32 | at[right], return_counts=True)
        return np.diff(first), pairs >> 32, pairs & 0xFFFFFFFF, count


def counted(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term, written out. Reads the texts once."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for first, stop, data, offsets in pieces(batch.column(1)):
                n, row, term, count = vocabulary.counts(data, offsets)
                ends = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32))) for values in (term, count)
                ]
                made = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, stop - first), pa.array(n.astype(np.int64)), *lists],
                    ["doc_id", "n", "terms", "counts"],
                )
                yield made.filter(pa.array(n > 0))

    schema = "doc_id long, n long, terms array<int>, counts array<int>"
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return saved(read.mapInArrow(rows, schema), "counts")


class Shard:
    """Some documents in the order of their ids, and the impact lists of their terms."""

    def __init__(self, table: pa.Table, documents: int, words: int, vocabulary: int):
        table = table.take(pc.sort_indices(table.column("doc_id"), null_placement="at_start"))
        table = table.combine_chunks()
        self.doc_id = table.column("doc_id").combine_chunks()
        terms, counts = (table.column(c).combine_chunks() for c in ("terms", "counts"))
        self.first = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.term = terms.flatten().to_numpy()
        count = counts.flatten().to_numpy().astype(np.int64)
        m = 100 - 25 + 25 * table.column("n").to_numpy() * documents // words
        doc = np.repeat(np.arange(len(self.doc_id)), np.diff(self.first))
        impact = 1_000_000_000 * count // (1000 * count + 12 * m[doc])
        order = np.lexsort((doc, -impact, self.term))
        self.listed_doc, self.listed_impact, self.impact = doc[order], impact[order], impact
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.lists = np.concatenate([[0], np.cumsum(np.bincount(self.term, minlength=vocabulary))])


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc_id = np.empty(0, np.int64), pa.array([], pa.int64())

    def add(self, score: np.ndarray, doc_id: pa.Array) -> None:
        if self.full:
            some = np.flatnonzero(score >= self.score[-1])
        else:
            some = np.flatnonzero(score > 0)
        if not len(some):
            return
        score = np.concatenate([self.score, score[some]])
        ids = pa.concat_arrays([self.doc_id, doc_id.take(pa.array(some))])
        # a null id is the smallest
        by_id = (ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False))
        order = np.lexsort((*by_id, -score))[: self.k]
        self.score, self.doc_id = score[order], ids.take(pa.array(order))

    @property
    def full(self) -> bool:
        return len(self.score) == self.k


def best_positions(shard: Shard, terms: np.ndarray, weights: np.ndarray, slots: np.ndarray, best: Best) -> int:
    """Adds what ``shard`` has for one item to ``best``; returns the documents scored.

    ``terms`` are the item's distinct terms and ``weights`` what an impact counts for each.
    ``slots`` is a table over the vocabulary, all -1 before and after.
    """
    start, stop = shard.lists[terms], shard.lists[terms + 1]
    some = stop > start
    terms, weights, start, size = terms[some], weights[some], start[some], (stop - start)[some]
    if not len(terms):
        return 0
    slots[terms] = np.arange(len(terms))
    base = np.cumsum(size) - size
    seen = np.zeros(int(size.sum()), bool)
    position = np.zeros(len(terms), np.int64)
    met = np.zeros(len(shard.doc_id), bool)
    read, depth = np.zeros(len(terms), np.int64), FIRST_DEPTH
    while True:
        upto = np.minimum(size, depth)
        docs = shard.listed_doc[ragged(start + read, upto - read)]
        read = upto
        docs = np.unique(docs[~met[docs]])
        met[docs] = True
        width = shard.first[docs + 1] - shard.first[docs]
        own = ragged(shard.first[docs], width)
        slot = slots[shard.term[own]]
        value = np.where(slot >= 0, weights[slot] * shard.impact[own], 0)
        total = np.concatenate([[0], np.cumsum(value)])
        ends = np.cumsum(width)
        best.add(total[ends] - total[ends - width], shard.doc_id.take(pa.array(docs)))
        own, slot = own[slot >= 0], slot[slot >= 0]
        seen[base[slot] + shard.place[own] - start[slot]] = True
        for i in np.flatnonzero(position < size):
            rest = seen[base[i] + position[i] : base[i] + size[i]]
            gap = int(rest.argmin())
            position[i] = size[i] if rest[gap] else position[i] + gap
        open_ = position < size
        bound = int((weights[open_] * shard.listed_impact[(start + position)[open_]]).sum())
        if not bound or best.full and bound < best.score[-1]:
            break
        depth *= 2
    slots[terms] = -1
    return int(met.sum())


def _search(batches: Iterator[pa.RecordBatch], items, terms, weights, first, vocabulary, documents, words, k):
    """The k best documents that this task has for every item."""
    best = [Best(k) for _ in items]
    slots = np.full(vocabulary, -1)

    def search(held: list[pa.RecordBatch]) -> None:
        shard = Shard(pa.Table.from_batches(held), documents, words, vocabulary)
        for i, found in enumerate(best):
            own = slice(first[i], first[i + 1])
            best_positions(shard, terms[own], weights[own], slots, found)

    held, postings, rows = [], 0, 0
    for batch in batches:
        held.append(batch)
        postings += len(batch.column("terms").flatten())
        rows += batch.num_rows
        if postings >= SHARD_POSTINGS or rows >= SHARD_DOCUMENTS:
            search(held)
            held, postings, rows = [], 0, 0
    if rows:
        search(held)
    for item, found in zip(items.tolist(), best):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(found.score), item)), found.doc_id, pa.array(found.score)], ["item", "doc_id", "score"]
        )


def _searched(docs: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    """(item, doc_id, score): the best of every task for a block of items (item, term, repeats)."""
    distinct = pc.unique(queries.column("term").combine_chunks())
    vocabulary, number = Vocabulary.of(distinct)
    term = number[pc.index_in(queries.column("term").combine_chunks(), distinct).to_numpy()]
    index = counted(docs, vocabulary)
    documents, words = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(distinct), np.int64)
    df[holding.column("term").to_numpy()] = holding.column("df").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    item, repeats = queries.column("item").to_numpy(), queries.column("repeats").to_numpy()
    order = np.lexsort((term, item))
    order = order[(weight[term[order]] > 0) & (df[term[order]] > 0)]
    items, first = np.unique(item[order], return_index=True)
    first = np.append(first, len(order))
    terms, weights = term[order].astype(np.int64), (weight[term] * repeats)[order]
    size = len(distinct)

    def search(batches):
        return _search(batches, items, terms, weights, first, size, documents, words, k)

    return index.mapInArrow(search, "item long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents of every row of ``items``.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. Only
    documents that score above 0 are listed; equal scores go by the smaller id, null first.
    Null and empty texts have no terms. Rows that repeat an id are documents, or items, of
    their own. Empty tables give an empty result. Items are dealt into blocks of about
    ``block_terms`` terms; the texts are read once a block, and a block's result is written out
    before the next one starts.
    """
    number = F.monotonically_increasing_id()
    numbered = saved(items.select("item_id", terms_of(F.col("text")).alias("words")).withColumn("item", number), "items")
    total = numbered.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_terms))
    pairs = numbered.select("item", F.explode("words").alias("term")).groupBy("item", "term")
    pairs = pairs.agg(F.count("*").alias("repeats"))
    found = None
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()
        if not own.num_rows:
            continue
        part = saved(_searched(docs, own, k), "best")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = numbered.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def sql(k: int = TOP) -> str:
    """DuckDB SQL for ``ranked`` over documents and benchmark."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {words} AS words, len(words)::BIGINT AS n FROM documents),
stats AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_words FROM docs WHERE n > 0),
postings AS (
  SELECT r, doc_id, n, word, count(*)::BIGINT AS tf
  FROM (SELECT r, doc_id, n, unnest(words) AS word FROM docs) GROUP BY ALL),
weights AS (
  SELECT word, floor(1000 * ln((2 * any_value(all_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings CROSS JOIN stats GROUP BY word),
items AS (SELECT row_number() OVER () AS i, item_id, unnest({words}) AS word FROM benchmark),
asked AS (SELECT i, item_id, word, count(*)::BIGINT AS repeats FROM items GROUP BY ALL),
scores AS (
  SELECT i, item_id, r, doc_id,
    sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * all_docs) // all_words))))::BIGINT AS score
  FROM asked JOIN weights USING (word) JOIN postings USING (word) CROSS JOIN stats GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {k}"""
