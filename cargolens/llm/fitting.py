"""What the two classifiers share: splitting, choosing labelled rows, fitting in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.textbytes import SMALL_BYTES, give_back, pieces

#: What is predicted, beside columns of the caller's own naming.
KEPT = "__predicted"


def id_remainder(divisor: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % divisor


def labelled_ids(labels: DataFrame, label: str, allowed: Column, rows: int, seed: int = 17) -> DataFrame:
    """At most ``rows`` (doc_id, label) chosen by a hash of the id.

    Rows without id or label are left out; of several labels of one id the largest counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull() & allowed
    )
    return (
        known.groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(rows)
    )


def featured(docs: DataFrame, chosen: DataFrame, extract: Callable, columns: tuple[str, ...] = ()) -> DataFrame:
    """(label, features) of the chosen documents. ``chosen`` is bounded, so it is broadcast.

    ``extract(data, offsets, *columns)`` returns one bytes object a text.
    """

    def rows(batches: Iterator[pa.RecordBatch]):
        give_back()
        for batch in batches:
            for first, stop, data, offsets in pieces(batch.column("text"), SMALL_BYTES):
                more = [batch.column(c).slice(first, stop - first) for c in columns]
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": batch.column("label").slice(first, stop - first),
                        "features": pa.array(extract(data, offsets, *more), pa.binary()),
                    }
                )

    return (
        docs.select("doc_id", "text", *columns)
        .join(F.broadcast(chosen), "doc_id")
        .drop("doc_id")
        .mapInArrow(rows, "label int, features binary")
    )


def fitted(rows: DataFrame, fit: Callable):
    """``fit(labels, features)`` run in one task over the bounded ``rows``.

    Rows are put in an order of their own first, so that the model does not depend on
    how they were dealt out.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        give_back()
        table = [(f, y) for b in batches for y, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        table.sort()
        model = fit(np.array([y for _, y in table], float), [f for f, _ in table])
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    (row,) = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(row.model)


def scored(docs: DataFrame, score: Callable, held_out: Column, columns: tuple[str, ...] = (), keep: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted; with ``keep`` all of ``docs`` and column KEPT.

    ``score(data, offsets, *columns)`` returns a number from 0 to 1 for every text.
    """
    fields = docs.schema.fields if keep else [docs.schema["doc_id"]]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    made = [f"{KEPT} int"] if keep else ["held_out boolean", "score double", "predicted int"]
    schema = ", ".join([*kinds, *made])
    own = [f.name for f in fields]
    names = [m.split()[0] for m in made]

    def rows(batches: Iterator[pa.RecordBatch]):
        give_back()
        for batch in batches:
            values = [np.empty(0)]
            for first, stop, data, offsets in pieces(batch.column("text"), SMALL_BYTES):
                more = [batch.column(c).slice(first, stop - first) for c in columns]
                values.append(score(data, offsets, *more))
            value = np.concatenate(values)
            predicted = pa.array((value >= 0.5).astype(np.int32))
            new = {"score": pa.array(value), "predicted": predicted, KEPT: predicted}
            if not keep:
                new["held_out"] = batch.column("__held_out")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), *(new[c] for c in names)], [*own, *names]
            )

    needed = list(dict.fromkeys([*own, "text", *columns]))
    read = docs.select(*needed) if keep else docs.select(*needed, held_out.alias("__held_out"))
    return read.mapInArrow(rows, schema)
