"""Token ids as Arrow files of equal-length sequences.

Every partition of the documents, in the order of their ids, becomes two Arrow files with a
footer (the stream format and an index of its batches, for random access):

* ``ids-N.arrow``: fixed-size lists of ``seq_len`` ids, and of flags that are false on the
  filling after the last id. Memory-mapped, a sequence is a view into the file.
* ``docs-N.arrow``: the documents' ids, first places and lengths within the file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargolens.llm.storage import new_path, saved
from cargolens.llm.textbytes import pieces
from cargolens.llm.tokens import encoder, tokenizer_path

#: Sequences in a batch of a file.
BATCH = 128


def store_of(path: str):
    """(file system, path in it) of a path or address that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def open_file(path: str) -> pa.ipc.RecordBatchFileReader:
    """A reader; where files are local, memory-mapped, so batches are views."""
    from pyarrow import fs

    store, at = store_of(path)
    local = isinstance(store, fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(at) if local else store.open_input_file(at))


def sequences_schema(dtype: np.dtype, seq_len: int) -> pa.Schema:
    ids = pa.from_numpy_dtype(dtype)
    return pa.schema([("ids", pa.list_(ids, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class SequenceWriter:
    """Cuts a run of ids into sequences and writes them batch by batch."""

    def __init__(self, sink, dtype: np.dtype, seq_len: int):
        self._schema = sequences_schema(dtype, seq_len)
        self._file = pa.ipc.new_file(sink, self._schema)
        self._len, self._held, self._parts, self._dtype = seq_len, 0, [], dtype

    def add(self, ids: np.ndarray) -> None:
        self._parts.append(ids)
        self._held += len(ids)
        if self._held >= self._len * BATCH:
            ids = np.concatenate(self._parts)
            whole = len(ids) // (self._len * BATCH) * (self._len * BATCH)
            for at in range(0, whole, self._len * BATCH):
                self._batch(ids[at : at + self._len * BATCH], self._len * BATCH)
            self._parts, self._held = [ids[whole:]], len(ids) - whole

    def _batch(self, ids: np.ndarray, real: int) -> None:
        flags = pa.array(np.arange(len(ids)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(x, self._len) for x in (pa.array(ids), flags)]
        self._file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self._schema))

    def close(self) -> None:
        if self._held:
            ids = np.concatenate(self._parts)
            filling = -len(ids) % self._len
            self._batch(np.append(ids, np.zeros(filling, self._dtype)), len(ids))
        self._file.close()


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str | None, seq_len: int, end_id: int):
    """One partition's files. Content and names depend on its rows and number alone, and a
    file gets its name when it is complete, so a repeated task does no harm."""
    from pyspark import TaskContext

    task = TaskContext.get()
    part, attempt = task.partitionId(), task.taskAttemptId()
    enc = encoder(tokenizer or tokenizer_path())
    store, root = store_of(folder)
    store.create_dir(root, recursive=True)
    made = [f"{root}/{kind}-{part:06d}" for kind in ("ids", "docs")]
    doc_ids, counts = [], []
    with store.open_output_stream(f"{made[0]}.{attempt}") as sink:
        out = SequenceWriter(sink, enc.dtype, seq_len)
        for batch in batches:
            doc_ids.append(batch.column(0))
            for first, stop, data, offsets in pieces(batch.column(1)):
                ids, at = enc.encode(data, offsets)
                out.add(np.insert(ids, at[1:], enc.dtype.type(end_id)))
                counts.append(np.diff(at) + 1)
        out.close()
    n_tokens = np.concatenate(counts) if counts else np.empty(0, np.int64)
    if not len(n_tokens):
        store.delete_file(f"{made[0]}.{attempt}")
        return
    index = pa.table(
        {
            "doc_id": pa.chunked_array(doc_ids),
            "start": np.cumsum(n_tokens) - n_tokens,
            "n_tokens": n_tokens,
        }
    )
    with store.open_output_stream(f"{made[1]}.{attempt}") as sink, pa.ipc.new_file(sink, index.schema) as file:
        file.write_table(index)
    for name in made:
        store.move(f"{name}.{attempt}", f"{name}.arrow")
    yield pa.RecordBatch.from_pydict(
        {"part": [part], "n_docs": [len(n_tokens)], "n_tokens": [int(n_tokens.sum())]}
    )


def write_token_files(
    docs: DataFrame,
    folder: str | None = None,
    tokenizer: str | None = None,
    seq_len: int = 2048,
    end_id: int = 2,
) -> tuple[str, DataFrame]:
    """Encode ``docs`` (doc_id, text) and write the files; the folder and a table of its parts.

    Documents stand in ascending order of doc_id (null first; those of equal id by text), each
    followed by ``end_id``. Null and empty texts are the end id alone. An empty table makes
    no file. Other columns are ignored. ``tokenizer`` is a tokenizer file of the tokenizers
    library that every executor has; ids are two bytes wide if its vocabulary allows.
    """
    folder = folder or new_path(docs.sparkSession, "token-files")

    def part(batches):
        return _write_part(batches, folder, tokenizer, seq_len, end_id)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    parts = saved(ordered.mapInArrow(part, "part long, n_docs long, n_tokens long"), "token-parts")
    return folder, parts


def _read_part(batches: Iterator[pa.RecordBatch], folder: str):
    for batch in batches:
        for part, base in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
            index, ids = (open_file(f"{folder}/{kind}-{part:06d}.arrow") for kind in ("docs", "ids"))
            reader = SequenceReader(ids)
            for k in range(index.num_record_batches):
                rows = index.get_batch(k)
                start, count = (rows.column(i).to_numpy() for i in (1, 2))
                crc = [
                    zlib.crc32(reader.ids(a, n).astype("<u4").tobytes())
                    for a, n in zip(start.tolist(), count.tolist())
                ]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": rows.column(0), "start": start + base, "n_tokens": count, "ids_crc32": pa.array(crc, pa.int64())}
                )


class SequenceReader:
    """Random access to the ids of an ``ids-N.arrow`` file."""

    def __init__(self, file: pa.ipc.RecordBatchFileReader):
        self._file = file
        self._width = file.schema.field("ids").type.list_size * BATCH
        self._at, self._held = -1, None

    def _batch(self, k: int) -> np.ndarray:
        if k != self._at:
            self._at, self._held = k, self._file.get_batch(k).column(0).flatten().to_numpy()
        return self._held

    def ids(self, start: int, count: int) -> np.ndarray:
        """The ids ``start`` .. ``start + count - 1`` of the file; a view if in one batch."""
        parts = []
        while count:
            k, at = divmod(start, self._width)
            got = self._batch(k)[at : at + count]
            parts.append(got)
            start, count = start + len(got), count - len(got)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_token_files(folder: str, parts: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files.

    ``parts`` has one row a file, so the running sum over it is small.
    """
    before = F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    based = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    files = based.repartitionByRange(max(1, parts.count()), "part")

    def read(batches):
        return _read_part(batches, folder)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
