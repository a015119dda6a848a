"""Tables that the registered queries share, written once for each state of their input."""

from __future__ import annotations

import tempfile
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from cargolens.sources.staging import COMPRESSION, new_path

#: Input files hold rows in about a twentieth of their size in memory, so a task gets some 80 MB.
BYTES_A_PARTITION = 4 << 20
SOURCES = ("region", "nation", "customer", "part", "orders", "lineitem")
_paths: dict[tuple, str] = {}
_lock = threading.RLock()


@cache
def _folder_of_one_process() -> str:
    return tempfile.mkdtemp(prefix="cargolens-")


def shared_folder(spark: SparkSession) -> str | None:
    """The shared folder; a temporary one where none is named and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local["):
        folder = _folder_of_one_process()
    return folder


def state_of(spark: SparkSession, folder: str) -> tuple:
    """Bytes, files and time of change of every input table."""
    context = spark.sparkContext
    states = []
    for name in SOURCES:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.parquet")
        store = path.getFileSystem(context._jsc.hadoopConfiguration())
        content = store.getContentSummary(path)
        changed = store.getFileStatus(path).getModificationTime()
        states.append((content.getLength(), content.getFileCount(), changed))
    return tuple(states)


@contextmanager
def partitions_for(spark: SparkSession, size: int) -> Iterator[None]:
    """Shuffles in as many partitions as input of ``size`` bytes needs, never fewer than set."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), -(-size // BYTES_A_PARTITION))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(
    spark: SparkSession,
    name: str,
    folder: str,
    write: Callable[[str], object],
    read: Callable[[str], Any],
) -> Any:
    """The table ``name`` made from ``folder``, written anew when the input has changed.

    A path is remembered only after ``write`` returned, so a failed write is never read.
    """
    state = state_of(spark, folder)
    key = (spark.sparkContext.applicationId, name, folder, state)
    with _lock:
        if key not in _paths:
            path = new_path(spark, name, shared_folder(spark))
            with partitions_for(spark, sum(length for length, _, _ in state)):
                write(path)
            _paths[key] = path
        return read(_paths[key])


def stage(spark: SparkSession, name: str, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` as a stored Parquet table."""
    return stored(
        spark,
        name,
        folder,
        lambda path: build().write.parquet(path, compression=COMPRESSION),
        spark.read.parquet,
    )
