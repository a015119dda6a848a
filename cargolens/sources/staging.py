"""Tables written once and read many times, at paths that the caller knows.

What is read back starts from the files: lineage is cut, later queries scan only the columns
they need, and a lost executor costs a re-read and nothing more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Of stored tables, whatever the session's own is: about a quarter less than Spark's default.
COMPRESSION = "zstd"


def new_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A path that nothing else uses, below ``folder`` or the one in ``spark.checkpoint.dir``."""
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share, or pass a path")
    return f"{folder.rstrip('/')}/cargolens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written_out(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` as Parquet and read back. Runs a job."""
    df.write.parquet(path, compression=COMPRESSION)
    return df.sparkSession.read.schema(df.schema).parquet(path)
