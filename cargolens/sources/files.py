"""CSV and Parquet in and out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.operators.clustering import z_ordered
from cargolens.operators.ordering import first_rows
from cargolens.schema import FACETS, HEADER_OF, NA_TOKENS, RAW_COLUMNS
from cargolens.sources.staging import COMPRESSION


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    encoding: str = "ISO-8859-1",
    multi_line: bool = False,
    na_tokens: Iterable[str] = NA_TOKENS,
    types: Mapping[str, str] | None = None,
    source: str | None = None,
    rejected: str | None = None,
) -> DataFrame:
    """Read order-item CSV files under canonical names and declared types.

    Cells are read as text, cells equal to an NA token become null, and only then
    are the typed columns cast, so one bad cell costs that cell and not the row.
    Columns without a declared type stay text unless ``types`` (header to type) has them.

    Each path of a list is read by its own header, and the results are joined by column name;
    columns that one of them lacks are null there. Files below one path must have the same
    header: Spark raises an error where they differ.

    Files are split at any size. ``multi_line`` keeps quoted line breaks in one cell, but
    makes every file one split.

    ``source`` names a column that gets the file of the row, and ``rejected`` one that gets the
    cells that were there and could not be cast, as (column, text); both are made in the same
    parse.
    """
    parts = [path] if isinstance(path, str) else list(path)
    tables = [
        read_layout(spark, p, encoding, multi_line, na_tokens, types, source, rejected) for p in parts
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_layout(
    spark: SparkSession,
    path: str | Sequence[str],
    encoding: str = "ISO-8859-1",
    multi_line: bool = False,
    na_tokens: Iterable[str] = NA_TOKENS,
    types: Mapping[str, str] | None = None,
    source: str | None = None,
    rejected: str | None = None,
) -> DataFrame:
    """``read_csv`` of files that all have one header, in a single scan."""
    tokens, types = list(na_tokens), types or {}
    cells = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("enforceSchema", False)
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path if isinstance(path, str) else list(path))
    )
    columns, failed = [], {}
    longest = max((len(t.encode()) for t in tokens), default=-1)
    for header in cells.columns:
        name, kind = RAW_COLUMNS.get(header, (header, "string"))
        kind = types.get(header, kind)
        text = F.col(f"`{header}`")
        present = F.when((F.octet_length(text) > longest) | ~text.isin(tokens), text)
        if kind == "string":
            columns.append(present.alias(name))
            continue
        value = present.try_cast(kind)
        columns.append(value.alias(name))
        failed[name] = (present.isNotNull() & value.isNull(), text)
    if source:
        columns.append(F.col("_metadata.file_path").alias(source))
    if rejected:
        columns.append(rejected_cells(failed).alias(rejected))
    return cells.select(*columns)


#: Type of a column of rejected cells.
REJECTED = "array<struct<column:string,text:string>>"


def rejected_cells(failed: Mapping[str, tuple[Column, Column]]) -> Column:
    """The cells of a row that fail, given for each column name its test and its text.

    Rows without any, which are the most, take the tests and nothing else. Conditions and ``concat``
    are compiled with the rest of the row; a filter of an array would be interpreted.
    """
    none = F.array().cast(REJECTED)
    if not failed:
        return none
    cells = {
        name: F.array(F.struct(F.lit(name).alias("column"), text.alias("text"))).cast(REJECTED)
        for name, (_, text) in failed.items()
    }
    found = F.concat(*[F.when(test, cells[name]).otherwise(none) for name, (test, _) in failed.items()])
    return F.when(reduce(or_, [test for test, _ in failed.values()]), found).otherwise(none)


def read_order_items(spark: SparkSession, path: str) -> DataFrame:
    """Prepared order items that ``write_mart`` stored; a filter on the year prunes files."""
    return spark.read.parquet(path)


def write_csv(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    limit: int | None = None,
    raw_headers: bool = False,
    encoding: str = "UTF-8",
    mode: str = "errorifexists",
    compression: str | None = None,
    partition_by: Sequence[str] = (),
) -> None:
    """Write the chosen columns as CSV with a header, every row unless ``limit`` is set.

    The files are written in parallel, one per partition; nothing passes the driver.
    ``limit`` takes the first rows in the order of the chosen columns. ``compression`` names
    a codec; Spark cannot split what gzip wrote, so partitions should be of moderate size.
    ``partition_by`` names columns that go into the names of folders and not into the files.
    """
    out = df.select(*columns) if columns else df
    if limit is not None:
        out = first_rows(out, out.columns, limit)
    if raw_headers:
        out = out.withColumnsRenamed({c: HEADER_OF[c] for c in out.columns if c in HEADER_OF})
    if compression:
        writer = out.write.mode(mode).option("compression", compression)
    else:
        writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    (
        writer.option("header", True)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_clustered(
    df: DataFrame,
    path: str,
    columns: Sequence[str] = FACETS,
    then: Sequence[str] = ("order_ts",),
    files: int | None = None,
    row_group_bytes: int = 32 << 20,
) -> None:
    """Store a prepared table so that filters on any of several facets skip most of it.

    Rows lie along a Z-order curve through ``columns``; readers compare a filter with the least
    and greatest value of each row group, so smaller groups skip more and compress less.
    """
    rows = z_ordered(df, columns, [c for c in then if c in df.columns], files)
    writer = rows.write.mode("errorifexists").option("parquet.block.size", row_group_bytes)
    writer.parquet(path, compression=COMPRESSION)


def write_mart(df: DataFrame, path: str, partition_by: Sequence[str] = ("order_year",)) -> None:
    """Store a prepared table as Parquet, split by the facet that is used first.

    The rebalance hint lets adaptive execution size the files: a year that holds a
    third of all rows is cut into many files, and small years are not shredded into
    one tiny file per task.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("errorifexists").partitionBy(
            *partition_by
        ).parquet(path)
    else:
        df.write.mode("errorifexists").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> None:
    """Store a table dealt into ``buckets`` by ``key`` and sorted by it, as ``table`` at ``path``.

    Spark remembers the layout, so aggregates by the key and joins of tables that are dealt alike
    need no exchange. A key that holds a third of all rows fills one bucket; orders do not.
    """
    dealt = df.repartition(buckets, F.col(f"`{key}`"))
    dealt.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
