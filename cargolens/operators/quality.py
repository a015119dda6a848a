"""Profile and quality checks of the raw table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.measures import percent
from cargolens.operators.cleaning import parse_date
from cargolens.operators.ordering import first_rows
from cargolens.operators.quantiles import exact_quantiles
from cargolens.operators.samples import DRAW, with_draw
from cargolens.schema import CATEGORICAL_COLUMNS

_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")


def numeric_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind.split("(")[0] in _NUMERIC]


def dataset_shape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("row_count"), F.lit(len(df.columns)).alias("column_count")
    )


def _col(name: str) -> Column:
    """A column by its name, which may hold dots."""
    return F.col(f"`{name}`")


def _per_column(df: DataFrame, counts: dict, name: str) -> DataFrame:
    """One aggregate per column, turned from one wide row into one row per column."""
    row = df.agg(F.array(*[counts[c] for c in df.columns]).alias("each"), F.count("*").alias("__rows"))
    names = F.array(*[F.lit(c) for c in df.columns])
    pairs = F.explode(F.arrays_zip(names.alias("column_name"), F.col("each").alias(name)))
    return row.select("__rows", pairs.alias("pair")).select(
        "__rows", F.col("pair")["column_name"].alias("column_name"), F.col("pair")[name].alias(name)
    )


def column_types(df: DataFrame) -> DataFrame:
    """Rows ``(column_name, data_type, non_null_count)``."""
    counted = _per_column(df, {c: F.count(_col(c)) for c in df.columns}, "non_null_count")
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return counted.select("column_name", kinds[F.col("column_name")].alias("data_type"), "non_null_count")


def numeric_describe(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False
) -> DataFrame:
    """Count, mean, sample deviation, extremes and inner quartiles of each numeric column.

    Everything but the quartiles comes from one wide aggregate. Columns without any value
    are listed with count 0. ``approximate`` takes the quartiles from the same pass, off by
    at most a ten-thousandth of the rows.
    """
    names = list(columns or numeric_columns(df))
    doubles = df.select(*[_col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    shown = [F.when(~F.isnan(f"c{i}"), F.col(f"c{i}")) for i in range(len(names))]
    inner = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    rough = [F.percentile_approx(v, list(inner.values()), 10_000) if approximate else F.lit(None).cast("array<double>") for v in shown]
    wide = doubles.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.count(v).alias("count"),
                    F.round(F.avg(v), 2).alias("mean"),
                    F.round(F.stddev_samp(v), 2).alias("std"),
                    F.round(F.min(v), 2).alias("min"),
                    F.round(F.max(v), 2).alias("max"),
                    r.alias("rough"),
                )
                for c, v, r in zip(names, shown, rough)
            ]
        ).alias("each")
    )
    moments = wide.select(F.inline("each"))
    if approximate:
        quartiles = [F.round(F.get("rough", i), 2).alias(label) for i, label in enumerate(inner)]
        described = moments.select("*", *quartiles)
    else:
        quantiles = (
            exact_quantiles(df, names, tuple(inner.values()))
            .groupBy("column_name")
            .agg(
                *[
                    F.round(F.max(F.when(F.col("probability") == p, F.col("value"))), 2).alias(label)
                    for label, p in inner.items()
                ]
            )
        )
        described = moments.join(quantiles, "column_name", "left")
    return described.select("column_name", "count", "mean", "std", "min", *inner, "max")


def categorical_values(
    df: DataFrame, columns: Sequence[str] = CATEGORICAL_COLUMNS
) -> DataFrame:
    """Rows ``(column_name, value)``: the distinct values of the columns present."""
    names = [c for c in columns if c in df.columns]
    texts = df.select(*[_col(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)])
    listed = F.array(*[F.lit(c) for c in names])
    number = F.substring("column_no", 2, 9).cast("int")
    return (
        texts.unpivot([], texts.columns, "column_no", "value")
        .where(F.col("value").isNotNull())
        .distinct()
        .select(F.get(listed, number).alias("column_name"), "value")
    )


def categorical_uniques(
    df: DataFrame, columns: Sequence[str] = CATEGORICAL_COLUMNS
) -> DataFrame:
    """Rows ``(column_name, unique_values)`` for the columns present, 0 for an empty one."""
    names = [c for c in columns if c in df.columns]
    counted = categorical_values(df, names).groupBy("column_name").agg(F.count("*").alias("n"))
    listed = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in names])).alias("column_name"))
    return listed.join(counted, "column_name", "left").select(
        "column_name", F.coalesce("n", F.lit(0)).alias("unique_values")
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Columns with gaps: how many cells are missing and what share, most first."""
    gaps = _per_column(df, {c: F.count_if(_col(c).isNull()) for c in df.columns}, "missing_count")
    return (
        gaps.where(F.col("missing_count") > 0)
        .select(
            "column_name",
            "missing_count",
            F.round(percent(F.col("missing_count"), F.col("__rows")), 2).alias("missing_pct"),
        )
        .orderBy(F.desc("missing_count"), "column_name")
    )


def missing_cells(df: DataFrame) -> DataFrame:
    gaps = reduce(add, [F.count_if(_col(c).isNull()) for c in df.columns])
    return df.agg(gaps.alias("missing_cells"))


def duplicate_rows(df: DataFrame, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """How many rows repeat an earlier row in every column; missing equals missing.

    Only a 64-bit row hash is shuffled at first. The full rows are compared just for
    hashes seen more than once, so equal hashes of different rows do no harm and copies
    are still collapsed inside each task. ``store`` writes the repeated hashes and reads them
    back: their size is then known before any row moves, and few are broadcast. Without
    it all rows are shuffled to meet them.
    """
    every = [_col(c) for c in df.columns]
    hashed = df.withColumn("row_hash", F.xxhash64(*every))
    repeated = (
        hashed.groupBy("row_hash").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("row_hash")
    )
    copies = (
        hashed.join(store(repeated) if store else repeated, "row_hash", "left_semi")
        .groupBy(*every)
        .agg((F.count("*") - 1).alias("extra"))
    )
    return copies.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_rows"))


def negative_sales(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("sales") < 0).alias("negative_sales_rows"))


def negative_profit(df: DataFrame) -> DataFrame:
    rows = F.count_if(F.col("profit") < 0)
    return df.agg(
        rows.alias("negative_profit_rows"),
        F.round(F.coalesce(percent(rows, F.count("*")), F.lit(0.0)), 1).alias(
            "negative_profit_pct"
        ),
    )


def invalid_dates(raw: DataFrame) -> DataFrame:
    unreadable = F.count_if(parse_date("order_date_raw").isNull())
    return raw.agg(unreadable.alias("invalid_order_dates"))


def order_date_range(raw: DataFrame) -> DataFrame:
    parsed = raw.select(parse_date("order_date_raw").alias("ts"))
    return parsed.agg(F.min("ts").alias("first_order"), F.max("ts").alias("last_order"))


def sample_rows(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], n: int = 5000, seed: int = 42
) -> DataFrame:
    """``n`` rows drawn by the order of a seeded hash of ``keys``.

    The draw depends on the data alone: partitioning and retries cannot change it.
    """
    drawn = with_draw(df, keys, seed).select(*columns, DRAW)
    return first_rows(drawn, [DRAW, *columns], n).drop(DRAW)
