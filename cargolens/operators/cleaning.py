"""Cleaning: one projection and one filter, so it runs inside the scan stage."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cargolens.functions.text import strip
from cargolens.schema import DATE_FORMAT, DROPPED_COLUMNS

_DATES = {"order_date_raw": "order_ts", "shipping_date_raw": "shipping_ts"}
_FILLS = {"customer_lname": "Unknown", "customer_zipcode": 0.0}
_REQUIRED = ("sales", "profit")


def parse_date(column: Column | str) -> Column:
    """A date-time without zone, or null when the text is not one.

    The text is read as UTC and counted from an epoch without zone, so the hours that the
    session's zone skips in spring are read as written.
    """
    instant = F.try_to_timestamp(F.concat(column, F.lit(" Z")), F.lit(f"{DATE_FORMAT} X"))
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", F.unix_seconds(instant), epoch)


def _cleaned_columns(df: DataFrame, strip_text: bool = True) -> list[Column]:
    columns = []
    for name, kind in df.dtypes:
        if name in DROPPED_COLUMNS:
            continue
        value = F.col(f"`{name}`")
        if name in _DATES:
            columns.append(parse_date(name).alias(_DATES[name]))
            continue
        if kind == "string" and strip_text:
            value = strip(value)
        elif kind in ("double", "float"):
            value = F.when(~F.isnan(value), value)
        if name in _FILLS:
            value = F.coalesce(value, F.lit(_FILLS[name]))
        columns.append(value.alias(name))
    return columns


def complete_row() -> Column:
    """Both core measures are there."""
    present = F.lit(True)
    for name in _REQUIRED:
        present = present & F.col(name).isNotNull()
    return present


def clean_rows(raw: DataFrame) -> DataFrame:
    """``clean`` without dropping any row."""
    return raw.select(*_cleaned_columns(raw))


def clean(raw: DataFrame) -> DataFrame:
    """Parse dates, strip text, drop unused columns, fill gaps, drop incomplete rows.

    Rows whose dates cannot be read stay, with null dates. Text is stripped before gaps
    are filled, so a blank last name becomes empty and not ``Unknown``.
    """
    return clean_rows(raw).where(complete_row())


def _counters(columns: list[str]) -> list[Column]:
    gaps = reduce(add, [F.col(f"`{c}`").isNull().cast("int") for c in columns])
    return [
        F.count("*").alias("original_rows"),
        F.count_if(complete_row()).alias("cleaned_rows"),
        F.coalesce(F.sum(F.when(complete_row(), gaps)), F.lit(0)).alias("missing_after"),
    ]


def _summary(counted: DataFrame, before: int, after: int) -> DataFrame:
    return counted.select(
        "original_rows",
        F.lit(before).alias("original_cols"),
        "cleaned_rows",
        F.lit(after).alias("cleaned_cols"),
        (F.col("original_rows") - F.col("cleaned_rows")).alias("rows_dropped"),
        F.lit(before - after).alias("cols_dropped"),
        "missing_after",
    )


def clean_summary(raw: DataFrame) -> DataFrame:
    """Rows and columns before and after cleaning, and the gaps left, in one pass.

    Stripping text makes no cell missing, so it is left out here.
    """
    tidy = raw.select(*_cleaned_columns(raw, strip_text=False))
    return _summary(tidy.agg(*_counters(tidy.columns)), len(raw.columns), len(tidy.columns))


def clean_and_observe(raw: DataFrame) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """``clean(raw)``, and what gives its summary once the rows have been written or counted."""
    tidy = raw.select(*_cleaned_columns(raw))
    seen = Observation()
    before, after = len(raw.columns), len(tidy.columns)

    def summary() -> DataFrame:
        names = ("original_rows", "cleaned_rows", "missing_after")
        row = tuple(seen.get[name] for name in names)
        counted = raw.sparkSession.createDataFrame([row], ", ".join(f"{n} bigint" for n in names))
        return _summary(counted, before, after)

    return tidy.observe(seen, *_counters(tidy.columns)).where(complete_row()), summary
