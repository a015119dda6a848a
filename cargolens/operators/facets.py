"""Faceted slicing: predicate, choices and coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.measures import percent
from cargolens.operators.ordering import first_rows
from cargolens.schema import EXPLORER_COLUMNS, FACETS

Selection = Mapping[str, Sequence]


def _conditions(selection: Selection) -> list[Column]:
    unknown = set(selection) - set(FACETS)
    if unknown:
        raise ValueError(f"not a facet: {sorted(unknown)}")
    return [F.col(facet).isin(*values) for facet, values in selection.items() if values]


def facet_predicate(selection: Selection) -> Column:
    """AND over facets, IN within one. An empty choice switches its facet off."""
    matches = reduce(and_, _conditions(selection), F.lit(True))
    return F.coalesce(matches, F.lit(False))


def facet_filter(df: DataFrame, selection: Selection) -> DataFrame:
    """The rows that match the selection; each condition can reach the Parquet scan."""
    for condition in _conditions(selection):
        df = df.where(condition)
    return df


def facet_options(df: DataFrame, facets: Sequence[str] = FACETS) -> DataFrame:
    """Rows ``(facet, option)``: the sorted distinct values of each facet, in one scan."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in facets])
    return (
        texts.unpivot([], list(facets), "facet", "option")
        .where(F.col("option").isNotNull())
        .distinct()
        .orderBy("facet", "option")
    )


def drill_options(df: DataFrame, selection: Selection, facets: Sequence[str] = FACETS) -> DataFrame:
    """Rows ``(facet, option, items, chosen)``: what each facet offers under the choices in the others.

    An option's items obey the choices in all facets but its own, so a sidebar shows what adding
    the option would bring. One scan: every row gets a bit for each facet whose choice it fails. A
    row without any counts for all facets, one with a single bit for that facet alone, and
    others leave before anything is multiplied. Options without items are not listed.
    """
    unknown = set(selection) - set(facets)
    if unknown:
        raise ValueError(f"not a facet: {sorted(unknown)}")
    active = {f: list(values) for f, values in selection.items() if values}
    bit = {f: 1 << i for i, f in enumerate(facets)}
    fails = [
        F.when(F.coalesce(F.col(f).isin(*values), F.lit(False)), 0).otherwise(bit[f]) for f, values in active.items()
    ]
    failed = reduce(lambda a, b: a.bitwiseOR(b), fails, F.lit(0))
    rows = df.select(failed.alias("failed"), *[F.col(f).cast("string").alias(f) for f in facets])
    counted = rows.where(F.bit_count("failed") <= 1).unpivot(["failed"], list(facets), "facet", "option")
    bits = F.coalesce(*[F.when(F.col("facet") == f, b) for f, b in bit.items()])
    counted = counted.where(F.col("option").isNotNull() & ((F.col("failed") == 0) | (F.col("failed") == bits)))
    chosen = [
        F.when(F.col("facet") == f, F.col("option").isin(*[str(v) for v in values])) for f, values in active.items()
    ]
    counted = counted.groupBy("facet", "option").agg(F.count("*").alias("items"))
    return counted.withColumn("chosen", F.coalesce(*chosen, F.lit(False))).orderBy("facet", "option")


def filter_coverage(df: DataFrame, selection: Selection) -> DataFrame:
    """Matching rows, all rows and their percentage, in one pass."""
    matching = F.count_if(facet_predicate(selection))
    everything = F.count("*")
    return df.agg(
        matching.alias("filtered_rows"),
        everything.alias("total_rows"),
        F.round(F.coalesce(percent(matching, everything), F.lit(0.0)), 1).alias("filtered_pct"),
    )


def explore(
    df: DataFrame, columns: Sequence[str] | None = None, limit: int | None = None
) -> DataFrame:
    """The chosen columns; with ``limit``, the first rows in the order of those columns."""
    names = [c for c in (columns or EXPLORER_COLUMNS) if c in df.columns]
    shown = df.select(*names)
    return shown if limit is None else first_rows(shown, names, limit)
