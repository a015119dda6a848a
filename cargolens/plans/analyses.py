"""The analyses by business domain, and loading to a prepared table in one call.

Each analysis takes the prepared table, whole or filtered, and returns its reports by
name. A report is a plan: only the ones that are shown or written cost anything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from cargolens.operators.cleaning import clean_and_observe
from cargolens.operators.features import engineer_features
from cargolens.operators.reports import analysis
from cargolens.sources.files import read_csv
from cargolens.sources.staging import new_path, written_out


def load_and_prepare(
    spark: SparkSession, path: str | Sequence[str], mart_path: str | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """The prepared table of CSV files, and the one-row cleaning summary.

    The text is parsed once: the cleaned rows are written below ``mart_path`` while the
    summary's counters are observed, and the table with all features beside them. Without
    a path a new one below ``spark.checkpoint.dir`` is taken. ``options`` go to ``read_csv``.
    """
    folder = mart_path or new_path(spark, "mart")
    rows, summary = clean_and_observe(read_csv(spark, path, **options))
    cleaned = written_out(rows, f"{folder}/cleaned")
    return written_out(engineer_features(cleaned), f"{folder}/prepared"), summary()


def sales_analysis(df: DataFrame) -> dict[str, DataFrame]:
    return analysis(df, "sales")


def profit_analysis(df: DataFrame) -> dict[str, DataFrame]:
    return analysis(df, "profit")


def customer_analysis(df: DataFrame) -> dict[str, DataFrame]:
    return analysis(df, "customer")


def product_analysis(df: DataFrame) -> dict[str, DataFrame]:
    return analysis(df, "product")


def shipping_analysis(df: DataFrame) -> dict[str, DataFrame]:
    return analysis(df, "shipping")


def delivery_analysis(df: DataFrame) -> dict[str, DataFrame]:
    return analysis(df, "delivery")


def geo_analysis(df: DataFrame) -> dict[str, DataFrame]:
    return analysis(df, "geo")
