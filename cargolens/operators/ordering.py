"""The first rows of a table in the order of some columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows by ``order``, ascending with missing values last.

    One scan: every task keeps a heap of ``n`` rows, and only these meet in one place,
    where again no more than ``n`` are held. What moves is ``n`` rows a task, so this is for
    the few rows that somebody looks at, not for sorting a table.
    """
    return df.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in order]).limit(n)
