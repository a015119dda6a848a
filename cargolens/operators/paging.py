"""Pages of a sorted table, each found from the last row of the one before.

An offset would sort and skip all rows before a page. A page that starts after a given row is a
filter, and its first condition reaches the scan: row groups that lie before the page are not
read. Rows that are equal in all sort columns are told apart by their file and place in it,
so none is shown twice or left out; the table has to be one that was read from Parquet files.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

#: Names of the two columns that tell equal rows apart.
_FILE, _PLACE = "__file", "__place"


@dataclass(frozen=True)
class Page:
    """Rows in order, and the values after which the next page starts; None after the last page."""

    rows: list[Row]
    after: tuple | None


def _literal(df: DataFrame, column: str, value) -> Column:
    kind = df.schema[column].dataType
    # a time without zone must not pass through the session's
    plain = value.isoformat(" ") if isinstance(kind, TimestampNTZType) else value
    return F.lit(plain).cast(kind)


def _behind(df: DataFrame, order: Sequence[str], after: Sequence) -> Column:
    """True for rows that come after the given values; missing ones come last."""
    conditions, equal = [], F.lit(True)
    for column, value in zip(order, after):
        here = F.col(f"`{column}`")
        if value is not None:
            conditions.append(equal & ((here > _literal(df, column, value)) | here.isNull()))
            equal = equal & (here == _literal(df, column, value))
        else:
            equal = equal & here.isNull()
    return reduce(or_, conditions, F.lit(False))


def page_of(df: DataFrame, order: Sequence[str], n: int, after: Sequence | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows by ``order``, or the first ``n`` behind ``after``, a page's own ``after``.

    Ascending, missing values last. One scan: every task keeps ``n`` rows at most. Beside the
    ``columns`` stand those that the next page starts from.
    """
    placed = df.withColumns({_FILE: F.col("_metadata.file_path"), _PLACE: F.col("_metadata.row_index")})
    whole = [*order, _FILE, _PLACE]
    if after is not None:
        first, value = f"`{order[0]}`", after[0]
        if value is None:
            placed = placed.where(F.col(first).isNull())
        else:  # implied by the next condition, but this one the scan understands
            placed = placed.where((F.col(first) >= _literal(placed, order[0], value)) | F.col(first).isNull())
        placed = placed.where(_behind(placed, whole, after))
    needed = list(dict.fromkeys([*(columns or df.columns), *whole]))
    shown = placed.select(*[f"`{c}`" for c in needed])
    return shown.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in whole]).limit(n)


def page(df: DataFrame, order: Sequence[str], n: int, after: Sequence | None = None, columns: Sequence[str] | None = None) -> Page:
    """``page_of`` as rows, and where the next page starts."""
    columns = list(columns or df.columns)
    found = page_of(df, order, n, after, columns).collect()
    token = tuple(found[-1][c] for c in (*order, _FILE, _PLACE)) if len(found) == n else None
    return Page([Row(**{c: r[c] for c in columns}) for r in found], token)
