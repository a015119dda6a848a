"""Dimensions of small vocabularies as one number, so that grouping moves numbers and not texts.

Groups of nine facets are formed by a shuffle of nine texts a row. Where the vocabularies are small,
the places of the nine values in their sorted vocabularies fit one number of 63 bits; it takes
their place until the groups are formed and is then turned back into the values. Dimensions
with more values, or of other types than text and whole numbers, stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: From more values on a dimension stays as it is.
MOST = 255
CODE = "__code"
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def small_vocabularies(df: DataFrame, dims: Sequence[str], most: int = MOST) -> dict[str, list]:
    """The sorted values of every text or whole-number dimension that has at most ``most``.

    One scan; the driver gets no more than ``most`` + 1 values of a dimension.
    """
    kinds = dict(df.dtypes)
    names = [d for d in dims if kinds[d] in ("string", *_WHOLE)]
    if not names:
        return {}
    texts = df.select(*[F.col(f"`{d}`").cast("string").alias(f"d{i}") for i, d in enumerate(names)])
    found = texts.unpivot([], texts.columns, "dim", "value").where(F.col("value").isNotNull()).distinct()
    place = F.row_number().over(W.partitionBy("dim").orderBy("value"))
    found = found.withColumn("place", place).where(F.col("place") <= most + 1).select("dim", "value").collect()
    values: dict[str, list] = {d: [] for d in names}
    for row in found:
        name = names[int(row.dim[1:])]
        values[name].append(int(row.value) if kinds[name] in _WHOLE else row.value)
    order = lambda v: v.encode() if isinstance(v, str) else v
    return {d: sorted(v, key=order) for d, v in values.items() if len(v) <= most}


def place_in(value: Column, bounds: Sequence[tuple[Column, int]]) -> Column:
    """The number of the last bound that is not over the value, by halving; bounds rise."""
    if len(bounds) == 1:
        return F.lit(bounds[0][1])
    half = len(bounds) // 2
    return F.when(value < bounds[half][0], place_in(value, bounds[:half])).otherwise(place_in(value, bounds[half:]))


def coded(
    df: DataFrame, dims: Sequence[str], plain: Sequence[str] = (), vocabularies: Mapping[str, list] | None = None
) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """``df`` with the number, what to group by in place of ``dims``, and what brings these back.

    Missing values have place 0. Dimensions that do not fit the number, and ``plain`` ones, by which
    the rows may be dealt already, stay columns. ``vocabularies`` are those of ``small_vocabularies`` for
    the other dimensions of the same rows, where they are known; else a scan finds them.
    """
    kinds = dict(df.dtypes)
    parts, bits = [], 0
    if vocabularies is None:
        vocabularies = small_vocabularies(df, [d for d in dims if d not in plain])
    for name, values in sorted(vocabularies.items(), key=lambda x: len(x[1])):
        width = len(values).bit_length()
        if bits + width <= 63:
            parts.append((name, [F.lit(v).cast(kinds[name]) for v in values], bits, width))
            bits += width
    if len(parts) < 2:
        return df, list(dims), lambda groups: groups
    code = F.lit(0).cast("bigint")
    for name, values, at, _ in parts:
        if values:
            value = F.col(f"`{name}`")
            place = place_in(value, [(v, i + 1) for i, v in enumerate(values)])
            place = F.when(value.isNull(), 0).otherwise(place).cast("bigint")
            code = code.bitwiseOR(F.shiftleft(place, at))
    inside = {name for name, *_ in parts}

    def opened(groups: DataFrame) -> DataFrame:
        back = {}
        for name, values, at, width in parts:
            place = F.shiftright(CODE, at).bitwiseAND((1 << width) - 1).cast("int")
            none = F.lit(None).cast(kinds[name])
            back[name] = F.get(F.array(*values), place - 1) if values else none
        shown = [back[d].alias(d) if d in back else F.col(f"`{d}`") for d in dims]
        return groups.select(*shown, *[F.col(f"`{c}`") for c in groups.columns if c not in (CODE, *dims)])

    return df.withColumn(CODE, code), [CODE, *[d for d in dims if d not in inside]], opened
