"""Text expressions: trimming and number display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python calls white space; none lies beyond U+3000.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
ASCII_WHITESPACE = "".join(c for c in WHITESPACE if c.isascii())


def strip(column: Column | str) -> Column:
    """Remove white space of any kind from both ends.

    The cost of a trim grows with the set of characters, so text that is all ASCII, which
    its equal byte and character counts tell, is trimmed against the short set only.
    """
    return F.when(
        F.octet_length(column) == F.char_length(column), F.btrim(column, F.lit(ASCII_WHITESPACE))
    ).otherwise(F.btrim(column, F.lit(WHITESPACE)))


def fixed_point(value: Column, digits: int) -> Column:
    """``value`` with ``digits`` decimals and no thousands separators."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def grouped(value: Column, digits: int = 0) -> Column:
    """``value`` with ``digits`` decimals and thousands separators."""
    return F.format_number(value, digits)


def fmt_currency(column: Column | str) -> Column:
    """Compact dollars: millions as ``$1.23M``, thousands as ``$1.2K``, else ``$1.23``."""
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    return (
        F.when(F.abs(value) >= 1e6, F.concat(F.lit("$"), fixed_point(value / 1e6, 2), F.lit("M")))
        .when(F.abs(value) >= 1e3, F.concat(F.lit("$"), fixed_point(value / 1e3, 1), F.lit("K")))
        .when(value.isNotNull(), F.concat(F.lit("$"), fixed_point(value, 2)))
    )


def fmt_number(column: Column | str) -> Column:
    """Whole number with thousands separators; fractions are cut off."""
    value = F.col(column) if isinstance(column, str) else column
    return F.format_number(value.cast("bigint"), 0)


def fmt_percent(column: Column | str) -> Column:
    """One decimal and a percent sign."""
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.concat(fixed_point(value, 1), F.lit("%"))
