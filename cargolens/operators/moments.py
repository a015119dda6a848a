"""Deviations and correlations from stored groups.

Sums of squares lose their digits when a large mean is taken off in the end. Groups keep
their count, mean and sums of deviations from that mean instead; merged, a group adds its own
deviations and those of its mean from the common one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pair(x: str, y: str) -> tuple[Column, Column]:
    """Both columns as doubles where both have a value."""
    a, b = F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a), F.when(both, b)


def comoments_of(x: str, y: str) -> list[Column]:
    """Aggregates that describe two columns together, over items: n, two means, three deviations."""
    a, b = _pair(x, y)
    n = F.count(a)
    return [
        n.alias("pairs"),
        F.avg(a).alias("mean_x"),
        F.avg(b).alias("mean_y"),
        (F.var_pop(a) * n).alias("dev_xx"),
        (F.var_pop(b) * n).alias("dev_yy"),
        (F.covar_pop(a, b) * n).alias("dev_xy"),
    ]


def merged_comoments(groups: DataFrame) -> DataFrame:
    """One row with the same columns for all groups together."""
    weighted = lambda m: F.sum(F.col("pairs") * F.col(m)) / F.sum("pairs")
    means = groups.agg(F.struct(weighted("mean_x").alias("x"), weighted("mean_y").alias("y"))).scalar()
    off = {m: F.col(f"mean_{m}") - means[m] for m in "xy"}

    def deviation(a: str, b: str) -> Column:
        return F.sum(F.col(f"dev_{a}{b}") + F.col("pairs") * off[a] * off[b]).alias(f"dev_{a}{b}")

    return groups.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        weighted("mean_x").alias("mean_x"),
        weighted("mean_y").alias("mean_y"),
        deviation("x", "x"),
        deviation("y", "y"),
        deviation("x", "y"),
    )


def correlation(merged: DataFrame) -> DataFrame:
    """Pearson's r of merged groups; null where one of the two does not vary."""
    scale = F.sqrt(F.col("dev_xx")) * F.sqrt(F.col("dev_yy"))
    return merged.select(F.try_divide(F.col("dev_xy"), scale).alias("pearson_r"))


def deviations(merged: DataFrame) -> DataFrame:
    """Count, means and sample deviations of merged groups."""
    sample = lambda d: F.sqrt(F.try_divide(F.col(d), F.col("pairs") - 1))
    return merged.select("pairs", "mean_x", sample("dev_xx").alias("std_x"), "mean_y", sample("dev_yy").alias("std_y"))
