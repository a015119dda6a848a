"""Exact interpolated quantiles that never gather a column in one task.

``F.percentile`` keeps every distinct value of a group in one task's memory. Here the
value is found by narrowing instead: a coarse histogram tells which bins hold the wanted
ranks, a fine histogram inside those few bins narrows them again, and only the values
left in the fine bins are counted one by one. Each step is a scan with map-side combine
whose shuffle is a histogram, not the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_COARSE_PER_UNIT = 512  # bins per unit of log(1 + |value|): about 0.2 % wide
_FINE_BINS = 16384


def coarse_bin() -> Column:
    """A bin number that never decreases as the value grows."""
    return F.floor(F.signum("value") * F.log1p(F.abs("value")) * _COARSE_PER_UNIT)


def _fine_bin() -> Column:
    """Equal steps between the smallest and the largest value of the coarse bin."""
    share = F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))
    return F.floor(share * _FINE_BINS)


def _histogram(values: DataFrame, bin_number: Column, *within: str) -> DataFrame:
    return values.groupBy(*within, bin_number.alias("bin")).agg(
        F.count("*").alias("n"), F.min("value").alias("bin_lo"), F.max("value").alias("bin_hi")
    )


def _spans_with_ranks(histogram: DataFrame, *within: str) -> DataFrame:
    """The bins that hold a wanted rank, one row per bin and rank."""
    upto = F.sum("n").over(W.partitionBy(*within).orderBy("bin"))
    inside = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n")))
    return (
        histogram.withColumn("below", F.col("start") + upto - F.col("n"))
        .withColumn("ranks", inside)
        .where(F.size("ranks") > 0)
    )


def _inside(values: DataFrame, spans: DataFrame) -> DataFrame:
    """The values inside the spans. Spans do not overlap, and there are at most two per
    column and probability, which bounds the broadcast."""
    return values.join(
        F.broadcast(spans),
        (F.col("column_no") == F.col("span_no"))
        & F.col("value").between(F.col("lo"), F.col("hi")),
    )


def _open_spans(bins: DataFrame) -> DataFrame:
    """Bins of more than one value, which the next step has to look into."""
    return bins.where(F.col("bin_lo") < F.col("bin_hi")).select(
        F.col("column_no").alias("span_no"),
        F.col("bin_lo").alias("lo"),
        F.col("bin_hi").alias("hi"),
        F.col("below").alias("start"),
        "last",
        "ranks",
    )


def _settled(bins: DataFrame) -> DataFrame:
    """Bins of a single value: the value at their ranks is known."""
    return bins.where(F.col("bin_lo") == F.col("bin_hi")).select(
        "column_no", "last", F.explode("ranks").alias("rank"), F.col("bin_lo").alias("value")
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """Rows ``(column_name, probability, value)``; missing values are skipped.

    A quantile between two ranks is interpolated linearly. Columns without any value
    yield no rows.
    """
    # Columns go by number on the way: joining and grouping by a number is far cheaper.
    numbered = {str(number): name for number, name in enumerate(columns)}
    doubles = df.select(*[F.col(f"`{name}`").cast("double").alias(no) for no, name in numbered.items()])
    values = (
        doubles.unpivot([], list(numbered), "column_no", "value")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .withColumn("column_no", F.coalesce(F.col("column_no").cast("int"), F.lit(0)))
    )

    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    coarse = _histogram(values, coarse_bin(), "column_no").withColumns(
        {
            "last": F.sum("n").over(W.partitionBy("column_no")) - 1,
            "start": F.lit(0).cast("bigint"),
        }
    )
    positions = F.transform(wanted, lambda p: p * F.col("last"))
    ranks = F.array_distinct(
        F.flatten(F.transform(positions, lambda at: F.array(F.floor(at), F.ceil(at))))
    )
    coarse = _spans_with_ranks(coarse.withColumn("ranks", ranks), "column_no")

    span = ["column_no", "lo", "hi", "start", "last", "ranks"]
    fine = _histogram(_inside(values, _open_spans(coarse)), _fine_bin(), *span)
    fine = _spans_with_ranks(fine, *span)

    single = _inside(values, _open_spans(fine)).groupBy(*span, "value").agg(
        F.count("*").alias("n")
    )
    single = _spans_with_ranks(single.withColumn("bin", F.col("value")), *span)
    at_rank = (
        _settled(coarse)
        .unionByName(_settled(fine))
        .unionByName(
            single.select("column_no", "last", F.explode("ranks").alias("rank"), "value")
        )
    )

    ends = (
        at_rank.withColumn("probability", F.explode(wanted))
        .withColumn("position", F.col("probability") * F.col("last"))
        .where(F.col("rank").isin(F.floor("position"), F.ceil("position")))
    )
    lower, upper = F.min("value"), F.max("value")
    share = F.first("position") - F.floor(F.first("position"))
    names = F.array(*[F.lit(name) for name in columns])
    return (
        ends.groupBy("column_no", "probability")
        .agg((lower + (upper - lower) * share).alias("value"))
        .select(names[F.col("column_no")].alias("column_name"), "probability", "value")
    )
