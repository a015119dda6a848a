"""Derived columns of the prepared table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.operators.cleaning import clean
from cargolens.operators.quantiles import exact_quantiles
from cargolens.schema import LATE_STATUS

# Bands from the lowest to the highest quarter of sales, and the band
# every row gets when the quartiles do not separate four bands.
REVENUE_BANDS = ("Low", "Medium", "High", "Very High")
FALLBACK_BAND = "Medium"
MARGIN_LIMIT = 200.0


def time_features(df: DataFrame) -> DataFrame:
    ts = F.col("order_ts")
    return df.withColumns(
        {
            "order_year": F.year(ts),
            "order_month": F.month(ts),
            "order_month_name": F.date_format(ts, "MMM"),
            "order_quarter": F.concat(F.lit("Q"), F.quarter(ts).cast("string")),
            "order_year_month": F.date_format(ts, "yyyy-MM"),
        }
    )


def shipping_features(df: DataFrame) -> DataFrame:
    late = F.coalesce((F.col("delivery_status") == LATE_STATUS).cast("int"), F.lit(0))
    return df.withColumns(
        {
            "shipping_delay_days": F.col("days_real") - F.col("days_scheduled"),
            "is_late": late,
        }
    )


def margin_feature(df: DataFrame) -> DataFrame:
    """Profit as percent of sales, kept within +-200; 0 where sales are 0."""
    sales, profit = F.col("sales").cast("double"), F.col("profit").cast("double")
    ratio = F.try_divide(profit, sales) * 100
    bounded = F.greatest(F.lit(-MARGIN_LIMIT), F.least(F.lit(MARGIN_LIMIT), ratio))
    return df.withColumn(
        "profit_margin_pct", F.when(sales == 0, F.lit(0.0)).when(ratio.isNotNull(), bounded)
    )


#: The quartile edges, ends included.
REVENUE_PROBABILITIES = (0.0, 0.25, 0.5, 0.75, 1.0)


def revenue_band_edges(df: DataFrame) -> DataFrame:
    """One row: the three inner quartiles of sales, and whether all five edges differ."""
    probabilities = REVENUE_PROBABILITIES
    quantiles = exact_quantiles(df, ["sales"], probabilities)
    edge = [F.max(F.when(F.col("probability") == p, F.col("value"))) for p in probabilities]
    distinct = F.size(F.collect_set("value")) == len(probabilities)
    return quantiles.agg(
        F.struct(
            edge[1].alias("q1"), edge[2].alias("q2"), edge[3].alias("q3"),
            distinct.alias("separate"),
        ).alias("edges")
    )


def revenue_band(sales: Column, edges: Column | Mapping[str, Column]) -> Column:
    low, medium, high, top = (F.lit(band) for band in REVENUE_BANDS)
    band = (
        F.when(sales <= edges["q1"], low)
        .when(sales <= edges["q2"], medium)
        .when(sales <= edges["q3"], high)
        .when(sales.isNotNull(), top)
    )
    return F.when(edges["separate"], band).otherwise(F.lit(FALLBACK_BAND))


def band_of_edges(sales: Column, edges: Sequence[float] | None) -> Column:
    """The band for edges that are known as numbers, as stored ones are."""
    if edges is None:
        return F.lit(None).cast("string")
    known = {f"q{i}": F.lit(edges[i]) for i in (1, 2, 3)}
    return revenue_band(sales, known | {"separate": F.lit(len(set(edges)) == len(edges))})


def revenue_feature(df: DataFrame) -> DataFrame:
    """Quarter of all sales the row falls into.

    The edges come from the whole input as a scalar subquery, which is planned only for
    queries that read the band.
    """
    edges = revenue_band_edges(df).scalar()
    return df.withColumn("revenue_band", revenue_band(F.col("sales").cast("double"), edges))


def engineer_features(df: DataFrame) -> DataFrame:
    """Add every derived column. Filter afterwards: bands refer to the whole input."""
    return (
        df.transform(time_features)
        .transform(shipping_features)
        .transform(margin_feature)
        .transform(revenue_feature)
    )


def prepare(raw: DataFrame) -> DataFrame:
    """Raw order items to the prepared table."""
    return raw.transform(clean).transform(engineer_features)
