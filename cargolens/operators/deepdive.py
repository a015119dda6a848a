"""Further questions about late risk, shares, orders and discounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.functions.measures import measure, percent
from cargolens.operators.quantiles import exact_quantiles
from cargolens.operators.reports import group_report, report, share_of_total
from cargolens.schema import AT_RISK_ORDER_STATUSES


def late_risk_rate(df: DataFrame) -> DataFrame:
    return df.agg(measure("late_risk_pct"), measure("late_risk_items"), measure("order_items"))


def late_risk_by(df: DataFrame, dim: str) -> DataFrame:
    grouped = group_report(df, [dim], [measure("late_risk_pct")])
    return grouped.orderBy(F.desc("late_risk_pct"), dim)


def total_share_by(df: DataFrame, dim: str, name: str) -> DataFrame:
    """A report by one dimension with each row's share of the whole."""
    grouped = group_report(df, [dim], [measure(name)])
    return share_of_total(grouped, name).orderBy(F.desc(name), dim)


def _only_quantile(df: DataFrame, column: str, probability: float):
    return exact_quantiles(df, [column], [probability]).select("value").scalar()


def low_margin_high_sales_products(
    df: DataFrame,
    probability: float = 0.75,
    margin_below: float = 10.0,
    basis: str = "item",
) -> DataFrame:
    """Products that sell above the quantile of sales but earn a thin margin.

    ``basis="item"`` compares a product's mean item sales with the quantile of item
    sales; ``basis="total"`` compares its total with the quantile of product totals.
    """
    products = group_report(
        df,
        ["product_name"],
        [measure("total_sales"), measure("avg_sales"), measure("margin_of_sums_pct")],
    )
    if basis == "item":
        compared, limit = "avg_sales", _only_quantile(df, "sales", probability)
    elif basis == "total":
        compared, limit = "total_sales", _only_quantile(products, "total_sales", probability)
    else:
        raise ValueError("basis is 'item' or 'total'")
    return products.where(
        (F.col(compared) > limit) & (F.col("margin_of_sums_pct") < margin_below)
    ).orderBy("margin_of_sums_pct", "product_name")


def discount_profit_corr(df: DataFrame) -> DataFrame:
    return df.agg(F.corr("discount_rate", F.col("profit").cast("double")).alias("pearson_r"))


def _order_values(df: DataFrame) -> DataFrame:
    return group_report(df, ["order_id"], [F.coalesce(F.sum("sales"), F.lit(0)).alias("order_sales")])


def avg_order_value_by_order(df: DataFrame) -> DataFrame:
    """Mean over orders of the order's sales, unlike the KPI, which is per item."""
    return _order_values(df).agg(
        F.try_divide(F.sum("order_sales").cast("double"), F.count("*")).alias("avg_order_value"),
        F.count("*").alias("orders"),
    )


def order_value_range(df: DataFrame) -> DataFrame:
    return _order_values(df).agg(
        F.min("order_sales").cast("double").alias("min_order_value"),
        F.max("order_sales").cast("double").alias("max_order_value"),
    )


def delivery_scorecard_weekly(
    df: DataFrame, alert_above: float = 60.0, rate: str = "late_rate_pct"
) -> DataFrame:
    """Late rate per week (from Monday), shipping mode and region, with an alert flag.

    ``rate`` is ``late_rate_pct``, of late deliveries, or ``late_risk_pct``, of items at risk.
    """
    weekly = df.withColumn("week_start", F.date_trunc("week", "order_ts").cast("date"))
    dims = ["week_start", "shipping_mode", "order_region"]
    scored = group_report(weekly, dims, [measure("order_items"), measure(rate)])
    return scored.withColumn("alert", F.col(rate) > alert_above).orderBy(*dims)


def high_margin_categories(df: DataFrame, n: int) -> list[str]:
    """The ``n`` categories with the best average margin, from the data. Runs a job."""
    return [r.category_name for r in report(df, "product", "category_profit_margin", n=n).collect()]


def discount_guardrails(
    df: DataFrame,
    high_margin_categories: Sequence[str],
    standard_cap: float = 0.15,
    high_margin_cap: float = 0.10,
    approval_above: float = 0.20,
) -> DataFrame:
    """Every item with the discount cap of its category and how it stands to it."""
    protected = F.coalesce(F.col("category_name").isin(*high_margin_categories), F.lit(False))
    cap = F.when(protected, high_margin_cap).otherwise(standard_cap)
    rate = F.col("discount_rate")
    return df.withColumns(
        {
            "discount_cap": cap,
            "guardrail": F.when(rate.isNull(), F.lit(None))
            .when(rate > approval_above, "needs approval")
            .when(rate > cap, "over cap")
            .otherwise("within cap"),
        }
    )


def guardrail_summary(guarded: DataFrame) -> DataFrame:
    """Items and profit per category and guardrail state."""
    return group_report(
        guarded, ["category_name", "guardrail"], [measure("order_items"), measure("total_profit")]
    ).orderBy("category_name", "guardrail")


def non_complete_share(
    df: DataFrame, statuses: Sequence[str] = AT_RISK_ORDER_STATUSES
) -> DataFrame:
    at_risk = F.count_if(F.coalesce(F.col("order_status").isin(*statuses), F.lit(False)))
    return df.agg(
        at_risk.alias("at_risk_items"),
        F.count("*").alias("order_items"),
        F.coalesce(percent(at_risk, F.count("*")), F.lit(0.0)).alias("at_risk_pct"),
    )
