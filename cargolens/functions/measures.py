"""Aggregates shared by all reports.

Missing values are skipped, a sum over nothing is 0 and a mean over nothing is null.
Sums keep the input type until the last step, so decimal money adds up exactly and in
any order; only the result becomes a double.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargolens.schema import ON_TIME_STATUSES


# What measures are made of: aggregates of order items that simply add up, so groups can
# be formed in steps and the result is the same.
PARTS = {
    "items": lambda: F.count("*"),
    "orders_n": lambda: F.count("order_id"),
    "sales_sum": lambda: F.sum("sales"),
    "sales_n": lambda: F.count("sales"),
    "profit_sum": lambda: F.sum("profit"),
    "profit_n": lambda: F.count("profit"),
    "margin_sum": lambda: F.sum("profit_margin_pct"),
    "margin_n": lambda: F.count("profit_margin_pct"),
    "delay_sum": lambda: F.sum("shipping_delay_days"),
    "delay_n": lambda: F.count("shipping_delay_days"),
    "discount_sum": lambda: F.sum("discount_rate"),
    "discount_n": lambda: F.count("discount_rate"),
    "late_n": lambda: F.sum("is_late"),
    "risk_sum": lambda: F.sum("late_delivery_risk"),
    "risk_n": lambda: F.count("late_delivery_risk"),
    "on_time_n": lambda: F.count_if(on_time()),
}

# The columns that parts are made of.
MEASURE_COLUMNS = (
    "order_id", "sales", "profit", "profit_margin_pct", "shipping_delay_days", "discount_rate",
    "is_late", "late_delivery_risk", "delivery_status",
)

# Each measure as a formula over parts; ``part`` turns a part's name into an aggregate.
MEASURES = {
    "order_items": lambda part: part("items"),
    "orders_present": lambda part: part("orders_n"),
    "total_sales": lambda part: _or_zero(part("sales_sum")),
    "total_profit": lambda part: _or_zero(part("profit_sum")),
    "avg_sales": lambda part: _ratio(part("sales_sum"), part("sales_n")),
    "avg_profit": lambda part: _ratio(part("profit_sum"), part("profit_n")),
    "margin_of_sums_pct": lambda part: _ratio(part("profit_sum"), part("sales_sum")) * 100,
    "avg_profit_margin_pct": lambda part: _ratio(part("margin_sum"), part("margin_n")),
    "avg_delay_days": lambda part: _ratio(part("delay_sum"), part("delay_n")),
    "avg_discount_pct": lambda part: _ratio(part("discount_sum"), part("discount_n")) * 100,
    "late_rate_pct": lambda part: _ratio(part("late_n"), part("items")) * 100,
    "late_risk_pct": lambda part: _ratio(part("risk_sum"), part("risk_n")) * 100,
    "late_risk_items": lambda part: F.coalesce(part("risk_sum"), F.lit(0)),
    "on_time_items": lambda part: part("on_time_n"),
    "on_time_pct": lambda part: _ratio(part("on_time_n"), part("items")) * 100,
}


def _or_zero(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def _ratio(part: Column, whole: Column) -> Column:
    """A quotient of doubles, null when the whole is zero or missing."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return _ratio(part, whole) * 100


def on_time(status: str = "delivery_status") -> Column:
    """True for the two on-time statuses; a missing status is not on time."""
    return F.coalesce(F.col(status).isin(*ON_TIME_STATUSES), F.lit(False))


def measure(name: str) -> Column:
    """The named aggregate over order items."""
    if name == "total_orders":  # distinct orders do not add up
        return F.count_distinct("order_id").alias(name)
    return MEASURES[name](lambda part: PARTS[part]()).alias(name)


def parts_of(names: Sequence[str]) -> list[Column]:
    """The parts the measures need, as aggregates over order items."""
    needed: dict[str, None] = {}
    for name in names:
        MEASURES[name](lambda part: needed.setdefault(part) or F.lit(0))
    return [PARTS[part]().alias(part) for part in needed]


def measure_of_parts(name: str) -> Column:
    """The named aggregate over groups that hold parts."""
    return MEASURES[name](F.sum).alias(name)
