"""The named report tables.

Every report is ``group by some dimensions, one aggregate, sort, maybe cut``. The
registry states those four things; ``report`` turns them into a lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.measures import measure, percent

KEY, DESC, ASC = "key", "desc", "asc"


@dataclass(frozen=True)
class Report:
    """``order`` sorts by the dimensions (``key``) or by the first measure."""

    dims: tuple[str, ...]
    measures: tuple[str, ...]
    order: str = KEY
    limit: int | None = None
    finish: Callable[[DataFrame], DataFrame] | None = None


def _by(dim: str, name: str, order: str = KEY, limit: int | None = None) -> Report:
    return Report((dim,), (name,), order, limit)


def _full_name(df: DataFrame) -> DataFrame:
    return df.withColumn("customer_name", F.concat_ws(" ", "customer_fname", "customer_lname"))


# The domains, the report names inside them, and how many rows a list shows.
DOMAINS: dict[str, dict[str, Report]] = {
    "sales": {
        "monthly_trend": _by("order_year_month", "total_sales"),
        "yearly_trend": _by("order_year", "total_sales"),
        "by_market": _by("market", "total_sales"),
        "by_region": _by("order_region", "total_sales", DESC),
        "by_segment": _by("customer_segment", "total_sales"),
        "by_shipping_mode": _by("shipping_mode", "total_sales"),
        "by_quarter": _by("order_quarter", "total_sales"),
    },
    "profit": {
        "monthly_trend": _by("order_year_month", "total_profit"),
        "yearly_trend": _by("order_year", "total_profit"),
        "by_market": _by("market", "total_profit"),
        "by_region": _by("order_region", "total_profit", DESC),
        "by_segment": _by("customer_segment", "total_profit"),
        "by_category": _by("category_name", "total_profit", DESC),
        "by_department": _by("department_name", "total_profit", DESC),
        "margin_by_market": _by("market", "avg_profit_margin_pct"),
        "margin_by_segment": _by("customer_segment", "avg_profit_margin_pct"),
    },
    "customer": {
        "segment_counts": _by("customer_segment", "order_items"),
        "sales_by_segment": _by("customer_segment", "total_sales"),
        "profit_by_segment": _by("customer_segment", "total_profit"),
        "top_customers": Report(
            ("customer_id", "customer_fname", "customer_lname"),
            ("total_sales",),
            DESC,
            20,
            _full_name,
        ),
        "segment_avg_order": _by("customer_segment", "avg_sales"),
        "payment_type_counts": _by("payment_type", "order_items"),
    },
    "product": {
        "sales_by_category": _by("category_name", "total_sales", DESC),
        "profit_by_category": _by("category_name", "total_profit", DESC),
        "sales_by_department": _by("department_name", "total_sales", DESC),
        "top_products_by_sales": _by("product_name", "total_sales", DESC, 15),
        "top_products_by_profit": _by("product_name", "total_profit", DESC, 15),
        "bottom_products": _by("product_name", "total_profit", ASC, 10),
        "category_profit_margin": _by("category_name", "avg_profit_margin_pct", DESC),
    },
    "shipping": {
        "mode_counts": _by("shipping_mode", "order_items"),
        "mode_sales": _by("shipping_mode", "total_sales"),
        "mode_avg_delay": _by("shipping_mode", "avg_delay_days"),
        "delay_distribution": _by("shipping_delay_days", "order_items"),
        "mode_late_rate": _by("shipping_mode", "late_rate_pct"),
    },
    "delivery": {
        "status_counts": _by("delivery_status", "order_items", DESC),
        "status_by_market": Report(("market", "delivery_status"), ("order_items",)),
        "late_by_region": _by("order_region", "late_rate_pct", DESC),
        "late_by_category": _by("category_name", "late_rate_pct", DESC),
        "order_status_counts": _by("order_status", "order_items", DESC),
        "late_by_year": _by("order_year", "late_rate_pct"),
    },
    "geo": {
        "sales_by_market": _by("market", "total_sales", DESC),
        "profit_by_market": _by("market", "total_profit", DESC),
        "sales_by_region": _by("order_region", "total_sales", DESC),
        "profit_by_region": _by("order_region", "total_profit", DESC),
        "sales_by_country": _by("order_country", "total_sales", DESC, 20),
        "market_order_count": _by("market", "total_orders"),
    },
    "overview": {
        "category_scatter": Report(
            ("category_name",), ("total_sales", "total_profit", "orders_present")
        ),
        "yearly_sales_vs_profit": Report(("order_year",), ("total_sales", "total_profit")),
        "rows_by_year": _by("order_year", "order_items"),
    },
}


def group_report(df: DataFrame, dims: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Group by the dimensions; rows that miss one of them belong to no group."""
    for dim in dims:
        df = df.where(F.col(dim).isNotNull())
    return df.groupBy(*dims).agg(*aggregates)


def sort_report(df: DataFrame, spec: Report) -> DataFrame:
    """Sort, with ties in the order of the keys, and cut."""
    value = spec.measures[0]
    if spec.order == DESC:
        df = df.orderBy(F.col(value).desc_nulls_last(), *spec.dims)
    elif spec.order == ASC:
        df = df.orderBy(F.col(value).asc_nulls_last(), *spec.dims)
    else:
        df = df.orderBy(*spec.dims)
    return df if spec.limit is None else df.limit(spec.limit)


def run_report(
    df: DataFrame, spec: Report, aggregate: Callable[[str], Column] = measure
) -> DataFrame:
    grouped = group_report(df, spec.dims, [aggregate(m) for m in spec.measures])
    result = sort_report(grouped, spec)
    return result if spec.finish is None else spec.finish(result)


def adjusted(spec: Report, n: int | None, order: str | None) -> Report:
    if order is not None:
        spec = replace(spec, order=order)
    if n is not None:
        spec = replace(spec, limit=n)
    return spec


def report(
    df: DataFrame, domain: str, name: str, n: int | None = None, order: str | None = None
) -> DataFrame:
    """One named report, optionally with another order or another number of rows.

    ``n`` replaces the report's own limit, be it smaller or larger.
    """
    return run_report(df, adjusted(DOMAINS[domain][name], n, order))


def analysis(df: DataFrame, domain: str) -> dict[str, DataFrame]:
    """All reports of a domain by name; each is a plan, nothing runs yet."""
    return {name: run_report(df, spec) for name, spec in DOMAINS[domain].items()}


def share_of_total(grouped: DataFrame, value: str, digits: int = 1) -> DataFrame:
    """Add ``share_pct``: the row's part of the sum over all rows of the report."""
    whole = grouped.agg(F.sum(value)).scalar()
    return grouped.withColumn("share_pct", F.round(percent(F.col(value), whole), digits))


def loss_flag(df: DataFrame, value: str = "total_profit") -> DataFrame:
    """Add ``is_loss``: the value is below zero."""
    return df.withColumn("is_loss", F.col(value) < 0)
