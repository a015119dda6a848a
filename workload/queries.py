"""Every registered query: ``(spark, folder of the tables) -> DataFrame``.

All of them read order items bound from the star schema. The raw table and the prepared
table are staged once per session, as the dashboard behind these queries would do, and
each query scans only the columns it uses. Doubles are rounded to six digits, decimals
become doubles and times become text, so results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.functions.measures import measure
from cargolens.functions.text import fmt_currency, fmt_number, fmt_percent
from cargolens.operators import deepdive, quality
from cargolens.operators.cleaning import clean, clean_summary
from cargolens.operators.cube import metrics_cube
from cargolens.operators.distinct_sets import as_sets, count_sets, key_places
from cargolens.operators.facets import Selection, drill_options, explore, facet_filter, facet_options, filter_coverage
from cargolens.operators.features import prepare
from cargolens.operators.moments import comoments_of, correlation, deviations, merged_comoments
from cargolens.operators.paging import page, page_of
from cargolens.operators.reports import loss_flag, report, share_of_total
from cargolens.operators.summary import SUMMARY_DIMENSIONS, summarize, summary_report
from cargolens.operators.top_keys import top_keys
from cargolens.plans import findings
from cargolens.plans.facts import facts_of_summary
from cargolens.plans.kpis import distinct_count, kpis, kpis_long, kpis_of_summary
from cargolens.schema import EXPLORER_COLUMNS, FEATURE_COLUMNS
from cargolens.sources.files import read_csv, read_order_items, write_bucketed, write_clustered, write_csv, write_mart
from cargolens.sources.incremental import IncrementalMart
from cargolens.sources.staging import new_path, written_out
from cargolens.sources.star import bind_star_schema
from workload import refreshing
from workload.tables import shared_folder, stage, stored

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6

SELECTION = {
    "order_year": [1996, 1997, 1998],
    "market": ["ASIA", "EUROPE"],
    "shipping_mode": ["Same Day", "Standard Class"],
    "customer_segment": [],
}
# All eight facets.
FULL_SELECTION = {
    "order_year": [1995, 1996, 1997, 1998, 1999],
    "market": ["ASIA", "EUROPE", "AMERICA"],
    "order_region": ["ASIA West", "ASIA East", "EUROPE West", "AMERICA West"],
    "customer_segment": ["BUILDING", "MACHINERY", "AUTOMOBILE"],
    "department_name": [],
    "shipping_mode": ["Standard Class", "First Class"],
    "order_status": ["COMPLETE", "PENDING"],
    "delivery_status": ["Late delivery", "Advance shipping"],
}
EXPORT_COLUMNS = (
    "order_id", "market", "order_region", "customer_segment", "product_name",
    "shipping_mode", "order_status", "sales", "profit", "discount_rate",
)
PREVIEW_COLUMNS = ("order_id", "product_name", "sales", "profit", *FEATURE_COLUMNS)
HIGH_MARGIN_CATEGORIES = ("Brand#1", "Brand#10")
GUARDRAILS = {"standard_cap": 0.08, "high_margin_cap": 0.05, "approval_above": 0.09}
DIMENSION_COLUMNS = ("customer_id", "market", "payment_type", "category_name", "shipping_mode")


def raw_items(spark: SparkSession, folder: str) -> DataFrame:
    return stage(spark, "raw", folder, lambda: bind_star_schema(spark, folder))


def mart(spark: SparkSession, folder: str) -> DataFrame:
    return stage(spark, "mart", folder, lambda: prepare(raw_items(spark, folder)))


def summary(spark: SparkSession, folder: str) -> DataFrame:
    return stage(spark, "summary", folder, lambda: summarize(mart(spark, folder)))


def sets(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and customers of the summary's groups."""

    def build() -> DataFrame:
        places = lambda: key_places(mart(spark, folder), SUMMARY_DIMENSIONS, ("order_id", "customer_id"))
        return as_sets(stage(spark, "places", folder, places))

    return stage(spark, "sets", folder, build)


def refreshed(spark: SparkSession, folder: str) -> IncrementalMart:
    """The mart that has been refreshed after its input changed."""
    return stored(
        spark,
        "refreshed",
        folder,
        lambda path: refreshing.write_states(raw_items(spark, folder), path),
        lambda path: IncrementalMart(spark, f"{path}/mart", types=refreshing.TYPES),
    )


def comparable(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Types and precision that both engines share."""
    columns = []
    for name, kind in df.dtypes:
        value = F.col(name)
        if kind.startswith("decimal"):
            value = value.cast("double")
        elif kind in ("double", "float"):
            value = F.round(value.cast("double"), digits)
        elif kind.startswith("timestamp"):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            value = value.cast("string")
        columns.append(value.alias(name))
    return df.select(*columns)


def _on_mart(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: comparable(build(mart(spark, folder)))


def _on_raw(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: comparable(build(raw_items(spark, folder)))


def _on_summary(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: comparable(build(summary(spark, folder)))


def _on_sets(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: comparable(build(sets(spark, folder)))


def _on_refreshed(build: Callable[[IncrementalMart], DataFrame]) -> Query:
    return lambda spark, folder: comparable(build(refreshed(spark, folder)))


def _summary_kpis(selection: Selection) -> Query:
    return lambda spark, folder: comparable(
        kpis_of_summary(
            facet_filter(summary(spark, folder), selection), facet_filter(sets(spark, folder), selection)
        )
    )


# Query name -> (domain, report).
REPORTS = {
    "sales_monthly_trend": ("sales", "monthly_trend"),
    "sales_yearly_trend": ("sales", "yearly_trend"),
    "sales_by_market": ("sales", "by_market"),
    "sales_by_region": ("sales", "by_region"),
    "sales_by_segment": ("sales", "by_segment"),
    "sales_by_shipping_mode": ("sales", "by_shipping_mode"),
    "sales_by_quarter": ("sales", "by_quarter"),
    "profit_monthly_trend": ("profit", "monthly_trend"),
    "profit_yearly_trend": ("profit", "yearly_trend"),
    "profit_by_market": ("profit", "by_market"),
    "profit_by_region": ("profit", "by_region"),
    "profit_by_segment": ("profit", "by_segment"),
    "profit_by_category": ("profit", "by_category"),
    "profit_by_department": ("profit", "by_department"),
    "margin_by_market": ("profit", "margin_by_market"),
    "margin_by_segment": ("profit", "margin_by_segment"),
    "top_customers": ("customer", "top_customers"),
    "segment_counts": ("customer", "segment_counts"),
    "customer_sales_by_segment": ("customer", "sales_by_segment"),
    "customer_profit_by_segment": ("customer", "profit_by_segment"),
    "segment_avg_order": ("customer", "segment_avg_order"),
    "payment_type_counts": ("customer", "payment_type_counts"),
    "sales_by_category": ("product", "sales_by_category"),
    "product_profit_by_category": ("product", "profit_by_category"),
    "sales_by_department": ("product", "sales_by_department"),
    "top_products_by_sales": ("product", "top_products_by_sales"),
    "top_products_by_profit": ("product", "top_products_by_profit"),
    "bottom_products": ("product", "bottom_products"),
    "category_profit_margin": ("product", "category_profit_margin"),
    "category_scatter": ("overview", "category_scatter"),
    "mode_counts": ("shipping", "mode_counts"),
    "mode_sales": ("shipping", "mode_sales"),
    "mode_avg_delay": ("shipping", "mode_avg_delay"),
    "delay_distribution": ("shipping", "delay_distribution"),
    "mode_late_rate": ("shipping", "mode_late_rate"),
    "status_counts": ("delivery", "status_counts"),
    "status_by_market": ("delivery", "status_by_market"),
    "late_by_region": ("delivery", "late_by_region"),
    "late_by_category": ("delivery", "late_by_category"),
    "order_status_counts": ("delivery", "order_status_counts"),
    "late_by_year": ("delivery", "late_by_year"),
    "geo_sales_by_market": ("geo", "sales_by_market"),
    "geo_profit_by_market": ("geo", "profit_by_market"),
    "geo_sales_by_region": ("geo", "sales_by_region"),
    "geo_profit_by_region": ("geo", "profit_by_region"),
    "sales_by_country": ("geo", "sales_by_country"),
    "market_order_count": ("geo", "market_order_count"),
    "yearly_sales_vs_profit": ("overview", "yearly_sales_vs_profit"),
    "rows_by_year": ("overview", "rows_by_year"),
}

# Query name -> (domain, report, rows shown).
TOP_REPORTS = {
    "topn_profit_by_department_10": ("profit", "by_department", 10),
    "topn_sales_by_category_10": ("product", "sales_by_category", 10),
    "topn_profit_by_category_10": ("product", "profit_by_category", 10),
    "topn_sales_by_category_15": ("product", "sales_by_category", 15),
    "topn_margin_by_category_20": ("product", "category_profit_margin", 20),
    "topn_late_by_region_15": ("delivery", "late_by_region", 15),
    "topn_sales_by_region_15": ("geo", "sales_by_region", 15),
    "topn_order_statuses_8": ("delivery", "order_status_counts", 8),
}

# Query name -> (domain, report, order, rows): the re-sorts of the dashboard and longer lists.
RESORTED = {
    "resort_margin_by_segment": ("profit", "margin_by_segment", "desc", None),
    "resort_sales_by_mode": ("shipping", "mode_sales", "desc", None),
    "resort_mode_avg_delay": ("shipping", "mode_avg_delay", "desc", None),
    "resort_mode_late_rate": ("shipping", "mode_late_rate", "desc", None),
    "resort_late_by_region": ("delivery", "late_by_region", "asc", None),
    "resort_category_margin_asc": ("product", "category_profit_margin", "asc", 7),
    "top_products_by_sales_50": ("product", "top_products_by_sales", None, 50),
    "top_customers_100": ("customer", "top_customers", None, 100),
    "bottom_products_40": ("product", "bottom_products", None, 40),
    "topn_sales_by_market_3": ("sales", "by_market", "desc", 3),
    "topn_profit_by_region_4": ("profit", "by_region", None, 4),
    "topn_status_by_items_2": ("delivery", "status_counts", None, 2),
}

# Query name -> (domain, report, measure): slices of the whole.
SHARES = {
    "share_sales_by_segment": ("sales", "by_segment", "total_sales"),
    "share_items_by_segment": ("customer", "segment_counts", "order_items"),
    "share_items_by_mode": ("shipping", "mode_counts", "order_items"),
    "share_items_by_delivery_status": ("delivery", "status_counts", "order_items"),
}


def _report(domain: str, name: str, n: int | None = None, order: str | None = None) -> Query:
    return _on_mart(lambda df: report(df, domain, name, n=n, order=order))


def _share(domain: str, name: str, value: str) -> Query:
    return _on_mart(lambda df: share_of_total(report(df, domain, name), value))


def load_order_items(spark: SparkSession, folder: str) -> DataFrame:
    """The raw table written as CSV files with the original headers and read back."""
    items = stored(
        spark,
        "raw-csv",
        folder,
        lambda path: write_csv(
            raw_items(spark, folder), path, raw_headers=True, encoding="ISO-8859-1"
        ),
        lambda path: read_csv(spark, path),
    )
    return comparable(items)


def export_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of a filtered selection written as CSV and read back."""
    rows = stored(
        spark,
        "export-csv",
        folder,
        lambda path: write_csv(
            facet_filter(mart(spark, folder), SELECTION), path, EXPORT_COLUMNS, raw_headers=True
        ),
        lambda path: read_csv(spark, path, encoding="UTF-8"),
    )
    return comparable(rows)


def csv_layouts(spark: SparkSession, folder: str) -> DataFrame:
    """Two CSV folders with columns in another order, one column short, read by name."""
    columns = ["order_id", "market", "sales", "profit", "product_name", "days_real"]

    def write(path: str) -> None:
        items = raw_items(spark, folder).select(*columns)
        early = F.col("order_id") % 2 == 0
        write_csv(items.where(early), f"{path}/one", raw_headers=True, encoding="ISO-8859-1")
        other = items.where(~early).select(*reversed(columns[1:]), "order_id").drop("product_name")
        write_csv(other, f"{path}/two", raw_headers=True, encoding="ISO-8859-1")

    return comparable(
        stored(spark, "csv-layouts", folder, write, lambda path: read_csv(spark, [f"{path}/one", f"{path}/two"]))
    )


def mart_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """The mart stored by year and read back for two years."""
    rows = stored(
        spark,
        "mart-by-year",
        folder,
        lambda path: write_mart(mart(spark, folder), path),
        lambda path: read_order_items(spark, path),
    )
    chosen = rows.where(F.col("order_year").isin(1997, 1999))
    return comparable(chosen.select("order_id", "order_year", "market", "sales", "profit"))


def clustered(spark: SparkSession, folder: str) -> DataFrame:
    """The mart stored along a Z-order curve through its facets."""
    return stored(
        spark,
        "mart-clustered",
        folder,
        lambda path: write_clustered(mart(spark, folder), path),
        lambda path: read_order_items(spark, path),
    )


def _on_clustered(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: comparable(build(clustered(spark, folder)))


def bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """The mart's orders and sales, dealt into buckets by order."""

    def write(path: str) -> None:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        items = mart(spark, folder).select("order_id", "sales")
        write_bucketed(items, _table_at(path), path, "order_id", buckets)

    return stored(spark, "bucketed", folder, write, lambda path: spark.table(_table_at(path)))


def _table_at(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def comoments(spark: SparkSession, folder: str) -> DataFrame:
    return stage(
        spark,
        "comoments",
        folder,
        lambda: mart(spark, folder).groupBy(*SUMMARY_DIMENSIONS).agg(*comoments_of("discount_rate", "profit")),
    )


def _on_bucketed(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: comparable(build(bucketed(spark, folder)))


def _on_comoments(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: comparable(build(merged_comoments(comoments(spark, folder))))


def _kept(df: DataFrame) -> DataFrame:
    """A small table in the shared folder."""
    return written_out(df, new_path(df.sparkSession, "kept", shared_folder(df.sparkSession)))


def _threshold_customers(df: DataFrame) -> DataFrame:
    names = ("customer_id", "customer_fname", "customer_lname")
    best = top_keys(df, names, "sales", 20, store=_kept).withColumnRenamed("total", "total_sales")
    return best.withColumn("customer_name", F.concat_ws(" ", *names[1:]))


def _threshold_products(df: DataFrame, value: str, name: str, n: int, largest: bool = True) -> DataFrame:
    return top_keys(df, ["product_name"], value, n, largest, store=_kept).withColumnRenamed("total", name)


def _third_page(df: DataFrame) -> DataFrame:
    """The third of the explorer's pages of 500 rows, each found from the one before."""
    after = None
    for _ in range(2):
        after = page(df, EXPLORER_COLUMNS, 500, after, EXPLORER_COLUMNS).after
    return page_of(df, EXPLORER_COLUMNS, 500, after, EXPLORER_COLUMNS).select(*EXPLORER_COLUMNS)


def _describe_gaps(df: DataFrame) -> DataFrame:
    """A profile with a column that is missing everywhere."""
    return quality.numeric_describe(
        df.select("sales", "days_real", F.lit(None).cast("double").alias("discount_amount"))
    )


def _formats(df: DataFrame) -> DataFrame:
    return df.select(
        "order_id", "sales", "profit",
        fmt_currency("sales").alias("sales_text"),
        fmt_currency("profit").alias("profit_text"),
    )


def _currency_totals(df: DataFrame) -> DataFrame:
    by_product = report(df, "overview", "category_scatter")
    return by_product.select(
        "category_name",
        fmt_currency("total_sales").alias("sales_text"),
        fmt_currency("total_profit").alias("profit_text"),
        fmt_number("orders_present").alias("items_text"),
    )


def _numbers(df: DataFrame) -> DataFrame:
    return df.select(
        "order_id", "sales", "profit",
        fmt_number("sales").alias("sales_text"),
        fmt_number("profit").alias("profit_text"),
    )


def _kpi_cards(df: DataFrame) -> DataFrame:
    money = ("total_sales", "total_profit", "avg_order_value", "avg_profit_per_order")
    counts = ("total_orders", "total_customers", "total_order_items")
    rates = ("overall_profit_margin", "late_delivery_rate", "avg_discount_rate")
    return kpis(df).select(
        *[fmt_currency(c).alias(c) for c in money],
        *[fmt_number(c).alias(c) for c in counts],
        *[fmt_percent(c).alias(c) for c in rates],
    )


def _on_time_rate(df: DataFrame) -> DataFrame:
    return df.agg(
        measure("on_time_items"),
        measure("order_items"),
        F.round(measure("on_time_pct"), 2).alias("on_time_rate_pct"),
    )


def _cleaned(*columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda raw: clean(raw).select(*columns)


def queries() -> dict[str, Query]:
    registry: dict[str, Query] = {
        # sources and sinks
        "load_order_items": load_order_items,
        "prepared_mart": _on_mart(lambda df: df),
        "export_filtered": export_filtered,
        "csv_layouts": csv_layouts,
        "mart_by_year": mart_by_year,
        "preview_rows": _on_mart(lambda df: explore(df, PREVIEW_COLUMNS, limit=5)),
        "preview_raw_rows": _on_raw(lambda raw: explore(raw, raw.columns, limit=5)),
        # cleaning
        "clean_dates": _on_raw(
            _cleaned("order_id", "product_name", "sales", "order_ts", "shipping_ts")
        ),
        "clean_trim": _on_raw(
            _cleaned("order_id", "sales", "customer_fname", "category_name", "product_name")
        ),
        "clean_fill": _on_raw(
            _cleaned("order_id", "customer_id", "customer_lname", "customer_zipcode")
        ),
        "clean_drop_nulls": _on_raw(
            lambda raw: clean(raw).agg(
                F.count("*").alias("kept_rows"),
                F.sum("sales").cast("double").alias("total_sales"),
                F.sum("profit").cast("double").alias("total_profit"),
            )
        ),
        "clean_summary": _on_raw(clean_summary),
        # features
        "feat_time": _on_mart(
            lambda df: df.select(
                "order_id", "sales", "order_year", "order_month", "order_month_name",
                "order_quarter", "order_year_month",
            )
        ),
        "feat_shipping": _on_mart(
            lambda df: df.select(
                "order_id", "sales", "days_real", "days_scheduled", "delivery_status",
                "shipping_delay_days", "is_late",
            )
        ),
        "feat_margin": _on_mart(
            lambda df: df.select("order_id", "sales", "profit", "profit_margin_pct")
        ),
        "feat_revenue_band": _on_mart(lambda df: df.select("order_id", "sales", "revenue_band")),
        # formats
        "fmt_currency": _on_mart(_formats),
        "fmt_currency_totals": _on_mart(_currency_totals),
        "fmt_number": _on_mart(_numbers),
        "kpi_cards": _on_mart(_kpi_cards),
        # facets
        "facet_filter": _on_mart(lambda df: facet_filter(df, SELECTION).select(*EXPORT_COLUMNS)),
        "facet_options": _on_mart(facet_options),
        "drill_options": _on_mart(lambda df: drill_options(df, SELECTION)),
        "drill_options_all": _on_mart(lambda df: drill_options(df, FULL_SELECTION)),
        "drill_options_free": _on_mart(lambda df: drill_options(df, {})),
        "clustered_facet_filter": _on_clustered(
            lambda df: facet_filter(df, SELECTION).select(*EXPORT_COLUMNS)
        ),
        "clustered_facet_filter_all": _on_clustered(
            lambda df: facet_filter(df, FULL_SELECTION).select(*EXPORT_COLUMNS)
        ),
        "clustered_kpis": _on_clustered(lambda df: kpis(facet_filter(df, SELECTION))),
        "filter_coverage": _on_mart(lambda df: filter_coverage(df, SELECTION)),
        "filtered_kpis": _on_mart(lambda df: kpis(facet_filter(df, SELECTION))),
        "on_time_rate": _on_mart(_on_time_rate),
        "explorer": _on_mart(lambda df: explore(df, limit=5000)),
        # figures
        "kpis": _on_mart(kpis),
        "kpis_long": _on_mart(kpis_long),
        "unique_customers": _on_mart(
            lambda df: distinct_count(df, "customer_id").select(
                F.col("distinct_customer_id").alias("unique_customers")
            )
        ),
        "metrics_cube": _on_mart(metrics_cube),
        "profit_monthly_loss_flag": _on_mart(
            lambda df: loss_flag(report(df, "profit", "monthly_trend"))
        ),
        # findings
        "business_answers": _on_mart(findings.business_answers),
        "insights": _on_mart(findings.insights),
        "recommendations": _on_mart(findings.recommendations),
        "filtered_insights": _on_mart(
            lambda df: findings.insights(facet_filter(df, SELECTION))
        ),
        "filtered_recommendations": _on_mart(
            lambda df: findings.recommendations(facet_filter(df, SELECTION))
        ),
        "empty_insights": _on_mart(
            lambda df: findings.insights(facet_filter(df, {"market": ["NOWHERE"]}))
        ),
        # the same from a stored summary of the facets
        "summary_late_by_category": _on_summary(
            lambda groups: summary_report(groups, "delivery", "late_by_category")
        ),
        "summary_filtered_sales_by_region": _on_summary(
            lambda groups: summary_report(facet_filter(groups, SELECTION), "sales", "by_region")
        ),
        "summary_insights": _on_summary(
            lambda groups: findings.insights_of(facts_of_summary(groups))
        ),
        "summary_kpis": _summary_kpis({}),
        "summary_filtered_kpis": _summary_kpis(SELECTION),
        "summary_market_order_count": _on_sets(
            lambda found: count_sets(found.where("key = 'order_id'"), "market").select(
                "market", F.col("distinct").alias("total_orders")
            )
        ),
        "summary_unique_customers": _on_sets(
            lambda found: count_sets(found.where("key = 'customer_id'")).select(
                F.col("distinct").alias("unique_customers")
            )
        ),
        # a mart that was refreshed after files came, changed and went
        "refreshed_mart": _on_refreshed(refreshing.refreshed_rows),
        "refreshed_edges": _on_refreshed(refreshing.refreshed_edges),
        "refreshed_kpis": _on_refreshed(lambda mart: refreshing.refreshed_kpis(mart, {})),
        "refreshed_filtered_kpis": _on_refreshed(lambda mart: refreshing.refreshed_kpis(mart, SELECTION)),
        "refreshed_orders_by_market": _on_refreshed(refreshing.refreshed_orders_by_market),
        "refreshed_insights": _on_refreshed(refreshing.refreshed_insights),
        "rejected_cells": _on_refreshed(refreshing.rejected_cells),
        "refreshed_sample": _on_refreshed(refreshing.refreshed_sample),
        "refreshed_profile": _on_refreshed(refreshing.refreshed_profile),
        # the best of very many keys, pages, orders without an exchange, moments of stored groups
        "threshold_top_customers": _on_mart(_threshold_customers),
        "threshold_top_products_by_sales": _on_mart(
            lambda df: _threshold_products(df, "sales", "total_sales", 15)
        ),
        "threshold_bottom_products": _on_mart(
            lambda df: _threshold_products(df, "profit", "total_profit", 10, largest=False)
        ),
        "explorer_third_page": _on_mart(_third_page),
        "bucketed_avg_order_value": _on_bucketed(deepdive.avg_order_value_by_order),
        "bucketed_order_value_range": _on_bucketed(deepdive.order_value_range),
        "summary_discount_profit_corr": _on_comoments(correlation),
        "summary_discount_profit_deviations": _on_comoments(deviations),
        # quality
        "dataset_shape": _on_raw(quality.dataset_shape),
        "column_types": _on_raw(quality.column_types),
        "numeric_describe": _on_raw(quality.numeric_describe),
        "numeric_describe_gaps": _on_raw(_describe_gaps),
        "categorical_uniques": _on_raw(quality.categorical_uniques),
        "categorical_uniques_gaps": _on_raw(
            lambda raw: quality.categorical_uniques(
                raw.withColumn("customer_segment", F.lit(None).cast("string"))
            )
        ),
        "categorical_values": _on_raw(quality.categorical_values),
        "missing_values": _on_raw(quality.missing_values),
        "missing_cells": _on_raw(quality.missing_cells),
        "duplicate_rows": _on_raw(lambda raw: quality.duplicate_rows(raw, _kept)),
        "duplicate_dimension_rows": _on_raw(
            lambda raw: quality.duplicate_rows(raw.select(*DIMENSION_COLUMNS), _kept)
        ),
        "negative_sales": _on_raw(quality.negative_sales),
        "negative_profit": _on_raw(quality.negative_profit),
        "invalid_dates": _on_raw(quality.invalid_dates),
        "order_date_range": _on_raw(quality.order_date_range),
        "discount_profit_sample": _on_mart(
            lambda df: quality.sample_rows(
                df, ["discount_rate", "profit"], ["order_id", "customer_id", "sales", "profit"]
            )
        ),
        # deep dive
        "late_risk_rate": _on_mart(deepdive.late_risk_rate),
        "late_risk_by_mode": _on_mart(lambda df: deepdive.late_risk_by(df, "shipping_mode")),
        "late_risk_by_region": _on_mart(lambda df: deepdive.late_risk_by(df, "order_region")),
        "market_revenue_share": _on_mart(
            lambda df: deepdive.total_share_by(df, "market", "total_sales")
        ),
        "department_profit_share": _on_mart(
            lambda df: deepdive.total_share_by(df, "department_name", "total_profit")
        ),
        "segment_profit_share": _on_mart(
            lambda df: deepdive.total_share_by(df, "customer_segment", "total_profit")
        ),
        "order_status_share": _on_mart(
            lambda df: deepdive.total_share_by(df, "order_status", "order_items")
        ),
        "low_margin_high_sales_products": _on_mart(deepdive.low_margin_high_sales_products),
        "low_margin_high_total_products": _on_mart(
            lambda df: deepdive.low_margin_high_sales_products(
                df, margin_below=50.0, basis="total"
            )
        ),
        "low_margin_above_median_products": _on_mart(
            lambda df: deepdive.low_margin_high_sales_products(
                df, probability=0.5, margin_below=50.0
            )
        ),
        "discount_profit_corr": _on_mart(deepdive.discount_profit_corr),
        "avg_order_value_by_order": _on_mart(deepdive.avg_order_value_by_order),
        "order_value_range": _on_mart(deepdive.order_value_range),
        "delivery_scorecard_weekly": _on_mart(deepdive.delivery_scorecard_weekly),
        "late_risk_scorecard_weekly": _on_mart(
            lambda df: deepdive.delivery_scorecard_weekly(df, rate="late_risk_pct")
        ),
        "guardrails_of_best_categories": _on_mart(
            lambda df: deepdive.guardrail_summary(
                deepdive.discount_guardrails(df, deepdive.high_margin_categories(df, 5))
            )
        ),
        "low_margin_under_half_products": _on_mart(
            lambda df: deepdive.low_margin_high_sales_products(
                df, probability=0.5, margin_below=60.0, basis="total"
            )
        ),
        "facet_filter_all": _on_mart(
            lambda df: facet_filter(df, FULL_SELECTION).select(*EXPORT_COLUMNS)
        ),
        "discount_guardrails": _on_mart(
            lambda df: deepdive.discount_guardrails(
                df, HIGH_MARGIN_CATEGORIES, **GUARDRAILS
            ).select(
                "order_id", "category_name", "sales", "discount_rate", "discount_cap", "guardrail"
            )
        ),
        "discount_guardrail_summary": _on_mart(
            lambda df: deepdive.guardrail_summary(
                deepdive.discount_guardrails(df, HIGH_MARGIN_CATEGORIES, **GUARDRAILS)
            )
        ),
        "non_complete_share": _on_mart(deepdive.non_complete_share),
    }
    for name, (domain, table) in REPORTS.items():
        registry[name] = _report(domain, table)
    for name, (domain, table, rows) in TOP_REPORTS.items():
        registry[name] = _report(domain, table, rows)
    for name, (domain, table, order, rows) in RESORTED.items():
        registry[name] = _report(domain, table, rows, order)
    for name, (domain, table, value) in SHARES.items():
        registry[name] = _share(domain, table, value)
    for question in findings.QUESTIONS:
        registry[question.name] = _on_mart(lambda df, q=question.name: findings.answer(df, q))
    return registry


