"""Supply-chain order-item analytics as plain Spark DataFrame transformations."""

from cargolens.operators.cleaning import clean, clean_summary
from cargolens.operators.cube import metrics_cube
from cargolens.operators.facets import drill_options, explore, facet_filter, facet_options, filter_coverage
from cargolens.operators.features import engineer_features, prepare
from cargolens.operators.paging import page
from cargolens.operators.reports import report, share_of_total
from cargolens.operators.summary import summarize, summary_report
from cargolens.operators.top_keys import top_keys
from cargolens.plans.analyses import (
    customer_analysis,
    delivery_analysis,
    geo_analysis,
    load_and_prepare,
    product_analysis,
    profit_analysis,
    sales_analysis,
    shipping_analysis,
)
from cargolens.plans.findings import answer, business_answers, insights, recommendations
from cargolens.plans.kpis import kpis, kpis_long, kpis_of_summary
from cargolens.session import build_session
from cargolens.sources.files import read_csv, read_order_items, write_clustered, write_csv, write_mart
from cargolens.sources.incremental import IncrementalMart

__version__ = "0.1.0"

__all__ = [
    "IncrementalMart",
    "answer",
    "build_session",
    "business_answers",
    "clean",
    "clean_summary",
    "customer_analysis",
    "delivery_analysis",
    "drill_options",
    "engineer_features",
    "explore",
    "facet_filter",
    "facet_options",
    "filter_coverage",
    "geo_analysis",
    "insights",
    "kpis",
    "kpis_long",
    "kpis_of_summary",
    "load_and_prepare",
    "metrics_cube",
    "page",
    "prepare",
    "product_analysis",
    "profit_analysis",
    "read_csv",
    "read_order_items",
    "recommendations",
    "report",
    "sales_analysis",
    "share_of_total",
    "shipping_analysis",
    "summarize",
    "summary_report",
    "top_keys",
    "write_clustered",
    "write_csv",
    "write_mart",
]
