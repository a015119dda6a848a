"""What the plans look like: pruned scans, no Python, no cross joins."""

from __future__ import annotations

import pytest

from cargolens import explore, facet_filter, insights, kpis, metrics_cube, report, share_of_total
from cargolens.operators import quality
from cargolens.operators.features import prepare
from cargolens.sources import staging
from cargolens.sources.star import bind_star_schema
from tests.conftest import TABLES
from workload import tables
from workload.queries import queries

BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
          "MapInPandas", "ObjectHashAggregate(keys=[]", "LocalTableScan")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_slow_operator(spark, name):
    text = plan(queries()[name](spark, TABLES))
    assert not [word for word in BANNED if word in text]


def test_report_reads_two_columns(prepared):
    text = plan(report(prepared, "sales", "by_market"))
    assert "ReadSchema: struct<market:string,sales:decimal(12,2)>" in text
    assert "PushedFilters: [IsNotNull(market)]" in text
    assert text.count("Exchange hashpartitioning") == 1


def test_top_reports_sort_no_more_than_they_show(prepared):
    assert "TakeOrderedAndProject(limit=20" in plan(report(prepared, "customer", "top_customers"))


def test_facets_reach_the_scan(prepared):
    chosen = facet_filter(prepared, {"market": ["ASIA"], "order_year": [1997]})
    text = plan(kpis(chosen))
    assert "EqualTo(market,ASIA)" in text and "EqualTo(order_year,1997)" in text


def test_insights_scan_once(prepared):
    assert plan(insights(prepared)).count("FileScan") == 1


def test_kpis_do_not_multiply_rows(prepared):
    assert "Expand" not in plan(kpis(prepared))


def test_bands_cost_nothing_when_unused(raw):
    text = plan(report(prepare(raw), "sales", "by_market"))
    assert text.count("FileScan") == 1 and "Subquery" not in text


def test_share_reuses_the_report(prepared):
    shares = share_of_total(report(prepared, "sales", "by_segment"), "total_sales")
    shares.collect()
    assert "ReusedExchange" in plan(shares)


def test_new_input_is_seen(spark, tmp_path):
    """A table made from files is made anew when rows are added to them."""
    for name in tables.SOURCES:
        spark.range(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    built = []

    def read():
        def build():
            built.append(1)
            return spark.read.parquet(str(tmp_path / "orders.parquet"))

        return tables.stage(spark, "probe", str(tmp_path), build).count()

    assert (read(), read(), len(built)) == (3, 3, 1)
    spark.range(5).write.mode("append").parquet(str(tmp_path / "orders.parquet"))
    assert (read(), len(built)) == (8, 2)


def test_failed_write_is_not_reused(spark):
    def fail(path):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        tables.stored(spark, "broken", TABLES, fail, spark.read.parquet)
    assert not [k for k in tables._paths if k[1] == "broken"]


class _Session:
    """Just enough of a session to ask for a path."""

    def __init__(self, master, folder):
        self.conf = {"spark.checkpoint.dir": folder}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app"})


@pytest.mark.parametrize("master", ["yarn", "local[2]"])
def test_paths_are_below_the_named_folder_on_any_master(master):
    assert staging.new_path(_Session(master, "hdfs://shared/"), "x").startswith("hdfs://shared/cargolens/app/x-")
    with pytest.raises(ValueError):
        staging.new_path(_Session(master, None), "x")


@pytest.mark.parametrize("n", [5, 5000])
def test_first_rows_read_once_and_shuffle_nothing_but_candidates(prepared, n):
    text = plan(explore(prepared, limit=n))
    assert text.count("FileScan") == 1 and "Exchange" not in text and "Window" not in text
    assert f"TakeOrderedAndProject(limit={n}" in text


def test_cube_shuffles_one_row_for_a_key_and_task(prepared):
    text = plan(metrics_cube(prepared))
    assert text.count("Exchange") == 1 and text.count("HashAggregate") == 2 and text.count("FileScan") == 1


def test_binding_joins_by_hash_or_sort_only(spark):
    text = plan(prepare(bind_star_schema(spark, TABLES)).select("order_id", "sales", "market"))
    assert text.count("FileScan") == 6 and not [word for word in BANNED if word in text]
    assert "RoundRobin" not in text


def test_values_of_a_vocabulary_stay_rows(raw):
    text = plan(quality.categorical_values(raw))
    assert "collect_list" not in text and "collect_set" not in text
