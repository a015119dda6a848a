"""Relations that hold between results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cargolens import (
    business_answers,
    facet_filter,
    insights,
    kpis,
    metrics_cube,
    recommendations,
    report,
    share_of_total,
    summarize,
    summary_report,
)
from cargolens.operators.quality import duplicate_rows, numeric_describe, sample_rows
from cargolens.operators.reports import DOMAINS
from cargolens.operators.summary import answers
from cargolens.plans.facts import facts_of_summary
from cargolens.plans.findings import business_answers_of, insights_of, recommendations_of
from cargolens.plans.kpis import distinct_count
from workload.queries import RESORTED

SELECTION = {"market": ["ASIA", "EUROPE"], "order_year": [1997, 1998]}
ALIASES = [
    (("sales", "by_segment"), ("customer", "sales_by_segment")),
    (("profit", "by_segment"), ("customer", "profit_by_segment")),
    (("profit", "by_category"), ("product", "profit_by_category")),
    (("sales", "by_shipping_mode"), ("shipping", "mode_sales")),
    (("sales", "by_region"), ("geo", "sales_by_region")),
    (("profit", "by_region"), ("geo", "profit_by_region")),
]


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(("one", "other"), ALIASES)
def test_aliases(prepared, one, other):
    assert rows(report(prepared, *one)) == rows(report(prepared, *other))


def test_totals_agree(prepared):
    whole = kpis(prepared).first().total_sales
    for name in ("by_market", "by_segment", "by_region"):
        parts = sum(r.total_sales for r in report(prepared, "sales", name).collect())
        assert parts == pytest.approx(whole)


def test_shares_add_up(prepared):
    shares = share_of_total(report(prepared, "delivery", "status_counts"), "order_items", 6)
    assert sum(r.share_pct for r in shares.collect()) == pytest.approx(100)


def test_bands_cover_all_rows(prepared):
    assert prepared.groupBy("revenue_band").count().agg(F.sum("count")).first()[0] == prepared.count()


def test_filtering_first_equals_filtering_by_hand(prepared):
    by_hand = prepared.where("market in ('ASIA', 'EUROPE') and order_year in (1997, 1998)")
    assert rows(report(facet_filter(prepared, SELECTION), "sales", "by_market")) == rows(
        report(by_hand, "sales", "by_market")
    )


def test_more_facets_never_add_rows(prepared):
    wide = facet_filter(prepared, {"market": ["ASIA", "EUROPE"]}).count()
    assert facet_filter(prepared, SELECTION).count() <= wide <= prepared.count()


def test_cut_report_is_part_of_the_whole(prepared):
    few = rows(report(prepared, "product", "sales_by_category", n=5))
    assert few == rows(report(prepared, "product", "sales_by_category"))[:5]


def test_cube_equals_the_reports(prepared):
    cube = metrics_cube(prepared)
    for dim, (domain, name) in {
        "market": ("sales", "by_market"), "order_region": ("sales", "by_region"),
    }.items():
        of_cube = {
            r.key: r.total_sales for r in cube.where(F.col("dimension") == dim).collect()
        }
        assert of_cube == {r[0]: r[1] for r in report(prepared, domain, name).collect()}


def test_cube_drops_missing_keys(spark, edge):
    regions = metrics_cube(edge, ["order_region", "market"]).where("dimension = 'order_region'")
    assert sorted(r.key for r in regions.collect()) == ["East", "South", "West"]


def test_every_report_runs(edge):
    for domain, reports in DOMAINS.items():
        for name in reports:
            assert report(edge, domain, name).columns


def test_duplicates_against_brute_force(spark):
    """A third of the rows are copies of one row, and some cells are missing."""
    data = [(1, "a", None)] * 400 + [(i % 97, None, float(i % 5)) for i in range(800)] + [(None, "a", 1.0)]
    df = spark.createDataFrame(data, "x int, y string, z double").repartition(7)
    assert duplicate_rows(df).first()[0] == len(data) - len(set(data))
    assert duplicate_rows(df.limit(0)).first()[0] == 0


def test_sample_depends_on_data_alone(prepared):
    keys = ["order_id", "customer_id", "sales", "profit"]
    one = sample_rows(prepared, ["discount_rate", "profit"], keys, n=50)
    two = sample_rows(prepared.repartition(11), ["discount_rate", "profit"], keys, n=50)
    assert rows(one) == rows(two) and one.count() == 50
    other = sample_rows(prepared, ["discount_rate", "profit"], keys, n=50, seed=43)
    assert rows(other) != rows(one)
    assert sample_rows(prepared, ["profit"], keys, n=10**6).count() == prepared.count()


@pytest.mark.parametrize("selection", [{}, SELECTION, {"market": ["NOWHERE"]}])
def test_summary_reports_equal_reports(prepared, selection):
    groups = facet_filter(summarize(prepared).cache(), selection)
    items = facet_filter(prepared, selection)
    checked = 0
    for domain, reports in DOMAINS.items():
        for name, spec in reports.items():
            if not answers(groups, spec):
                continue
            got, want = rows(summary_report(groups, domain, name)), rows(report(items, domain, name))
            assert [r[: len(spec.dims)] for r in got] == [r[: len(spec.dims)] for r in want]
            for one, other in zip(got, want):
                assert one[len(spec.dims):] == pytest.approx(other[len(spec.dims):], rel=1e-9)
            checked += 1
    assert checked > 25


def test_summary_refuses_what_it_cannot_answer(prepared):
    for domain, name in (("product", "top_products_by_sales"), ("geo", "market_order_count")):
        with pytest.raises(ValueError):
            summary_report(summarize(prepared), domain, name)


def test_findings_of_a_summary(edge):
    known = facts_of_summary(summarize(edge))
    assert rows(insights_of(known)) == rows(insights(edge))
    assert rows(recommendations_of(known)) == rows(recommendations(edge))
    assert rows(business_answers_of(known)) == rows(business_answers(edge))


@pytest.mark.parametrize(
    "name, domain, table, order",
    [(n, *spec[:3]) for n, spec in RESORTED.items() if spec[2]],
)
def test_rows_come_in_the_asked_order(prepared, name, domain, table, order):
    """The order itself, which a comparison of sets does not see."""
    spec = DOMAINS[domain][table]
    rows = report(prepared, domain, table, order=order).collect()
    value, dim = spec.measures[0], spec.dims[0]
    sign = -1 if order == "desc" else 1
    assert rows == sorted(rows, key=lambda r: (sign * r[value], r[dim]))


def test_approximate_options_are_close(prepared):
    exact = {r.column_name: r for r in numeric_describe(prepared, ["sales", "profit"]).collect()}
    rough = {r.column_name: r for r in numeric_describe(prepared, ["sales", "profit"], approximate=True).collect()}
    for column, row in exact.items():
        assert row["count"] == rough[column]["count"]
        for quartile in ("p25", "p50", "p75"):
            assert abs(row[quartile] - rough[column][quartile]) <= 0.02 * abs(row["max"])
    whole, near = (distinct_count(prepared, "order_id", approximate=a).first()[0] for a in (False, True))
    assert abs(whole - near) <= 0.1 * whole
