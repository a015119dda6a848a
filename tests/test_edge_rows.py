"""Cleaning, features and reports on hand-made rows with known results."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cargolens import (
    answer,
    business_answers,
    clean,
    clean_summary,
    engineer_features,
    explore,
    facet_filter,
    filter_coverage,
    geo_analysis,
    insights,
    kpis,
    prepare,
    recommendations,
    report,
    share_of_total,
)
from cargolens.functions.text import WHITESPACE, fmt_currency, fmt_number, strip
from cargolens.operators import deepdive, quality
from cargolens.operators.cleaning import parse_date
from cargolens.plans.findings import QUESTIONS


def column(df, name):
    return [row[name] for row in df.collect()]


def in_order(df):
    return [tuple(row) for row in df.collect()]


def by_item(df, name):
    rows = df.orderBy("order_id", F.asc("sales")).select(name).collect()
    return [row[0] for row in rows]


def test_incomplete_rows_are_dropped(edge):
    assert edge.count() == 6


def test_text_is_stripped_before_gaps_are_filled(edge):
    assert by_item(edge, "customer_lname") == ["Lee", "Lee", "Unknown", "", "Lee", "Hay"]
    assert by_item(edge, "customer_fname") == ["Ann", "Ann", "Bo", "Cy", "Ann", "Flo"]
    assert by_item(edge, "customer_zipcode")[2] == 0.0


def test_unused_columns_are_gone(edge):
    assert not {"customer_email", "product_image", "order_date_raw"} & set(edge.columns)


def test_margin_is_bounded_and_zero_for_zero_sales(edge):
    assert by_item(edge, "profit_margin_pct") == [20.0, -200.0, 0.0, 25.0, 10.0, 5.0]


def test_revenue_bands_follow_interpolated_quartiles(edge):
    assert by_item(edge, "revenue_band") == [
        "Low", "High", "Low", "Medium", "Very High", "Very High",
    ]


def test_equal_edges_put_every_row_in_one_band(edge_raw):
    tied = edge_raw.withColumn("sales", F.when(F.col("order_id") == 7, 5.0).otherwise(1.0))
    assert set(column(prepare(tied), "revenue_band")) == {"Medium"}


def test_delay_and_late_flag(edge):
    assert by_item(edge, "shipping_delay_days") == [1, 0, 3, -2, 0, 3]
    assert by_item(edge, "is_late") == [1, 0, 1, 0, 0, 1]


def test_unreadable_dates_leave_null_features(edge):
    assert by_item(edge, "order_year") == [2017, 2017, 2017, None, None, 2018]
    assert by_item(edge, "order_quarter") == ["Q1", "Q1", "Q1", None, None, "Q4"]
    assert by_item(edge, "order_year_month")[:3] == ["2017-01", "2017-01", "2017-02"]
    assert by_item(edge, "order_month_name")[5] == "Dec"


def test_kpis(edge):
    assert tuple(kpis(edge).first()) == (
        1500.0, -760.0, 5, 4, 250.0, -126.67, -50.67, 50.0, 5.83, 6,
    )


def test_missing_keys_form_no_group(edge):
    assert in_order(report(edge, "sales", "by_market")) == [
        ("Africa", 200.0), ("Europe", 800.0), ("Pacific Asia", 500.0),
    ]
    late = in_order(report(edge, "delivery", "late_by_region"))
    assert late == [("East", 100.0), ("South", 50.0), ("West", 50.0)]


def test_monthly_sales_skip_rows_without_a_date(edge):
    assert in_order(report(edge, "sales", "monthly_trend")) == [
        ("2017-01", 400.0), ("2017-02", 0.0), ("2018-12", 500.0),
    ]


def test_top_customers(edge):
    rows = report(edge, "customer", "top_customers").collect()
    assert [(r.customer_id, r.customer_name, r.total_sales) for r in rows] == [
        (10, "Ann Lee", 800.0), (15, "Flo Hay", 500.0), (12, "Cy ", 200.0), (11, "Bo Unknown", 0.0),
    ]


def test_ties_go_to_the_smaller_key(edge):
    assert answer(edge, "most_used_shipping_mode").first()[0] == "First Class"
    r4 = [r for r in recommendations(edge).collect() if r.rule_id == "R4"]
    assert r4[0].entity == "Same Day"


def test_answers_agree_with_the_single_questions(edge):
    together = {
        r.question: r.answer_text if r.answer_text is not None else r.answer_value
        for r in business_answers(edge).collect()
    }
    for question in QUESTIONS:
        assert together[question.name] == answer(edge, question.name).first()[0]
    assert together["on_time_delivery_rate_pct"] == 33.33
    assert together["avg_shipping_delay_days"] == 0.83


def test_profit_share_may_pass_one_hundred_percent(edge):
    shares = {
        r.customer_segment: r.share_pct
        for r in share_of_total(report(edge, "profit", "by_segment"), "total_profit", 2).collect()
    }
    assert shares == {"Consumer": 103.95, "Corporate": -0.66, "Home Office": -3.29}
    assert answer(edge, "most_profitable_segment").first()[0] == "Home Office"


def test_order_value_is_per_order(edge):
    assert deepdive.avg_order_value_by_order(edge).first().avg_order_value == 300.0


def test_discount_correlation(edge):
    assert deepdive.discount_profit_corr(edge).first()[0] == pytest.approx(-0.241436, abs=1e-6)


def test_clean_summary_counts_both_sides(edge_raw):
    summary = clean_summary(edge_raw).first()
    tidy = clean(edge_raw)
    assert summary.original_rows == 8 and summary.cleaned_rows == 6 and summary.rows_dropped == 2
    assert summary.original_cols == len(edge_raw.columns)
    assert summary.cleaned_cols == len(tidy.columns)
    gaps = sum(tidy.where(F.col(c).isNull()).count() for c in tidy.columns)
    assert summary.missing_after == gaps


def test_nan_counts_as_missing(spark, edge_raw):
    broken = edge_raw.withColumn("sales", F.lit(float("nan")))
    assert clean(broken).count() == 0


def test_empty_selection(edge):
    nothing = facet_filter(edge, {"market": ["Atlantis"]})
    assert tuple(kpis(nothing).first()) == (0.0, 0.0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
    assert report(nothing, "sales", "by_market").count() == 0
    assert [r.topic for r in insights(nothing).collect()] == ["empty"]
    assert [(r.rule_id, r.priority) for r in recommendations(nothing).collect()] == [("R0", "N/A")]
    assert answer(nothing, "top_market_by_revenue").first()[0] is None
    assert nothing.isEmpty()


def test_rules_fire_by_their_thresholds(edge):
    fired = {r.rule_id: r.priority for r in recommendations(edge).collect()}
    assert fired == {
        "R1": "Medium", "R2": "High", "R3": "High", "R4": "Medium", "R5": "Medium",
        "R6": "Low", "R7": "Low",
    }
    strict = recommendations(edge, late_rate_limit=40.0, discount_limit=90.0, margin_floor=-99.0)
    assert {r.rule_id: r.priority for r in strict.collect()} == {
        "R1": "High", "R4": "Medium", "R5": "Medium", "R6": "Low", "R7": "Low",
    }


def test_facets_combine(edge):
    chosen = facet_filter(edge, {"market": ["Europe", "Africa"], "order_year": [2017], "order_region": []})
    assert sorted(column(chosen, "order_id")) == [1, 1, 2]
    coverage = filter_coverage(edge, {"delivery_status": ["Late delivery"]}).first()
    assert tuple(coverage) == (3, 6, 50.0)
    with pytest.raises(ValueError):
        facet_filter(edge, {"sales": [1]})


def test_bands_keep_to_the_whole_table_after_filtering(edge):
    europe = facet_filter(edge, {"market": ["Europe"]})
    assert by_item(europe, "revenue_band") == ["Low", "High", "Very High"]


def test_explorer_shows_present_columns_in_order(edge):
    shown = explore(edge, limit=2)
    assert "product_name" in shown.columns and shown.count() == 2
    assert explore(edge, ["sales", "no_such"]).columns == ["sales"]


def test_report_order_and_size_can_change(edge):
    assert [r[0] for r in report(edge, "geo", "sales_by_market", n=1).collect()] == ["Europe"]
    rising = report(edge, "geo", "sales_by_market", order="asc")
    assert [r[0] for r in rising.collect()] == ["Africa", "Pacific Asia", "Europe"]
    assert set(geo_analysis(edge)) >= {"sales_by_country", "market_order_count"}


def test_features_need_no_cleaning_first(spark):
    rows = spark.createDataFrame(
        [(None, 1.0), (2.0, None), (0.0, None), (4.0, 1.0)], "sales double, profit double"
    ).withColumns(
        {
            "order_ts": F.lit(None).cast("timestamp_ntz"), "days_real": F.lit(1),
            "days_scheduled": F.lit(2), "delivery_status": F.lit(None).cast("string"),
        }
    )
    out = engineer_features(rows).collect()
    assert [r.profit_margin_pct for r in out] == [None, None, 0.0, 25.0]
    assert [r.is_late for r in out] == [0, 0, 0, 0]


def test_strip_removes_what_python_strips(spark):
    words = ["a", "", " a b ", "é x"] + [f"{c}a{c}b{c}" for c in WHITESPACE] + ["​a​"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.s for r in df.withColumn("s", strip("w")).collect()}
    assert got == {w: w.strip() for w in words}


@pytest.mark.parametrize(
    ("value", "text"),
    [
        (36_784_734.0, "$36.78M"), (-1_500_000.0, "$-1.50M"), (1_234.0, "$1.2K"),
        (999_999.9, "$1000.0K"), (3.454, "$3.45"), (-12.5, "$-12.50"), (0.0, "$0.00"),
        (1250.0, "$1.2K"), (1e12, "$1000000.00M"), (None, None),
    ],
)
def test_currency(spark, value, text):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(fmt_currency("v")).first()[0] == text


def test_number_cuts_fractions(spark):
    df = spark.createDataFrame([(1234567.9,), (-1234.9,), (0.0,)], "v double")
    assert [r[0] for r in df.select(fmt_number("v")).collect()] == ["1,234,567", "-1,234", "0"]


def test_guardrails(edge):
    guarded = deepdive.discount_guardrails(edge, ["cat Consumer"])
    states = {(r.discount_rate, r.guardrail) for r in guarded.collect()}
    assert states == {
        (0.05, "within cap"), (0.1, "within cap"), (0.0, "within cap"), (0.2, "over cap"),
    }
    tight = deepdive.discount_guardrails(edge, [], standard_cap=0.01, approval_above=0.1)
    assert {r.guardrail for r in tight.where("discount_rate = 0.2").collect()} == {"needs approval"}


def test_profile(edge_raw):
    assert quality.invalid_dates(edge_raw).first()[0] == 2
    assert tuple(quality.negative_profit(edge_raw).first()) == (1, 12.5)
    assert quality.negative_sales(edge_raw).first()[0] == 0
    gaps = {r.column_name: r.missing_count for r in quality.missing_values(edge_raw).collect()}
    assert gaps["customer_lname"] == 1 and gaps["sales"] == 1 and "order_id" not in gaps
    values = [r.value for r in quality.categorical_values(edge_raw).collect() if r.column_name == "market"]
    assert sorted(values) == ["Africa", "Europe", "Pacific Asia"]
    uniques = {r.column_name: r.unique_values for r in quality.categorical_uniques(edge_raw).collect()}
    assert uniques["market"] == 3


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "America/Sao_Paulo"])
def test_dates_do_not_depend_on_the_session_zone(spark, zone):
    texts = ["3/12/2017 2:30", "10/16/2016 00:00", "11/5/2017 1:30", "2/30/2017 1:00",
             " 1/1/2017 1:00", "1/1/2017 24:00", "12/31/1969 23:59", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = [r[0] for r in df.select(parse_date("t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [
        datetime(2017, 3, 12, 2, 30), datetime(2016, 10, 16), datetime(2017, 11, 5, 1, 30),
        None, None, None, datetime(1969, 12, 31, 23, 59), None,
    ]
