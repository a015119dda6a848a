"""Top keys, pages, moments, profiles, samples and bucketed storage against plain computations."""

from __future__ import annotations

import random
import uuid
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.operators import deepdive
from cargolens.operators.moments import comoments_of, correlation, deviations, merged_comoments
from cargolens.operators.paging import page
from cargolens.operators.profiles import RANK_ERROR, merged_profiles, profile_parts
from cargolens.operators.quality import sample_rows
from cargolens.operators.samples import DRAW, smallest_draws, with_draw
from cargolens.operators.top_keys import bucket_bounds, candidates, top_keys
from cargolens.schema import EXPLORER_COLUMNS
from cargolens.sources.files import write_bucketed
from workload.queries import mart
from tests.conftest import TABLES


def plain_top(rows, k, largest):
    totals = {}
    for key, value in rows:
        if key is not None:
            totals[key] = totals.get(key, 0) + (value or 0)
    order = sorted(totals.items(), key=lambda x: (-x[1] if largest else x[1], x[0]))
    return [(key, float(total)) for key, total in order[:k]]


@pytest.mark.parametrize("largest", [True, False])
def test_top_keys(spark, largest):
    rng = random.Random(1)
    tables = {
        "skewed": [(min(int(rng.paretovariate(0.7)), 5000), Decimal(rng.randint(-50, 900)) / 100) for _ in range(20_000)],
        "ties": [(i % 700, Decimal(1)) for i in range(7000)],
        "losses": [(rng.randint(0, 300), Decimal(-rng.randint(1, 99))) for _ in range(3000)],
        "few": [(1, Decimal(5)), (2, None), (None, Decimal(900)), (3, Decimal(-2))],
        "none": [],
    }
    for name, rows in tables.items():
        df = spark.createDataFrame(rows, "k int, v decimal(12,2)").withColumn("bound", F.lit(1))
        for buckets in (16, 1 << 16):
            got = [tuple(r) for r in top_keys(df, ["k"], "v", 10, largest, buckets).collect()]
            assert got == plain_top(rows, 10, largest), (name, buckets)


def test_few_keys_are_grouped(spark):
    # 50,000 customers, of whom few buy much
    df = spark.range(400_000).select(
        (F.pow(F.rand(3), 3) * 50_000).cast("int").alias("k"), (F.rand(4) * 100).cast("decimal(12,2)").alias("v")
    ).unionByName(spark.range(3000).select((F.col("id") % 30 + 60_000).cast("int").alias("k"), F.lit(500).cast("decimal(12,2)").alias("v")))
    rows = candidates(df, ["k"], "v", 20)
    assert rows.select("k").distinct().count() < 2_000
    want = df.groupBy("k").agg(F.sum("v").cast("double").alias("total")).orderBy(F.desc("total"), "k").limit(20)
    assert [tuple(r) for r in top_keys(df, ["k"], "v", 20).collect()] == [tuple(r) for r in want.collect()]
    bounds = bucket_bounds(df, ["k"], F.col("v"))
    assert bounds.count() <= 2 << 16


def test_pages_are_the_sorted_table(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), rng.choice([0.5, 1.5])) for _ in range(400)]
    spark.createDataFrame(rows, "x int, y string, z double").repartition(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for order in (["x", "y"], ["y", "x", "z"]):
        after, got = None, []
        while True:
            shown = page(df, order, 37, after)
            got += [tuple(r) for r in shown.rows]
            after = shown.after
            if after is None:
                break
        assert len(got) == 400 and sorted(map(repr, got)) == sorted(map(repr, rows))
        at = [["x", "y", "z"].index(c) for c in order]
        keys = [tuple((r[i] is None, r[i] or 0) for i in at) for r in got]
        keys = [tuple((a, str(b)) for a, b in k) for k in keys]
        assert keys == sorted(keys)


def test_pages_reach_the_scan(spark, prepared):
    first = page(prepared, EXPLORER_COLUMNS, 50, columns=["order_id", "order_ts"])
    second = page(prepared, EXPLORER_COLUMNS, 50, first.after, ["order_id", "order_ts"])
    whole = prepared.orderBy(*[F.col(c).asc_nulls_last() for c in EXPLORER_COLUMNS]).limit(100)
    want = [r.order_ts for r in whole.select("order_ts").collect()]
    assert [r.order_ts for r in first.rows + second.rows] == want
    assert set(second.rows[0].asDict()) == {"order_id", "order_ts"}
    filtered = prepared.where((F.col("order_ts") >= F.lit(str(want[49])).cast("timestamp_ntz")) | F.col("order_ts").isNull())
    assert "Or(GreaterThanOrEqual(order_ts" in filtered._jdf.queryExecution().toString()


def test_moments_merge(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e9, 1.0, 3000)  # plain sums of squares would lose all digits here
    y = 0.5 * (x - 1e9) + rng.normal(0, 1, 3000)
    rows = [(int(rng.integers(0, 40)), float(a), float(b)) for a, b in zip(x, y)] + [(1, None, 2.0), (99, 3.0, None)]
    groups = spark.createDataFrame(rows, "g int, x double, y double").groupBy("g").agg(*comoments_of("x", "y"))
    merged = merged_comoments(groups)
    assert correlation(merged).first()[0] == pytest.approx(np.corrcoef(x, y)[0, 1], rel=1e-6)
    got = deviations(merged).first()
    assert (got.pairs, got.std_x, got.std_y) == (3000, pytest.approx(x.std(ddof=1), rel=1e-6), pytest.approx(y.std(ddof=1), rel=1e-9))
    assert correlation(merged_comoments(groups.limit(0))).first()[0] is None
    one = groups.where("g = 99")
    assert correlation(merged_comoments(one)).first()[0] is None


def test_profiles_merge(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.lognormal(4, 1, 30_000), rng.normal(-5, 3, 20_000), np.full(10_000, 7.0)])
    rows = [(int(i % 9), float(v)) for i, v in enumerate(values)] + [(3, float("nan")), (4, None)]
    df = spark.createDataFrame(rows, "part int, a double").withColumn("b", F.lit(None).cast("int"))
    got = {r.column_name: r for r in merged_profiles(profile_parts(df, ["a", "b"], "part")).collect()}
    a = got["a"]
    assert (a["count"], a.min, a.max) == (len(values), values.min(), values.max())
    assert a.mean == pytest.approx(values.mean()) and a.std == pytest.approx(values.std(ddof=1))
    ordered = np.sort(values)
    for label, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        low, high = np.searchsorted(ordered, a[label], "left") / len(ordered), np.searchsorted(ordered, a[label], "right") / len(ordered)
        assert low - RANK_ERROR <= p <= high + RANK_ERROR
    b = got["b"]
    assert b["count"] == 0 and b.mean is None and b.std is None and b.p50 is None and b.max is None


def test_samples_merge(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abc"), rng.choice([None, 1.0, 2.0])) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, s string, v double")
    drawn = with_draw(df, ["id"])
    whole = {tuple(r) for r in smallest_draws(drawn, 50, ["s"], ["id"]).collect()}
    assert len(whole) == 150
    for parts in (2, 7):
        dealt = drawn.withColumn("part", F.pmod(F.xxhash64("v", "id"), F.lit(parts)))
        stored = smallest_draws(dealt, 50, ["part", "s"], ["id"]).drop("part")
        assert {tuple(r) for r in smallest_draws(stored, 50, ["s"], ["id"]).collect()} == whole
    direct = {r.id for r in sample_rows(df, ["id"], ["id"], 40).collect()}
    assert direct == {r.id for r in smallest_draws(drawn.withColumn("all", F.lit(0)), 40, ["all"], ["id"]).collect()}
    assert DRAW not in sample_rows(df, ["id"], ["id"], 40).columns


def test_orders_in_buckets_need_no_exchange(spark, tmp_path):
    table = f"orders_{uuid.uuid4().hex}"
    items = mart(spark, TABLES).select("order_id", "sales")
    write_bucketed(items, table, str(tmp_path / "b"), "order_id", 4)
    back = spark.table(table)
    plan = back.groupBy("order_id").agg(F.sum("sales"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    for figure in (deepdive.avg_order_value_by_order, deepdive.order_value_range):
        assert figure(back).collect() == figure(items).collect()
    spark.sql(f"DROP TABLE {table}")
