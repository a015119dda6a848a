"""What moves between tasks grows no faster than it must, and results stay the same."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cargolens.operators.clustering import z_ordered
from cargolens.operators.coding import coded, small_vocabularies
from cargolens.operators.distinct_sets import key_places
from cargolens.operators.quality import duplicate_rows
from cargolens.operators.samples import DRAW, smallest_draws, with_draw
from cargolens.operators.stored_quantiles import value_counts
from cargolens.operators.summary import summarize
from cargolens.schema import FACETS
from cargolens.sources.files import read_csv, write_csv
from cargolens.sources.star import bind_star_schema
from tests.conftest import TABLES
from workload import tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def groups(spark):
    rng = random.Random(7)
    rows = [
        (rng.choice(["a", "", "é", None]), rng.choice([1997, -1, None]), rng.choice([True, None]), f"u{i}", rng.choice([i // 3 + 1, None]))
        for i in range(3000)
    ]
    return spark.createDataFrame(rows, "d string, y int, b boolean, u string, order_id bigint")


def test_dimensions_come_back_from_their_number(groups):
    dims = ["u", "y", "b", "d"]
    assert small_vocabularies(groups, dims) == {"y": [-1, 1997], "d": ["", "a", "é"]}
    rows, by, opened = coded(groups, dims)
    assert by == ["__code", "u", "b"]
    got = opened(rows.groupBy(*by).agg(F.count("order_id").alias("n")))
    want = groups.groupBy(*dims).agg(F.count("order_id").alias("n"))
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    none = groups.limit(0)
    rows, by, opened = coded(none, dims)
    assert opened(rows.groupBy(*by).agg(F.count("order_id").alias("n"))).collect() == []


def test_places_and_groups_move_as_numbers(groups, prepared):
    places = key_places(groups, ["d", "y"], ["order_id"])
    want = {}
    for r in groups.collect():
        if r.order_id is not None:
            bucket, place = divmod(r.order_id - 1, 1 << 15)
            want.setdefault((r.d, r.y, "order_id", bucket + 1), set()).add(place)
    got = {(r.d, r.y, r.key, r.bucket): set(r.places) for r in places.collect()}
    assert got == want
    assert "hashpartitioning(__code" in plan_of(places)
    assert "hashpartitioning(__code" in plan_of(summarize(prepared))


def test_curve_joins_nothing(prepared):
    assert "Join" not in plan_of(z_ordered(prepared, FACETS, ["order_ts"]))


def test_repeated_hashes_are_small_before_rows_move(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 4000).alias("a"), F.lit(None).cast("string").alias("b"))

    def store(df):
        df.write.parquet(str(tmp_path / "kept"))
        return spark.read.parquet(str(tmp_path / "kept"))

    counted = duplicate_rows(rows, store)
    assert "BroadcastHashJoin" in plan_of(counted) and "SortMergeJoin" not in plan_of(counted)
    assert counted.first()[0] == duplicate_rows(rows).first()[0] == 1000


def test_items_are_not_dealt_by_country(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(bind_star_schema(spark, TABLES))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [c_nationkey" in plan and "hashpartitioning(c_nationkey" not in plan
    line = next(x for x in plan.splitlines() if "SortMergeJoin [l_partkey" in x)
    order = next(x for x in plan.splitlines() if "SortMergeJoin [l_orderkey" in x)
    assert plan.index(order) < plan.index(line)  # the plan's root comes first


def test_partitions_follow_the_input(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError), tables.partitions_for(spark, 100 * tables.BYTES_A_PARTITION + 1):
        assert spark.conf.get(key) == "101"
        raise RuntimeError
    assert spark.conf.get(key) == before
    with tables.partitions_for(spark, 1):
        assert spark.conf.get(key) == before


def test_samples_send_few_rows(spark):
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("s"))
    drawn = with_draw(rows, ["id"])
    few = smallest_draws(drawn, 1500, ["s"], ["id"])
    assert few.columns == drawn.columns and "BroadcastHashJoin" in plan_of(few)
    want = {}
    for r in drawn.collect():
        want.setdefault(r.s, []).append((r[DRAW], r.id))
    got = {}
    for r in few.collect():
        got.setdefault(r.s, []).append((r[DRAW], r.id))
    assert {s: sorted(v) for s, v in got.items()} == {s: sorted(v)[:1500] for s, v in want.items()}


def test_values_move_once(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("part"), (F.col("id") % 7).alias("sales"))
    counts = value_counts(df, "sales", "part")
    assert plan_of(counts).count("Exchange ") == 1
    assert sum(r.n for r in counts.collect()) == 1000 and counts.count() == 14


def test_packed_csv(spark, edge_raw, tmp_path):
    write_csv(edge_raw, str(tmp_path / "out"), raw_headers=True, encoding="ISO-8859-1", compression="gzip")
    assert list((tmp_path / "out").glob("*.csv.gz")) and not list((tmp_path / "out").glob("*.csv"))
    back = read_csv(spark, str(tmp_path / "out"))
    assert sorted(r.order_id for r in back.collect()) == sorted(r.order_id for r in edge_raw.collect())
