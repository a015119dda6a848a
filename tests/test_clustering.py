"""Marts along a Z-order curve and the counts of a sidebar."""

from __future__ import annotations

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cargolens.operators.clustering import interleaved, value_ranks, z_ordered
from cargolens.operators.facets import drill_options, facet_filter
from cargolens.schema import FACETS
from cargolens.sources.files import write_clustered, write_mart


def test_interleaved_bits(spark):
    rows = [(0, 0), (1, 0), (0, 1), (3, 5), (127, 127), (64, 1)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = [r.z for r in df.select(interleaved([F.col("a"), F.col("b")]).alias("z")).collect()]
    want = [int("".join(x + y for x, y in zip(f"{a:07b}", f"{b:07b}")), 2) for a, b in rows]
    assert got == want
    with pytest.raises(ValueError, match="too many bits"):
        interleaved([F.lit(0)] * 10)


def test_ranks_rise_with_values(spark):
    for n in (1, 5, 127, 128, 1000):
        df = spark.range(n * 3).select((F.col("id") % n).alias("c")).unionByName(spark.createDataFrame([(None,)], "c bigint"))
        ranks = value_ranks(df, "c").orderBy("value").collect()
        assert len(ranks) == n
        got = [r["rank"] for r in ranks]
        assert got == sorted(got) and 1 <= got[0] and got[-1] <= 127
        assert n > 127 or len(set(got)) == n


def test_no_row_or_column_changes(spark, edge):
    odd = edge.withColumns({"__z_": F.lit(1), "a.b": F.col("sales")})
    back = z_ordered(odd, FACETS, ["order_ts"], 3)
    assert back.columns == odd.columns
    assert sorted(map(repr, back.collect())) == sorted(map(repr, odd.collect()))


def read_share(path, selection):
    """Share of rows in row groups whose least and greatest values admit the selection."""
    total = read = 0
    for file in Path(path).rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            columns = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
            total += group.num_rows
            fits = all(any(columns[f].min <= v <= columns[f].max for v in values) for f, values in selection.items())
            read += group.num_rows * fits
    return read / total


def test_filters_on_several_facets_skip_row_groups(spark, prepared, tmp_path):
    curve, years = str(tmp_path / "curve"), str(tmp_path / "years")
    write_clustered(prepared, curve, files=64)
    write_mart(prepared.repartition(64), years, partition_by=())
    two = {"market": ["ASIA"], "shipping_mode": ["First Class"]}
    three = {"customer_segment": ["BUILDING"], "order_region": ["EUROPE West"], "order_year": [1997]}
    for selection in (two, three):
        assert read_share(years, selection) > 0.95
        assert read_share(curve, selection) < 0.45
        back = spark.read.parquet(curve)
        assert facet_filter(back, selection).count() == facet_filter(prepared, selection).count()
        plan = facet_filter(back, selection)._jdf.queryExecution().toString()
        assert all(f in plan.split("PushedFilters")[1][:600] for f in selection)


def plain_options(rows, selection):
    out = {}
    for facet in FACETS:
        others = {f: v for f, v in selection.items() if v and f != facet}
        for row in rows:
            if row[facet] is not None and all(row[f] in v for f, v in others.items()):
                chosen = bool(selection.get(facet)) and row[facet] in selection[facet]
                key = (facet, str(row[facet]), chosen)
                out[key] = out.get(key, 0) + 1
    return out


def test_drill_options(spark, prepared, edge):
    rng = random.Random(3)
    for df in (prepared, edge):
        rows = df.select(*FACETS).collect()
        values = {f: sorted({r[f] for r in rows if r[f] is not None}) for f in FACETS}
        for _ in range(4):
            selection = {f: rng.sample(values[f], rng.randint(0, len(values[f]))) for f in rng.sample(FACETS, 4)}
            got = {(r.facet, r.option, r.chosen): r["items"] for r in drill_options(df, selection).collect()}
            assert got == plain_options(rows, selection)
    assert drill_options(edge.limit(0), {}).count() == 0
    with pytest.raises(ValueError, match="not a facet"):
        drill_options(edge, {"sales": [1]})


def test_drill_options_scan_once(spark, prepared):
    plan = drill_options(prepared, {"market": ["ASIA"]})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
