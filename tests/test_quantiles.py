"""Exact quantiles against NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from cargolens.operators.quantiles import exact_quantiles

PROBABILITIES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
rng = np.random.default_rng(7)
CASES = {
    "single": [3.5],
    "pair": [1.0, 2.0],
    "constant": [4.2] * 100,
    "hot value": [299.98] * 500 + list(rng.normal(300, 50, 1000)),
    "negative": list(-rng.lognormal(3, 2, 900)) + [0.0] * 50,
    "heavy tail": list(rng.pareto(0.5, 2000) * 10) + [1e15, -1e15],
    "tiny steps": list(1e6 + rng.integers(0, 50, 2000) * 1e-7),
    "whole numbers": [float(x) for x in rng.integers(-5, 5, 700)],
    "wide": [float(f"1e{e}") for e in range(-300, 300, 7)],
}


@pytest.mark.parametrize("name", CASES)
def test_matches_numpy(spark, name):
    values = [float(v) for v in CASES[name]]
    df = spark.createDataFrame([(v,) for v in values + [None, float("nan")]], "x double")
    got = {r.probability: r.value for r in exact_quantiles(df, ["x"], PROBABILITIES).collect()}
    for p in PROBABILITIES:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-300)


def test_many_columns_at_once(spark):
    data = [(i, float(i * i), i % 3) for i in range(101)]
    df = spark.createDataFrame(data, "a bigint, b double, c int").repartition(5)
    got = {
        (r.column_name, r.probability): r.value
        for r in exact_quantiles(df, ["a", "b", "c"], (0.25, 0.5)).collect()
    }
    assert got == {
        ("a", 0.25): 25.0, ("a", 0.5): 50.0, ("b", 0.25): 625.0, ("b", 0.5): 2500.0,
        ("c", 0.25): 0.0, ("c", 0.5): 1.0,
    }


def test_no_values_no_rows(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, ["x"], (0.5,)).isEmpty()


def test_three_scans_and_no_python(spark, raw):
    df = exact_quantiles(raw, ["sales", "profit"], (0.25, 0.5, 0.75))
    assert df.count() == 6
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    assert final.count("FileScan") <= 3 and "ReusedExchange" in final
    assert not [w for w in ("Python", "Cartesian", "NestedLoop") if w in text]
