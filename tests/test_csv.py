"""Reading and writing CSV."""

from __future__ import annotations

import pytest

from cargolens import clean, clean_summary, load_and_prepare, read_csv, write_csv, write_mart
from cargolens.operators import quality

HEADER = (
    "Order Id,Customer Fname,Customer Lname,Sales,Order Profit Per Order,"
    "Customer Zipcode,Days for shipping (real),order date (DateOrders),Extra\n"
)
BODY = (
    '1,José,NA,"1.5",2.5,10,3,1/5/2018 7:05,"a, b"\n'
    '2,N/A, ,nan,None,null,x,bad,"say ""hi"""\n'
    '3,"two\nlines",,-1,NULL,,4,12/31/2018 23:59,plain\n'
)


@pytest.fixture(scope="module")
def messy(tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "items.csv"
    path.write_bytes((HEADER + BODY).encode("latin-1"))
    return str(path)


def test_cells_are_read_as_declared(spark, messy):
    rows = {r.order_id: r for r in read_csv(spark, messy, multi_line=True).collect()}
    assert len(rows) == 3
    assert rows[1].customer_fname == "José" and rows[1].customer_lname is None
    assert rows[1].sales == 1.5 and rows[1].Extra == "a, b" and rows[1].days_real == 3
    assert rows[2].customer_fname is None and rows[2].customer_lname == " "
    assert rows[2].sales is None and rows[2].profit is None and rows[2].days_real is None
    assert rows[2].Extra == 'say "hi"' and rows[2].order_date_raw == "bad"
    assert rows[3].customer_fname == "two\nlines" and rows[3].profit is None
    assert rows[3].customer_zipcode is None


def test_round_trip_keeps_every_cell(spark, raw, tmp_path):
    path = str(tmp_path / "out")
    write_csv(raw, path, raw_headers=True, encoding="ISO-8859-1")
    back = read_csv(spark, path)
    assert back.columns == raw.columns
    same = [raw[c].cast(dict(back.dtypes)[c]).alias(c) for c in raw.columns]
    expected = raw.select(*same)
    assert expected.exceptAll(back).isEmpty() and back.exceptAll(expected).isEmpty()


def test_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Order Id,Sales,Market,Latitude\n1,20.0,Europe,1.5\n")
    (tmp_path / "b.csv").write_text("Market,Order Id,Sales,Unit.Price\nAfrica,2,30.0,7\n")
    both = read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], types={"Latitude": "double"})
    got = {r.order_id: r for r in both.collect()}
    assert (got[1].market, got[1].sales, got[1].Latitude, got[1]["Unit.Price"]) == ("Europe", 20.0, 1.5, None)
    assert (got[2].market, got[2].sales, got[2].Latitude, got[2]["Unit.Price"]) == ("Africa", 30.0, None, "7")
    assert dict(both.dtypes)["Latitude"] == "double"
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(tmp_path / "*.csv")).collect()


def test_names_with_dots(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Order Id,Sales,Order Profit Per Order,Unit.Price\n1,20.0,1, 7 \n2,3,4,NA\n")
    raw = read_csv(spark, str(tmp_path / "a.csv"), types={"Unit.Price": "string"})
    assert [r["Unit.Price"] for r in clean(raw).orderBy("order_id").collect()] == ["7", None]
    assert {r.column_name: r.missing_count for r in quality.missing_values(raw).collect()} == {"Unit.Price": 1}
    assert quality.column_types(raw).count() == 4 and quality.duplicate_rows(raw).first()[0] == 0
    priced = raw.withColumn("Unit.Price", raw["`Unit.Price`"].try_cast("double"))
    described = {r.column_name: r for r in quality.numeric_describe(priced).collect()}
    assert described["Unit.Price"]["count"] == 1 and described["Unit.Price"]["max"] == 7


def test_limit_is_opt_in(spark, raw, tmp_path):
    write_csv(raw, str(tmp_path / "few"), ["order_id", "market"], limit=7)
    assert spark.read.option("header", True).csv(str(tmp_path / "few")).count() == 7


def test_load_and_prepare(spark, raw, prepared, tmp_path):
    path = str(tmp_path / "items")
    write_csv(raw, path, raw_headers=True, encoding="ISO-8859-1")
    table, summary = load_and_prepare(spark, path, str(tmp_path / "mart"))
    assert summary.collect() == clean_summary(read_csv(spark, path)).collect()
    assert table.count() == prepared.count() == summary.first().cleaned_rows
    assert set(table.columns) == set(prepared.columns)


def test_mart_is_split_by_year(spark, prepared, tmp_path):
    path = str(tmp_path / "mart")
    write_mart(prepared, path)
    back = spark.read.parquet(path)
    assert back.count() == prepared.count()
    plan = back.where("order_year = 1997")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_year" in plan
