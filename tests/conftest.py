from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cargolens import build_session

    session = build_session(
        "tests",
        "local[4]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def prepared(spark):
    """The prepared table of the smallest test tables."""
    from workload.queries import mart

    return mart(spark, TABLES)


@pytest.fixture(scope="session")
def raw(spark):
    from workload.queries import raw_items

    return raw_items(spark, TABLES)


EDGE_COLUMNS = (
    "order_id bigint, customer_id bigint, customer_fname string, customer_lname string, "
    "customer_zipcode double, market string, order_region string, customer_segment string, "
    "shipping_mode string, delivery_status string, order_status string, sales double, "
    "profit double, discount_rate double, days_real int, days_scheduled int, "
    "order_date_raw string"
)
EDGE_ROWS = [
    (1, 10, " Ann ", "Lee", 1.0, "Europe", "West", "Consumer", "First Class", "Late delivery",
     "COMPLETE", 100.0, 20.0, 0.05, 2, 1, "1/31/2017 22:56"),
    (1, 10, "Ann", "Lee", 1.0, "Europe", "West", "Consumer", "First Class", "Shipping on time",
     "COMPLETE", 300.0, -900.0, 0.10, 1, 1, "01/31/2017 23:10"),
    (2, 11, "Bo", None, None, "Africa", "South", "Corporate", "Same Day", "Late delivery",
     "PENDING", 0.0, 5.0, 0.0, 3, 0, "02/01/2017 00:00"),
    (3, 12, "Cy", " ", 3.0, "Africa", "South", "Consumer", "Standard Class", "Advance shipping",
     "COMPLETE", 200.0, 50.0, 0.0, 2, 4, "not a date"),
    (4, 10, "Ann", "Lee", 1.0, "Europe", None, "Consumer", "Standard Class", None,
     "ON_HOLD", 400.0, 40.0, 0.2, 4, 4, None),
    (5, 13, "Di", "Fox\t", 5.0, None, "West", "Home Office", "Second Class", "Late delivery",
     "COMPLETE", None, 9.0, 0.0, 5, 2, "03/05/2018 10:00"),
    (6, 14, "Ed", "Gee", 6.0, "Pacific Asia", "East", "Home Office", "Second Class",
     "Late delivery", "PENDING", 500.0, None, 0.0, 5, 2, "03/06/2018 10:00"),
    (7, 15, "Flo", "Hay", 7.0, "Pacific Asia", "East", "Home Office", "Second Class",
     "Late delivery", "PENDING", 500.0, 25.0, 0.0, 5, 2, "12/31/2018 23:59"),
]


@pytest.fixture(scope="session")
def edge_raw(spark):
    """Hand-made rows, with the columns the reports need beside them."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(EDGE_ROWS, EDGE_COLUMNS)
    return rows.withColumns(
        {
            "category_name": F.concat(F.lit("cat "), "customer_segment"),
            "department_name": F.concat(F.lit("dep "), "customer_segment"),
            "product_name": F.concat(F.lit("prod "), "market"),
            "order_country": F.col("market"),
            "payment_type": F.lit("CASH"),
            "late_delivery_risk": (F.col("days_real") > F.col("days_scheduled")).cast("int"),
            "customer_email": F.lit("x"),
            "product_image": F.lit("x"),
            "shipping_date_raw": F.col("order_date_raw"),
        }
    )


@pytest.fixture(scope="session")
def edge(edge_raw):
    from cargolens import prepare

    return prepare(edge_raw)
