"""Raw order items assembled from a star schema (lineitem, orders, customer, ...).

The result has the columns and the dirt of an order-item file: padded names, missing
last names and zip codes, unreadable dates and missing sales. Items meet their parts first and
their orders last, so the long names of orders and customers are shuffled once an order and not
once an item. Only the countries are hinted, a few rows whatever the number of items: the
optimizer broadcasts any other side only after checking its size, and adaptive
execution splits skewed customers and parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _days_between(ship: str, order: str) -> Column:
    """Days from order to shipping, folded into 0..6."""
    return F.pmod(F.datediff(F.col(ship), F.col(order)), F.lit(7)).cast("int")


def bind_star_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Join the star schema in ``folder`` into raw order items."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")

    countries = table("nation").join(
        table("region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    # names are split once a customer, and prices cast once an item
    customers = table("customer").withColumns(
        {f"c_name_{i}": F.split_part("c_name", F.lit("#"), F.lit(i)) for i in (1, 2)}
    )
    placed = table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    # of the shipping time only the day counts, which takes less room in the shuffles
    shipped = table("lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    items = (
        shipped.join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(F.broadcast(countries), F.col("c_nationkey") == F.col("n_nationkey"))
    )

    price = F.col("price")
    kept_share = F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    cost = F.col("l_quantity").cast("decimal(8,0)") * F.col("p_retailprice").cast("decimal(12,2)")
    canceled = (F.col("o_orderstatus") == "P") & (F.col("l_returnflag") == "R")
    mode = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Same Day")
        .when(F.col("o_orderpriority") == "2-HIGH", "First Class")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Second Class")
        .otherwise("Standard Class")
    )
    scheduled = (
        F.when(F.col("shipping_mode") == "Same Day", 0)
        .when(F.col("shipping_mode") == "First Class", 1)
        .when(F.col("shipping_mode") == "Second Class", 2)
        .otherwise(4)
    )
    text_date = "MM/dd/yyyy HH:mm"

    dated = items.withColumns(
        {
            "shipping_mode": mode,
            "days_real": _days_between("l_shipdate", "o_orderdate"),
            "price": F.col("l_extendedprice").cast("decimal(12,2)"),
        }
    ).withColumn("days_scheduled", scheduled)

    return dated.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("c_custkey").alias("customer_id"),
        F.concat(F.lit(" "), "c_name_1", F.lit(" ")).alias("customer_fname"),
        F.when(F.col("c_custkey") % 50 != 0, F.col("c_name_2")).alias("customer_lname"),
        F.when(
            F.col("c_custkey") % 40 != 0, (F.col("c_custkey") + 10000).cast("double")
        ).alias("customer_zipcode"),
        F.col("c_mktsegment").alias("customer_segment"),
        F.lit("XXXXXXXXX").alias("customer_email"),
        F.lit("XXXXXXXXX").alias("customer_password"),
        F.when(F.col("l_returnflag") == "A", "DEBIT")
        .when(F.col("l_returnflag") == "N", "TRANSFER")
        .when(F.col("l_returnflag") == "R", "CASH")
        .alias("payment_type"),
        F.col("r_name").alias("market"),
        F.concat(
            F.col("r_name"), F.when(F.col("n_nationkey") < 13, " West").otherwise(" East")
        ).alias("order_region"),
        F.col("n_name").alias("order_country"),
        F.when(canceled, "CANCELED")
        .when(F.col("o_orderstatus") == "F", "COMPLETE")
        .when(F.col("o_orderstatus") == "O", "PENDING")
        .otherwise("PROCESSING")
        .alias("order_status"),
        F.when(canceled, "Shipping canceled")
        .when(F.col("days_real") > F.col("days_scheduled"), "Late delivery")
        .when(F.col("days_real") < F.col("days_scheduled"), "Advance shipping")
        .otherwise("Shipping on time")
        .alias("delivery_status"),
        "shipping_mode",
        F.col("p_brand").alias("category_name"),
        F.col("p_type").alias("department_name"),
        F.col("p_name").alias("product_name"),
        F.lit("no description").alias("product_description"),
        F.lit("no image").alias("product_image"),
        F.when(F.col("l_orderkey") % 997 != 0, price).alias("sales"),
        (price * kept_share - cost).cast("decimal(18,4)").alias("profit"),
        F.col("l_discount").alias("discount_rate"),
        "days_real",
        "days_scheduled",
        (F.col("days_real") > F.col("days_scheduled")).cast("int").alias("late_delivery_risk"),
        F.when(F.col("l_orderkey") % 499 == 1, "not a date")
        .otherwise(F.date_format("o_orderdate", text_date))
        .alias("order_date_raw"),
        F.date_format(
            F.date_add(F.col("o_orderdate").cast("date"), F.col("days_real")), text_date
        ).alias("shipping_date_raw"),
    )
