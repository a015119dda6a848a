"""DuckDB SQL for the registered queries, written against the star schema alone."""

from __future__ import annotations

RAW = """
raw_keys AS (
  SELECT *,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
    (o_orderstatus = 'P' AND l_returnflag = 'R') AS canceled,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Same Day' WHEN '2-HIGH' THEN 'First Class'
      WHEN '3-MEDIUM' THEN 'Second Class' ELSE 'Standard Class' END AS mode_name,
    CAST(((datediff('day', o_orderdate, l_shipdate) % 7) + 7) % 7 AS INTEGER) AS real_days,
    CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1
      WHEN '3-MEDIUM' THEN 2 ELSE 4 END AS planned_days
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
),
raw AS (
  SELECT
    l_orderkey AS order_id,
    c_custkey AS customer_id,
    ' ' || split_part(c_name, '#', 1) || ' ' AS customer_fname,
    CASE WHEN c_custkey % 50 <> 0 THEN split_part(c_name, '#', 2) END AS customer_lname,
    CASE WHEN c_custkey % 40 <> 0 THEN CAST(10000 + c_custkey AS DOUBLE) END AS customer_zipcode,
    c_mktsegment AS customer_segment,
    'XXXXXXXXX' AS customer_email,
    'XXXXXXXXX' AS customer_password,
    CASE l_returnflag WHEN 'A' THEN 'DEBIT' WHEN 'N' THEN 'TRANSFER' WHEN 'R' THEN 'CASH' END
      AS payment_type,
    r_name AS market,
    r_name || CASE WHEN n_nationkey < 13 THEN ' West' ELSE ' East' END AS order_region,
    n_name AS order_country,
    CASE WHEN canceled THEN 'CANCELED' WHEN o_orderstatus = 'F' THEN 'COMPLETE'
      WHEN o_orderstatus = 'O' THEN 'PENDING' ELSE 'PROCESSING' END AS order_status,
    CASE WHEN canceled THEN 'Shipping canceled' WHEN real_days > planned_days THEN 'Late delivery'
      WHEN real_days < planned_days THEN 'Advance shipping' ELSE 'Shipping on time' END
      AS delivery_status,
    mode_name AS shipping_mode,
    p_brand AS category_name,
    p_type AS department_name,
    p_name AS product_name,
    'no description' AS product_description,
    'no image' AS product_image,
    CASE WHEN l_orderkey % 997 <> 0 THEN price END AS sales,
    CAST(price * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))
      - CAST(l_quantity AS DECIMAL(8,0)) * CAST(p_retailprice AS DECIMAL(12,2))
      AS DECIMAL(18,4)) AS profit,
    l_discount AS discount_rate,
    real_days AS days_real,
    CAST(planned_days AS INTEGER) AS days_scheduled,
    CAST(real_days > planned_days AS INTEGER) AS late_delivery_risk,
    CASE WHEN l_orderkey % 499 = 1 THEN 'not a date'
      ELSE strftime(o_orderdate, '%m/%d/%Y %H:%M') END AS order_date_raw,
    strftime(date_trunc('day', o_orderdate) + to_days(real_days), '%m/%d/%Y %H:%M')
      AS shipping_date_raw
  FROM raw_keys
)"""

MART = (
    RAW
    + """,
cleaned AS (
  SELECT * EXCLUDE (customer_email, customer_password, product_description, product_image,
      order_date_raw, shipping_date_raw, customer_fname, customer_lname, customer_zipcode),
    trim(customer_fname) AS customer_fname,
    coalesce(customer_lname, 'Unknown') AS customer_lname,
    coalesce(customer_zipcode, 0.0) AS customer_zipcode,
    try_strptime(order_date_raw, '%m/%d/%Y %H:%M') AS order_ts,
    try_strptime(shipping_date_raw, '%m/%d/%Y %H:%M') AS shipping_ts
  FROM raw
  WHERE sales IS NOT NULL AND profit IS NOT NULL
),
edges AS (
  SELECT quantile_cont(CAST(sales AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM cleaned
),
mart AS (
  SELECT cleaned.*,
    CAST(year(order_ts) AS INTEGER) AS order_year,
    CAST(month(order_ts) AS INTEGER) AS order_month,
    strftime(order_ts, '%b') AS order_month_name,
    'Q' || CAST(quarter(order_ts) AS VARCHAR) AS order_quarter,
    strftime(order_ts, '%Y-%m') AS order_year_month,
    days_real - days_scheduled AS shipping_delay_days,
    CASE WHEN delivery_status = 'Late delivery' THEN 1 ELSE 0 END AS is_late,
    CASE WHEN sales = 0 THEN 0.0
      ELSE greatest(-200.0::DOUBLE, least(200.0::DOUBLE,
        CAST(profit AS DOUBLE) / CAST(sales AS DOUBLE) * 100)) END AS profit_margin_pct,
    CASE WHEN CAST(sales AS DOUBLE) <= q[1] THEN 'Low' WHEN CAST(sales AS DOUBLE) <= q[2] THEN 'Medium'
      WHEN CAST(sales AS DOUBLE) <= q[3] THEN 'High' ELSE 'Very High' END AS revenue_band
  FROM cleaned CROSS JOIN edges
)"""
)

# What a mart holds after its files came, changed and went: five units of orders and half of a
# sixth, with cells that are no numbers missing.
REFRESHED = MART.replace("raw AS (", "raw_all AS (", 1).replace(
    "cleaned AS (",
    """raw AS (
  SELECT * REPLACE (CASE WHEN order_id % 37 = 5 THEN NULL ELSE days_real END AS days_real,
    CASE WHEN order_id % 41 = 7 THEN NULL ELSE discount_rate END AS discount_rate)
  FROM raw_all WHERE order_id % 8 IN (0, 1, 3, 4, 6) OR order_id % 16 = 2
),
cleaned AS (""",
    1,
)

# The selection the filter queries use.
CHOSEN = (
    "order_year IN (1996, 1997, 1998) AND market IN ('ASIA', 'EUROPE') "
    "AND shipping_mode IN ('Same Day', 'Standard Class')"
)

# All eight facets, and what each of them allows.
CHOICES = {
    "order_year": "order_year BETWEEN 1995 AND 1999",
    "market": "market IN ('ASIA', 'EUROPE', 'AMERICA')",
    "order_region": "order_region IN ('ASIA West', 'ASIA East', 'EUROPE West', 'AMERICA West')",
    "customer_segment": "customer_segment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')",
    "department_name": "true",
    "shipping_mode": "shipping_mode IN ('Standard Class', 'First Class')",
    "order_status": "order_status IN ('COMPLETE', 'PENDING')",
    "delivery_status": "delivery_status IN ('Late delivery', 'Advance shipping')",
}
SHOWN = (
    "SELECT order_id, market, order_region, customer_segment, product_name, shipping_mode, "
    "order_status, CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS profit, discount_rate FROM mart"
)
FILTER_ALL = f"{SHOWN} WHERE " + " AND ".join(CHOICES.values())


def _drill(choices: dict[str, str]) -> str:
    """Options of every facet under the choices in the others."""
    rows = []
    for facet in CHOICES:
        others = [c for f, c in choices.items() if f != facet and c != "true"]
        own = choices.get(facet, "true")
        chosen = "false" if own == "true" else f"any_value({own})"
        rows.append(
            f"SELECT '{facet}' AS facet, CAST({facet} AS VARCHAR) AS option, count(*) AS items, {chosen} AS chosen "
            f"FROM mart WHERE {' AND '.join([f'{facet} IS NOT NULL', *others])} GROUP BY {facet}"
        )
    return " UNION ALL ".join(rows)


CUSTOMERS = (
    "SELECT customer_id, customer_fname, customer_lname, CAST(sum(sales) AS DOUBLE) AS total_sales, "
    "customer_fname || ' ' || customer_lname AS customer_name FROM mart "
    "WHERE customer_id IS NOT NULL AND customer_fname IS NOT NULL "
    "GROUP BY customer_id, customer_fname, customer_lname "
    "ORDER BY sum(sales) DESC, customer_id, customer_fname, customer_lname LIMIT {rows}"
)
SAMPLE = (
    "SELECT discount_rate, CAST(profit AS DOUBLE) AS profit FROM ("
    "SELECT discount_rate, profit FROM mart ORDER BY md5('42|' || "
    "coalesce(CAST(order_id AS VARCHAR), '') || '|' || "
    "coalesce(CAST(customer_id AS VARCHAR), '') || '|' || "
    "coalesce(CAST(sales AS VARCHAR), '') || '|' || coalesce(CAST(profit AS VARCHAR), '')), "
    "discount_rate, profit LIMIT 5000)"
)

# Aggregates by result column.
AGGREGATES = {
    "total_sales": "CAST(coalesce(sum(sales), 0) AS DOUBLE)",
    "total_profit": "CAST(coalesce(sum(profit), 0) AS DOUBLE)",
    "order_items": "count(*)",
    "orders_present": "count(order_id)",
    "total_orders": "count(DISTINCT order_id)",
    "avg_sales": "round(CAST(sum(sales) AS DOUBLE) / count(sales), 6)",
    "avg_profit": "round(CAST(sum(profit) AS DOUBLE) / count(profit), 6)",
    "avg_profit_margin_pct": "round(avg(profit_margin_pct), 6)",
    "avg_delay_days": "round(avg(shipping_delay_days), 6)",
    "avg_discount_pct": "round(avg(discount_rate) * 100, 6)",
    "late_rate_pct": "round(avg(is_late) * 100, 6)",
    "late_risk_pct": "round(avg(late_delivery_risk) * 100, 6)",
    "on_time_pct": "round(avg(CASE WHEN delivery_status IN "
    "('Advance shipping', 'Shipping on time') THEN 1 ELSE 0 END) * 100, 6)",
}

# Query -> (dimension columns, result columns, rest of the statement).
REPORTS = {
    "sales_monthly_trend": ("order_year_month", "total_sales", ""),
    "sales_yearly_trend": ("order_year", "total_sales", ""),
    "sales_by_market": ("market", "total_sales", ""),
    "sales_by_region": ("order_region", "total_sales", ""),
    "sales_by_segment": ("customer_segment", "total_sales", ""),
    "sales_by_shipping_mode": ("shipping_mode", "total_sales", ""),
    "sales_by_quarter": ("order_quarter", "total_sales", ""),
    "profit_monthly_trend": ("order_year_month", "total_profit", ""),
    "profit_yearly_trend": ("order_year", "total_profit", ""),
    "profit_by_market": ("market", "total_profit", ""),
    "profit_by_region": ("order_region", "total_profit", ""),
    "profit_by_segment": ("customer_segment", "total_profit", ""),
    "profit_by_category": ("category_name", "total_profit", ""),
    "profit_by_department": ("department_name", "total_profit", ""),
    "margin_by_market": ("market", "avg_profit_margin_pct", ""),
    "margin_by_segment": ("customer_segment", "avg_profit_margin_pct", ""),
    "segment_counts": ("customer_segment", "order_items", ""),
    "customer_sales_by_segment": ("customer_segment", "total_sales", ""),
    "customer_profit_by_segment": ("customer_segment", "total_profit", ""),
    "segment_avg_order": ("customer_segment", "avg_sales", ""),
    "payment_type_counts": ("payment_type", "order_items", ""),
    "sales_by_category": ("category_name", "total_sales", ""),
    "product_profit_by_category": ("category_name", "total_profit", ""),
    "sales_by_department": ("department_name", "total_sales", ""),
    "top_products_by_sales": (
        "product_name", "total_sales", "ORDER BY total_sales DESC, product_name LIMIT 15"),
    "top_products_by_profit": (
        "product_name", "total_profit", "ORDER BY total_profit DESC, product_name LIMIT 15"),
    "bottom_products": (
        "product_name", "total_profit", "ORDER BY total_profit, product_name LIMIT 10"),
    "category_profit_margin": ("category_name", "avg_profit_margin_pct", ""),
    "category_scatter": ("category_name", "total_sales, total_profit, orders_present", ""),
    "mode_counts": ("shipping_mode", "order_items", ""),
    "mode_sales": ("shipping_mode", "total_sales", ""),
    "mode_avg_delay": ("shipping_mode", "avg_delay_days", ""),
    "delay_distribution": ("shipping_delay_days", "order_items", ""),
    "mode_late_rate": ("shipping_mode", "late_rate_pct", ""),
    "status_counts": ("delivery_status", "order_items", ""),
    "status_by_market": ("market, delivery_status", "order_items", ""),
    "late_by_region": ("order_region", "late_rate_pct", ""),
    "late_by_category": ("category_name", "late_rate_pct", ""),
    "order_status_counts": ("order_status", "order_items", ""),
    "late_by_year": ("order_year", "late_rate_pct", ""),
    "geo_sales_by_market": ("market", "total_sales", ""),
    "geo_profit_by_market": ("market", "total_profit", ""),
    "geo_sales_by_region": ("order_region", "total_sales", ""),
    "geo_profit_by_region": ("order_region", "total_profit", ""),
    "sales_by_country": (
        "order_country", "total_sales", "ORDER BY total_sales DESC, order_country LIMIT 20"),
    "market_order_count": ("market", "total_orders", ""),
    "yearly_sales_vs_profit": ("order_year", "total_sales, total_profit", ""),
    "rows_by_year": ("order_year", "order_items", ""),
    "topn_profit_by_department_10": (
        "department_name", "total_profit", "ORDER BY total_profit DESC, department_name LIMIT 10"),
    "topn_sales_by_category_10": (
        "category_name", "total_sales", "ORDER BY total_sales DESC, category_name LIMIT 10"),
    "topn_profit_by_category_10": (
        "category_name", "total_profit", "ORDER BY total_profit DESC, category_name LIMIT 10"),
    "topn_sales_by_category_15": (
        "category_name", "total_sales", "ORDER BY total_sales DESC, category_name LIMIT 15"),
    "topn_margin_by_category_20": (
        "category_name", "avg_profit_margin_pct",
        "ORDER BY avg_profit_margin_pct DESC, category_name LIMIT 20"),
    "topn_late_by_region_15": (
        "order_region", "late_rate_pct", "ORDER BY late_rate_pct DESC, order_region LIMIT 15"),
    "topn_sales_by_region_15": (
        "order_region", "total_sales", "ORDER BY total_sales DESC, order_region LIMIT 15"),
    "topn_order_statuses_8": (
        "order_status", "order_items", "ORDER BY order_items DESC, order_status LIMIT 8"),
    "late_risk_by_mode": ("shipping_mode", "late_risk_pct", ""),
    "late_risk_by_region": ("order_region", "late_risk_pct", ""),
}

# Query -> (dimension, result column).
SHARES = {
    "share_sales_by_segment": ("customer_segment", "total_sales"),
    "share_items_by_segment": ("customer_segment", "order_items"),
    "share_items_by_mode": ("shipping_mode", "order_items"),
    "share_items_by_delivery_status": ("delivery_status", "order_items"),
    "market_revenue_share": ("market", "total_sales"),
    "department_profit_share": ("department_name", "total_profit"),
    "segment_profit_share": ("customer_segment", "total_profit"),
    "order_status_share": ("order_status", "order_items"),
}

CUBE_DIMENSIONS = (
    "market", "order_region", "customer_segment", "department_name", "category_name",
    "shipping_mode", "delivery_status", "order_status",
)
CUBE_COLUMNS = (
    "order_items, total_sales, total_profit, avg_sales, avg_profit, avg_profit_margin_pct, "
    "avg_delay_days, avg_discount_pct, late_rate_pct, on_time_pct"
)


def _mart(select: str) -> str:
    return f"WITH {MART}\n{select}"


def _refreshed(select: str) -> str:
    return f"WITH {REFRESHED}\n{select}"


def _raw(select: str) -> str:
    return f"WITH {RAW}\n{select}"


def _aggregates(columns: str) -> str:
    return ", ".join(f"{AGGREGATES[c]} AS {c}" for c in columns.split(", "))


def _grouped(dims: str, columns: str, rest: str = "", source: str = "mart") -> str:
    present = " AND ".join(f"{d} IS NOT NULL" for d in dims.split(", "))
    return (
        f"SELECT {dims}, {_aggregates(columns)} FROM {source} "
        f"WHERE {present} GROUP BY {dims} {rest}"
    )


def _share(dim: str, column: str) -> str:
    return (
        f"SELECT *, round({column} / sum({column}) OVER () * 100, 1) AS share_pct "
        f"FROM ({_grouped(dim, column)})"
    )


def _currency(value: str) -> str:
    v = f"CAST({value} AS DOUBLE)"
    return (
        f"CASE WHEN abs({v}) >= 1e6 THEN '$' || format('{{:.2f}}', {v} / 1e6) || 'M' "
        f"WHEN abs({v}) >= 1e3 THEN '$' || format('{{:.1f}}', {v} / 1e3) || 'K' "
        f"ELSE '$' || format('{{:.2f}}', {v}) END"
    )


def _whole(value: str) -> str:
    return f"format('{{:,}}', CAST(trunc(CAST({value} AS DOUBLE)) AS BIGINT))"


KPIS = """
  round(CAST(coalesce(sum(sales), 0) AS DOUBLE), 2) AS total_sales,
  round(CAST(coalesce(sum(profit), 0) AS DOUBLE), 2) AS total_profit,
  count(DISTINCT order_id) AS total_orders,
  count(DISTINCT customer_id) AS total_customers,
  round(CAST(sum(sales) AS DOUBLE) / count(sales), 2) AS avg_order_value,
  round(CAST(sum(profit) AS DOUBLE) / count(profit), 2) AS avg_profit_per_order,
  round(CAST(sum(profit) AS DOUBLE) / CAST(sum(sales) AS DOUBLE) * 100, 2)
    AS overall_profit_margin,
  round(avg(is_late) * 100, 2) AS late_delivery_rate,
  round(avg(discount_rate) * 100, 2) AS avg_discount_rate,
  count(*) AS total_order_items
"""

ON_TIME = (
    "CASE WHEN delivery_status IN ('Advance shipping', 'Shipping on time') THEN 1 ELSE 0 END"
)


def _top(dim: str, value: str, direction: str = "DESC", source: str = "mart") -> str:
    return (
        f"(SELECT {dim} FROM {source} WHERE {dim} IS NOT NULL GROUP BY {dim} "
        f"ORDER BY {value} {direction}, {dim} LIMIT 1)"
    )


def _extreme(dim: str, value: str, how: str, source: str) -> str:
    return (
        f"(SELECT {how}(v) FROM (SELECT {value} AS v FROM {source} "
        f"WHERE {dim} IS NOT NULL GROUP BY {dim}))"
    )


SALES, PROFIT = "CAST(sum(sales) AS DOUBLE)", "CAST(sum(profit) AS DOUBLE)"


def _facts(source: str) -> str:
    """Every figure the findings use, each from its own subquery."""
    return f"""
facts AS (
  SELECT {KPIS},
    round(avg({ON_TIME}) * 100, 2) AS on_time_rate,
    round(avg(shipping_delay_days), 2) AS avg_delay_days,
    {_top('market', SALES, source=source)} AS top_market,
    {_extreme('market', SALES, 'max', source)} / {_extreme('market', SALES, 'sum', source)} * 100
      AS top_market_share,
    {_top('customer_segment', PROFIT, source=source)} AS top_segment,
    {_extreme('customer_segment', PROFIT, 'max', source)}
      / {_extreme('customer_segment', PROFIT, 'sum', source)} * 100 AS top_segment_share,
    {_top('shipping_mode', 'count(*)', source=source)} AS common_mode,
    {_top('category_name', 'avg(profit_margin_pct)', source=source)} AS top_margin_category,
    {_extreme('category_name', 'avg(profit_margin_pct)', 'max', source)} AS top_margin,
    {_top('order_region', 'avg(is_late)', source=source)} AS latest_region,
    {_top('order_status', 'count(*)', source=source)} AS common_status,
    {_top('department_name', SALES, source=source)} AS top_department,
    {_extreme('department_name', SALES, 'max', source)} AS top_department_sales,
    {_top('shipping_mode', 'avg(shipping_delay_days)', source=source)} AS slowest_mode,
    {_extreme('shipping_mode', 'avg(shipping_delay_days)', 'max', source)} AS slowest_mode_delay,
    {_top('order_region', PROFIT, 'ASC', source)} AS weakest_region,
    {_extreme('order_region', PROFIT, 'min', source)} AS weakest_region_profit
  FROM {source}
)"""


def _one(value: str) -> str:
    return f"format('{{:.1f}}', {value})"


def _dollars(value: str) -> str:
    return f"format('{{:,.0f}}', {value})"


def _insights(source: str, filtered: str = "") -> str:
    rows = [
        ("revenue", "NULL", "total_sales",
         f"'Sales of $' || {_dollars('total_sales')} || ' left a profit of $' || "
         f"{_dollars('total_profit')} || ', a margin of ' || {_one('overall_profit_margin')} || '%.'"),
        ("top_market", "top_market", "top_market_share",
         f"'Market ' || top_market || ' leads with ' || {_one('top_market_share')} || '% of all sales.'"),
        ("late_delivery", "latest_region", "late_delivery_rate",
         f"'Late items make up ' || {_one('late_delivery_rate')} || '%; ' || latest_region || "
         "' is hit hardest.'"),
        ("on_time", "NULL", "on_time_rate",
         f"'Deliveries arrive on time for ' || {_one('on_time_rate')} || '% of items.'"),
        ("top_segment", "top_segment", "top_segment_share",
         f"'Segment ' || top_segment || ' earns ' || {_one('top_segment_share')} || '% of the profit.'"),
        ("shipping_mode", "common_mode", "NULL", "'Most items travel by ' || common_mode || '.'"),
        ("discount", "NULL", "avg_discount_rate",
         f"'Discounts average ' || {_one('avg_discount_rate')} || '% of the price.'"),
        ("delay", "NULL", "avg_delay_days",
         "'Shipping takes ' || format('{:.2f}', avg_delay_days) || "
         "' days longer than planned on average.'"),
        ("top_department", "top_department", "top_department_sales",
         "'Department ' || top_department || ' sells the most.'"),
        ("top_margin_category", "top_margin_category", "top_margin",
         "'Category ' || top_margin_category || ' has the best average margin.'"),
    ]
    selects = [
        f"SELECT CAST({n} AS INTEGER) AS insight_no, '{topic}' AS topic, "
        f"CAST({entity} AS VARCHAR) AS entity, round(CAST({value} AS DOUBLE), 6) AS value, "
        f"{text} AS text FROM facts WHERE total_order_items > 0"
        for n, (topic, entity, value, text) in enumerate(rows, start=1)
    ]
    selects.append(
        "SELECT 0, 'empty', NULL, NULL, 'The selection holds no order items.' "
        "FROM facts WHERE total_order_items = 0"
    )
    body = "\nUNION ALL ".join(selects)
    return f"WITH {MART}{filtered},{_facts(source)}\n{body}"


def _recommendations(source: str, filtered: str = "") -> str:
    some = "total_order_items > 0"
    late = "late_delivery_rate > 50"
    rows = [
        ("R1", f"'late rate ' || {_one('late_delivery_rate')} || '%, limit 50.0%'",
         f"CASE WHEN {late} THEN 'lower by ' || {_one('abs(late_delivery_rate - 50)')} || ' points' "
         f"ELSE 'hold, ' || {_one('abs(late_delivery_rate - 50)')} || ' points inside the limit' END",
         f"CASE WHEN {late} THEN 'High' ELSE 'Medium' END", "NULL", "late_delivery_rate", some),
        ("R2", f"'mean discount ' || {_one('avg_discount_rate')} || '%, limit 5.0%'",
         f"'lower by ' || {_one('abs(avg_discount_rate - 5)')} || ' points'",
         "'High'", "NULL", "avg_discount_rate", "avg_discount_rate > 5"),
        ("R3", f"'overall margin ' || {_one('overall_profit_margin')} || '%, floor 10.0%'",
         f"'raise by ' || {_one('abs(overall_profit_margin - 10)')} || ' points'",
         "'High'", "NULL", "overall_profit_margin", "overall_profit_margin < 10"),
        ("R4", f"'mean delay ' || {_one('slowest_mode_delay')} || ' days, longest of all shipping modes'",
         "'start with shipping mode ' || slowest_mode",
         "'Medium'", "slowest_mode", "slowest_mode_delay", some),
        ("R5", f"'profit $' || {_dollars('weakest_region_profit')} || ', lowest of all regions'",
         "'start with region ' || weakest_region",
         "'Medium'", "weakest_region", "weakest_region_profit", some),
        ("R6", f"'share of sales ' || {_one('top_market_share')} || '%, largest of all markets'",
         "'hold the share of market ' || top_market",
         "'Low'", "top_market", "top_market_share", some),
        ("R7", f"'share of profit ' || {_one('top_segment_share')} || '%, largest of all segments'",
         "'hold the share of segment ' || top_segment",
         "'Low'", "top_segment", "top_segment_share", some),
        ("R0", "'The selection holds no order items.'", "'Choose fewer filters.'",
         "'N/A'", "NULL", "NULL", "total_order_items = 0"),
    ]
    selects = [
        f"SELECT '{rule}' AS rule_id, {finding} AS finding, {advice} AS recommendation, "
        f"{priority} AS priority, CAST(CASE {priority} WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 "
        f"WHEN 'Low' THEN 3 ELSE 4 END AS INTEGER) AS priority_rank, "
        f"CAST({entity} AS VARCHAR) AS entity, round(CAST({value} AS DOUBLE), 6) AS value "
        f"FROM facts WHERE {applies}"
        for rule, finding, advice, priority, entity, value, applies in rows
    ]
    body = "\nUNION ALL ".join(selects)
    return f"WITH {MART}{filtered},{_facts(source)}\n{body}"


# Query name -> (dimension, measure, what is sorted by, direction, rows).
RESORTED = {
    "resort_margin_by_segment": ("customer_segment", "avg_profit_margin_pct", "avg(profit_margin_pct)", "DESC", 0),
    "resort_sales_by_mode": ("shipping_mode", "total_sales", "sum(sales)", "DESC", 0),
    "resort_mode_avg_delay": ("shipping_mode", "avg_delay_days", "avg(shipping_delay_days)", "DESC", 0),
    "resort_mode_late_rate": ("shipping_mode", "late_rate_pct", "avg(is_late)", "DESC", 0),
    "resort_late_by_region": ("order_region", "late_rate_pct", "avg(is_late)", "ASC", 0),
    "resort_category_margin_asc": ("category_name", "avg_profit_margin_pct", "avg(profit_margin_pct)", "ASC", 7),
    "top_products_by_sales_50": ("product_name", "total_sales", "sum(sales)", "DESC", 50),
    "bottom_products_40": ("product_name", "total_profit", "sum(profit)", "ASC", 40),
    "topn_sales_by_market_3": ("market", "total_sales", "sum(sales)", "DESC", 3),
    "topn_profit_by_region_4": ("order_region", "total_profit", "sum(profit)", "DESC", 4),
    "topn_status_by_items_2": ("delivery_status", "order_items", "count(*)", "DESC", 2),
}

FILTERED = f",\nchosen AS (SELECT * FROM mart WHERE {CHOSEN})"
NOWHERE = ",\nchosen AS (SELECT * FROM mart WHERE market = 'NOWHERE')"

ANSWERS = (
    ("top_market_by_revenue", "Which market brings in the most revenue?", "top_market", "NULL"),
    ("most_profitable_segment", "Which customer segment earns the most profit?", "top_segment", "NULL"),
    ("most_used_shipping_mode", "Which shipping mode is used most often?", "common_mode", "NULL"),
    ("on_time_delivery_rate_pct", "What share of deliveries is on time?", "NULL", "on_time_rate"),
    ("highest_margin_category", "Which category has the best average margin?", "top_margin_category", "NULL"),
    ("highest_late_rate_region", "Which region is late most often?", "latest_region", "NULL"),
    ("avg_shipping_delay_days", "How many days is shipping late on average?", "NULL", "avg_delay_days"),
    ("most_common_order_status", "Which order status is most common?", "common_status", "NULL"),
    ("top_department_by_sales", "Which department sells the most?", "top_department", "NULL"),
    ("avg_discount_rate_pct", "What is the average discount?", "NULL", "avg_discount_rate"),
)


def _business_answers() -> str:
    body = "\nUNION ALL ".join(
        f"SELECT CAST({n} AS INTEGER) AS question_no, '{name}' AS question, '{wording}' AS wording, "
        f"CAST({text} AS VARCHAR) AS answer_text, CAST({value} AS DOUBLE) AS answer_value FROM facts"
        for n, (name, wording, text, value) in enumerate(ANSWERS, start=1)
    )
    return f"WITH {MART},{_facts('mart')}\n{body}"


def _cube() -> str:
    parts = [f"SELECT 'all' AS dimension, 'all' AS key, {_aggregates(CUBE_COLUMNS)} FROM mart"]
    parts += [
        f"SELECT '{d}', {d}, {_aggregates(CUBE_COLUMNS)} FROM mart WHERE {d} IS NOT NULL GROUP BY {d}"
        for d in CUBE_DIMENSIONS
    ]
    return "\nUNION ALL ".join(parts)


RAW_TYPES = {
    "order_id": "bigint", "customer_id": "bigint", "customer_fname": "string",
    "customer_lname": "string", "customer_zipcode": "double", "customer_segment": "string",
    "customer_email": "string", "customer_password": "string", "payment_type": "string",
    "market": "string", "order_region": "string", "order_country": "string",
    "order_status": "string", "delivery_status": "string", "shipping_mode": "string",
    "category_name": "string", "department_name": "string", "product_name": "string",
    "product_description": "string", "product_image": "string", "sales": "decimal(12,2)",
    "profit": "decimal(18,4)", "discount_rate": "double", "days_real": "int",
    "days_scheduled": "int", "late_delivery_risk": "int", "order_date_raw": "string",
    "shipping_date_raw": "string",
}
NUMERIC = tuple(c for c, kind in RAW_TYPES.items() if kind != "string")
CATEGORICAL = (
    "market", "order_region", "customer_segment", "shipping_mode", "delivery_status",
    "order_status", "department_name", "category_name", "payment_type",
)


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def _describe(column: str) -> str:
    v = f"CAST({column} AS DOUBLE)"
    q = f"quantile_cont({v}, %s)"
    return (
        f"SELECT '{column}' AS column_name, count({column}) AS count, round(avg({v}), 2) AS mean, "
        f"round(stddev_samp({v}), 2) AS std, round(min({v}), 2) AS min, "
        f"round({q % 0.25}, 2) AS p25, round({q % 0.5}, 2) AS p50, round({q % 0.75}, 2) AS p75, "
        f"round(max({v}), 2) AS max FROM raw"
    )


def _products(having: str, basis: str) -> str:
    return f"""
, products AS (
  SELECT product_name, CAST(sum(sales) AS DOUBLE) AS total_sales,
    CAST(sum(sales) AS DOUBLE) / count(sales) AS mean_sales,
    CAST(sum(profit) AS DOUBLE) / nullif(CAST(sum(sales) AS DOUBLE), 0) * 100 AS margin
  FROM mart WHERE product_name IS NOT NULL GROUP BY product_name
)
SELECT product_name, total_sales, round(mean_sales, 6) AS avg_sales,
  round(margin, 6) AS margin_of_sums_pct
FROM products WHERE {basis} AND margin < {having}"""


ORDER_VALUES = (
    "(SELECT order_id, sum(sales) AS order_sales FROM mart WHERE order_id IS NOT NULL "
    "GROUP BY order_id)"
)
CAP = "CASE WHEN category_name IN ('Brand#1', 'Brand#10') THEN 0.05::DOUBLE ELSE 0.08::DOUBLE END"
GUARD = (
    f"CASE WHEN discount_rate > 0.09::DOUBLE THEN 'needs approval' WHEN discount_rate > {CAP} "
    "THEN 'over cap' ELSE 'within cap' END"
)
TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def oracle_sql() -> dict[str, str]:
    shown_ts = TIME.format("order_ts")
    statements = {name: _mart(_grouped(*spec)) for name, spec in REPORTS.items()}
    statements |= {name: _mart(_share(*spec)) for name, spec in SHARES.items()}
    statements |= {
        name: f"WITH {MART},{_facts('mart')}\nSELECT {text if text != 'NULL' else value} AS {name} FROM facts"
        for name, _, text, value in ANSWERS
    }
    statements |= {
        "load_order_items": _raw(
            "SELECT * REPLACE (CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS profit) "
            "FROM raw"
        ),
        "prepared_mart": _mart(
            "SELECT * REPLACE (CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS profit, "
            f"{shown_ts} AS order_ts, {TIME.format('shipping_ts')} AS shipping_ts, "
            "round(profit_margin_pct, 6) AS profit_margin_pct) FROM mart"
        ),
        "export_filtered": _mart(
            "SELECT order_id, market, order_region, customer_segment, product_name, shipping_mode, "
            "order_status, CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS profit, "
            f"discount_rate FROM mart WHERE {CHOSEN}"
        ),
        "preview_rows": _mart(
            "SELECT order_id, product_name, CAST(sales AS DOUBLE) AS sales, "
            "CAST(profit AS DOUBLE) AS profit, order_year, order_month, order_month_name, "
            "order_quarter, order_year_month, shipping_delay_days, is_late, "
            "round(profit_margin_pct, 6) AS profit_margin_pct, revenue_band FROM mart "
            "ORDER BY mart.order_id, mart.product_name, mart.sales, mart.profit, order_year "
            "NULLS LAST, order_month NULLS LAST, shipping_delay_days, is_late LIMIT 5"
        ),
        "preview_raw_rows": _raw(
            "SELECT * REPLACE (CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS profit) "
            f"FROM (SELECT * FROM raw ORDER BY {', '.join(f'{c} NULLS LAST' for c in RAW_TYPES)} LIMIT 5)"
        ),
        "clean_dates": _mart(
            "SELECT order_id, product_name, CAST(sales AS DOUBLE) AS sales, "
            f"{shown_ts} AS order_ts, {TIME.format('shipping_ts')} AS shipping_ts FROM cleaned"
        ),
        "clean_trim": _mart(
            "SELECT order_id, CAST(sales AS DOUBLE) AS sales, customer_fname, category_name, "
            "product_name FROM cleaned"
        ),
        "clean_fill": _mart(
            "SELECT order_id, customer_id, customer_lname, customer_zipcode FROM cleaned"
        ),
        "clean_drop_nulls": _mart(
            "SELECT count(*) AS kept_rows, CAST(sum(sales) AS DOUBLE) AS total_sales, "
            "CAST(sum(profit) AS DOUBLE) AS total_profit FROM cleaned"
        ),
        "clean_summary": _mart(
            "SELECT (SELECT count(*) FROM raw) AS original_rows, "
            f"CAST({len(RAW_TYPES)} AS INTEGER) AS original_cols, count(*) AS cleaned_rows, "
            f"CAST({len(RAW_TYPES) - 4} AS INTEGER) AS cleaned_cols, "
            "(SELECT count(*) FROM raw) - count(*) AS rows_dropped, CAST(4 AS INTEGER) AS cols_dropped, "
            "CAST(sum(CASE WHEN order_ts IS NULL THEN 1 ELSE 0 END) "
            "+ sum(CASE WHEN shipping_ts IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_after "
            "FROM cleaned"
        ),
        "feat_time": _mart(
            "SELECT order_id, CAST(sales AS DOUBLE) AS sales, order_year, order_month, "
            "order_month_name, order_quarter, order_year_month FROM mart"
        ),
        "feat_shipping": _mart(
            "SELECT order_id, CAST(sales AS DOUBLE) AS sales, days_real, days_scheduled, "
            "delivery_status, shipping_delay_days, is_late FROM mart"
        ),
        "feat_margin": _mart(
            "SELECT order_id, CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS profit, "
            "round(profit_margin_pct, 6) AS profit_margin_pct FROM mart"
        ),
        "feat_revenue_band": _mart(
            "SELECT order_id, CAST(sales AS DOUBLE) AS sales, revenue_band FROM mart"
        ),
        "fmt_currency": _mart(
            "SELECT order_id, CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS profit, "
            f"{_currency('sales')} AS sales_text, {_currency('profit')} AS profit_text FROM mart"
        ),
        "fmt_currency_totals": _mart(
            f"SELECT category_name, {_currency('sum(sales)')} AS sales_text, "
            f"{_currency('sum(profit)')} AS profit_text, {_whole('count(order_id)')} AS items_text "
            "FROM mart WHERE category_name IS NOT NULL GROUP BY category_name"
        ),
        "fmt_number": _mart(
            "SELECT order_id, CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS profit, "
            f"{_whole('sales')} AS sales_text, {_whole('profit')} AS profit_text FROM mart"
        ),
        "kpi_cards": _mart(
            f"SELECT {_currency('total_sales')} AS total_sales, {_currency('total_profit')} AS total_profit, "
            f"{_currency('avg_order_value')} AS avg_order_value, "
            f"{_currency('avg_profit_per_order')} AS avg_profit_per_order, "
            f"{_whole('total_orders')} AS total_orders, {_whole('total_customers')} AS total_customers, "
            f"{_whole('total_order_items')} AS total_order_items, "
            f"{_one('overall_profit_margin')} || '%' AS overall_profit_margin, "
            f"{_one('late_delivery_rate')} || '%' AS late_delivery_rate, "
            f"{_one('avg_discount_rate')} || '%' AS avg_discount_rate "
            f"FROM (SELECT {KPIS} FROM mart)"
        ),
        "facet_filter": _mart(
            "SELECT order_id, market, order_region, customer_segment, product_name, shipping_mode, "
            "order_status, CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS profit, "
            f"discount_rate FROM mart WHERE {CHOSEN}"
        ),
        "facet_options": _mart(
            _union([
                f"SELECT DISTINCT '{f}' AS facet, CAST({f} AS VARCHAR) AS option FROM mart "
                f"WHERE {f} IS NOT NULL"
                for f in ("order_year", "market", "order_region", "customer_segment",
                          "department_name", "shipping_mode", "order_status", "delivery_status")
            ])
        ),
        "drill_options": _mart(
            _drill(
                {
                    "order_year": "order_year IN (1996, 1997, 1998)",
                    "market": "market IN ('ASIA', 'EUROPE')",
                    "shipping_mode": "shipping_mode IN ('Same Day', 'Standard Class')",
                }
            )
        ),
        "drill_options_all": _mart(_drill(CHOICES)),
        "drill_options_free": _mart(_drill({})),
        "clustered_facet_filter": _mart(f"{SHOWN} WHERE {CHOSEN}"),
        "clustered_facet_filter_all": _mart(FILTER_ALL),
        "clustered_kpis": _mart(f"SELECT {KPIS} FROM mart WHERE {CHOSEN}"),
        "filter_coverage": _mart(
            f"SELECT count(*) FILTER ({CHOSEN}) AS filtered_rows, count(*) AS total_rows, "
            f"round(count(*) FILTER ({CHOSEN}) / count(*) * 100, 1) AS filtered_pct FROM mart"
        ),
        "filtered_kpis": _mart(f"SELECT {KPIS} FROM mart WHERE {CHOSEN}"),
        "on_time_rate": _mart(
            f"SELECT CAST(sum({ON_TIME}) AS BIGINT) AS on_time_items, count(*) AS order_items, "
            f"round(avg({ON_TIME}) * 100, 2) AS on_time_rate_pct FROM mart"
        ),
        "explorer": _mart(
            f"SELECT {shown_ts} AS order_ts, market, order_region, customer_segment, "
            "department_name, category_name, product_name, shipping_mode, delivery_status, "
            "order_status, CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS profit, "
            "round(profit_margin_pct, 6) AS profit_margin_pct, shipping_delay_days FROM ("
            "SELECT * FROM mart ORDER BY order_ts NULLS LAST, market, order_region, "
            "customer_segment, department_name, category_name, product_name, shipping_mode, "
            "delivery_status, order_status, sales, profit, profit_margin_pct, shipping_delay_days "
            "LIMIT 5000)"
        ),
        "kpis": _mart(f"SELECT {KPIS} FROM mart"),
        "kpis_long": _mart(
            "SELECT kpi, value FROM (UNPIVOT (SELECT "
            + ", ".join(
                f"CAST({c} AS DOUBLE) AS {c}"
                for c in (
                    "total_sales", "total_profit", "total_orders", "total_customers",
                    "avg_order_value", "avg_profit_per_order", "overall_profit_margin",
                    "late_delivery_rate", "avg_discount_rate", "total_order_items",
                )
            )
            + f" FROM (SELECT {KPIS} FROM mart)) ON COLUMNS(*) INTO NAME kpi VALUE value)"
        ),
        "unique_customers": _mart(
            "SELECT count(DISTINCT customer_id) AS unique_customers FROM mart"
        ),
        "metrics_cube": _mart(_cube()),
        "profit_monthly_loss_flag": _mart(
            "SELECT *, total_profit < 0 AS is_loss FROM ("
            + _grouped("order_year_month", "total_profit")
            + ")"
        ),
        "business_answers": _business_answers(),
        "insights": _insights("mart"),
        "recommendations": _recommendations("mart"),
        "filtered_insights": _insights("chosen", FILTERED),
        "filtered_recommendations": _recommendations("chosen", FILTERED),
        "empty_insights": _insights("chosen", NOWHERE),
        "summary_late_by_category": _mart(_grouped("category_name", "late_rate_pct")),
        "summary_filtered_sales_by_region": f"WITH {MART}{FILTERED}\n"
        + _grouped("order_region", "total_sales", source="chosen"),
        "summary_insights": _insights("mart"),
        "summary_kpis": _mart(f"SELECT {KPIS} FROM mart"),
        "summary_filtered_kpis": _mart(f"SELECT {KPIS} FROM mart WHERE {CHOSEN}"),
        "summary_market_order_count": _mart(_grouped("market", "total_orders")),
        "summary_unique_customers": _mart("SELECT count(DISTINCT customer_id) AS unique_customers FROM mart"),
        "refreshed_mart": _refreshed(
            "SELECT order_id, customer_id, product_name, market, CAST(sales AS DOUBLE) AS sales, "
            "CAST(profit AS DOUBLE) AS profit, discount_rate, days_real, order_year, shipping_delay_days, "
            "is_late, round(profit_margin_pct, 6) AS profit_margin_pct, revenue_band FROM mart"
        ),
        "refreshed_edges": _refreshed(
            "SELECT round(q[1], 6) AS q1, round(q[2], 6) AS q2, round(q[3], 6) AS q3 FROM edges"
        ),
        "refreshed_kpis": _refreshed(f"SELECT {KPIS} FROM mart"),
        "refreshed_filtered_kpis": _refreshed(f"SELECT {KPIS} FROM mart WHERE {CHOSEN}"),
        "refreshed_orders_by_market": _refreshed(_grouped("market", "total_orders")),
        "refreshed_insights": _insights("mart").replace(MART, REFRESHED),
        "rejected_cells": _refreshed("")
        + """, cells AS (
  SELECT order_id, 'days_real' AS column, 'x' || CAST(days_real AS VARCHAR) AS text FROM raw_all WHERE order_id % 37 = 5
  UNION ALL SELECT order_id, 'discount_rate', 'free' FROM raw_all WHERE order_id % 41 = 7
  UNION ALL SELECT order_id, 'order_date_raw', order_date_raw FROM raw_all
    WHERE try_strptime(order_date_raw, '%m/%d/%Y %H:%M') IS NULL)
SELECT CAST(order_id % 8 AS INTEGER) AS unit, "column", text, count(*) AS cells FROM cells
WHERE order_id % 8 IN (0, 1, 3, 4, 6) OR order_id % 16 = 2 GROUP BY ALL""",
        "refreshed_sample": _refreshed(SAMPLE),
        "refreshed_profile": _refreshed(
            _union([
                f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg(CAST({c} AS DOUBLE)), 4) AS mean, "
                f"round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, "
                f"round(CAST(max({c}) AS DOUBLE), 4) AS max FROM mart"
                for c in ("sales", "profit", "discount_rate", "days_real", "days_scheduled",
                          "shipping_delay_days", "profit_margin_pct")
            ])
        ),
        "threshold_top_customers": _mart(CUSTOMERS.format(rows=20)),
        "threshold_top_products_by_sales": _mart(
            _grouped("product_name", "total_sales", "ORDER BY total_sales DESC, product_name LIMIT 15")
        ),
        "threshold_bottom_products": _mart(
            _grouped("product_name", "total_profit", "ORDER BY total_profit, product_name LIMIT 10")
        ),
        "explorer_third_page": _mart(
            f"SELECT {shown_ts} AS order_ts, market, order_region, customer_segment, "
            "department_name, category_name, product_name, shipping_mode, delivery_status, "
            "order_status, CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS profit, "
            "round(profit_margin_pct, 6) AS profit_margin_pct, shipping_delay_days FROM ("
            "SELECT * FROM mart ORDER BY order_ts NULLS LAST, market, order_region, "
            "customer_segment, department_name, category_name, product_name, shipping_mode, "
            "delivery_status, order_status, sales, profit, profit_margin_pct, shipping_delay_days "
            "LIMIT 500 OFFSET 1000)"
        ),
        "bucketed_avg_order_value": _mart(
            "SELECT round(CAST(sum(order_sales) AS DOUBLE) / count(*), 6) AS avg_order_value, "
            f"count(*) AS orders FROM {ORDER_VALUES}"
        ),
        "bucketed_order_value_range": _mart(
            "SELECT CAST(min(order_sales) AS DOUBLE) AS min_order_value, "
            f"CAST(max(order_sales) AS DOUBLE) AS max_order_value FROM {ORDER_VALUES}"
        ),
        "summary_discount_profit_corr": _mart(
            "SELECT round(corr(discount_rate, CAST(profit AS DOUBLE)), 6) AS pearson_r FROM mart"
        ),
        "summary_discount_profit_deviations": _mart(
            "SELECT count(discount_rate) AS pairs, round(avg(discount_rate), 6) AS mean_x, "
            "round(stddev_samp(discount_rate), 6) AS std_x, round(avg(CAST(profit AS DOUBLE)), 6) AS mean_y, "
            "round(stddev_samp(CAST(profit AS DOUBLE)), 6) AS std_y FROM mart"
        ),
        "dataset_shape": _raw(
            f"SELECT count(*) AS row_count, CAST({len(RAW_TYPES)} AS INTEGER) AS column_count FROM raw"
        ),
        "column_types": _raw(
            _union([
                f"SELECT '{c}' AS column_name, '{kind}' AS data_type, count({c}) AS non_null_count FROM raw"
                for c, kind in RAW_TYPES.items()
            ])
        ),
        "numeric_describe": _raw(_union([_describe(c) for c in NUMERIC])),
        "numeric_describe_gaps": _raw(
            _union([_describe("sales"), _describe("days_real")])
            + " UNION ALL SELECT 'discount_amount', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL"
        ),
        "categorical_uniques": _raw(
            _union([
                f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_values FROM raw"
                for c in CATEGORICAL
            ])
        ),
        "categorical_uniques_gaps": _raw(
            _union([
                f"SELECT '{c}' AS column_name, "
                + ("count(NULL::VARCHAR)" if c == "customer_segment" else f"count(DISTINCT {c})")
                + " AS unique_values FROM raw"
                for c in CATEGORICAL
            ])
        ),
        "categorical_values": _raw(
            _union([
                f"SELECT DISTINCT '{c}' AS column_name, {c} AS value FROM raw WHERE {c} IS NOT NULL"
                for c in CATEGORICAL
            ])
        ),
        "csv_layouts": _raw(
            "SELECT order_id, market, CAST(sales AS DOUBLE) AS sales, CAST(profit AS DOUBLE) AS profit, "
            "CASE WHEN order_id % 2 = 0 THEN product_name END AS product_name, days_real FROM raw"
        ),
        "mart_by_year": _mart(
            "SELECT order_id, order_year, market, CAST(sales AS DOUBLE) AS sales, "
            "CAST(profit AS DOUBLE) AS profit FROM mart WHERE order_year IN (1997, 1999)"
        ),
        "facet_filter_all": _mart(FILTER_ALL),
        "late_risk_scorecard_weekly": _mart(
            "SELECT strftime(date_trunc('week', order_ts), '%Y-%m-%d') AS week_start, shipping_mode, "
            "order_region, count(*) AS order_items, round(avg(late_delivery_risk) * 100, 6) AS late_risk_pct, "
            "avg(late_delivery_risk) * 100 > 60 AS alert FROM mart WHERE order_ts IS NOT NULL "
            "AND shipping_mode IS NOT NULL AND order_region IS NOT NULL GROUP BY 1, 2, 3"
        ),
        "guardrails_of_best_categories": _mart("")
        + """, best AS (SELECT category_name AS c FROM mart WHERE category_name IS NOT NULL
  GROUP BY category_name ORDER BY avg(profit_margin_pct) DESC, category_name LIMIT 5),
capped AS (SELECT category_name, profit, discount_rate, CASE WHEN category_name IN (SELECT c FROM best)
  THEN 0.10::DOUBLE ELSE 0.15::DOUBLE END AS cap FROM mart)
SELECT category_name, CASE WHEN discount_rate > 0.20::DOUBLE THEN 'needs approval'
    WHEN discount_rate > cap THEN 'over cap' ELSE 'within cap' END AS guardrail,
  count(*) AS order_items, CAST(sum(profit) AS DOUBLE) AS total_profit
FROM capped WHERE category_name IS NOT NULL GROUP BY 1, 2""",
        "low_margin_under_half_products": _mart("")
        + _products("60", "total_sales > (SELECT quantile_cont(total_sales, 0.5) FROM products)"),
        **{
            name: _mart(
                f"SELECT {dims}, {_aggregates(column)} FROM mart WHERE {dims} IS NOT NULL GROUP BY {dims} "
                f"ORDER BY {by} {way}, {dims}" + (f" LIMIT {rows}" if rows else "")
            )
            for name, (dims, column, by, way, rows) in RESORTED.items()
        },
        "top_customers_100": _mart(CUSTOMERS.format(rows=100)),
        "missing_values": _raw(
            "SELECT * FROM ("
            + _union([
                f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
                f"round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct FROM raw"
                for c in RAW_TYPES
            ])
            + ") WHERE missing_count > 0"
        ),
        "missing_cells": _raw(
            "SELECT CAST("
            + " + ".join(f"(count(*) - count({c}))" for c in RAW_TYPES)
            + " AS BIGINT) AS missing_cells FROM raw"
        ),
        "duplicate_rows": _raw(
            "SELECT (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) "
            "AS duplicate_rows"
        ),
        "duplicate_dimension_rows": _raw(
            "SELECT (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT customer_id, "
            "market, payment_type, category_name, shipping_mode FROM raw)) AS duplicate_rows"
        ),
        "negative_sales": _raw(
            "SELECT count(*) FILTER (sales < 0) AS negative_sales_rows FROM raw"
        ),
        "negative_profit": _raw(
            "SELECT count(*) FILTER (profit < 0) AS negative_profit_rows, "
            "round(count(*) FILTER (profit < 0) / count(*) * 100, 1) AS negative_profit_pct FROM raw"
        ),
        "invalid_dates": _raw(
            "SELECT count(*) FILTER (try_strptime(order_date_raw, '%m/%d/%Y %H:%M') IS NULL) "
            "AS invalid_order_dates FROM raw"
        ),
        "order_date_range": _raw(
            "SELECT "
            + TIME.format("min(try_strptime(order_date_raw, '%m/%d/%Y %H:%M'))")
            + " AS first_order, "
            + TIME.format("max(try_strptime(order_date_raw, '%m/%d/%Y %H:%M'))")
            + " AS last_order FROM raw"
        ),
        "discount_profit_sample": _mart(SAMPLE),
        "top_customers": _mart(CUSTOMERS.format(rows=20)),
        "late_risk_rate": _mart(
            f"SELECT {_aggregates('late_risk_pct')}, "
            "CAST(sum(late_delivery_risk) AS BIGINT) AS late_risk_items, count(*) AS order_items FROM mart"
        ),
        "low_margin_high_sales_products": _mart("")
        + _products("10", "mean_sales > (SELECT quantile_cont(CAST(sales AS DOUBLE), 0.75) FROM mart)"),
        "low_margin_high_total_products": _mart("")
        + _products("50", "total_sales > (SELECT quantile_cont(total_sales, 0.75) FROM products)"),
        "low_margin_above_median_products": _mart("")
        + _products("50", "mean_sales > (SELECT quantile_cont(CAST(sales AS DOUBLE), 0.5) FROM mart)"),
        "discount_profit_corr": _mart(
            "SELECT round(corr(discount_rate, CAST(profit AS DOUBLE)), 6) AS pearson_r FROM mart"
        ),
        "avg_order_value_by_order": _mart(
            "SELECT round(CAST(sum(order_sales) AS DOUBLE) / count(*), 6) AS avg_order_value, "
            f"count(*) AS orders FROM {ORDER_VALUES}"
        ),
        "order_value_range": _mart(
            "SELECT CAST(min(order_sales) AS DOUBLE) AS min_order_value, "
            f"CAST(max(order_sales) AS DOUBLE) AS max_order_value FROM {ORDER_VALUES}"
        ),
        "delivery_scorecard_weekly": _mart(
            "SELECT strftime(date_trunc('week', order_ts), '%Y-%m-%d') AS week_start, shipping_mode, "
            "order_region, count(*) AS order_items, round(avg(is_late) * 100, 6) AS late_rate_pct, "
            "avg(is_late) * 100 > 60 AS alert FROM mart WHERE order_ts IS NOT NULL "
            "AND shipping_mode IS NOT NULL AND order_region IS NOT NULL GROUP BY 1, 2, 3"
        ),
        "discount_guardrails": _mart(
            "SELECT order_id, category_name, CAST(sales AS DOUBLE) AS sales, discount_rate, "
            f"{CAP} AS discount_cap, {GUARD} AS guardrail FROM mart"
        ),
        "discount_guardrail_summary": _mart(
            f"SELECT category_name, {GUARD} AS guardrail, count(*) AS order_items, "
            "CAST(sum(profit) AS DOUBLE) AS total_profit FROM mart "
            "WHERE category_name IS NOT NULL GROUP BY 1, 2"
        ),
        "non_complete_share": _mart(
            "SELECT count(*) FILTER (order_status IN ('CANCELED', 'SUSPECTED_FRAUD', 'ON_HOLD', "
            "'PAYMENT_REVIEW')) AS at_risk_items, count(*) AS order_items, "
            "round(count(*) FILTER (order_status IN ('CANCELED', 'SUSPECTED_FRAUD', 'ON_HOLD', "
            "'PAYMENT_REVIEW')) / count(*) * 100, 6) AS at_risk_pct FROM mart"
        ),
    }
    return statements
