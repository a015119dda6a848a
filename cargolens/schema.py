"""Names and types of the order-item table.

One row is one item of an order. Everything downstream uses the snake_case names
on the right of ``RAW_COLUMNS``; columns that are not listed pass through.
"""

from __future__ import annotations

# The headers of the order-item file, the name used here, the type.
RAW_COLUMNS = {
    "Order Id": ("order_id", "bigint"),
    "Customer Id": ("customer_id", "bigint"),
    "Customer Fname": ("customer_fname", "string"),
    "Customer Lname": ("customer_lname", "string"),
    "Customer Segment": ("customer_segment", "string"),
    "Customer Zipcode": ("customer_zipcode", "double"),
    "Customer Email": ("customer_email", "string"),
    "Customer Password": ("customer_password", "string"),
    "Product Description": ("product_description", "string"),
    "Product Image": ("product_image", "string"),
    "Type": ("payment_type", "string"),
    "Market": ("market", "string"),
    "Order Region": ("order_region", "string"),
    "Order Country": ("order_country", "string"),
    "Order Status": ("order_status", "string"),
    "Delivery Status": ("delivery_status", "string"),
    "Shipping Mode": ("shipping_mode", "string"),
    "Category Name": ("category_name", "string"),
    "Department Name": ("department_name", "string"),
    "Product Name": ("product_name", "string"),
    "Sales": ("sales", "double"),
    "Order Profit Per Order": ("profit", "double"),
    "Order Item Discount Rate": ("discount_rate", "double"),
    "Order Item Discount": ("discount_amount", "double"),
    "Days for shipping (real)": ("days_real", "int"),
    "Days for shipment (scheduled)": ("days_scheduled", "int"),
    "order date (DateOrders)": ("order_date_raw", "string"),
    "shipping date (DateOrders)": ("shipping_date_raw", "string"),
    "Late_delivery_risk": ("late_delivery_risk", "int"),
}

HEADER_OF = {canonical: header for header, (canonical, _) in RAW_COLUMNS.items()}

# Columns the cleaning step removes when they are present.
DROPPED_COLUMNS = (
    "customer_email",
    "customer_password",
    "product_description",
    "product_image",
)

# Date layout and the delivery statuses the logic depends on.
DATE_FORMAT = "M/d/yyyy H:m"
LATE_STATUS = "Late delivery"
ON_TIME_STATUSES = ("Advance shipping", "Shipping on time")
AT_RISK_ORDER_STATUSES = ("CANCELED", "SUSPECTED_FRAUD", "ON_HOLD", "PAYMENT_REVIEW")

# Cell texts that CSV readers of the pandas family take as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# The facets, the derived columns, and the columns that profiles and the explorer show.
FACETS = (
    "order_year",
    "market",
    "order_region",
    "customer_segment",
    "department_name",
    "shipping_mode",
    "order_status",
    "delivery_status",
)

FEATURE_COLUMNS = (
    "order_year",
    "order_month",
    "order_month_name",
    "order_quarter",
    "order_year_month",
    "shipping_delay_days",
    "is_late",
    "profit_margin_pct",
    "revenue_band",
)

CATEGORICAL_COLUMNS = (
    "market",
    "order_region",
    "customer_segment",
    "shipping_mode",
    "delivery_status",
    "order_status",
    "department_name",
    "category_name",
    "payment_type",
)

# What the explorer shows unless other columns are asked for.
EXPLORER_COLUMNS = (
    "order_ts",
    "market",
    "order_region",
    "customer_segment",
    "department_name",
    "category_name",
    "product_name",
    "shipping_mode",
    "delivery_status",
    "order_status",
    "sales",
    "profit",
    "profit_margin_pct",
    "shipping_delay_days",
)
