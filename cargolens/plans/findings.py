"""Business answers, insights and recommendations, all built from the facts row.

Every list is an array of structs expanded in Spark: a rule that does not apply leaves
no row, and an empty input leaves the placeholder. Nothing is decided on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.measures import measure
from cargolens.functions.text import fixed_point, grouped
from cargolens.operators.reports import group_report
from cargolens.plans.facts import facts



@dataclass(frozen=True)
class Question:
    """A business question: the key of a dimension's largest measure, or one figure."""

    name: str
    wording: str
    fact: str
    measure: str
    dimension: str | None = None


QUESTIONS = (
    Question("top_market_by_revenue", "Which market brings in the most revenue?",
             "top_market", "total_sales", "market"),
    Question("most_profitable_segment", "Which customer segment earns the most profit?",
             "top_segment", "total_profit", "customer_segment"),
    Question("most_used_shipping_mode", "Which shipping mode is used most often?",
             "common_mode", "order_items", "shipping_mode"),
    Question("on_time_delivery_rate_pct", "What share of deliveries is on time?",
             "on_time_rate", "on_time_pct"),
    Question("highest_margin_category", "Which category has the best average margin?",
             "top_margin_category", "avg_profit_margin_pct", "category_name"),
    Question("highest_late_rate_region", "Which region is late most often?",
             "latest_region", "late_rate_pct", "order_region"),
    Question("avg_shipping_delay_days", "How many days is shipping late on average?",
             "avg_delay_days", "avg_delay_days"),
    Question("most_common_order_status", "Which order status is most common?",
             "common_status", "order_items", "order_status"),
    Question("top_department_by_sales", "Which department sells the most?",
             "top_department", "total_sales", "department_name"),
    Question("avg_discount_rate_pct", "What is the average discount?",
             "avg_discount_rate", "avg_discount_pct"),
)

PRIORITY_RANK = {"High": 1, "Medium": 2, "Low": 3}
LATE_RATE_LIMIT = 50.0
DISCOUNT_LIMIT = 5.0
MARGIN_FLOOR = 10.0


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _expand(row: DataFrame, entries: list[Column], fields: tuple[str, ...]) -> DataFrame:
    """One output row per entry whose ``applies`` holds."""
    listed = row.select(F.array(*entries).alias("entries"))
    return listed.select(F.inline(F.filter("entries", lambda e: e["applies"]))).select(*fields)


def business_answers(df: DataFrame) -> DataFrame:
    """Rows ``(question_no, question, wording, answer_text, answer_value)``."""
    return business_answers_of(facts(df))


def business_answers_of(known: DataFrame) -> DataFrame:
    """The answers from a facts row."""
    no_text, no_value = F.lit(None).cast("string"), F.lit(None).cast("double")
    entries = []
    for number, question in enumerate(QUESTIONS, start=1):
        fact = F.col(question.fact)
        entries.append(
            F.struct(
                F.lit(number).alias("question_no"),
                F.lit(question.name).alias("question"),
                F.lit(question.wording).alias("wording"),
                (fact if question.dimension else no_text).alias("answer_text"),
                (no_value if question.dimension else fact).alias("answer_value"),
                F.lit(True).alias("applies"),
            )
        )
    fields = ("question_no", "question", "wording", "answer_text", "answer_value")
    return _expand(known, entries, fields)


def answer(df: DataFrame, name: str) -> DataFrame:
    """One row and one column: the answer to one question, null for an empty input.

    Reads only the one or two columns the question is about.
    """
    question = next(q for q in QUESTIONS if q.name == name)
    if question.dimension is None:
        return df.agg(F.round(measure(question.measure), 2).alias(name))
    groups = group_report(df, [question.dimension], [measure(question.measure)])
    ranked = F.struct((-F.col(question.measure)).alias("v"), F.col(question.dimension).alias("key"))
    known = F.col(question.measure).isNotNull()
    return groups.agg(F.min(F.when(known, ranked))["key"].alias(name))


def insights(df: DataFrame) -> DataFrame:
    """Rows ``(insight_no, topic, entity, value, text)``; one placeholder when empty."""
    return insights_of(facts(df))


def insights_of(known: DataFrame) -> DataFrame:
    """The insights from a facts row."""
    some = F.col("order_items") > 0
    nobody = F.lit(None).cast("string")

    def one(value: str) -> Column:
        return fixed_point(F.col(value), 1)

    def whole(value: str) -> Column:
        return grouped(F.col(value), 0)

    lines = [
        ("revenue", nobody, "total_sales",
         _say("Sales of $", whole("total_sales"), " left a profit of $", whole("total_profit"),
              ", a margin of ", one("overall_profit_margin"), "%.")),
        ("top_market", F.col("top_market"), "top_market_share",
         _say("Market ", F.col("top_market"), " leads with ", one("top_market_share"),
              "% of all sales.")),
        ("late_delivery", F.col("latest_region"), "late_delivery_rate",
         _say("Late items make up ", one("late_delivery_rate"), "%; ", F.col("latest_region"),
              " is hit hardest.")),
        ("on_time", nobody, "on_time_rate",
         _say("Deliveries arrive on time for ", one("on_time_rate"), "% of items.")),
        ("top_segment", F.col("top_segment"), "top_segment_share",
         _say("Segment ", F.col("top_segment"), " earns ", one("top_segment_share"),
              "% of the profit.")),
        ("shipping_mode", F.col("common_mode"), None,
         _say("Most items travel by ", F.col("common_mode"), ".")),
        ("discount", nobody, "avg_discount_rate",
         _say("Discounts average ", one("avg_discount_rate"), "% of the price.")),
        ("delay", nobody, "avg_delay_days",
         _say("Shipping takes ", fixed_point(F.col("avg_delay_days"), 2),
              " days longer than planned on average.")),
        ("top_department", F.col("top_department"), "top_department_sales",
         _say("Department ", F.col("top_department"), " sells the most.")),
        ("top_margin_category", F.col("top_margin_category"), "top_margin",
         _say("Category ", F.col("top_margin_category"), " has the best average margin.")),
    ]

    def entry(number: int, topic: str, entity: Column, value: Column, text: Column, applies: Column):
        return F.struct(
            F.lit(number).alias("insight_no"),
            F.lit(topic).alias("topic"),
            entity.alias("entity"),
            value.alias("value"),
            text.alias("text"),
            applies.alias("applies"),
        )

    no_value = F.lit(None).cast("double")
    entries = [
        entry(number, topic, entity, F.col(value) if value else no_value, text, some)
        for number, (topic, entity, value, text) in enumerate(lines, start=1)
    ]
    entries.append(
        entry(0, "empty", nobody, no_value, F.lit("The selection holds no order items."), ~some)
    )
    return _expand(known, entries, ("insight_no", "topic", "entity", "value", "text"))


def recommendations(
    df: DataFrame,
    late_rate_limit: float = LATE_RATE_LIMIT,
    discount_limit: float = DISCOUNT_LIMIT,
    margin_floor: float = MARGIN_FLOOR,
) -> DataFrame:
    """The rules that fire, in rule order; one placeholder when the input is empty."""
    return recommendations_of(facts(df), late_rate_limit, discount_limit, margin_floor)


def recommendations_of(
    known: DataFrame,
    late_rate_limit: float = LATE_RATE_LIMIT,
    discount_limit: float = DISCOUNT_LIMIT,
    margin_floor: float = MARGIN_FLOOR,
) -> DataFrame:
    """The recommendations from a facts row: measure, threshold, gap and what it is about."""
    some = F.col("order_items") > 0
    nobody = F.lit(None).cast("string")
    often_late = F.col("late_delivery_rate") > late_rate_limit

    def one(value: str) -> Column:
        return fixed_point(F.col(value), 1)

    def gap(value: str, limit: float) -> Column:
        return fixed_point(F.abs(F.col(value) - limit), 1)

    rules = [
        ("R1",
         _say("late rate ", one("late_delivery_rate"), f"%, limit {late_rate_limit:.1f}%"),
         F.when(often_late, _say("lower by ", gap("late_delivery_rate", late_rate_limit), " points"))
         .otherwise(_say("hold, ", gap("late_delivery_rate", late_rate_limit), " points inside the limit")),
         F.when(often_late, "High").otherwise("Medium"),
         nobody, F.col("late_delivery_rate"), some),
        ("R2",
         _say("mean discount ", one("avg_discount_rate"), f"%, limit {discount_limit:.1f}%"),
         _say("lower by ", gap("avg_discount_rate", discount_limit), " points"),
         F.lit("High"), nobody, F.col("avg_discount_rate"),
         F.col("avg_discount_rate") > discount_limit),
        ("R3",
         _say("overall margin ", one("overall_profit_margin"), f"%, floor {margin_floor:.1f}%"),
         _say("raise by ", gap("overall_profit_margin", margin_floor), " points"),
         F.lit("High"), nobody, F.col("overall_profit_margin"),
         F.col("overall_profit_margin") < margin_floor),
        ("R4",
         _say("mean delay ", one("slowest_mode_delay"), " days, longest of all shipping modes"),
         _say("start with shipping mode ", F.col("slowest_mode")),
         F.lit("Medium"), F.col("slowest_mode"), F.col("slowest_mode_delay"), some),
        ("R5",
         _say("profit $", grouped(F.col("weakest_region_profit"), 0), ", lowest of all regions"),
         _say("start with region ", F.col("weakest_region")),
         F.lit("Medium"), F.col("weakest_region"), F.col("weakest_region_profit"), some),
        ("R6",
         _say("share of sales ", one("top_market_share"), "%, largest of all markets"),
         _say("hold the share of market ", F.col("top_market")),
         F.lit("Low"), F.col("top_market"), F.col("top_market_share"), some),
        ("R7",
         _say("share of profit ", one("top_segment_share"), "%, largest of all segments"),
         _say("hold the share of segment ", F.col("top_segment")),
         F.lit("Low"), F.col("top_segment"), F.col("top_segment_share"), some),
        ("R0", F.lit("The selection holds no order items."), F.lit("Choose fewer filters."),
         F.lit("N/A"), nobody, F.lit(None).cast("double"), ~some),
    ]
    entries = []
    for rule, finding, advice, priority, entity, value, applies in rules:
        rank = F.lit(4)
        for name, place in PRIORITY_RANK.items():
            rank = F.when(priority == name, place).otherwise(rank)
        entries.append(
            F.struct(
                F.lit(rule).alias("rule_id"),
                finding.alias("finding"),
                advice.alias("recommendation"),
                priority.alias("priority"),
                rank.alias("priority_rank"),
                entity.alias("entity"),
                value.alias("value"),
                F.coalesce(applies, F.lit(False)).alias("applies"),
            )
        )
    fields = (
        "rule_id", "finding", "recommendation", "priority", "priority_rank", "entity", "value",
    )
    return _expand(known, entries, fields)
