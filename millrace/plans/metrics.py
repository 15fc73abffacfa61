"""Metrics over a star of orders: definitions first, then fifteen questions made of them.

Revenue and net revenue leave cancelled orders out; the cancel rate counts all orders; attributes of a member are those of the
version valid on the order's day, whose last day is inclusive here. Months are given as `yyyy-MM`. A star is a dict of frames
fact_order (order_id, full_date, member_sk, member_id, product_sk, order_status, amount_twd, coupon_discount_twd), dim_member
(member_sk, member_id, member_level, city, valid_from, valid_to, is_current) and dim_product (product_sk, product_name, product_type, destination_country).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Star = dict[str, DataFrame]
CANCELLED, COMPLETED = "cancelled", "completed"


def live(fact: DataFrame) -> DataFrame:
    return fact.filter(F.col("order_status") != CANCELLED)


def revenue() -> Column:
    return F.sum("amount_twd").cast("decimal(28,2)")


def net() -> Column:
    return F.col("amount_twd") - F.col("coupon_discount_twd")


def ratio(part: Column, whole: Column, scale: int = 6) -> Column:
    """part / whole, cut to a scale, by whole numbers, so that no engine's division shows."""
    return F.floor(part.cast("decimal(36,4)") * 10**scale / whole.cast("decimal(36,4)")).cast("long")


def month(name: str = "full_date") -> Column:
    return F.date_format(name, "yyyy-MM")


def with_member(star: Star, fact: DataFrame) -> DataFrame:
    """Orders with the member version of their day; every version has its own row, so the key is the member and the day."""
    m = star["dim_member"].select(F.col("member_id").alias("_id"), "member_level", "city", "valid_from", "valid_to")
    return fact.join(m, (fact["member_id"] == m["_id"]) & fact["full_date"].between(m["valid_from"], m["valid_to"]))


def with_product(star: Star, fact: DataFrame) -> DataFrame:
    return fact.join(star["dim_product"], "product_sk")


def total_revenue(star: Star, a: str, b: str) -> DataFrame:
    return live(star["fact_order"]).filter(month() == a).agg(revenue().alias("revenue"))


def top_level_revenue(star: Star, a: str, b: str) -> DataFrame:
    return with_member(star, live(star["fact_order"])).filter((month() == a) & (F.col("member_level") == star_level(0))).agg(revenue().alias("revenue"))


def star_level(i: int) -> str:
    return LEVELS[i]


#: The two highest levels.
LEVELS = ("白金", "金卡")


def revenue_trend(star: Star, a: str, b: str) -> DataFrame:
    own = live(star["fact_order"]).agg(F.sum(F.when(month() == a, F.col("amount_twd"))).cast("decimal(28,2)").alias("first"), F.sum(F.when(month() == b, F.col("amount_twd"))).cast("decimal(28,2)").alias("second"))
    return own.withColumn("trend", F.when(F.col("second") > F.col("first"), "up").when(F.col("second") < F.col("first"), "down").otherwise("flat"))


def cancel_rates(star: Star, a: str, b: str) -> DataFrame:
    own = with_product(star, star["fact_order"]).groupBy("destination_country").agg(F.count_if(F.col("order_status") == CANCELLED).alias("cancelled"), F.count("*").alias("orders"))
    return own.withColumn("rate_ppm", ratio(F.col("cancelled"), F.col("orders"))).orderBy(F.desc("rate_ppm"), "destination_country").limit(1)


def upper_level_share(star: Star, a: str, b: str) -> DataFrame:
    own = with_member(star, live(star["fact_order"]))
    return own.agg(ratio(F.sum(F.when(F.col("member_level").isin(*LEVELS), F.col("amount_twd")).otherwise(0)), F.sum("amount_twd")).alias("share_ppm"))


def revenue_by_type(star: Star, a: str, b: str) -> DataFrame:
    return with_product(star, live(star["fact_order"]).filter(month() == b)).groupBy("product_type").agg(revenue().alias("revenue"))


def best_city(star: Star, a: str, b: str) -> DataFrame:
    own = with_member(star, live(star["fact_order"])).groupBy("city").agg(ratio(F.sum(net()), F.count("*"), 4).alias("average_net_e4"))
    return own.orderBy(F.desc("average_net_e4"), "city").limit(1)


def weekend_split(star: Star, a: str, b: str) -> DataFrame:
    weekend = F.dayofweek("full_date").isin(1, 7)
    return star["fact_order"].filter(month() == a).groupBy(weekend.alias("is_weekend")).agg(F.count("*").alias("orders"))


def repeat_members(star: Star, a: str, b: str) -> DataFrame:
    return star["fact_order"].groupBy("member_id").agg(F.count("*").alias("n")).filter("n >= 2").agg(F.count("*").alias("members"))


def top_products(star: Star, a: str, b: str) -> DataFrame:
    own = live(star["fact_order"]).filter(month() == b).groupBy("product_sk").agg(revenue().alias("revenue"))
    return own.orderBy(F.desc("revenue"), "product_sk").limit(5).join(star["dim_product"].select("product_sk", "product_name"), "product_sk")


def average_discount(star: Star, a: str, b: str) -> DataFrame:
    return star["fact_order"].groupBy((F.col("order_status") == CANCELLED).alias("is_cancelled")).agg(ratio(F.sum("coupon_discount_twd"), F.count("*"), 4).alias("average_discount_e4"))


def country_by_month(star: Star, a: str, b: str) -> DataFrame:
    own = with_product(star, live(star["fact_order"])).filter((F.col("destination_country") == "JP") & month().isin(a, b))
    return own.groupBy(month().alias("month")).agg(revenue().alias("revenue"))


def average_by_level(star: Star, a: str, b: str) -> DataFrame:
    return with_member(star, live(star["fact_order"])).groupBy("member_level").agg(ratio(F.sum("amount_twd"), F.count("*"), 4).alias("average_amount_e4"))


def net_by_month(star: Star, a: str, b: str) -> DataFrame:
    own = live(star["fact_order"]).filter(month().isin(a, b)).groupBy(month().alias("month")).agg(F.sum(net()).cast("decimal(28,2)").alias("net_revenue"))
    return own.orderBy(F.desc("net_revenue"), "month").limit(1)


def completed_share(star: Star, a: str, b: str) -> DataFrame:
    return star["fact_order"].agg(ratio(F.count_if(F.col("order_status") == COMPLETED), F.count("*")).alias("share_ppm"))


QUESTIONS: dict[str, Callable[[Star, str, str], DataFrame]] = {
    f"q{i:02d}": f
    for i, f in enumerate((total_revenue, top_level_revenue, revenue_trend, cancel_rates, upper_level_share, revenue_by_type, best_city, weekend_split, repeat_members, top_products, average_discount, country_by_month, average_by_level, net_by_month, completed_share), 1)
}


def _unlike(answer: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one of them has more often than the other, as text by column name."""
    a, b = (df.select(*(F.col(c).cast("string").alias(c) for c in sorted(right.columns))) for df in (answer, right))
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def grade(answer: DataFrame, right: DataFrame) -> bool:
    """Whether a candidate's rows are the metric's rows, as multisets of values by column name."""
    return sorted(answer.columns) == sorted(right.columns) and _unlike(answer, right).isEmpty()


#: What a statement shows when it keeps to a definition, and the questions that the definition is for.
_REVENUES = {"q01", "q02", "q03", "q05", "q06", "q07", "q10", "q12", "q13", "q14"}
DEFINITIONS = {
    "cancelled_counted": (re.compile(r"order_status\s*(<>|!=)\s*'cancelled'", re.I), _REVENUES),
    "member_undated": (re.compile(r"valid_from\b.*\bvalid_to\b", re.I | re.S), {"q02", "q05", "q07", "q13"}),
    "gross_for_net": (re.compile(r"coupon_discount_twd", re.I), {"q07", "q14"}),
}


def departures(question: str, sql: str) -> list[str]:
    """The definitions that a statement does not show, in order; hints beside the verdict, which rests on rows."""
    out = [k for k, (shown, asked) in DEFINITIONS.items() if question in asked and not shown.search(sql)]
    return out + ["month_without_year"] * bool(re.search(r"\bmonth\s*\(", sql, re.I) and not re.search(r"\byear\s*\(", sql, re.I))


def judge(spark: SparkSession, star: Star, answers: Iterable[tuple[str, str, str]], a: str, b: str) -> DataFrame:
    """(answer_id, question, verdict, departures) of answers (answer_id, question, statement over the star's tables).

    The verdict is right or wrong by the rows that the statement and the metric give, or error if the statement cannot be read over
    the star or has other columns. Statements are only read from: each becomes a subquery, so that none can change anything.
    """
    out = []
    for answer, question, sql in answers:
        try:
            own, right = spark.sql("WITH " + ", ".join(f"{t} AS (SELECT * FROM {{{t}}})" for t in star) + " SELECT * FROM (" + sql.replace("{", "{{").replace("}", "}}") + ")", **star), QUESTIONS[question](star, a, b)
        except (AnalysisException, ParseException):
            own = None
        if own is not None and sorted(own.columns) == sorted(right.columns):
            verdict = _unlike(own, right).agg(F.when(F.count("*") == 0, "right").otherwise("wrong").alias("verdict"))
        else:
            verdict = spark.range(1).select(F.lit("error").alias("verdict"))
        out.append(verdict.select(F.lit(answer).alias("answer_id"), F.lit(question).alias("question"), "verdict", F.lit(",".join(departures(question, sql))).alias("departures")))
    return reduce(DataFrame.unionByName, out)


def daily_revenue(events: DataFrame, products: DataFrame, rates: DataFrame) -> DataFrame:
    """(event_date, destination_country, revenue): events sent again count once; a missing rate is 1 and a missing product UNKNOWN, by this workload's own contract.

    Filtered and narrowed before they meet, repeated events fall to one by an aggregation that starts on each task; the small sides are joined as their size allows."""
    own = events.filter("event_type = 'paid'").select("event_id", "event_ts", "currency", "amount", "product_id").dropDuplicates(["event_id"]).withColumn("event_date", F.substring("event_ts", 1, 10))
    own = own.join(rates.select(F.col("rate_date").alias("event_date"), "currency", "rate_to_twd"), ["event_date", "currency"], "left").join(products.select("product_id", "destination_country"), "product_id", "left")
    money = F.col("amount").cast("decimal(20,4)") * F.coalesce(F.col("rate_to_twd").cast("decimal(17,8)"), F.lit(1).cast("decimal(17,8)"))
    return own.groupBy("event_date", F.coalesce("destination_country", F.lit("UNKNOWN")).alias("destination_country")).agg(F.round(F.sum(money), 2).cast("decimal(28,2)").alias("revenue"))
