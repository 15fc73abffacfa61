"""The star: products (type 1), members (type 2), dates, and the fact of orders at their latest state."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import OPEN_END, TERMINAL
from ..functions.identity import surrogate_key
from ..functions.money import reported
from ..operators import scd2
from ..operators.states import latest
from .gates import fx_key, product_key, snapshot_key
from .staging import alike

LINEAGE = ("source_file", "source_row_number", "source_row_uid", "row_hash")
UNKNOWN_MEMBER = "__UNKNOWN__"


def eligible(df: DataFrame, decided: DataFrame, entity_type: str, key) -> DataFrame:
    good = decided.filter(F.col("is_eligible") & (F.col("entity_type") == entity_type)).select(F.col("business_key").alias("_key"))
    return df.withColumn("_key", key).join(good, "_key", "left_semi").drop("_key")


def _with_unknown(df: DataFrame, **values: object) -> DataFrame:
    """The Unknown row, key 0, before the others."""
    spark = df.sparkSession
    row = spark.range(1).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields))
    return row.unionByName(df)


def dim_product(products: DataFrame, decided: DataFrame) -> DataFrame:
    own = eligible(products, decided, "product", product_key())
    sk = surrogate_key(F.lit("dim_product"), F.lit("v1"), F.col("product_id"))
    columns = ["product_id", "product_name", "product_type", "destination_country", "destination_city", "trip_days", "base_price_twd"]
    known = own.select(sk.alias("product_sk"), *columns, (F.col("is_active") == "Y").alias("is_active"), F.lit(False).alias("is_unknown"), *LINEAGE)
    return _with_unknown(known, product_sk=0, product_name="Unknown Product", product_type="Unknown", is_unknown=True)


def with_good_days(members: DataFrame, decided: DataFrame) -> DataFrame:
    """Adds _reliable: member and snapshot are eligible. All that is decided on a member meets its rows at once, so that rows dealt by member need not be dealt anew by snapshot."""
    of_member = F.col("entity_type") == "member"
    known = decided.filter(F.col("is_eligible") & F.col("entity_type").isin("member", "member_snapshot"))
    # A snapshot's key ends with its day, which holds no bar.
    owner = F.when(of_member, F.col("business_key")).otherwise(F.regexp_replace("business_key", r"\|[^|]*$", ""))
    good = known.groupBy(owner.alias("_member")).agg(F.bool_or(of_member).alias("_good"), F.collect_set(F.when(~of_member, F.col("business_key"))).alias("_days"))
    both = members.join(good, members["member_id"] == good["_member"], "left")
    return both.withColumn("_reliable", F.coalesce(F.col("_good") & F.array_contains("_days", snapshot_key()), F.lit(False))).drop("_member", "_good", "_days")


def dim_member(members: DataFrame, decided: DataFrame) -> DataFrame:
    """Versions of level and city, with what the snapshot that starts a version says. A day on which a member's snapshots disagree ends its version and starts none."""
    carried = ["member_name", "birth_date", "register_date", "birth_date_sentinel", "birth_date_unknown", "birth_date_restatement", "_version_hash", *LINEAGE]
    given = {"member_level": "member_level", "city": "city", "member_name": "member_name", "birth_date": "canonical_birth_date", "register_date": "register_date", "birth_date_sentinel": "has_birth_date_sentinel", "birth_date_unknown": "birth_date_unknown", "birth_date_restatement": "birth_date_restatement", "_version_hash": "version_hash"} | {c: c for c in LINEAGE}
    kinds = dict(members.dtypes)
    said = F.struct(*(F.col(c).alias(n) for n, c in given.items()))
    # Two levels that disagree stand for a day of conflict, whatever its rows say.
    clash = lambda level: F.struct(*(F.lit(level if n == "member_level" else None).cast(kinds[c]).alias(n) for n, c in given.items()))
    conflict = F.col("same_day_conflict") & F.col("extract_date").isNotNull()
    rows = F.array(F.when(F.col("is_canonical_snapshot") & F.col("_reliable"), said), F.when(conflict, clash("<A>")), F.when(conflict, clash("<B>")))
    days = with_good_days(members, decided).select("member_id", "extract_date", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("member_id", "extract_date", "x.*")
    versions = scd2.build(days, "member_id", "extract_date", ["member_level", "city"], "dim_member|v1", carried)
    versions = versions.select(F.col("sk").alias("member_sk"), "member_id", "member_name", "member_level", "city", "birth_date", "register_date", "birth_date_sentinel", "birth_date_unknown", "birth_date_restatement", "valid_from", "valid_to", "is_current", F.col("_version_hash").alias("version_hash"), F.lit(False).alias("is_unknown"), F.col("valid_from").alias("source_extract_date"), *LINEAGE)
    nobody = {"member_sk": 0, "member_id": UNKNOWN_MEMBER, "member_name": "Unknown Member", "member_level": "Unknown", "city": "Unknown", "birth_date_sentinel": False, "birth_date_unknown": True, "birth_date_restatement": False, "valid_from": "0001-01-01", "valid_to": OPEN_END, "is_current": True, "is_unknown": True}
    return _with_unknown(versions, **nobody)


def member_lineage(members: DataFrame, decided: DataFrame, dim: DataFrame) -> DataFrame:
    """Every accepted snapshot row of a day without conflict, with the version that covers it."""
    good = with_good_days(members.filter("not same_day_conflict"), decided).filter("_reliable")
    versions = dim.filter("not is_unknown").withColumnRenamed("member_sk", "sk")
    return scd2.lineage(good.select("source_row_uid", "source_file", "source_row_number", "row_hash", "member_id", "extract_date"), versions, "member_id", "extract_date").withColumnRenamed("sk", "member_sk")


#: Of the datasets with dates the kind and key of their entities, and seven kinds of dates. Copies of an event have its dates.
DATED = {
    "orders": ("order", lambda: F.col("order_id"), ("order_business_date", "updated_business_date", "departure_date")),
    "members": ("member", lambda: F.col("member_id"), ("extract_date", "register_date", "canonical_birth_date")),
    "fx_rates": ("fx_rate", fx_key, ("rate_date",)),
}


def accepted_dates(staged: Mapping[str, DataFrame], decided: DataFrame, dataset: str) -> DataFrame:
    """(full_date) of the accepted rows of one dataset."""
    entity_type, key, columns = DATED[dataset]
    return eligible(staged[dataset], decided, entity_type, key()).select(F.explode(F.array(*columns)).alias("full_date"))


def dim_date(staged: Mapping[str, DataFrame], decided: DataFrame) -> DataFrame:
    """All days between the least and the greatest of the accepted dates; sentinels are not among them."""
    return scd2.calendar(*(accepted_dates(staged, decided, d) for d in DATED))


def fact_order(orders: DataFrame, decided: DataFrame, by_rule: DataFrame, members: DataFrame, products: DataFrame) -> DataFrame:
    """One row for each accepted order, at its latest state, with versions as of its business date."""
    of_order = Window.partitionBy("order_id")
    events = orders.withColumn("_event", F.dense_rank().over(of_order.orderBy("canonical_event_hash"))).withColumn("_surplus", F.count("*").over(of_order) - F.max("_event").over(of_order)).drop("_event")
    good = eligible(events.filter("is_canonical_event"), decided, "order", F.col("order_id"))
    flags = by_rule.filter("entity_type = 'order'").groupBy(F.col("business_key").alias("order_id")).agg(F.bool_or(F.col("rule_id") == "ORD-018").alias("lifecycle_warning"), F.bool_or(F.col("rule_id") == "INC-001").alias("late_event_flag"))
    one = latest(good, ["order_id"], "updated_at", ["canonical_event_hash"]).join(flags, "order_id", "left").fillna(False, ["lifecycle_warning", "late_event_flag"])
    versions = members.filter("not is_unknown")
    one = scd2.as_of(one, versions, "member_id", F.col("order_business_date"), ["member_sk"], {"member_sk": 0})
    one = one.join(products.filter("not is_unknown").select("product_id", "product_sk"), "product_id", "left").fillna(0, ["product_sk"])
    key = lambda c: F.date_format(c, "yyyyMMdd").cast("int")
    return one.select(
        "order_id", "member_id", "product_id", "member_sk", "product_sk", key("order_business_date").alias("order_date_sk"), key("updated_business_date").alias("updated_date_sk"), key("departure_date").alias("departure_date_sk"), key("order_business_date").alias("fx_date_sk"),
        "channel", "order_status", "quantity", F.col("raw_currency").alias("original_currency"), "currency", F.col("amount").alias("original_amount"), "rate_to_twd", "coupon_discount_twd", "gross_amount_twd_exact", "net_amount_twd_exact",
        reported(F.col("gross_amount_twd_exact")).alias("gross_amount_twd"), reported(F.col("net_amount_twd_exact")).alias("net_amount_twd"), "order_created_at", "updated_at", "departure_date", "order_business_date",
        (F.col("member_sk") == 0).alias("unknown_member_flag"), (F.col("product_sk") == 0).alias("unknown_product_flag"), (F.col("product_sk") == 0).alias("price_check_not_evaluable"), "timezone_assumed", "currency_normalized", "lifecycle_warning", "late_event_flag",
        F.col("order_status").isin(*TERMINAL).alias("is_terminal"), F.col("duplicate_source_row_count").cast("int").alias("event_copies"), F.col("_surplus").cast("int").alias("duplicate_source_row_count"),
        "canonical_event_hash", "source_file", "source_row_number", "batch_order", "source_row_uid", "row_hash",
    )


def event_lineage(orders: DataFrame) -> DataFrame:
    """Each physical row with the row that stands for its logical event; with each, should several have one uid."""
    logical = F.max(F.when(F.col("is_canonical_event"), F.col("source_row_uid"))).over(alike())
    own = orders.withColumns({"_logical": logical, "_times": F.count_if("is_canonical_event").over(alike())})
    return own.select("canonical_event_hash", "source_row_uid", "batch_order", "order_id", "is_canonical_event", F.explode(F.array_repeat("_logical", F.col("_times").cast("int"))).alias("logical_row_uid"))
