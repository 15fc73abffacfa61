"""Typed staging of the four datasets: one row a raw row, nothing dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions.identity import json_hash, utc_text
from ..functions.money import convert, less, rate_or_one
from ..functions.times import business_date, instant

LINEAGE = ("source_file", "source_row_number", "batch_order", "row_hash", "source_row_uid")


def alike() -> WindowSpec:
    """Rows of one event, copies of each other, among the rows of their order: the hash holds the order's number."""
    return Window.partitionBy("order_id").orderBy("canonical_event_hash").rangeBetween(Window.currentRow, Window.currentRow)


def stage_fx(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("rate_date").try_cast("date").alias("rate_date"), F.trim("currency").alias("currency"), F.col("rate_to_twd").try_cast("decimal(24,8)").alias("rate_to_twd"), *LINEAGE)


def stage_products(raw: DataFrame) -> DataFrame:
    text = [F.trim(c).alias(c) for c in ("product_id", "product_name", "product_type", "destination_country", "destination_city", "is_active")]
    return raw.select(*text, F.col("trip_days").try_cast("int").alias("trip_days"), F.col("base_price_twd").try_cast("decimal(24,4)").alias("base_price_twd"), *LINEAGE)


def _rank_copies(df: DataFrame, identity: list[str], count: str, flag: str) -> DataFrame:
    """How many rows are alike, and whether a row is the one with the least uid; one exchange for both."""
    own = Window.partitionBy(*identity)
    return df.withColumn(count, F.count("*").over(own)).withColumn(flag, F.col("source_row_uid") == F.min("source_row_uid").over(own))


def stage_members(raw: DataFrame) -> DataFrame:
    """A sentinel birth date is unknown; one real date of a member holds for all its snapshots; several make the member ambiguous."""
    sentinel = F.col("birth_date") == C.BIRTH_SENTINEL
    typed = raw.select(
        F.trim("member_id").alias("member_id"), "member_name", F.trim("member_level").alias("member_level"), F.trim("city").alias("city"), F.col("birth_date").alias("raw_birth_date"),
        F.when(~sentinel, F.col("birth_date").try_cast("date")).alias("row_birth_date"), sentinel.alias("birth_date_sentinel"),
        F.col("register_date").try_cast("date").alias("register_date"), F.col("extract_date").try_cast("date").alias("extract_date"), *LINEAGE,
    )
    of_member = Window.partitionBy("member_id")
    low, high = F.min("row_birth_date").over(of_member), F.max("row_birth_date").over(of_member)
    known = typed.withColumns({"canonical_birth_date": F.when(low == high, low), "birth_date_identity_ambiguous": F.coalesce(low != high, F.lit(False)), "birth_date_unknown": low.isNull(), "has_birth_date_sentinel": F.bool_or("birth_date_sentinel").over(of_member)})
    none = F.lit("<NULL>")
    own = known.withColumn("birth_date_restatement", F.col("has_birth_date_sentinel") & F.col("canonical_birth_date").isNotNull()).withColumn(
        "snapshot_payload_hash",
        json_hash(schema_version=F.lit("member-payload-v1"), member_name=F.col("member_name"), member_level=F.col("member_level"), city=F.col("city"), birth_date=F.coalesce(F.col("canonical_birth_date").cast("string"), none), register_date=F.coalesce(F.col("register_date").cast("string"), none)),
    ).withColumn("version_hash", json_hash(schema_version=F.lit("member-state-v1"), member_level=F.coalesce("member_level", none), city=F.coalesce("city", none)))
    day = Window.partitionBy("member_id", "extract_date")
    own = own.withColumn("same_day_conflict", F.min("snapshot_payload_hash").over(day) != F.max("snapshot_payload_hash").over(day))
    return _rank_copies(own, ["member_id", "extract_date", "snapshot_payload_hash"], "identical_snapshot_count", "is_canonical_snapshot")


def unique_rates(fx: DataFrame) -> DataFrame:
    """One rate for a date and currency; a key with several rows has none, so that no order fans out."""
    return fx.groupBy("rate_date", "currency").agg(F.when(F.count("*") == 1, F.min("rate_to_twd")).alias("rate_to_twd"))


def order_rows(raw: DataFrame, fx: DataFrame, deal: bool = False) -> DataFrame:
    """All of staged orders that a row tells alone, with its rate; deal: the rows of an order meet."""
    currency = F.trim("currency")
    normal = currency
    for alias, name in C.ALIASES.items():
        normal = F.when(currency == alias, name).otherwise(normal)
    typed = raw.select(
        *(F.trim(c).alias(c) for c in ("order_id", "member_id", "product_id", "channel", "order_status")), F.col("quantity").try_cast("int").alias("quantity"), F.col("currency").alias("raw_currency"), normal.alias("currency"),
        F.col("amount").try_cast("decimal(24,4)").alias("amount"), F.col("coupon_discount").try_cast("decimal(24,4)").alias("coupon_discount_twd"), F.col("order_created_at").alias("raw_order_created_at"),
        instant(F.col("order_created_at")).alias("order_created_at"), F.col("order_created_at").rlike(C.NAIVE).alias("timezone_assumed"), F.col("departure_date").try_cast("date").alias("departure_date"), F.col("updated_at").try_cast("timestamp").alias("updated_at"), *LINEAGE,
    )
    dated = typed.withColumns({"order_business_date": business_date(F.col("order_created_at")), "updated_business_date": business_date(F.col("updated_at")), "currency_normalized": F.col("currency") != F.trim("raw_currency")})
    rates = unique_rates(fx).select(F.col("rate_date").alias("order_business_date"), "currency", F.col("rate_to_twd").alias("_rate"))
    # Rates are one a day and currency, so they go to the orders.
    priced = (dated.repartition("order_id") if deal else dated).join(F.broadcast(rates), ["order_business_date", "currency"], "left").withColumn("rate_to_twd", rate_or_one(F.col("currency"), F.col("_rate"))).drop("_rate")
    return priced.withColumn("gross_amount_twd_exact", convert(F.col("amount"), F.col("rate_to_twd"))).withColumn("net_amount_twd_exact", less(F.col("gross_amount_twd_exact"), F.col("coupon_discount_twd")))


def _order_hashes() -> dict[str, Column]:
    shared = {c: F.col(c) for c in ("member_id", "product_id", "channel", "quantity", "currency", "amount")} | {"coupon_discount": F.col("coupon_discount_twd"), "order_created_at": utc_text(F.col("order_created_at")), "departure_date": F.col("departure_date").cast("string")}
    event = json_hash(schema_version=F.lit("order-event-v1"), order_id=F.col("order_id"), order_status=F.col("order_status"), updated_at=utc_text(F.col("updated_at")), **shared)
    return {"canonical_event_hash": event, "invariant_hash": json_hash(schema_version=F.lit("order-invariant-v1"), **shared)}


def stage_orders(raw: DataFrame, fx: DataFrame) -> DataFrame:
    """The rows of an order meet before their hashes are made: all windows over orders, copies too, are by order_id and share one exchange."""
    own = order_rows(raw, fx, deal=True).withColumns(_order_hashes())
    return own.withColumn("duplicate_source_row_count", F.count("*").over(alike())).withColumn("is_canonical_event", F.col("source_row_uid") == F.min("source_row_uid").over(alike()))


def order_events(raw: DataFrame, fx: DataFrame) -> DataFrame:
    """Of staged orders what tells which rows are one event. The hash is made before the rows meet, and is dealt as bytes, so that it goes for all that it is made of."""
    hashed = order_rows(raw, fx).select("order_id", F.unhex(_order_hashes()["canonical_event_hash"]).alias("_event"), "source_row_uid", "batch_order")
    own = hashed.repartition("order_id").withColumn("canonical_event_hash", F.lower(F.hex("_event"))).drop("_event")
    return own.withColumn("is_canonical_event", F.col("source_row_uid") == F.min("source_row_uid").over(alike()))
