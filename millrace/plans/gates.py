"""Quality gates: the rules that decide which entities reach the curated tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import contracts as C
from ..operators.rules import ACCEPT, NORMALIZE, QUARANTINE, WARN, Rule, dispositions, entity_rules, hits, quarantined

NONE = "<NULL>"


def _outside(column: str, domain: tuple[str, ...]) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(*domain)


def _unlike(column: str, pattern: str) -> Column:
    return F.col(column).isNull() | ~F.col(column).rlike(pattern)


def snapshot_key() -> Column:
    return F.concat("member_id", F.lit("|"), F.coalesce(F.col("extract_date").cast("string"), F.lit(NONE)))


def fx_key() -> Column:
    return F.concat(F.coalesce(F.col("rate_date").cast("string"), F.lit(NONE)), F.lit("|"), F.coalesce("currency", F.lit(NONE)))


def product_key() -> Column:
    return F.coalesce("product_id", F.lit(NONE))


def marked_orders(orders: DataFrame) -> DataFrame:
    """Orders with all that rules need of other orders. Every window is by order_id, so that one exchange serves them all."""
    of_order = Window.partitionBy("order_id")
    canonical = F.col("is_canonical_event")
    hash_ = F.when(canonical, F.col("canonical_event_hash"))
    same_time = Window.partitionBy("order_id", "updated_at")
    own = orders.withColumns({
        "_invariant_conflict": F.min(F.when(canonical, F.col("invariant_hash"))).over(of_order) != F.max(F.when(canonical, F.col("invariant_hash"))).over(of_order),
        "_same_time_conflict": F.col("updated_at").isNotNull() & (F.min(hash_).over(same_time) != F.max(hash_).over(same_time)),
        "_latest": F.max(F.when(canonical, F.col("updated_at"))).over(of_order),
    })
    own = own.withColumn("_latest_tie", F.count_if(canonical & (F.col("updated_at") == F.col("_latest"))).over(of_order) > 1)
    # The state before is that of the canonical event before; copies have no place of their own in the sequence.
    sequence = Window.partitionBy("order_id", "is_canonical_event").orderBy(F.col("updated_at").asc_nulls_last(), "canonical_event_hash")
    own = own.withColumn("_prior_status", F.when(canonical, F.lag("order_status").over(sequence)))
    earlier = Window.partitionBy("order_id").orderBy("batch_order").rangeBetween(Window.unboundedPreceding, -1)
    return own.withColumn("_known_time", F.max(F.when(canonical, F.col("updated_at"))).over(earlier))


def with_members(orders: DataFrame, members: DataFrame) -> DataFrame:
    return orders.join(members.select("member_id").distinct().withColumn("_member_known", F.lit(True)), "member_id", "left")


def with_prices(orders: DataFrame, products: DataFrame) -> DataFrame:
    prices = products.groupBy("product_id").agg(F.max("base_price_twd").alias("_price"), F.min("base_price_twd").alias("_price_low"), F.lit(True).alias("_product_known"))
    return orders.join(prices, "product_id", "left")


#: Order rules that look at other datasets: their rows meet these with the few columns that they need, apart from the other rules.
OF_MEMBERS, OF_PRICES = ("ORD-015",), ("ORD-016", "ORD-023")


def order_rules() -> list[Rule]:
    total = (F.col("_price") * F.col("quantity")).cast("decimal(38,4)")
    total_low = (F.col("_price_low") * F.col("quantity")).cast("decimal(38,4)")
    gross = F.col("gross_amount_twd_exact").cast("decimal(36,12)")
    priced = (F.col("amount") > 0) & gross.isNotNull() & (F.col("quantity") > 0) & (F.col("_price_low") > 0)
    window = reduce(lambda a, b: a | b, ((F.col("source_file") == f) & (F.col("batch_order") == n) & (F.col("order_business_date").isNull() | ~F.col("order_business_date").between(F.lit(low).cast("date"), F.lit(high).cast("date"))) for f, (n, low, high) in C.WINDOWS.items()))
    canonical = F.col("is_canonical_event")
    return [
        Rule("ORD-001", NORMALIZE, F.col("duplicate_source_row_count") > 1),
        Rule("ORD-003", QUARANTINE, F.col("_same_time_conflict")),
        Rule("ORD-004", QUARANTINE, F.col("_invariant_conflict")),
        Rule("ORD-005", QUARANTINE, F.col("_latest_tie")),
        Rule("ORD-006", QUARANTINE, _outside("order_status", C.STATUSES)),
        Rule("ORD-007", QUARANTINE, _outside("channel", C.CHANNELS)),
        Rule("ORD-008", QUARANTINE, F.col("quantity").isNull() | (F.col("quantity") <= 0)),
        Rule("ORD-009", NORMALIZE, F.col("currency_normalized")),
        Rule("ORD-010", QUARANTINE, F.col("amount").isNull() | (F.col("amount") <= 0)),
        Rule("ORD-011", QUARANTINE, F.col("coupon_discount_twd").isNull() | (F.col("coupon_discount_twd") < 0)),
        Rule("ORD-012", NORMALIZE, F.col("timezone_assumed")),
        Rule("ORD-013", QUARANTINE, F.col("order_created_at").isNull() | F.col("updated_at").isNull() | (F.col("updated_at") < F.col("order_created_at"))),
        Rule("ORD-014", QUARANTINE, F.col("departure_date") < F.col("order_business_date")),
        Rule("ORD-015", ACCEPT, F.col("_member_known").isNull()),
        Rule("ORD-016", ACCEPT, F.col("_product_known").isNull()),
        # An exact amount out of the range of money is as unusable as a missing rate.
        Rule("ORD-017", QUARANTINE, ~F.col("currency").isin(*C.CURRENCIES) | (F.col("currency").isin(*C.FOREIGN) & F.col("rate_to_twd").isNull()) | (F.col("amount").isNotNull() & F.col("rate_to_twd").isNotNull() & gross.isNull())),
        Rule("ORD-018", ACCEPT, canonical & F.col("_prior_status").isin(*C.TERMINAL) & (F.col("order_status") != F.col("_prior_status"))),
        Rule("ORD-019", QUARANTINE, _unlike("order_id", C.ORDER_ID) | _unlike("member_id", C.MEMBER_ID) | _unlike("product_id", C.PRODUCT_ID)),
        Rule("ORD-020", QUARANTINE, (F.col("amount") > 0) & (F.col("coupon_discount_twd") >= 0) & (F.col("net_amount_twd_exact") < 0)),
        Rule("ORD-021", QUARANTINE, window),
        Rule("ORD-023", QUARANTINE, priced & ((gross * 2 < total) | (gross > total_low * 2))),
        Rule("ORD-024", QUARANTINE, F.col("departure_date").isNull()),
        Rule("INC-001", WARN, canonical & (F.col("batch_order") > 0) & (F.col("updated_at") < F.col("_known_time"))),
    ]


def member_rules() -> list[Rule]:
    birth = F.col("raw_birth_date").isNotNull() & (F.trim("raw_birth_date") != "") & F.col("raw_birth_date").try_cast("date").isNull()
    return [
        Rule("MEM-001", NORMALIZE, F.col("identical_snapshot_count") > 1),
        Rule("MEM-003", QUARANTINE, F.col("same_day_conflict")),
        Rule("MEM-004", QUARANTINE, _unlike("member_id", C.MEMBER_ID)),
        Rule("MEM-005", QUARANTINE, _outside("member_level", C.LEVELS)),
        Rule("MEM-006", QUARANTINE, F.col("extract_date").isNull() | F.col("register_date").isNull() | birth),
        Rule("MEM-007", QUARANTINE, (F.col("register_date") > F.col("extract_date")) | (F.col("canonical_birth_date") >= F.col("register_date"))),
        Rule("MEM-009", QUARANTINE, F.col("birth_date_identity_ambiguous"), "member", F.col("member_id")),
        Rule("MEM-011", NORMALIZE, F.col("birth_date_sentinel"), "member", F.col("member_id")),
    ]


def product_rules() -> list[Rule]:
    return [
        Rule("PROD-002", QUARANTINE, F.col("_copies") > 1),
        Rule("PROD-003", QUARANTINE, _unlike("product_id", C.PRODUCT_ID)),
        Rule("PROD-004", QUARANTINE, reduce(lambda a, b: a | b, (F.col(c).isNull() for c in ("product_name", "product_type", "destination_country", "destination_city")))),
        Rule("PROD-005", QUARANTINE, F.col("trip_days").isNull() | (F.col("trip_days") <= 0) | F.col("base_price_twd").isNull() | (F.col("base_price_twd") <= 0) | ~F.col("is_active").isin("Y", "N")),
    ]


def fx_rules() -> list[Rule]:
    return [
        Rule("FX-001", QUARANTINE, F.col("_copies") > 1),
        Rule("FX-003", QUARANTINE, F.col("rate_date").isNull() | ~F.col("currency").isin(*C.FOREIGN) | F.col("rate_to_twd").isNull() | (F.col("rate_to_twd") <= 0)),
    ]


def found(staged: Mapping[str, DataFrame], dataset: str) -> DataFrame:
    """issue_hit of one dataset."""
    copies = lambda df, *key: df.withColumn("_copies", F.count("*").over(Window.partitionBy(*key)))
    own = staged[dataset]
    if dataset == "members":
        return hits(own, dataset, "member_snapshot", snapshot_key(), "source_row_uid", member_rules())
    if dataset == "products":
        return hits(copies(own, "product_id"), dataset, "product", product_key(), "source_row_uid", product_rules())
    if dataset == "fx_rates":
        return hits(copies(own, "rate_date", "currency"), dataset, "fx_rate", fx_key(), "source_row_uid", fx_rules())
    alone = staged["order_rows"] if "order_rows" in staged else own  # they need no other rows of the order, so that they are dealt by member or product alone
    frames = {OF_MEMBERS: with_members(alone, staged["members"]), OF_PRICES: with_prices(alone, staged["products"])}
    rest = tuple(r.rule_id for r in order_rules() if not any(r.rule_id in ids for ids in frames))
    frames = {rest: marked_orders(own)} | frames
    return reduce(DataFrame.unionByName, (hits(df, dataset, "order", F.col("order_id"), "source_row_uid", [r for r in order_rules() if r.rule_id in ids]) for ids, df in frames.items()))


def entity_rows(staged: Mapping[str, DataFrame], dataset: str) -> DataFrame:
    """(dataset, entity_type, business_key, row_uid) of one dataset. Rows are tied to entities through their own staged row, so that padded keys are not missed."""
    kinds = {"orders": [("order", F.col("order_id"))], "members": [("member", F.col("member_id")), ("member_snapshot", snapshot_key())], "products": [("product", product_key())], "fx_rates": [("fx_rate", fx_key())]}[dataset]
    return reduce(DataFrame.unionByName, (staged[dataset].select(F.lit(dataset).alias("dataset"), F.lit(e).alias("entity_type"), k.alias("business_key"), F.col("source_row_uid").alias("row_uid")) for e, k in kinds))


def apply(staged: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """issue_hit, entity_rule, entity_disposition and quarantine_row of staged orders, members, products and fx_rates."""
    issue_hit = reduce(DataFrame.unionByName, (found(staged, d) for d in C.CONTRACTS))
    by_rule = entity_rules(issue_hit)
    rows = reduce(DataFrame.unionByName, (entity_rows(staged, d) for d in C.CONTRACTS))
    decided = dispositions(rows.select("entity_type", "business_key"), by_rule)
    return {"issue_hit": issue_hit, "entity_rule": by_rule, "entity_disposition": decided, "quarantine_row": quarantined(rows, decided, issue_hit, by_rule)}
