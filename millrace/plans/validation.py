"""Checks that every version of the warehouse must pass before it is published: 32 for the base, 41 with batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions.money import reported
from ..operators import scd2
from ..operators.rules import panel
from ..operators.states import late_arrivals, latest
from .curated import eligible
from .gates import NONE, fx_key, product_key, snapshot_key

Tables = Mapping[str, DataFrame]


class Checks(Mapping):
    """Violating rows by check. A check is made when it is asked for, so that one alone needs only its own tables."""

    def __init__(self, made: dict[str, Callable[[], DataFrame]]) -> None:
        self.made = made

    def __getitem__(self, name: str) -> DataFrame:
        return self.made[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self.made)

    def __len__(self) -> int:
        return len(self.made)

    def __or__(self, other: Checks) -> Checks:
        return Checks(self.made | other.made)


def part(t: Tables, table: str, dataset: str) -> DataFrame:
    """The rows of a gate's table that are of one dataset, where the tables have them apart; else the whole table."""
    name = f"{table}/{dataset}"
    return t[name] if name in t else t[table]


def _repeats(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).count().filter("count > 1")


def _gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """By how many rows two frames differ in size, as a violation count."""
    n = a.agg(F.count("*").alias("n")).unionByName(b.agg((-F.count("*")).alias("n")))
    return n.agg(F.abs(F.sum("n")).alias("violation_count"))


def _surplus(df: DataFrame, *key: str) -> DataFrame:
    """The number of rows beyond the first of each key."""
    return df.groupBy(*key).agg((F.count("*") - 1).alias("violation_count"))


def _files(t: Tables, allowed: dict[str, dict[str, int]]) -> DataFrame:
    """Raw rows of a file or batch that is not allowed."""
    fine = lambda names: reduce(lambda a, b: a | b, ((F.col("source_file") == f) & (F.col("batch_order") == n) for f, n in names.items()))
    return reduce(DataFrame.unionByName, (t[f"raw_{d}"].filter(~fine(names)).select("source_file") for d, names in allowed.items()))


def base_checks(t: Tables) -> Checks:
    orders = lambda: t["orders"]
    members = lambda: t["members"]
    fact = lambda: t["fact_order"]
    dm = lambda: t["dim_member"]
    dp = lambda: t["dim_product"]
    dd = lambda: t["dim_date"]
    decided = lambda dataset: part(t, "entity_disposition", dataset)
    known = lambda: dm().filter("not is_unknown")
    real = lambda: dp().filter("not is_unknown")
    days = lambda: dd().select(F.col("date_sk").alias("_day"), F.lit(True).alias("_known"))
    roles = ("order_date_sk", "departure_date_sk", "updated_date_sk", "fx_date_sk")
    # One row of dates a key, and dates are few: no row fans out.
    dated = lambda: reduce(lambda df, role: df.join(days().select(F.col("_day").alias(role), F.col("_known").alias(f"_{role}")), role, "left"), roles, fact())
    bounds = lambda: dd().agg(F.min("full_date").alias("a"), F.max("full_date").alias("b"), F.count("*").alias("n"))
    canonical = lambda: orders().filter("is_canonical_event")
    conflicting = lambda: canonical().groupBy("order_id").agg((F.min("invariant_hash") != F.max("invariant_hash")).alias("x")).filter("x").select("order_id")
    snapshots = lambda: members().select(F.coalesce("member_id", F.lit(NONE)), F.coalesce(F.col("extract_date").cast("string"), F.lit(NONE)))
    rates = lambda: t["fx_rates"].select(fx_key())
    grains = lambda: [df.distinct().select(F.lit(1).alias("one")) for df in (orders().select("order_id"), snapshots(), members().select("member_id"), t["products"].select(product_key()), rates())]
    exact = (F.col("rate_to_twd").cast("decimal(17,8)") * F.col("original_amount").cast("decimal(20,4)")).cast("decimal(38,12)")
    home = (F.col("currency") == "TWD") & (F.col("rate_to_twd") != 1)
    assumed = lambda: orders().filter("timezone_assumed").select("source_row_uid", "order_id")
    placed = lambda: decided("orders").filter("entity_type = 'order'").select(F.col("business_key").alias("order_id"))
    reliable = lambda: eligible(members().filter("not same_day_conflict"), decided("members"), "member", F.col("member_id"))
    accepted = lambda: eligible(reliable(), decided("members"), "member_snapshot", snapshot_key()).select("source_row_uid")
    traced = lambda: t["member_lineage"].select("source_row_uid", "member_sk")
    untraced = lambda: accepted().join(traced(), "source_row_uid", "left_anti").unionByName(traced().join(accepted(), "source_row_uid", "left_anti").select("source_row_uid"))
    rule_004 = lambda: part(t, "entity_rule", "orders").filter("entity_type = 'order' and rule_id = 'ORD-004'").select(F.col("business_key").alias("order_id"))
    return Checks({
        "RAW_STAGING_ORDER_COUNT": lambda: _gap(t["raw_orders"], orders()), "RAW_STAGING_MEMBER_COUNT": lambda: _gap(t["raw_members"], members()),
        "RAW_STAGING_PRODUCT_COUNT": lambda: _gap(t["raw_products"], t["products"]), "RAW_STAGING_FX_COUNT": lambda: _gap(t["raw_fx_rates"], t["fx_rates"]),
        "SOURCE_FILE_ALLOWLIST": lambda: _files(t, {c.dataset: {c.files[0]: 0} for c in C.CONTRACTS.values()}),
        "FACT_ORDER_UNIQUENESS": lambda: _surplus(fact(), "order_id"),
        "MEMBER_SK_COLLISION": lambda: known().select("member_sk", "member_id", "valid_from").distinct().groupBy("member_sk").count().filter("count > 1 and member_sk <> 0"), "PRODUCT_SK_COLLISION": lambda: real().select("product_sk", "product_id").distinct().groupBy("product_sk").count().filter("count > 1 and product_sk <> 0"),
        "KNOWN_SK_NONZERO": lambda: known().filter("member_sk <= 0").select("member_id").unionByName(real().filter("product_sk <= 0").select(F.col("product_id").alias("member_id"))),
        "UNKNOWN_MEMBER_CARDINALITY": lambda: _gap(dm().filter("member_sk = 0 and is_unknown"), dm().sparkSession.range(1)), "UNKNOWN_PRODUCT_CARDINALITY": lambda: _gap(dp().filter("product_sk = 0 and is_unknown"), dp().sparkSession.range(1)),
        "MEMBER_PERIOD_OVERLAP": lambda: scd2.overlaps(known(), "member_id"), "MEMBER_SINGLE_CURRENT": lambda: _repeats(known().filter("is_current"), "member_id"),
        "MEMBER_VALIDITY_FLAGS": lambda: known().filter((F.col("valid_from") >= F.col("valid_to")) | (F.col("is_current") != (F.col("valid_to") == F.lit(C.OPEN_END).cast("date")))),
        "FACT_MEMBER_ORPHAN": lambda: fact().join(dm(), "member_sk", "left_anti"), "FACT_PRODUCT_ORPHAN": lambda: fact().join(dp(), "product_sk", "left_anti"), "FACT_DATE_ORPHAN": lambda: dated().filter(reduce(lambda a, b: a | b, (F.col(f"_{r}").isNull() for r in roles))),
        "DATE_KEY_FORMAT": lambda: dd().filter(F.col("date_sk") != F.date_format("full_date", "yyyyMMdd").cast("int")), "DATE_CONTINUITY": lambda: bounds().select(F.when(F.col("n") == 0, 1).otherwise(F.abs(F.col("n") - F.datediff("b", "a") - 1)).cast("long").alias("violation_count")),
        "DATE_SENTINEL_EXCLUSION": lambda: dd().filter(F.col("full_date").isin(*(F.lit(x).cast("date") for x in (C.BIRTH_SENTINEL, C.OPEN_END)))),
        "MISSING_FX_LEAKAGE": lambda: fact().filter(F.col("rate_to_twd").isNull() | home), "UNSUPPORTED_CURRENCY_LEAKAGE": lambda: fact().filter(~F.col("currency").isin(*C.CURRENCIES)),
        "MONEY_EXACT_RECOMPUTE": lambda: fact().filter(~exact.eqNullSafe(F.col("gross_amount_twd_exact")) | ~F.col("net_amount_twd_exact").eqNullSafe((F.col("gross_amount_twd_exact").cast("decimal(36,12)") - F.col("coupon_discount_twd")).cast("decimal(38,12)"))),
        "MONEY_ROUND_RECOMPUTE": lambda: fact().filter(~reported(F.col("gross_amount_twd_exact")).eqNullSafe(F.col("gross_amount_twd")) | ~reported(F.col("net_amount_twd_exact")).eqNullSafe(F.col("net_amount_twd"))),
        "UNKNOWN_PRODUCT_FLAG": lambda: fact().filter((F.col("unknown_product_flag") != (F.col("product_sk") == 0)) | (F.col("unknown_product_flag") != F.col("price_check_not_evaluable"))), "UNKNOWN_MEMBER_FLAG": lambda: fact().filter(F.col("unknown_member_flag") != (F.col("member_sk") == 0)),
        "QUARANTINE_ROW_DUPLICATE": lambda: _surplus(t["quarantine_row"], "dataset", "row_uid"),
        "ORDER_CANONICAL_CONFLICT_RULE_RECONCILIATION": lambda: conflicting().join(rule_004(), "order_id", "left_anti").unionByName(rule_004().join(conflicting(), "order_id", "left_anti")),
        "ENTITY_DISPOSITION_SOURCE_GRAIN_RECONCILIATION": lambda: _gap(t["entity_disposition"].select(F.lit(1).alias("one")), reduce(DataFrame.unionByName, grains())),
        "MEMBER_ACCEPTED_LINEAGE_RECONCILIATION": lambda: untraced().unionByName(traced().join(known(), "member_sk", "left_anti").select("source_row_uid")).unionByName(_repeats(traced(), "source_row_uid").select("source_row_uid")),
        "TIMEZONE_ASSUMPTION_DISPOSITION_PARTITION": lambda: _gap(assumed().select("source_row_uid"), assumed().join(placed(), "order_id").select("source_row_uid")),
        "TIMEZONE_FACT_SELECTED_SOURCE_FLAG": lambda: fact().select("source_row_uid", F.col("timezone_assumed").alias("flag")).join(orders().select("source_row_uid", "timezone_assumed"), "source_row_uid").filter("flag <> timezone_assumed").select("source_row_uid"),
    })


def incremental_checks(t: Tables, ledger: dict) -> Checks:
    """The base checks with all order files allowed, and nine more on batches."""
    orders = lambda: t["orders"]
    fact = lambda: t["fact_order"]
    decided = lambda: part(t, "entity_disposition", "orders")
    lineage = lambda: t["event_lineage"]
    canonical = lambda: orders().filter("is_canonical_event")
    registry = lambda: SparkSession.active().createDataFrame([(f, v["batch_order"], v["rows"]) for f, v in ledger["files"].items()], "source_file string, batch_order int, rows long")
    done = lambda: SparkSession.active().createDataFrame([(a["file"], a["batch_order"]) for a in ledger["attempts"] if a["status"] == "SUCCEEDED"], "source_file string, batch_order int")
    counted = lambda: reduce(DataFrame.unionByName, (t[f"raw_{d}"].groupBy("source_file", "batch_order").agg(F.count("*").alias("n")) for d in C.CONTRACTS))
    good = lambda: decided().filter("entity_type = 'order' and is_eligible").select(F.col("business_key").alias("order_id"))
    top = lambda: latest(canonical().join(good(), "order_id", "left_semi"), ["order_id"], "updated_at", ["canonical_event_hash"]).select("order_id", F.col("canonical_event_hash").alias("wanted"))
    late = lambda: late_arrivals(canonical(), ["order_id"], "batch_order", "updated_at").filter("batch_order > 0")
    flagged = lambda: part(t, "issue_hit", "orders").filter("rule_id = 'INC-001'")
    return base_checks(t) | Checks({
        "SOURCE_FILE_ALLOWLIST": lambda: _files(t, {c.dataset: {f: i for i, f in enumerate(c.files)} for c in C.CONTRACTS.values()}),
        "REGISTRY_LOGICAL_FILE_UNIQUENESS": lambda: _surplus(done(), "source_file"), "BATCH_RECONCILIATION_UNIQUENESS": lambda: _surplus(done(), "batch_order"),
        "RAW_SOURCE_REGISTRY_RECONCILIATION": lambda: counted().join(registry(), ["source_file", "batch_order"], "left_anti"),
        "REGISTRY_SOURCE_ROW_COUNT": lambda: registry().join(counted(), ["source_file", "batch_order"], "left").filter("n is null or n <> rows"),
        "ORDER_LINEAGE_RAW_RECONCILIATION": lambda: _gap(lineage(), t["raw_orders"]),
        "ORDER_LINEAGE_LOGICAL_REPRESENTATIVE": lambda: lineage().groupBy("canonical_event_hash").agg(F.count_if("is_canonical_event").alias("n")).filter("n <> 1"),
        "FACT_LATEST_STATE": lambda: fact().select("order_id", "canonical_event_hash").join(top(), "order_id", "full_outer").filter(~F.col("wanted").eqNullSafe(F.col("canonical_event_hash"))),
        "LATE_EVENT_FLAG_RECONCILIATION": lambda: flagged().select(F.col("row_uid").alias("x"), F.lit(True).alias("is_flagged")).join(late().select(F.col("source_row_uid").alias("x"), F.lit(True).alias("is_late")), "x", "full_outer").filter("is_flagged is null or is_late is null").select("x"),
        "QUARANTINED_ORDER_FACT_LEAKAGE": lambda: fact().join(decided().filter("entity_type = 'order' and not is_eligible").select(F.col("business_key").alias("order_id")), "order_id", "left_semi"),
    })


def violations(checks: Mapping[str, DataFrame]) -> dict[str, int]:
    return {r.check_id: r.violation_count for r in panel(checks).collect()}
