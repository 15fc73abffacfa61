"""Profiling detectors over the raw tables: 47 rules and seven analyses.

Every detector gives (business_key, sample_sort_key, sample_json); summary() counts rows and keys and keeps three samples of each.
Rules that look at one row are conditions of a table; the others are functions. A detector reports, a gate decides: rules of the
same name may differ, as profiling looks at the source as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions.identity import row_json
from ..functions.money import convert, rate_or_one
from ..functions.times import business_date, instant
from ..operators import scd2, states
from ..operators.tables import exact_quantiles

Raw = dict[str, DataFrame]
EXPECTED = {"MEM-010", "ORD-002", "ORD-022"}
_ORDER_PAYLOAD = ["member_id", "product_id", "channel", "order_status", "quantity", "currency", "amount", "coupon_discount", "order_created_at", "departure_date"]
_INVARIANT = ["member_id", "product_id", "channel", "quantity", "currency", "amount", "coupon_discount", "order_created_at", "departure_date"]
_MEMBER_PAYLOAD = ["member_name", "member_level", "city", "birth_date", "register_date"]


REPORT = ("business_key", "sample_sort_key", "sample_json")


def report(df: DataFrame, key: Column, *extra: str, **kept: str) -> DataFrame:
    """REPORT's columns, with the columns extra in the JSON; kept columns go along."""
    shown = [*extra, "source_file", "source_row_number"]
    order = F.concat_ws("|", key, "source_file", F.lpad(F.col("source_row_number").cast("string"), 12, "0"))
    return df.select(key.alias("business_key"), order.alias("sample_sort_key"), row_json(*dict.fromkeys(shown)).alias("sample_json"), *(F.col(c).alias(n) for n, c in kept.items()))


def _any(columns: list[str], test: Callable[[Column], Column]) -> Column:
    return reduce(lambda a, b: a | b, (test(F.col(c)) for c in columns))


def _key(contract: C.Contract) -> Column:
    return F.col(contract.key[0]) if contract.dataset != "fx_rates" else F.concat_ws("|", "rate_date", "currency")


def _across(raw: Raw, test: Callable[[C.Contract], Column]) -> DataFrame:
    return reduce(DataFrame.unionByName, (report(raw[c.dataset].filter(test(c)).withColumn("dataset", F.lit(c.dataset)), _key(c), "dataset") for c in C.CONTRACTS.values()))


def _dec(c: str, kind: str = "decimal(24,4)") -> Column:
    return F.col(c).try_cast(kind)


def _ts(c: str) -> Column:
    return F.col(c).try_cast("timestamp")


def _date(c: str) -> Column:
    return F.col(c).try_cast("date")



def _iso(c: str) -> Column:
    return F.col(c).rlike(C.ISO_OFFSET)


def _created_day() -> Column:
    return business_date(_ts("order_created_at"))


@dataclass(frozen=True)
class RowRule:
    dataset: str
    when: Callable[[], Column]
    shown: tuple[str, ...]


ROW_RULES: dict[str, RowRule] = {
    "ORD-006": RowRule("orders", lambda: ~F.col("order_status").isin(*C.STATUSES), ("order_id", "order_status")),
    "ORD-007": RowRule("orders", lambda: ~F.col("channel").isin(*C.CHANNELS), ("order_id", "channel")),
    "ORD-008": RowRule("orders", lambda: F.coalesce(F.col("quantity").try_cast("int") <= 0, F.lit(True)), ("order_id", "quantity")),
    "ORD-009": RowRule("orders", lambda: ~F.col("currency").isin(*C.CURRENCIES), ("order_id", "currency")),
    "ORD-010": RowRule("orders", lambda: F.coalesce(_dec("amount") <= 0, F.lit(True)), ("order_id", "amount")),
    "ORD-011": RowRule("orders", lambda: F.coalesce(_dec("coupon_discount") < 0, F.lit(True)), ("order_id", "coupon_discount")),
    "ORD-012": RowRule("orders", lambda: ~_iso("order_created_at") | ~_iso("updated_at"), ("order_id", "order_created_at", "departure_date", "updated_at")),
    "ORD-013": RowRule("orders", lambda: _iso("order_created_at") & _iso("updated_at") & (_ts("updated_at") < _ts("order_created_at")), ("order_id", "order_created_at", "updated_at")),
    "ORD-014": RowRule("orders", lambda: _iso("order_created_at") & (_date("departure_date") < _created_day()), ("order_id", "order_created_at", "departure_date")),
    "ORD-019": RowRule("orders", lambda: ~F.col("order_id").rlike(C.ORDER_ID) | ~F.col("member_id").rlike(C.MEMBER_ID) | ~F.col("product_id").rlike(C.PRODUCT_ID), ("order_id", "member_id", "product_id")),
    "ORD-021": RowRule("orders", lambda: (F.col("source_file") == "orders_base.csv") & _iso("order_created_at") & ~_created_day().between(*(F.lit(x).cast("date") for x in C.WINDOWS["orders_base.csv"][1:])), ("order_id", "order_created_at")),
    "ORD-022": RowRule("orders", lambda: _iso("order_created_at") & _any(["source_file"], lambda f: reduce(lambda a, b: a | b, ((f == name) & (_created_day() != F.lit(day).cast("date")) for name, (n, _, day) in C.WINDOWS.items() if n))), ("order_id", "order_created_at")),
    "ORD-024": RowRule("orders", lambda: _date("departure_date").isNull() | ~F.col("departure_date").rlike(C.ISO_DATE), ("order_id", "departure_date")),
    "MEM-004": RowRule("members", lambda: ~F.col("member_id").rlike(C.MEMBER_ID), ("member_id",)),
    "MEM-005": RowRule("members", lambda: ~F.col("member_level").isin(*C.LEVELS), ("member_id", "member_level")),
    "MEM-006": RowRule("members", lambda: _date("register_date").isNull() | _date("extract_date").isNull() | ((F.trim("birth_date") != "") & _date("birth_date").isNull()), ("member_id", "birth_date", "register_date", "extract_date")),
    "MEM-007": RowRule("members", lambda: (_date("register_date") > _date("extract_date")) | ((F.col("birth_date") != C.BIRTH_SENTINEL) & (_date("birth_date") > _date("register_date"))), ("member_id", "birth_date", "register_date", "extract_date")),
    "PROD-003": RowRule("products", lambda: ~F.col("product_id").rlike(C.PRODUCT_ID), ("product_id",)),
    "PROD-004": RowRule("products", lambda: _any(["product_name", "product_type", "destination_country", "destination_city"], lambda c: F.trim(c) == ""), ("product_id", "product_name")),
    "PROD-005": RowRule("products", lambda: F.coalesce(F.col("trip_days").try_cast("int") <= 0, F.lit(True)) | F.coalesce(_dec("base_price_twd") <= 0, F.lit(True)) | ~F.col("is_active").isin("Y", "N"), ("product_id", "trip_days", "base_price_twd", "is_active")),
    "FX-003": RowRule("fx_rates", lambda: _date("rate_date").isNull() | ~F.col("currency").isin(*C.FOREIGN) | F.coalesce(_dec("rate_to_twd", "decimal(24,8)") <= 0, F.lit(True)), ("rate_date", "currency", "rate_to_twd")),
}


def _repeated(raw: Raw, contract: C.Contract, columns: list[str]) -> DataFrame:
    own = raw[contract.dataset].withColumn("copies", F.count("*").over(Window.partitionBy(*columns)))
    return report(own.filter("copies > 1"), _key(contract), *contract.key, "copies")


def _differing(raw: Raw, contract: C.Contract, key: list[str], payload: list[str]) -> DataFrame:
    """Rows of keys that have several payloads: least and greatest hash tell it, in a window without sets."""
    over = Window.partitionBy(*key)
    own = raw[contract.dataset].withColumn("_hash", F.md5(F.concat_ws(chr(31), *payload))).withColumn("_differs", F.min("_hash").over(over) != F.max("_hash").over(over))
    return report(own.filter("_differs"), _key(contract), *contract.key)


def _rates(raw: Raw) -> DataFrame:
    """One rate a currency and day: of several, which the rules on rates report, the least."""
    return raw["fx_rates"].select(F.col("currency").alias("fx_currency"), _date("rate_date").alias("fx_date"), _dec("rate_to_twd", "decimal(24,8)").alias("fx_rate")).groupBy("fx_currency", "fx_date").agg(F.min("fx_rate").alias("fx_rate"))


def _priced(raw: Raw, currency: Column, created: Column) -> DataFrame:
    own = raw["orders"].withColumns({"_currency": currency, "_day": business_date(created)})
    joined = own.join(_rates(raw), (F.col("_currency") == F.col("fx_currency")) & (F.col("_day") == F.col("fx_date")), "left")
    return joined.withColumn("_rate", rate_or_one(F.col("_currency"), F.col("fx_rate"))).withColumn("_gross", convert(_dec("amount"), F.col("_rate")))


def ord_004(raw: Raw) -> DataFrame:
    bad = states.conflicting(raw["orders"], ["order_id"], _INVARIANT)
    return report(raw["orders"].join(bad, "order_id", "left_semi"), F.col("order_id"), "order_id", "member_id", "product_id", "currency", "order_created_at")


def ord_005(raw: Raw) -> DataFrame:
    own = raw["orders"].withColumn("_at", _ts("updated_at")).withColumn("_top", F.max("_at").over(Window.partitionBy("order_id"))).filter("_at = _top")
    return report(own.withColumn("latest_candidates", F.count("*").over(Window.partitionBy("order_id"))).filter("latest_candidates > 1"), F.col("order_id"), "order_id", "updated_at", "latest_candidates")


def _dangling(raw: Raw, dataset: str, column: str) -> DataFrame:
    return report(raw["orders"].join(raw[dataset].select(column).distinct(), column, "left_anti"), F.col("order_id"), "order_id", column)


def ord_017(raw: Raw) -> DataFrame:
    own = _priced(raw, F.col("currency"), _ts("order_created_at"))
    return report(own.filter(F.col("currency").isin(*C.FOREIGN) & F.col("fx_currency").isNull() & _iso("order_created_at")), F.col("order_id"), "order_id", "currency", "order_created_at")


def ord_018(raw: Raw) -> DataFrame:
    own = raw["orders"].withColumn("_at", _ts("updated_at"))
    return report(states.reopened(own, ["order_id"], ["_at", "batch_order", "source_row_number"], "order_status", list(C.TERMINAL)), F.col("order_id"), "order_id", "previous", "order_status", "updated_at")


def ord_020(raw: Raw) -> DataFrame:
    own = _priced(raw, F.col("currency"), _ts("order_created_at")).filter(_iso("order_created_at") & (_dec("amount") > 0) & (_dec("coupon_discount") >= 0) & (_dec("coupon_discount") > F.col("_gross")))
    return report(own, F.col("order_id"), "order_id", "currency", "amount", "coupon_discount")


def _valued(raw: Raw) -> DataFrame:
    currency = F.when(F.col("currency") == "NTD", "TWD").otherwise(F.col("currency"))
    own = _priced(raw, currency, instant(F.col("order_created_at")))
    price = raw["products"].groupBy("product_id").agg(F.min(_dec("base_price_twd")).alias("_price"))
    return own.join(price, "product_id").withColumn("_total", (F.col("_price") * F.col("quantity").try_cast("int")).cast("decimal(36,4)"))


def ord_023(raw: Raw) -> DataFrame:
    gross = F.col("_gross").cast("decimal(36,12)")
    own = _valued(raw).filter((_dec("amount") > 0) & (F.col("_total") > 0) & ((gross * 2 < F.col("_total")) | (gross > F.col("_total") * 2)))
    return report(own, F.col("order_id"), "order_id", "product_id", "quantity", "currency", "amount")


def mem_008(raw: Raw) -> DataFrame:
    order = Window.partitionBy("member_id").orderBy(_date("extract_date").asc_nulls_last(), "source_row_number")
    columns = ["member_name", "member_level", "city", "birth_date"]
    own = raw["members"].withColumns({f"_{c}": F.lag(F.trim(c) == "").over(order) for c in columns})
    return report(own.filter(reduce(lambda a, b: a | b, (F.col(f"_{c}") != (F.trim(c) == "") for c in columns))), F.col("member_id"), "member_id", "extract_date")


def _real_births(raw: Raw) -> DataFrame:
    return raw["members"].filter((F.col("birth_date") != C.BIRTH_SENTINEL) & _date("birth_date").isNotNull())


def mem_009(raw: Raw) -> DataFrame:
    bad = states.conflicting(_real_births(raw).withColumn("_birth", _date("birth_date")), ["member_id"], ["_birth"])
    return report(raw["members"].join(bad, "member_id", "left_semi"), F.col("member_id"), "member_id", "birth_date", "extract_date")


def mem_010(raw: Raw) -> DataFrame:
    order = Window.partitionBy("member_id").orderBy(_date("extract_date").asc_nulls_last(), "source_row_number")
    own = raw["members"].withColumns({"prior_level": F.lag("member_level").over(order), "prior_city": F.lag("city").over(order), "_n": F.row_number().over(order)})
    changed = ~F.col("prior_level").eqNullSafe(F.col("member_level")) | ~F.col("prior_city").eqNullSafe(F.col("city"))
    return report(own.filter((F.col("_n") > 1) & changed), F.col("member_id"), "member_id", "prior_level", "member_level", "prior_city", "city")


def mem_011(raw: Raw) -> DataFrame:
    real = _real_births(raw).groupBy("member_id").agg(F.countDistinct(_date("birth_date")).alias("real_birth_dates"))
    own = raw["members"].filter(F.col("birth_date") == C.BIRTH_SENTINEL).join(real, "member_id", "left").fillna(0, ["real_birth_dates"])
    return report(own, F.col("member_id"), "member_id", "birth_date", "extract_date", "real_birth_dates")


def prod_006(raw: Raw) -> DataFrame:
    same = ["product_name", "product_type", "destination_country", "destination_city", "trip_days", "base_price_twd"]
    over = Window.partitionBy(*same)
    own = raw["products"].withColumn("_several", F.min("product_id").over(over) != F.max("product_id").over(over))
    return report(own.filter("_several"), F.col("product_id"), "product_id", "product_name")


def fx_004(raw: Raw) -> DataFrame:
    own = raw["fx_rates"].select("currency", _date("rate_date").alias("rate_date")).filter("rate_date is not null")
    key = F.concat_ws("|", F.col("missing_date").cast("string"), "currency")
    return scd2.gaps(own, "currency", "rate_date").select(key.alias("business_key"), F.concat_ws("|", "currency", F.col("missing_date").cast("string")).alias("sample_sort_key"), row_json("currency", "missing_date").alias("sample_json"))


DETECTORS: dict[str, Callable[[Raw], DataFrame]] = {
    "SRC-001": lambda raw: _across(raw, lambda c: _any([x.name for x in c.columns if x.required], lambda v: v.isNull() | (F.trim(v) == ""))),
    "SRC-002": lambda raw: _across(raw, lambda c: _any([x.name for x in c.columns if x.type == "string" or c.dataset != "members"], lambda v: v != F.trim(v))),
    "ORD-001": lambda raw: _repeated(raw, C.ORDERS, C.ORDERS.names),
    "ORD-002": lambda raw: _repeated(raw, C.ORDERS, ["order_id"]),
    "ORD-003": lambda raw: _differing(raw, C.ORDERS, ["order_id", "updated_at"], _ORDER_PAYLOAD),
    "ORD-004": ord_004,
    "ORD-005": ord_005,
    "ORD-015": lambda raw: _dangling(raw, "members", "member_id"),
    "ORD-016": lambda raw: _dangling(raw, "products", "product_id"),
    "ORD-017": ord_017,
    "ORD-018": ord_018,
    "ORD-020": ord_020,
    "ORD-023": ord_023,
    "MEM-001": lambda raw: _repeated(raw, C.MEMBERS, C.MEMBERS.names),
    "MEM-002": lambda raw: _repeated(raw, C.MEMBERS, ["member_id", "extract_date"]),
    "MEM-003": lambda raw: _differing(raw, C.MEMBERS, ["member_id", "extract_date"], _MEMBER_PAYLOAD),
    "MEM-008": mem_008,
    "MEM-009": mem_009,
    "MEM-010": mem_010,
    "MEM-011": mem_011,
    "PROD-001": lambda raw: _repeated(raw, C.PRODUCTS, C.PRODUCTS.names),
    "PROD-002": lambda raw: _repeated(raw, C.PRODUCTS, ["product_id"]),
    "PROD-006": prod_006,
    "FX-001": lambda raw: _repeated(raw, C.FX_RATES, ["rate_date", "currency"]),
    "FX-002": lambda raw: _differing(raw, C.FX_RATES, ["rate_date", "currency"], ["rate_to_twd"]),
    "FX-004": fx_004,
} | {k: (lambda raw, r=r: report(raw[r.dataset].filter(r.when()), _key(C.CONTRACTS[r.dataset]), *r.shown)) for k, r in ROW_RULES.items()}


class DetectorSchema(ValueError):
    """A detector's columns are not those that every report has."""


def run(raw: Raw, rule_id: str) -> DataFrame:
    """The report of one detector, whose columns are checked."""
    own = DETECTORS[rule_id](raw)
    if own.dtypes != [(c, "string") for c in REPORT]:
        raise DetectorSchema(f"{rule_id}: {own.dtypes}")
    return own


def _row_hits(raw: Raw, only: set[str]) -> list[DataFrame]:
    """All row rules of a dataset in one pass over it: (rule_id, report)."""
    out = []
    for dataset in sorted({r.dataset for k, r in ROW_RULES.items() if k in only}):
        of = {k: r for k, r in ROW_RULES.items() if r.dataset == dataset and k in only}
        key = _key(C.CONTRACTS[dataset])
        found = F.array(*(F.when(r.when(), F.struct(F.lit(k).alias("rule_id"), row_json(*dict.fromkeys([*r.shown, "source_file", "source_row_number"])).alias("sample_json"))) for k, r in of.items()))
        rows = report(raw[dataset].withColumn("_found", F.filter(found, lambda x: x.isNotNull())).filter(F.size("_found") > 0), key, found="_found")
        out.append(rows.select("business_key", "sample_sort_key", F.explode("found").alias("x")).select("business_key", "sample_sort_key", "x.sample_json", "x.rule_id"))
    return out


def summary(raw: Raw, only: list[str] | None = None) -> DataFrame:
    """(rule_id, row_count, key_count, finding, samples) of all detectors, in one job; samples are the first three by their sort key. Rules on one row share a scan."""
    wanted = set(only or DETECTORS)
    others = [run(raw, k).withColumn("rule_id", F.lit(k)) for k in sorted(wanted - set(ROW_RULES))]
    own = reduce(DataFrame.unionByName, [*_row_hits(raw, wanted), *others])
    every = own.sparkSession.createDataFrame([(k,) for k in sorted(only or DETECTORS)], "rule_id string")
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy("rule_id").orderBy("sample_sort_key", "sample_json"))).filter("_n <= 3")
    samples = first.groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "sample_json"))), lambda x: x["sample_json"]).alias("samples"))
    counts = own.groupBy("rule_id").agg(F.count("*").alias("row_count"), F.countDistinct("business_key").alias("key_count"))
    finding = F.when(F.col("row_count") == 0, "CONTROL_CHECK").when(F.col("rule_id").isin(*EXPECTED), "EXPECTED_CONDITION").otherwise("DATA_QUALITY_ISSUE")
    return every.join(counts, "rule_id", "left").join(samples, "rule_id", "left").fillna(0, ["row_count", "key_count"]).withColumn("finding", finding)


def invariant_breakdown(raw: Raw) -> DataFrame:
    return states.field_conflicts(raw["orders"], ["order_id"], _INVARIANT)


def birth_identity_breakdown(raw: Raw) -> DataFrame:
    """(real_birth_dates, members) of members by their number of real birth dates, from two up."""
    real = _real_births(raw).groupBy("member_id").agg(F.countDistinct(_date("birth_date")).alias("real_birth_dates"))
    return real.filter("real_birth_dates > 1").groupBy("real_birth_dates").agg(F.count("*").alias("members"))


def birth_semantics(raw: Raw) -> DataFrame:
    """Members with a sentinel, by whether a real date is known, one or several."""
    own = raw["members"].groupBy("member_id").agg(F.bool_or(F.col("birth_date") == C.BIRTH_SENTINEL).alias("has_sentinel"), F.countDistinct(F.when(F.col("birth_date") != C.BIRTH_SENTINEL, _date("birth_date"))).alias("n"))
    kind = F.when(F.col("n") == 0, "unknown").when(F.col("n") == 1, "restated").otherwise("ambiguous")
    return own.filter("has_sentinel").groupBy(kind.alias("semantics")).agg(F.count("*").alias("members"))


def duplicate_policy(raw: Raw) -> DataFrame:
    """Of groups of fully identical order rows: their number, rows and rows beyond the first."""
    groups = raw["orders"].groupBy(*C.ORDERS.names).agg(F.count("*").alias("n")).filter("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"))


def timestamp_formats(raw: Raw) -> DataFrame:
    """(field, format, rows) of the three time fields of orders."""
    long = raw["orders"].unpivot([], ["order_created_at", "departure_date", "updated_at"], "field", "value")
    kind = F.when(F.col("value").rlike(C.ISO_OFFSET), "iso_offset").when(F.col("value").rlike(C.NAIVE), "naive_slash").when(F.col("value").rlike(C.ISO_DATE), "iso_date").otherwise("other")
    return long.groupBy("field", kind.alias("format")).agg(F.count("*").alias("rows"))


def status_transitions(raw: Raw) -> DataFrame:
    return states.transitions(raw["orders"].withColumn("_at", _ts("updated_at")), ["order_id"], ["_at", "batch_order", "source_row_number"], "order_status")


def amount_ratios(raw: Raw) -> DataFrame:
    """Exact median, 1st and 99th percentile of gross over list price, by currency as given. The filter need not come before the division, so a total of zero must not fail there."""
    own = _valued(raw).filter((F.col("_total") > 0) & F.col("_gross").isNotNull()).withColumn("ratio", F.try_divide(F.col("_gross").cast("decimal(30,8)"), F.col("_total").cast("decimal(24,4)")).cast("decimal(24,8)"))
    return exact_quantiles(own, ["currency"], "ratio", {"p01": (1, 100), "p50": (1, 2), "p99": (99, 100)}, 8)


ANALYSES: dict[str, Callable[[Raw], DataFrame]] = {f.__name__: f for f in (invariant_breakdown, birth_identity_breakdown, birth_semantics, duplicate_policy, timestamp_formats, status_transitions, amount_ratios)}
