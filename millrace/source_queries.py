"""Queries of the warehouse itself over the driver's tables in the shape of the contracts, each beside SQL that gives the same rows.

The tables of a warehouse are made once for a session and folder, by the plans that the builder runs, and only those that a query needs.
Values are whole numbers, truth values or text, so that engines cannot differ in how they show them.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contracts as C
from . import source_shapes as shapes
from .operators import scd2
from .operators.rules import dispositions, entity_rules, quarantined
from .plans import curated, detectors, gates, staging, validation
from .queries import ORACLE_SQL, QUERIES, Query
from .sources import files

ORDERS, MEMBERS, PRODUCTS, RATES = ("raw_orders", "raw_members", "raw_products", "raw_fx_rates")
_BUILT: dict[tuple[str, str], Built] = {}
#: Raw rows of orders that meet in one share: what many of them need is made a share at a time, so that the shuffles on disk are those of one.
SHARE = 4_000_000
#: Plans over the orders, by the tables that they are made from.
OF_ORDERS: dict[str, Callable[[Mapping[str, DataFrame]], DataFrame]] = {
    "orders": lambda t: staging.stage_orders(t[ORDERS], t["fx_rates"]),
    "order_rows": lambda t: staging.order_rows(t[ORDERS], t["fx_rates"]),
    "fact_order": lambda t: curated.fact_order(t["orders"], t["entity_disposition/orders"], t["entity_rule/orders"], t["dim_member"], t["dim_product"]),
    "event_lineage": lambda t: curated.event_lineage(staging.order_events(t[ORDERS], t["fx_rates"])),
}


class Built(Mapping):
    """The tables of the warehouse of a folder, each made when it is first asked for, so that a query costs what its own tables cost.

    Raw and staged rows, lineages and facts are plans, of which a query computes the columns that it reads; what the gates say and
    the members' versions are written to the shared folder, as many others read them, the gates' tables for each dataset apart (table/dataset).
    """

    GATES = ("issue_hit", "entity_rule", "entity_disposition")

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.root, self.made, self.parts = spark, folder, "", {}, 0
        self.makers: dict[str, Callable[[], DataFrame]] = {
            "fx_rates": lambda: staging.stage_fx(self[RATES]), "products": lambda: staging.stage_products(self[PRODUCTS]), "members": lambda: staging.stage_members(self[MEMBERS]),
            "quarantine_row": lambda: quarantined(reduce(DataFrame.unionByName, (gates.entity_rows(self, d) for d in C.CONTRACTS)), self["entity_disposition"], self["issue_hit"], self["entity_rule"]),
            "dim_product": lambda: curated.dim_product(self["products"], self["entity_disposition/products"]),
            "dim_member": lambda: self.put("dim_member", curated.dim_member(self["members"], self["entity_disposition/members"])),
            "member_lineage": lambda: curated.member_lineage(self["members"], self["entity_disposition/members"], self["dim_member"]),
            "dim_date": lambda: scd2.calendar(*(self.dates(d) for d in curated.DATED)),
        }
        for name, plan in OF_ORDERS.items():
            self.makers[name] = lambda plan=plan: plan(self)
        for d in C.CONTRACTS:
            self.makers[f"raw_{d}"] = lambda d=d: shapes.raw(spark, folder)[d]
            self.makers[f"issue_hit/{d}"] = lambda d=d: self.put(f"issue_hit/{d}", (gates.found(t, d) for t in self.of(d)))
            self.makers[f"entity_rule/{d}"] = lambda d=d: self.put(f"entity_rule/{d}", (entity_rules(t[f"issue_hit/{d}"]) for t in self.of(d)))
            self.makers[f"entity_disposition/{d}"] = lambda d=d: self.put(f"entity_disposition/{d}", (dispositions(gates.entity_rows(t, d).select("entity_type", "business_key"), t[f"entity_rule/{d}"]) for t in self.of(d)))
        for name in self.GATES:
            self.makers[name] = lambda name=name: reduce(DataFrame.unionByName, (self[f"{name}/{d}"] for d in C.CONTRACTS))

    def put(self, name: str, df: DataFrame | Iterable[DataFrame]) -> DataFrame:
        """Writes a table, whole or share after share, and reads it back; the shuffles that made a share go with its plan. What is written again replaces its first attempt."""
        self.root = self.root or shapes.scratch(self.spark, "sources")
        frames, paths = iter([df] if isinstance(df, DataFrame) else df), []
        del df
        for own in frames:
            paths.append(f"{self.root}/{name}/{len(paths)}")
            own.write.mode("overwrite").parquet(paths[-1])
            schema = own.schema
            del own
            self.sweep()
        return self.spark.read.schema(schema).parquet(*paths)

    def sweep(self) -> None:
        """Shuffles of plans that nothing holds any more go now, not when the driver happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def shares(self) -> list[Mapping[str, DataFrame]]:
        """The tables by share of the orders; the whole, if it is no more than one share."""
        if not self.parts:
            self.parts = 1 + self[ORDERS].count() // SHARE
        return [self] if self.parts == 1 else [Share(self, i, self.parts) for i in range(self.parts)]

    def of(self, dataset: str) -> list[Mapping[str, DataFrame]]:
        """The tables by share, if the dataset has shares."""
        return self.shares() if dataset == "orders" else [self]

    def dates(self, dataset: str) -> DataFrame:
        """The accepted dates of a dataset; of one in shares the first and last of each, which is all that a calendar asks for."""
        frames = (curated.accepted_dates(t, t[f"entity_disposition/{dataset}"], dataset) for t in self.of(dataset))
        if len(self.of(dataset)) == 1:
            return next(frames)
        ends = []
        for own in frames:
            ends += own.agg(F.min("full_date"), F.max("full_date")).first()
            del own
            self.sweep()
        return self.spark.createDataFrame([(x,) for x in ends], "full_date date")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __contains__(self, name: object) -> bool:
        return name in self.makers

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)

    def keep(self, *names: str) -> Built:
        """Writes plans that a query reads many times."""
        for name in names:
            if not self.made.get(f"kept {name}"):
                self.made[name] = self.made[f"kept {name}"] = self.put(name, self[name])
        return self


class Share(Mapping):
    """Tables of which those of the orders have the orders of one share, told by a hash of the order's number, and the others are whole."""

    KEYS = {ORDERS: "order_id"} | dict.fromkeys((f"{name}/orders" for name in Built.GATES), "business_key")

    def __init__(self, tables: Built, i: int, n: int) -> None:
        self.tables, self.i, self.n = tables, i, n

    def __getitem__(self, name: str) -> DataFrame:
        if name in OF_ORDERS:
            return OF_ORDERS[name](self)
        own = self.tables[name]
        return own.filter(F.pmod(F.xxhash64(F.trim(self.KEYS[name])), F.lit(self.n)) == self.i) if name in self.KEYS else own

    def __contains__(self, name: object) -> bool:
        return name in self.tables

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)


def built(spark: SparkSession, folder: str) -> Built:
    """The tables of the warehouse of a folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _BUILT:
        _BUILT[key] = Built(spark, folder)
    return _BUILT[key]


def raw(spark: SparkSession, folder: str, keep: bool = False) -> detectors.Raw:
    """The raw tables by dataset; written, if a query reads them often."""
    t = built(spark, folder).keep(*(f"raw_{k}" for k in C.CONTRACTS)) if keep else built(spark, folder)
    return {k: t[f"raw_{k}"] for k in C.CONTRACTS}


def register(name: str, run: Query, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = run, sql


def shown(df: DataFrame) -> DataFrame:
    """Decimals, dates and times as text."""
    return df.select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t == "timestamp" else F.col(c).cast("string").alias(c) if t.startswith("decimal") or t == "date" else F.col(c) for c, t in df.dtypes))


# SQL of the raw rows and of casts -----------------------------------------------------------------

RAW = {f"raw_{k}": shapes.sql(k) for k in C.CONTRACTS}


def with_(ctes: dict[str, str], body: str) -> str:
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in ctes.items()) + " " + body


def inside(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def iso(c: str) -> str:
    return f"regexp_matches({c}, '{C.ISO_OFFSET}')"


def ts(c: str) -> str:
    return f"CASE WHEN {iso(c)} THEN make_timestamp(epoch_us(CAST({c} AS TIMESTAMPTZ))) END"


def instant(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{C.NAIVE}') THEN strptime({c}, '%Y/%m/%d %H:%M:%S') - INTERVAL 8 HOUR ELSE {ts(c)} END"


def business(t: str) -> str:
    return f"CAST(({t}) + INTERVAL 8 HOUR AS DATE)"


def day(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{C.ISO_DATE}') THEN TRY_CAST({c} AS DATE) END"


def number(c: str, kind: str = "DECIMAL(24,4)") -> str:
    return f"TRY_CAST({c} AS {kind})"


# Detectors ------------------------------------------------------------------------------------------


def report(source: str, where: str, key: str, *columns: str) -> str:
    pairs = ", ".join(f"'{c}', {c}" for c in dict.fromkeys((*columns, "source_file", "source_row_number")))
    return f"SELECT {key} AS business_key, concat_ws('|', {key}, source_file, lpad(CAST(source_row_number AS VARCHAR), 12, '0')) AS sample_sort_key, CAST(json_object({pairs}) AS VARCHAR) AS sample_json FROM {source} AS r WHERE {where}"


_CREATED, _UPDATED = ts("order_created_at"), ts("updated_at")
_FX_KEY = "concat_ws('|', rate_date, currency)"
_KEYS = {"orders": "order_id", "members": "member_id", "products": "product_id", "fx_rates": _FX_KEY}
_RATE = f"(SELECT currency AS fx_currency, {day('rate_date')} AS fx_date, min({number('rate_to_twd', 'DECIMAL(24,8)')}) AS fx_rate FROM raw_fx_rates GROUP BY 1, 2)"


def _across(test) -> str:
    parts = (report(f"(SELECT *, '{n}' AS dataset FROM raw_{n})", test(c), _KEYS[n], "dataset") for n, c in C.CONTRACTS.items())
    return " UNION ALL ".join(parts)


def _some(columns, test) -> str:
    return " OR ".join(test(c) for c in columns)


def _repeated(contract: C.Contract, columns: list[str]) -> str:
    source = f"(SELECT *, count(*) OVER (PARTITION BY {', '.join(columns)}) AS copies FROM raw_{contract.dataset})"
    return report(source, "copies > 1", _KEYS[contract.dataset], *contract.key, "copies")


def _differing(contract: C.Contract, key: list[str], payload: list[str]) -> str:
    group = ", ".join(key)
    source = f"(SELECT * FROM raw_{contract.dataset} JOIN (SELECT {group} FROM raw_{contract.dataset} GROUP BY {group} HAVING count(DISTINCT concat_ws('~', {', '.join(payload)})) > 1) USING ({group}))"
    return report(source, "true", _KEYS[contract.dataset], *contract.key)


def _priced(currency: str, created: str) -> str:
    rate = "CASE WHEN cur = 'TWD' THEN CAST(1 AS DECIMAL(24,8)) ELSE fx_rate END"
    return f"""(SELECT *, CAST({number('amount', 'DECIMAL(20,4)')} * CAST({rate} AS DECIMAL(17,8)) AS DECIMAL(38,12)) AS gross FROM (SELECT *, {currency} AS cur, {business(created)} AS bd FROM raw_orders) o LEFT JOIN {_RATE} x ON fx_currency = cur AND fx_date = bd)"""


_VALUED = f"(SELECT *, CAST(price * {number('quantity', 'INTEGER')} AS DECIMAL(36,4)) AS total FROM {_priced("CASE WHEN currency = 'NTD' THEN 'TWD' ELSE currency END", instant('order_created_at'))} v JOIN (SELECT product_id, min({number('base_price_twd')}) AS price FROM raw_products GROUP BY 1) USING (product_id))"
_LOW, _HIGH = C.WINDOWS["orders_base.csv"][1:]
_WRONG_DAY = " OR ".join(f"(source_file = '{f}' AND {business(_CREATED)} <> DATE '{high}')" for f, (n, _, high) in C.WINDOWS.items() if n)
_REAL = f"(birth_date <> '{C.BIRTH_SENTINEL}' AND ({day('birth_date')}) IS NOT NULL)"
_BLANKS = ["member_name", "member_level", "city", "birth_date"]
_SNAPSHOT_ORDER = f"PARTITION BY member_id ORDER BY {day('extract_date')} NULLS LAST, source_row_number"
_TERMINAL = inside(C.TERMINAL)

DETECTOR_SQL: dict[str, str] = {
    "SRC-001": _across(lambda c: _some([x.name for x in c.columns if x.required], lambda v: f"trim({v}) = ''")),
    "SRC-002": _across(lambda c: _some([x.name for x in c.columns if x.type == "string" or c.dataset != "members"], lambda v: f"{v} <> trim({v})")),
    "ORD-001": _repeated(C.ORDERS, C.ORDERS.names),
    "ORD-002": _repeated(C.ORDERS, ["order_id"]),
    "ORD-003": _differing(C.ORDERS, ["order_id", "updated_at"], [c for c in C.ORDERS.names if c not in ("order_id", "updated_at")]),
    "ORD-004": report("(SELECT * FROM raw_orders JOIN (SELECT order_id FROM raw_orders GROUP BY 1 HAVING " + " OR ".join(f"count(DISTINCT {c}) > 1" for c in C.ORDERS.names if c not in ("order_id", "order_status", "updated_at")) + ") USING (order_id))", "true", "order_id", "order_id", "member_id", "product_id", "currency", "order_created_at"),
    "ORD-005": report(f"(SELECT *, count(*) OVER (PARTITION BY order_id) AS latest_candidates FROM (SELECT *, {_UPDATED} AS u FROM raw_orders) QUALIFY true)".replace("QUALIFY true", "JOIN (SELECT order_id, max(" + _UPDATED + ") AS top FROM raw_orders GROUP BY 1) USING (order_id) WHERE u = top"), "latest_candidates > 1", "order_id", "order_id", "updated_at", "latest_candidates"),
    "ORD-006": report("raw_orders", f"order_status NOT IN {inside(C.STATUSES)}", "order_id", "order_id", "order_status"),
    "ORD-007": report("raw_orders", f"channel NOT IN {inside(C.CHANNELS)}", "order_id", "order_id", "channel"),
    "ORD-008": report("raw_orders", f"coalesce({number('quantity', 'INTEGER')} <= 0, true)", "order_id", "order_id", "quantity"),
    "ORD-009": report("raw_orders", f"currency NOT IN {inside(C.CURRENCIES)}", "order_id", "order_id", "currency"),
    "ORD-010": report("raw_orders", f"coalesce({number('amount')} <= 0, true)", "order_id", "order_id", "amount"),
    "ORD-011": report("raw_orders", f"coalesce({number('coupon_discount')} < 0, true)", "order_id", "order_id", "coupon_discount"),
    "ORD-012": report("raw_orders", f"NOT {iso('order_created_at')} OR NOT {iso('updated_at')}", "order_id", "order_id", "order_created_at", "departure_date", "updated_at"),
    "ORD-013": report("raw_orders", f"({_UPDATED}) < ({_CREATED})", "order_id", "order_id", "order_created_at", "updated_at"),
    "ORD-014": report("raw_orders", f"({day('departure_date')}) < {business(_CREATED)}", "order_id", "order_id", "order_created_at", "departure_date"),
    "ORD-015": report("raw_orders", "member_id NOT IN (SELECT member_id FROM raw_members)", "order_id", "order_id", "member_id"),
    "ORD-016": report("raw_orders", "product_id NOT IN (SELECT product_id FROM raw_products)", "order_id", "order_id", "product_id"),
    "ORD-017": report(_priced("currency", _CREATED), f"currency IN {inside(C.FOREIGN)} AND fx_currency IS NULL AND {iso('order_created_at')}", "order_id", "order_id", "currency", "order_created_at"),
    "ORD-018": report(f"(SELECT *, lag(order_status) OVER (PARTITION BY order_id ORDER BY {_UPDATED} NULLS LAST, batch_order, source_row_number) AS previous FROM raw_orders)", f"previous IN {_TERMINAL} AND order_status <> previous", "order_id", "order_id", "previous", "order_status", "updated_at"),
    "ORD-019": report("raw_orders", f"NOT regexp_matches(order_id, '{C.ORDER_ID}') OR NOT regexp_matches(member_id, '{C.MEMBER_ID}') OR NOT regexp_matches(product_id, '{C.PRODUCT_ID}')", "order_id", "order_id", "member_id", "product_id"),
    "ORD-020": report(_priced("currency", _CREATED), f"{iso('order_created_at')} AND {number('amount')} > 0 AND {number('coupon_discount')} >= 0 AND {number('coupon_discount')} > gross", "order_id", "order_id", "currency", "amount", "coupon_discount"),
    "ORD-021": report("raw_orders", f"source_file = 'orders_base.csv' AND {business(_CREATED)} NOT BETWEEN DATE '{_LOW}' AND DATE '{_HIGH}'", "order_id", "order_id", "order_created_at"),
    "ORD-022": report("raw_orders", _WRONG_DAY, "order_id", "order_id", "order_created_at"),
    "ORD-023": report(_VALUED, f"{number('amount')} > 0 AND total > 0 AND (CAST(gross AS DECIMAL(36,12)) * 2 < total OR CAST(gross AS DECIMAL(36,12)) > total * 2)", "order_id", "order_id", "product_id", "quantity", "currency", "amount"),
    "ORD-024": report("raw_orders", f"({day('departure_date')}) IS NULL", "order_id", "order_id", "departure_date"),
    "MEM-001": _repeated(C.MEMBERS, C.MEMBERS.names),
    "MEM-002": _repeated(C.MEMBERS, ["member_id", "extract_date"]),
    "MEM-003": _differing(C.MEMBERS, ["member_id", "extract_date"], ["member_name", "member_level", "city", "birth_date", "register_date"]),
    "MEM-004": report("raw_members", f"NOT regexp_matches(member_id, '{C.MEMBER_ID}')", "member_id", "member_id"),
    "MEM-005": report("raw_members", f"member_level NOT IN {inside(C.LEVELS)}", "member_id", "member_id", "member_level"),
    "MEM-006": report("raw_members", f"({day('register_date')}) IS NULL OR ({day('extract_date')}) IS NULL OR (trim(birth_date) <> '' AND ({day('birth_date')}) IS NULL)", "member_id", "member_id", "birth_date", "register_date", "extract_date"),
    "MEM-007": report("raw_members", f"({day('register_date')}) > ({day('extract_date')}) OR (birth_date <> '{C.BIRTH_SENTINEL}' AND ({day('birth_date')}) > ({day('register_date')}))", "member_id", "member_id", "birth_date", "register_date", "extract_date"),
    "MEM-008": report("(SELECT *, " + ", ".join(f"lag(trim({c}) = '') OVER ({_SNAPSHOT_ORDER}) AS was_{c}" for c in _BLANKS) + " FROM raw_members)", _some(_BLANKS, lambda c: f"was_{c} <> (trim({c}) = '')"), "member_id", "member_id", "extract_date"),
    "MEM-009": report(f"(SELECT * FROM raw_members JOIN (SELECT member_id FROM raw_members WHERE {_REAL} GROUP BY 1 HAVING count(DISTINCT birth_date) > 1) USING (member_id))", "true", "member_id", "member_id", "birth_date", "extract_date"),
    "MEM-010": report(f"(SELECT *, lag(member_level) OVER ({_SNAPSHOT_ORDER}) AS prior_level, lag(city) OVER ({_SNAPSHOT_ORDER}) AS prior_city, row_number() OVER ({_SNAPSHOT_ORDER}) AS place FROM raw_members)", "place > 1 AND (prior_level IS DISTINCT FROM member_level OR prior_city IS DISTINCT FROM city)", "member_id", "member_id", "prior_level", "member_level", "prior_city", "city"),
    "MEM-011": report(f"(SELECT *, coalesce(n, 0) AS real_birth_dates FROM raw_members LEFT JOIN (SELECT member_id, count(DISTINCT birth_date) AS n FROM raw_members WHERE {_REAL} GROUP BY 1) USING (member_id))", f"birth_date = '{C.BIRTH_SENTINEL}'", "member_id", "member_id", "birth_date", "extract_date", "real_birth_dates"),
    "PROD-001": _repeated(C.PRODUCTS, C.PRODUCTS.names),
    "PROD-002": _repeated(C.PRODUCTS, ["product_id"]),
    "PROD-003": report("raw_products", f"NOT regexp_matches(product_id, '{C.PRODUCT_ID}')", "product_id", "product_id"),
    "PROD-004": report("raw_products", _some(["product_name", "product_type", "destination_country", "destination_city"], lambda c: f"trim({c}) = ''"), "product_id", "product_id", "product_name"),
    "PROD-005": report("raw_products", f"coalesce({number('trip_days', 'INTEGER')} <= 0, true) OR coalesce({number('base_price_twd')} <= 0, true) OR is_active NOT IN ('Y', 'N')", "product_id", "product_id", "trip_days", "base_price_twd", "is_active"),
    "PROD-006": report("(SELECT *, count(DISTINCT product_id) OVER (PARTITION BY product_name, product_type, destination_country, destination_city, trip_days, base_price_twd) AS ids FROM raw_products)", "ids > 1", "product_id", "product_id", "product_name"),
    "FX-001": _repeated(C.FX_RATES, ["rate_date", "currency"]),
    "FX-002": _differing(C.FX_RATES, ["rate_date", "currency"], ["rate_to_twd"]),
    "FX-003": report("raw_fx_rates", f"({day('rate_date')}) IS NULL OR currency NOT IN {inside(C.FOREIGN)} OR coalesce({number('rate_to_twd', 'DECIMAL(24,8)')} <= 0, true)", _FX_KEY, "rate_date", "currency", "rate_to_twd"),
    "FX-004": f"""SELECT concat_ws('|', CAST(d AS VARCHAR), currency) AS business_key, concat_ws('|', currency, CAST(d AS VARCHAR)) AS sample_sort_key, CAST(json_object('currency', currency, 'missing_date', CAST(d AS VARCHAR)) AS VARCHAR) AS sample_json
 FROM (SELECT currency, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT currency, min({day('rate_date')}) AS a, max({day('rate_date')}) AS b FROM raw_fx_rates GROUP BY 1))
 WHERE (currency, d) NOT IN (SELECT (currency, {day('rate_date')}) FROM raw_fx_rates WHERE ({day('rate_date')}) IS NOT NULL)""",
}

for _rule, _sql in DETECTOR_SQL.items():
    register(f"detector_{_rule.lower().replace('-', '_')}", lambda spark, d, r=_rule: detectors.run(raw(spark, d), r), with_(RAW, _sql))

_FINDING = f"CASE WHEN n IS NULL THEN 'CONTROL_CHECK' WHEN rule_id IN {inside(tuple(sorted(detectors.EXPECTED)))} THEN 'EXPECTED_CONDITION' ELSE 'DATA_QUALITY_ISSUE' END"
_ALL = " UNION ALL ".join(f"SELECT '{r}' AS rule_id, business_key, sample_sort_key, sample_json FROM ({q})" for r, q in DETECTOR_SQL.items())
register(
    "detector_summary",
    lambda spark, d: detectors.summary(raw(spark, d, keep=True)).withColumn("samples", F.concat_ws("\n", F.coalesce("samples", F.array().cast("array<string>")))),
    with_(RAW | {"found": _ALL, "rules": " UNION ALL ".join(f"SELECT '{r}' AS rule_id" for r in DETECTOR_SQL)}, f"""SELECT rule_id, coalesce(n, 0) AS row_count, coalesce(k, 0) AS key_count, {_FINDING} AS finding, coalesce(s, '') AS samples FROM rules
 LEFT JOIN (SELECT rule_id, count(*) AS n, count(DISTINCT business_key) AS k FROM found GROUP BY 1) USING (rule_id)
 LEFT JOIN (SELECT rule_id, string_agg(sample_json, chr(10) ORDER BY place) AS s FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY sample_sort_key, sample_json) AS place FROM found) WHERE place <= 3 GROUP BY 1) USING (rule_id)"""),
)

_INVARIANT = [c for c in C.ORDERS.names if c not in ("order_id", "order_status", "updated_at")]
_RATIO = "CAST((gross / total) AS DECIMAL(24,8))"
ANALYSIS_SQL = {
    "invariant_breakdown": " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE n > 1) AS conflicting_keys FROM (SELECT count(DISTINCT {c}) AS n FROM raw_orders GROUP BY order_id)" for c in _INVARIANT),
    "birth_identity_breakdown": f"SELECT n AS real_birth_dates, count(*) AS members FROM (SELECT count(DISTINCT birth_date) AS n FROM raw_members WHERE {_REAL} GROUP BY member_id) WHERE n > 1 GROUP BY 1",
    "birth_semantics": f"SELECT CASE n WHEN 0 THEN 'unknown' WHEN 1 THEN 'restated' ELSE 'ambiguous' END AS semantics, count(*) AS members FROM (SELECT bool_or(birth_date = '{C.BIRTH_SENTINEL}') AS s, count(DISTINCT CASE WHEN {_REAL} THEN birth_date END) AS n FROM raw_members GROUP BY member_id) WHERE s GROUP BY 1",
    "duplicate_policy": f"SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM (SELECT count(*) AS n FROM raw_orders GROUP BY {', '.join(C.ORDERS.names)} HAVING count(*) > 1)",
    "timestamp_formats": " UNION ALL ".join(f"SELECT '{c}' AS field, CASE WHEN {iso(c)} THEN 'iso_offset' WHEN regexp_matches({c}, '{C.NAIVE}') THEN 'naive_slash' WHEN regexp_matches({c}, '{C.ISO_DATE}') THEN 'iso_date' ELSE 'other' END AS format, count(*) AS rows FROM raw_orders GROUP BY 1, 2" for c in ("order_created_at", "departure_date", "updated_at")),
    "status_transitions": f"SELECT previous AS from_state, order_status AS to_state, count(*) AS transitions FROM (SELECT *, lag(order_status) OVER (PARTITION BY order_id ORDER BY {_UPDATED} NULLS LAST, batch_order, source_row_number) AS previous FROM raw_orders) WHERE previous IS NOT NULL GROUP BY 1, 2",
}
for _name, _sql in ANALYSIS_SQL.items():
    register(f"analysis_{_name}", lambda spark, d, n=_name: shown(detectors.ANALYSES[n](raw(spark, d))), with_(RAW, _sql))
QUERIES["analysis_amount_ratios"] = lambda spark, d: shown(detectors.ANALYSES["amount_ratios"](raw(spark, d)))  # the ratio's digits depend on the engine's decimal division

# Staging --------------------------------------------------------------------------------------------

_LINE = "source_file, source_row_number, batch_order, row_hash, source_row_uid"


def quoted(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'null' ELSE '\"' || {c} || '\"' END"


def plain(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), 'null')"


def document(**fields: str) -> str:
    """The SHA-256 of a JSON object, built as text."""
    return "sha256('{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in fields.items()) + " || '}')"


def _utc(t: str) -> str:
    return quoted(f"(strftime({t}, '%Y-%m-%d %H:%M:%S') || '+00')")


_SHARED = {c: quoted(c) for c in ("member_id", "product_id", "channel")} | {"quantity": plain("quantity"), "currency": quoted("currency"), "amount": plain("amount"), "coupon_discount": plain("coupon_discount_twd"), "order_created_at": _utc("order_created_at"), "departure_date": quoted("CAST(departure_date AS VARCHAR)")}
_EVENT = document(schema_version="'\"order-event-v1\"'", order_id=quoted("order_id"), order_status=quoted("order_status"), updated_at=_utc("updated_at"), **_SHARED)
_PAYLOAD = document(schema_version="'\"member-payload-v1\"'", member_name=quoted("member_name"), member_level=quoted("member_level"), city=quoted("city"), birth_date=quoted("coalesce(CAST(canonical_birth_date AS VARCHAR), '<NULL>')"), register_date=quoted("coalesce(CAST(register_date AS VARCHAR), '<NULL>')"))
STAGED = {
    "fx_rates": f"SELECT {day('rate_date')} AS rate_date, trim(currency) AS currency, {number('rate_to_twd', 'DECIMAL(24,8)')} AS rate_to_twd, {_LINE} FROM raw_fx_rates",
    "products": f"SELECT {', '.join(f'trim({c}) AS {c}' for c in ('product_id', 'product_name', 'product_type', 'destination_country', 'destination_city', 'is_active'))}, {number('trip_days', 'INTEGER')} AS trip_days, {number('base_price_twd')} AS base_price_twd, {_LINE} FROM raw_products",
    "members": f"""SELECT *, count(*) OVER (PARTITION BY member_id, extract_date, snapshot_payload_hash) AS identical_snapshot_count, source_row_uid = min(source_row_uid) OVER (PARTITION BY member_id, extract_date, snapshot_payload_hash) AS is_canonical_snapshot FROM (
 SELECT *, min(snapshot_payload_hash) OVER (PARTITION BY member_id, extract_date) <> max(snapshot_payload_hash) OVER (PARTITION BY member_id, extract_date) AS same_day_conflict FROM (
 SELECT *, has_birth_date_sentinel AND canonical_birth_date IS NOT NULL AS birth_date_restatement, {_PAYLOAD} AS snapshot_payload_hash, {document(schema_version="'\"member-state-v1\"'", member_level=quoted('member_level'), city=quoted('city'))} AS version_hash FROM (
 SELECT *, CASE WHEN low = high THEN low END AS canonical_birth_date, coalesce(low <> high, false) AS birth_date_identity_ambiguous, low IS NULL AS birth_date_unknown, bool_or(birth_date_sentinel) OVER (PARTITION BY member_id) AS has_birth_date_sentinel FROM (
 SELECT *, min(row_birth_date) OVER (PARTITION BY member_id) AS low, max(row_birth_date) OVER (PARTITION BY member_id) AS high FROM (
 SELECT trim(member_id) AS member_id, member_name, trim(member_level) AS member_level, trim(city) AS city, birth_date AS raw_birth_date, CASE WHEN birth_date <> '{C.BIRTH_SENTINEL}' THEN {day('birth_date')} END AS row_birth_date, birth_date = '{C.BIRTH_SENTINEL}' AS birth_date_sentinel, {day('register_date')} AS register_date, {day('extract_date')} AS extract_date, {_LINE} FROM raw_members)))))""",
    "orders": f"""SELECT *, count(*) OVER (PARTITION BY canonical_event_hash) AS duplicate_source_row_count, source_row_uid = min(source_row_uid) OVER (PARTITION BY canonical_event_hash) AS is_canonical_event FROM (
 SELECT *, {_EVENT} AS canonical_event_hash, {document(schema_version="'\"order-invariant-v1\"'", **_SHARED)} AS invariant_hash FROM (
 SELECT *, CAST(gross_amount_twd_exact AS DECIMAL(36,12)) - coupon_discount_twd AS net_amount_twd_exact FROM (
 SELECT *, CAST(CAST(amount AS DECIMAL(20,4)) * CAST(rate_to_twd AS DECIMAL(17,8)) AS DECIMAL(38,12)) AS gross_amount_twd_exact FROM (
 SELECT t.*, CASE WHEN t.currency = 'TWD' THEN CAST(1 AS DECIMAL(24,8)) ELSE rate END AS rate_to_twd FROM (
 SELECT *, {business('order_created_at')} AS order_business_date, {business('updated_at')} AS updated_business_date, currency <> trim(raw_currency) AS currency_normalized FROM (
 SELECT {', '.join(f'trim({c}) AS {c}' for c in ('order_id', 'member_id', 'product_id', 'channel', 'order_status'))}, {number('quantity', 'INTEGER')} AS quantity, currency AS raw_currency, CASE trim(currency) WHEN 'NTD' THEN 'TWD' ELSE trim(currency) END AS currency, {number('amount')} AS amount, {number('coupon_discount')} AS coupon_discount_twd, order_created_at AS raw_order_created_at,
 {instant('order_created_at')} AS order_created_at, regexp_matches(order_created_at, '{C.NAIVE}') AS timezone_assumed, {day('departure_date')} AS departure_date, {_UPDATED} AS updated_at, {_LINE} FROM raw_orders)) t
 LEFT JOIN (SELECT rate_date, currency, CASE WHEN count(*) = 1 THEN min(rate_to_twd) END AS rate FROM fx_rates GROUP BY 1, 2) f ON f.rate_date = t.order_business_date AND f.currency = t.currency))))""",
}
for _name, _sql in STAGED.items():
    STAGED[_name] = _sql.replace("SELECT *, CASE WHEN low = high", "SELECT * EXCLUDE (low, high), CASE WHEN low = high")
CHAIN = RAW | STAGED


def texts(name: str, columns: dict[str, str]) -> str:
    """A table with decimals, dates and times as text, by the kinds of its columns."""
    show = {"date": "CAST({c} AS VARCHAR)", "timestamp": "strftime({c}, '%Y-%m-%d %H:%M:%S')"}
    return "SELECT " + ", ".join((show.get(t) or ("CAST({c} AS VARCHAR)" if t.startswith("decimal") else "{c}")).format(c=c) + f" AS {c}" for c, t in columns.items()) + f" FROM {name}"


_KINDS = {
    "fx_rates": {"rate_date": "date", "currency": "", "rate_to_twd": "decimal"},
    "products": {"product_id": "", "product_name": "", "product_type": "", "destination_country": "", "destination_city": "", "is_active": "", "trip_days": "", "base_price_twd": "decimal"},
    "members": {"member_id": "", "member_name": "", "member_level": "", "city": "", "raw_birth_date": "", "row_birth_date": "date", "birth_date_sentinel": "", "register_date": "date", "extract_date": "date", "canonical_birth_date": "date", "birth_date_identity_ambiguous": "", "birth_date_unknown": "", "has_birth_date_sentinel": "", "birth_date_restatement": "", "snapshot_payload_hash": "", "version_hash": "", "same_day_conflict": "", "identical_snapshot_count": "", "is_canonical_snapshot": ""},
    "orders": {"order_id": "", "member_id": "", "product_id": "", "channel": "", "order_status": "", "quantity": "", "raw_currency": "", "currency": "", "amount": "decimal", "coupon_discount_twd": "decimal", "raw_order_created_at": "", "order_created_at": "timestamp", "timezone_assumed": "", "departure_date": "date", "updated_at": "timestamp", "order_business_date": "date", "updated_business_date": "date", "currency_normalized": "", "rate_to_twd": "decimal", "gross_amount_twd_exact": "decimal", "net_amount_twd_exact": "decimal", "canonical_event_hash": "", "invariant_hash": "", "duplicate_source_row_count": "", "is_canonical_event": ""},
}
_LINEAGE_KINDS = {"source_file": "", "source_row_number": "", "source_row_uid": "", "row_hash": ""}


def _table(name: str, kinds: dict[str, str], ctes: dict[str, str], label: str = "") -> None:
    register(label or name, lambda spark, d: shown(built(spark, d)[name].select(*kinds)), with_(ctes, texts(name, kinds)))


for _name, _columns in _KINDS.items():
    _table(_name, _columns | _LINEAGE_KINDS, CHAIN, f"staging_{_name}")

# Gates ----------------------------------------------------------------------------------------------

_OF = "PARTITION BY order_id"
CHAIN |= {
    "marked": f"""SELECT o.*, mk.member_id IS NOT NULL AS member_known, price, price_low, product_known, count(*) FILTER (WHERE is_canonical_event AND updated_at = latest) OVER ({_OF}) > 1 AS latest_tie FROM (
 SELECT *, min(invariant_hash) FILTER (WHERE is_canonical_event) OVER ({_OF}) <> max(invariant_hash) FILTER (WHERE is_canonical_event) OVER ({_OF}) AS invariant_conflict,
  updated_at IS NOT NULL AND min(canonical_event_hash) FILTER (WHERE is_canonical_event) OVER ({_OF}, updated_at) <> max(canonical_event_hash) FILTER (WHERE is_canonical_event) OVER ({_OF}, updated_at) AS same_time_conflict,
  max(updated_at) FILTER (WHERE is_canonical_event) OVER ({_OF}) AS latest,
  CASE WHEN is_canonical_event THEN lag(order_status) OVER ({_OF}, is_canonical_event ORDER BY updated_at NULLS LAST, canonical_event_hash) END AS prior_status,
  max(CASE WHEN is_canonical_event THEN updated_at END) OVER ({_OF} ORDER BY batch_order RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known_time FROM orders) o
 LEFT JOIN (SELECT DISTINCT member_id FROM members) mk USING (member_id) LEFT JOIN (SELECT product_id, max(base_price_twd) AS price, min(base_price_twd) AS price_low, true AS product_known FROM products GROUP BY 1) pk USING (product_id)""",
    "products_marked": "SELECT *, count(*) OVER (PARTITION BY product_id) AS copies FROM products",
    "fx_marked": "SELECT *, count(*) OVER (PARTITION BY rate_date, currency) AS copies FROM fx_rates",
}
_WINDOW = " OR ".join(f"(source_file = '{f}' AND batch_order = {n} AND (order_business_date IS NULL OR order_business_date NOT BETWEEN DATE '{a}' AND DATE '{b}'))" for f, (n, a, b) in C.WINDOWS.items())
_GROSS = "CAST(gross_amount_twd_exact AS DECIMAL(36,12))"
_ID = lambda c, p: f"coalesce(NOT regexp_matches({c}, '{p}'), true)"
_NOT_IN = lambda c, d: f"coalesce({c} NOT IN {inside(d)}, true)"
_SNAPSHOT_KEY, _PRODUCT_KEY, _RATE_KEY = "member_id || '|' || coalesce(CAST(extract_date AS VARCHAR), '<NULL>')", "coalesce(product_id, '<NULL>')", "coalesce(CAST(rate_date AS VARCHAR), '<NULL>') || '|' || coalesce(currency, '<NULL>')"
_GRAINS = {"o": ("marked", "orders", "order", "order_id"), "s": ("members", "members", "member_snapshot", _SNAPSHOT_KEY), "m": ("members", "members", "member", "member_id"), "p": ("products_marked", "products", "product", _PRODUCT_KEY), "f": ("fx_marked", "fx_rates", "fx_rate", _RATE_KEY)}
#: Of every gate its table, what it does to an entity, and its condition.
GATE_SQL: dict[str, tuple[str, str, str]] = {
    "ORD-001": ("o", "NORMALIZE", "duplicate_source_row_count > 1"),
    "ORD-003": ("o", "QUARANTINE", "same_time_conflict"),
    "ORD-004": ("o", "QUARANTINE", "invariant_conflict"),
    "ORD-005": ("o", "QUARANTINE", "latest_tie"),
    "ORD-006": ("o", "QUARANTINE", _NOT_IN("order_status", C.STATUSES)),
    "ORD-007": ("o", "QUARANTINE", _NOT_IN("channel", C.CHANNELS)),
    "ORD-008": ("o", "QUARANTINE", "coalesce(quantity <= 0, true)"),
    "ORD-009": ("o", "NORMALIZE", "currency_normalized"),
    "ORD-010": ("o", "QUARANTINE", "coalesce(amount <= 0, true)"),
    "ORD-011": ("o", "QUARANTINE", "coalesce(coupon_discount_twd < 0, true)"),
    "ORD-012": ("o", "NORMALIZE", "timezone_assumed"),
    "ORD-013": ("o", "QUARANTINE", "coalesce(updated_at < order_created_at, true)"),
    "ORD-014": ("o", "QUARANTINE", "departure_date < order_business_date"),
    "ORD-015": ("o", "ACCEPT", "NOT member_known"),
    "ORD-016": ("o", "ACCEPT", "product_known IS NULL"),
    "ORD-017": ("o", "QUARANTINE", f"currency NOT IN {inside(C.CURRENCIES)} OR (currency IN {inside(C.FOREIGN)} AND rate_to_twd IS NULL) OR (amount IS NOT NULL AND rate_to_twd IS NOT NULL AND gross_amount_twd_exact IS NULL)"),
    "ORD-018": ("o", "ACCEPT", f"is_canonical_event AND prior_status IN {_TERMINAL} AND order_status <> prior_status"),
    "ORD-019": ("o", "QUARANTINE", f"{_ID('order_id', C.ORDER_ID)} OR {_ID('member_id', C.MEMBER_ID)} OR {_ID('product_id', C.PRODUCT_ID)}"),
    "ORD-020": ("o", "QUARANTINE", "amount > 0 AND coupon_discount_twd >= 0 AND net_amount_twd_exact < 0"),
    "ORD-021": ("o", "QUARANTINE", _WINDOW),
    "ORD-023": ("o", "QUARANTINE", f"amount > 0 AND gross_amount_twd_exact IS NOT NULL AND quantity > 0 AND price_low > 0 AND ({_GROSS} * 2 < CAST(price * quantity AS DECIMAL(38,4)) OR {_GROSS} > CAST(price_low * quantity AS DECIMAL(38,4)) * 2)"),
    "ORD-024": ("o", "QUARANTINE", "departure_date IS NULL"),
    "INC-001": ("o", "WARN", "is_canonical_event AND batch_order > 0 AND updated_at < known_time"),
    "MEM-001": ("s", "NORMALIZE", "identical_snapshot_count > 1"),
    "MEM-003": ("s", "QUARANTINE", "same_day_conflict"),
    "MEM-004": ("s", "QUARANTINE", _ID("member_id", C.MEMBER_ID)),
    "MEM-005": ("s", "QUARANTINE", _NOT_IN("member_level", C.LEVELS)),
    "MEM-006": ("s", "QUARANTINE", f"extract_date IS NULL OR register_date IS NULL OR (trim(raw_birth_date) <> '' AND ({day('raw_birth_date')}) IS NULL)"),
    "MEM-007": ("s", "QUARANTINE", "register_date > extract_date OR canonical_birth_date >= register_date"),
    "MEM-009": ("m", "QUARANTINE", "birth_date_identity_ambiguous"),
    "MEM-011": ("m", "NORMALIZE", "birth_date_sentinel"),
    "PROD-002": ("p", "QUARANTINE", "copies > 1"),
    "PROD-003": ("p", "QUARANTINE", _ID("product_id", C.PRODUCT_ID)),
    "PROD-004": ("p", "QUARANTINE", "product_name IS NULL OR product_type IS NULL OR destination_country IS NULL OR destination_city IS NULL"),
    "PROD-005": ("p", "QUARANTINE", "coalesce(trip_days <= 0, true) OR coalesce(base_price_twd <= 0, true) OR is_active NOT IN ('Y', 'N')"),
    "FX-001": ("f", "QUARANTINE", "copies > 1"),
    "FX-003": ("f", "QUARANTINE", f"rate_date IS NULL OR currency NOT IN {inside(C.FOREIGN)} OR coalesce(rate_to_twd <= 0, true)"),
}


def _gate(rule: str) -> str:
    grain, disposition, where = GATE_SQL[rule]
    source, dataset, kind, key = _GRAINS[grain]
    return f"SELECT DISTINCT '{dataset}' AS dataset, '{kind}' AS entity_type, {key} AS business_key, source_row_uid AS row_uid, '{rule}' AS rule_id, '{disposition}' AS disposition FROM {source} WHERE {where}"


for _rule in GATE_SQL:
    register(f"gate_{_rule.lower().replace('-', '_')}", lambda spark, d, r=_rule: built(spark, d)[f"issue_hit/{_GRAINS[GATE_SQL[r][0]][1]}"].filter(F.col("rule_id") == r), with_(CHAIN, _gate(_rule)))

_ENTITIES = " UNION ".join(f"SELECT '{k}' AS entity_type, {key} AS business_key FROM {t}" for _, t, k, key in _GRAINS.values())
_ROWS = " UNION ".join(f"SELECT '{t}' AS dataset, '{k}' AS entity_type, {key} AS business_key, source_row_uid AS row_uid FROM {t}" for _, t, k, key in _GRAINS.values())
_NAMES = lambda c: f"string_agg(DISTINCT {c}, ',' ORDER BY {c})"
CHAIN |= {
    "issue_hit": " UNION ALL ".join(_gate(r) for r in GATE_SQL),
    "entity_rule": "SELECT entity_type, business_key, rule_id, max(disposition) AS disposition, count(DISTINCT row_uid) AS row_count FROM issue_hit GROUP BY 1, 2, 3",
    "entity_disposition": f"""SELECT entity_type, business_key, CASE WHEN q > 0 THEN 'QUARANTINE' WHEN n > 0 THEN 'ACCEPT_WITH_FLAGS' ELSE 'ACCEPT' END AS disposition, coalesce(q, 0) = 0 AS is_eligible, coalesce(n, 0) AS matched_rules, coalesce(q, 0) AS quarantine_rules FROM ({_ENTITIES}) e
 LEFT JOIN (SELECT entity_type, business_key, count(*) AS n, count(*) FILTER (WHERE disposition = 'QUARANTINE') AS q FROM entity_rule GROUP BY 1, 2) USING (entity_type, business_key)""",
    "quarantine_row": f"""SELECT dataset, row_uid, b.business_key, coalesce(o.r, b.r, '<UNSPECIFIED>') AS rule_ids FROM (
  SELECT dataset, row_uid, {_NAMES('business_key')} AS business_key, {_NAMES('rule_id')} AS r FROM ({_ROWS}) x JOIN entity_disposition d USING (entity_type, business_key)
  LEFT JOIN (SELECT entity_type, business_key, rule_id FROM entity_rule WHERE disposition = 'QUARANTINE') q USING (entity_type, business_key) WHERE NOT is_eligible GROUP BY 1, 2) b
 LEFT JOIN (SELECT row_uid, {_NAMES('rule_id')} AS r FROM issue_hit WHERE disposition = 'QUARANTINE' GROUP BY 1) o USING (row_uid)""",
}
_table("issue_hit", dict.fromkeys(("dataset", "entity_type", "business_key", "row_uid", "rule_id", "disposition"), ""), CHAIN, "gate_issue_hit")
_table("entity_rule", dict.fromkeys(("entity_type", "business_key", "rule_id", "disposition", "row_count"), ""), CHAIN, "gate_entity_rule")
_table("entity_disposition", dict.fromkeys(("entity_type", "business_key", "disposition", "is_eligible", "matched_rules", "quarantine_rules"), ""), CHAIN, "gate_entity_disposition")
_table("quarantine_row", dict.fromkeys(("dataset", "row_uid", "business_key", "rule_ids"), ""), CHAIN, "gate_quarantine_row")

# Star -----------------------------------------------------------------------------------------------


def _eligible(kind: str, key: str) -> str:
    return f"{key} IN (SELECT business_key FROM entity_disposition WHERE entity_type = '{kind}' AND is_eligible)"


def _key(*parts: str) -> str:
    return f"CAST('0x' || substr(sha256({' || '.join(parts)}), 1, 15) AS BIGINT)"


_GOOD_ORDERS, _GOOD_MEMBERS = _eligible("order", "order_id"), _eligible("member", "member_id")
_GOOD_DAYS = f"{_GOOD_MEMBERS} AND {_eligible('member_snapshot', _SNAPSHOT_KEY)}"
_LINE4 = "source_file, source_row_number, source_row_uid, row_hash"
_NULLS4 = "NULL, NULL, NULL, NULL"
_DATES = " UNION ALL ".join([*(f"SELECT {c} AS d FROM orders WHERE is_canonical_event AND {_GOOD_ORDERS}" for c in ("order_business_date", "updated_business_date", "departure_date")), *(f"SELECT {c} FROM members WHERE {_GOOD_MEMBERS}" for c in ("extract_date", "register_date", "canonical_birth_date")), f"SELECT rate_date FROM fx_rates WHERE {_eligible('fx_rate', _RATE_KEY)}"])
_SK = lambda c: f"CAST(strftime({c}, '%Y%m%d') AS INTEGER)"
CHAIN |= {
    "dim_product": f"""SELECT {_key("'dim_product|v1|'", 'product_id')} AS product_sk, product_id, product_name, product_type, destination_country, destination_city, trip_days, base_price_twd, is_active = 'Y' AS is_active, false AS is_unknown, {_LINE4} FROM products WHERE {_eligible('product', _PRODUCT_KEY)}
 UNION ALL SELECT 0, NULL, 'Unknown Product', 'Unknown', NULL, NULL, NULL, NULL, NULL, true, {_NULLS4}""",
    "timeline": f"""SELECT member_id, extract_date, false AS clash, member_name, member_level, city, canonical_birth_date, register_date, has_birth_date_sentinel, birth_date_unknown, birth_date_restatement, version_hash, {_LINE4} FROM members WHERE is_canonical_snapshot AND NOT same_day_conflict AND {_GOOD_DAYS}
 UNION ALL SELECT DISTINCT member_id, extract_date, true, NULL, NULL, NULL, NULL::DATE, NULL::DATE, NULL, NULL, NULL, NULL, {_NULLS4} FROM members WHERE same_day_conflict AND extract_date IS NOT NULL""",
    "bounds": """SELECT * FROM (SELECT *, lag(clash) OVER w AS clash_before, lag(member_level || '~' || city) OVER w AS state_before, row_number() OVER w AS place FROM timeline WINDOW w AS (PARTITION BY member_id ORDER BY extract_date))
 WHERE clash OR place = 1 OR clash_before OR state_before <> member_level || '~' || city""",
    "dim_member": f"""SELECT {_key("'dim_member|v1|'", 'member_id', "'|'", 'CAST(extract_date AS VARCHAR)')} AS member_sk, member_id, member_name, member_level, city, canonical_birth_date AS birth_date, register_date, has_birth_date_sentinel AS birth_date_sentinel, birth_date_unknown, birth_date_restatement,
  extract_date AS valid_from, coalesce(next, DATE '{C.OPEN_END}') AS valid_to, next IS NULL AS is_current, version_hash, false AS is_unknown, extract_date AS source_extract_date, {_LINE4} FROM (SELECT *, lead(extract_date) OVER (PARTITION BY member_id ORDER BY extract_date) AS next FROM bounds) WHERE NOT clash
 UNION ALL SELECT 0, '{curated.UNKNOWN_MEMBER}', 'Unknown Member', 'Unknown', 'Unknown', NULL, NULL, false, true, false, DATE '0001-01-01', DATE '{C.OPEN_END}', true, NULL, true, NULL, {_NULLS4}""",
    "member_lineage": f"""SELECT d.member_sk, s.source_row_uid, s.source_file, s.source_row_number, s.extract_date, s.row_hash FROM members s JOIN dim_member d ON d.member_id = s.member_id AND NOT d.is_unknown AND d.valid_from <= s.extract_date AND s.extract_date < d.valid_to
 WHERE NOT s.same_day_conflict AND {_GOOD_DAYS.replace('member_id IN', 's.member_id IN').replace('member_id ||', 's.member_id ||').replace('CAST(extract_date', 'CAST(s.extract_date')}""",
    "dim_date": f"""SELECT d AS full_date, {_SK('d')} AS date_sk, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day, CAST(isoyear(d) AS INTEGER) AS iso_year, CAST(week(d) AS INTEGER) AS iso_week, CAST(isodow(d) AS INTEGER) AS iso_weekday, strftime(d, '%Y-%m') AS year_month, monthname(d) AS month_name, dayname(d) AS weekday_name, isodow(d) >= 6 AS is_weekend,
  d = date_trunc('month', d) AS is_month_start, d = last_day(d) AS is_month_end, d = date_trunc('quarter', d) AS is_quarter_start, d = date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS is_quarter_end, d = date_trunc('year', d) AS is_year_start, d = date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS is_year_end
 FROM (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM ({_DATES}))""",
    "fact_order": f"""SELECT l.order_id, l.member_id, l.product_id, coalesce(m.member_sk, 0) AS member_sk, coalesce(p.product_sk, 0) AS product_sk, {_SK('l.order_business_date')} AS order_date_sk, {_SK('l.updated_business_date')} AS updated_date_sk, {_SK('l.departure_date')} AS departure_date_sk, {_SK('l.order_business_date')} AS fx_date_sk,
  l.channel, l.order_status, l.quantity, l.raw_currency AS original_currency, l.currency, l.amount AS original_amount, l.rate_to_twd, l.coupon_discount_twd, l.gross_amount_twd_exact, l.net_amount_twd_exact, CAST(round(l.gross_amount_twd_exact, 2) AS DECIMAL(28,2)) AS gross_amount_twd, CAST(round(l.net_amount_twd_exact, 2) AS DECIMAL(28,2)) AS net_amount_twd,
  l.order_created_at, l.updated_at, l.departure_date, l.order_business_date, m.member_sk IS NULL AS unknown_member_flag, p.product_sk IS NULL AS unknown_product_flag, p.product_sk IS NULL AS price_check_not_evaluable, l.timezone_assumed, l.currency_normalized, coalesce(w.a, false) AS lifecycle_warning, coalesce(w.b, false) AS late_event_flag,
  l.order_status IN {_TERMINAL} AS is_terminal, CAST(l.duplicate_source_row_count AS INTEGER) AS event_copies, CAST(u.n AS INTEGER) AS duplicate_source_row_count, l.canonical_event_hash, l.source_file, l.source_row_number, l.batch_order, l.source_row_uid, l.row_hash
 FROM (SELECT * FROM orders WHERE is_canonical_event AND {_GOOD_ORDERS} QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY updated_at DESC NULLS LAST, canonical_event_hash) = 1) l
 LEFT JOIN dim_member m ON m.member_id = l.member_id AND NOT m.is_unknown AND m.valid_from <= l.order_business_date AND l.order_business_date < m.valid_to LEFT JOIN dim_product p ON p.product_id = l.product_id AND NOT p.is_unknown
 LEFT JOIN (SELECT business_key, bool_or(rule_id = 'ORD-018') AS a, bool_or(rule_id = 'INC-001') AS b FROM entity_rule WHERE entity_type = 'order' GROUP BY 1) w ON w.business_key = l.order_id JOIN (SELECT order_id, count(*) - count(DISTINCT canonical_event_hash) AS n FROM orders GROUP BY 1) u ON u.order_id = l.order_id""",
    "event_lineage": "SELECT o.source_row_uid, o.batch_order, o.order_id, o.canonical_event_hash, o.is_canonical_event, c.source_row_uid AS logical_row_uid FROM orders o JOIN orders c ON c.canonical_event_hash = o.canonical_event_hash AND c.is_canonical_event",
}
_STAR = {
    "dim_product": {"product_sk": "", "product_id": "", "product_name": "", "product_type": "", "destination_country": "", "destination_city": "", "trip_days": "", "base_price_twd": "decimal", "is_active": "", "is_unknown": ""} | _LINEAGE_KINDS,
    "dim_member": {"member_sk": "", "member_id": "", "member_name": "", "member_level": "", "city": "", "birth_date": "date", "register_date": "date", "birth_date_sentinel": "", "birth_date_unknown": "", "birth_date_restatement": "", "valid_from": "date", "valid_to": "date", "is_current": "", "version_hash": "", "is_unknown": "", "source_extract_date": "date"} | _LINEAGE_KINDS,
    "member_lineage": {"member_sk": "", "source_row_uid": "", "source_file": "", "source_row_number": "", "extract_date": "date", "row_hash": ""},
    "dim_date": {"full_date": "date"} | dict.fromkeys(("date_sk", "year", "quarter", "month", "day", "iso_year", "iso_week", "iso_weekday", "year_month", "month_name", "weekday_name", "is_weekend", "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end", "is_year_start", "is_year_end"), ""),
    "fact_order": {"order_id": "", "member_id": "", "product_id": "", "member_sk": "", "product_sk": "", "order_date_sk": "", "updated_date_sk": "", "departure_date_sk": "", "fx_date_sk": "", "channel": "", "order_status": "", "quantity": "", "original_currency": "", "currency": "", "original_amount": "decimal", "rate_to_twd": "decimal", "coupon_discount_twd": "decimal", "gross_amount_twd_exact": "decimal", "net_amount_twd_exact": "decimal", "gross_amount_twd": "decimal", "net_amount_twd": "decimal", "order_created_at": "timestamp", "updated_at": "timestamp", "departure_date": "date", "order_business_date": "date"} | dict.fromkeys(("unknown_member_flag", "unknown_product_flag", "price_check_not_evaluable", "timezone_assumed", "currency_normalized", "lifecycle_warning", "late_event_flag", "is_terminal", "event_copies", "duplicate_source_row_count", "canonical_event_hash", "batch_order"), "") | _LINEAGE_KINDS,
    "event_lineage": dict.fromkeys(("source_row_uid", "batch_order", "order_id", "canonical_event_hash", "is_canonical_event", "logical_row_uid"), ""),
}
for _name, _columns in _STAR.items():
    _table(_name, _columns, CHAIN, f"star_{_name}")

# Checks: each on tables that are broken so that it has something to count ----------------------------

DROP, TWICE = "drop", "twice"
Break = tuple  # (table, DROP or TWICE, rows) or (table, column, rows, value)
_ENDS = lambda c, x: f"{c} LIKE '%{x}'"


def break_frame(df: DataFrame, what: Break) -> DataFrame:
    _, how, rows, *value = what
    if how == DROP:
        return df.filter(f"NOT coalesce(({rows}), false)")
    return df.unionByName(df.filter(rows)) if how == TWICE else df.withColumn(how, F.expr(f"CASE WHEN {rows} THEN {value[0]} ELSE {how} END"))


def break_sql(what: Break) -> str:
    name, how, rows, *value = what
    if how == DROP:
        return f"SELECT * FROM {name} WHERE NOT coalesce(({rows}), false)"
    return f"SELECT * FROM {name} UNION ALL SELECT * FROM {name} WHERE {rows}" if how == TWICE else f"SELECT * REPLACE (CASE WHEN {rows} THEN {value[0]} ELSE {how} END AS {how}) FROM {name}"


def ledger(t: Mapping[str, DataFrame]) -> dict:
    """A ledger as the builder keeps it: of every file its batch and rows, and one attempt a batch."""
    counted = reduce(DataFrame.unionByName, (t[f"raw_{d}"].groupBy("source_file", "batch_order").agg(F.count("*").alias("n")) for d in C.CONTRACTS)).collect()  # seven files
    return {"files": {r.source_file: {"batch_order": r.batch_order, "rows": r.n} for r in counted}, "attempts": [{"file": f, "batch_order": i, "status": "SUCCEEDED"} for i, f in enumerate(C.ORDERS.files)]}


def _gap(a: str, b: str) -> str:
    return f"abs((SELECT count(*) FROM {a}) - (SELECT count(*) FROM {b}))"


_FILES = "(SELECT source_file, batch_order FROM raw_orders UNION ALL SELECT source_file, batch_order FROM raw_members UNION ALL SELECT source_file, batch_order FROM {products} UNION ALL SELECT source_file, batch_order FROM raw_fx_rates)"
_ALLOWED = ", ".join(f"('{f}', {i})" for c in C.CONTRACTS.values() for i, f in enumerate(c.files))
_SYMMETRIC = lambda a, b: f"(SELECT count(*) FROM (({a}) EXCEPT ({b}))) + (SELECT count(*) FROM (({b}) EXCEPT ({a})))"
_LATE = "SELECT source_row_uid FROM marked WHERE is_canonical_event AND batch_order > 0 AND updated_at < known_time"
#: Of every check what is broken (x is the broken table in the SQL), and the number of violations.
CHECK_SQL: dict[str, tuple[Break, str]] = {
    "RAW_STAGING_ORDER_COUNT": (("orders", DROP, _ENDS("order_id", 7)), _gap("raw_orders", "x")),
    "RAW_STAGING_MEMBER_COUNT": (("members", DROP, _ENDS("member_id", 7)), _gap("raw_members", "x")),
    "RAW_STAGING_PRODUCT_COUNT": (("products", DROP, _ENDS("product_id", 7)), _gap("raw_products", "x")),
    "RAW_STAGING_FX_COUNT": (("fx_rates", TWICE, "currency = 'USD'"), _gap("raw_fx_rates", "x")),
    "SOURCE_FILE_ALLOWLIST": (("raw_products", "source_file", _ENDS("product_id", 3), "'other.csv'"), f"(SELECT count(*) FROM {_FILES.format(products='x')} WHERE (source_file, batch_order) NOT IN ({_ALLOWED}))"),
    "FACT_ORDER_UNIQUENESS": (("fact_order", TWICE, _ENDS("order_id", 7)), "(SELECT count(*) - count(DISTINCT order_id) FROM x)"),
    "MEMBER_SK_COLLISION": (("dim_member", "member_sk", _ENDS("member_id", 3), "CAST(5 AS BIGINT)"), "(SELECT count(*) FROM (SELECT member_sk FROM x WHERE member_sk <> 0 AND NOT is_unknown GROUP BY 1 HAVING count(DISTINCT member_id || '|' || CAST(valid_from AS VARCHAR)) > 1))"),
    "PRODUCT_SK_COLLISION": (("dim_product", "product_sk", _ENDS("product_id", 4), "CAST(5 AS BIGINT)"), "(SELECT count(*) FROM (SELECT product_sk FROM x WHERE product_sk <> 0 GROUP BY 1 HAVING count(DISTINCT product_id) > 1))"),
    "KNOWN_SK_NONZERO": (("dim_member", "member_sk", _ENDS("member_id", 3), "CAST(0 AS BIGINT)"), "(SELECT count(*) FROM x WHERE NOT is_unknown AND member_sk = 0)"),
    "UNKNOWN_MEMBER_CARDINALITY": (("dim_member", TWICE, "is_unknown"), "(SELECT abs(count(*) - 1) FROM x WHERE member_sk = 0 AND is_unknown)"),
    "UNKNOWN_PRODUCT_CARDINALITY": (("dim_product", DROP, "is_unknown"), "(SELECT abs(count(*) - 1) FROM x WHERE product_sk = 0 AND is_unknown)"),
    "MEMBER_PERIOD_OVERLAP": (("dim_member", "valid_to", "valid_to < DATE '9999-12-31'", "DATE '9999-12-31'"), "(SELECT count(*) FROM x b WHERE NOT is_unknown AND EXISTS (SELECT 1 FROM x a WHERE a.member_id = b.member_id AND a.valid_from < b.valid_from AND a.valid_to > b.valid_from))"),
    "MEMBER_SINGLE_CURRENT": (("dim_member", "is_current", "NOT is_unknown", "true"), "(SELECT count(*) FROM (SELECT member_id FROM x WHERE is_current AND NOT is_unknown GROUP BY 1 HAVING count(*) > 1))"),
    "MEMBER_VALIDITY_FLAGS": (("dim_member", "is_current", "member_id < 'M000050'", "NOT is_current"), "(SELECT count(*) FROM x WHERE NOT is_unknown AND (valid_from >= valid_to OR is_current <> (valid_to = DATE '9999-12-31')))"),
    "FACT_MEMBER_ORPHAN": (("dim_member", DROP, _ENDS("member_id", 6)), "(SELECT count(*) FROM fact_order WHERE member_sk NOT IN (SELECT member_sk FROM x))"),
    "FACT_PRODUCT_ORPHAN": (("dim_product", DROP, _ENDS("product_id", 1)), "(SELECT count(*) FROM fact_order WHERE product_sk NOT IN (SELECT product_sk FROM x))"),
    "FACT_DATE_ORPHAN": (("dim_date", DROP, "date_sk % 100 = 3"), "(SELECT count(*) FROM fact_order WHERE order_date_sk NOT IN (SELECT date_sk FROM x) OR departure_date_sk NOT IN (SELECT date_sk FROM x) OR updated_date_sk NOT IN (SELECT date_sk FROM x) OR fx_date_sk NOT IN (SELECT date_sk FROM x))"),
    "DATE_KEY_FORMAT": (("dim_date", "date_sk", "month = 5", "date_sk + 1"), "(SELECT count(*) FROM x WHERE date_sk <> CAST(strftime(full_date, '%Y%m%d') AS INTEGER))"),
    "DATE_CONTINUITY": (("dim_date", DROP, "date_sk % 100 = 3"), "(SELECT abs(count(*) - (date_diff('day', min(full_date), max(full_date)) + 1)) FROM x)"),
    "DATE_SENTINEL_EXCLUSION": (("dim_date", "full_date", "date_sk % 10000 = 1231", "DATE '9999-12-31'"), "(SELECT count(*) FROM x WHERE full_date IN (DATE '1900-01-01', DATE '9999-12-31'))"),
    "MISSING_FX_LEAKAGE": (("fact_order", "rate_to_twd", "currency = 'USD'", "NULL"), "(SELECT count(*) FROM x WHERE rate_to_twd IS NULL)"),
    "UNSUPPORTED_CURRENCY_LEAKAGE": (("fact_order", "currency", _ENDS("order_id", 5), "'EUR'"), f"(SELECT count(*) FROM x WHERE currency NOT IN {inside(C.CURRENCIES)})"),
    "MONEY_EXACT_RECOMPUTE": (("fact_order", "gross_amount_twd_exact", "currency = 'JPY'", "gross_amount_twd_exact + 1"), "(SELECT count(*) FROM x WHERE gross_amount_twd_exact <> CAST(original_amount AS DECIMAL(20,4)) * CAST(rate_to_twd AS DECIMAL(17,8)) OR net_amount_twd_exact <> CAST(gross_amount_twd_exact AS DECIMAL(36,12)) - coupon_discount_twd)"),
    "MONEY_ROUND_RECOMPUTE": (("fact_order", "net_amount_twd", _ENDS("order_id", 5), "net_amount_twd + 1"), "(SELECT count(*) FROM x WHERE gross_amount_twd <> round(gross_amount_twd_exact, 2) OR net_amount_twd <> round(net_amount_twd_exact, 2))"),
    "UNKNOWN_PRODUCT_FLAG": (("fact_order", "price_check_not_evaluable", _ENDS("order_id", 5), "NOT price_check_not_evaluable"), "(SELECT count(*) FROM x WHERE (product_sk = 0) <> unknown_product_flag OR unknown_product_flag <> price_check_not_evaluable)"),
    "UNKNOWN_MEMBER_FLAG": (("fact_order", "unknown_member_flag", _ENDS("order_id", 5), "NOT unknown_member_flag"), "(SELECT count(*) FROM x WHERE (member_sk = 0) <> unknown_member_flag)"),
    "QUARANTINE_ROW_DUPLICATE": (("quarantine_row", TWICE, _ENDS("row_uid", 50)), "(SELECT count(*) - count(DISTINCT dataset || row_uid) FROM x)"),
    "ORDER_CANONICAL_CONFLICT_RULE_RECONCILIATION": (("entity_rule", DROP, f"rule_id = 'ORD-004' AND {_ENDS('business_key', 8)}"), _SYMMETRIC("SELECT order_id FROM orders WHERE is_canonical_event GROUP BY 1 HAVING count(DISTINCT invariant_hash) > 1", "SELECT business_key FROM x WHERE entity_type = 'order' AND rule_id = 'ORD-004'")),
    "ENTITY_DISPOSITION_SOURCE_GRAIN_RECONCILIATION": (("entity_disposition", DROP, _ENDS("business_key", 2)), _gap("x", f"({_ENTITIES})")),
    "MEMBER_ACCEPTED_LINEAGE_RECONCILIATION": (("member_lineage", DROP, _ENDS("source_row_uid", 51)), _SYMMETRIC(f"SELECT source_row_uid FROM members WHERE NOT same_day_conflict AND {_GOOD_DAYS}", "SELECT source_row_uid FROM x")),
    "TIMEZONE_ASSUMPTION_DISPOSITION_PARTITION": (("entity_disposition", DROP, f"entity_type = 'order' AND {_ENDS('business_key', 3)}"), "abs((SELECT count(*) FROM orders WHERE timezone_assumed) - (SELECT count(*) FROM orders JOIN x ON entity_type = 'order' AND business_key = order_id WHERE timezone_assumed))"),
    "TIMEZONE_FACT_SELECTED_SOURCE_FLAG": (("fact_order", "timezone_assumed", _ENDS("order_id", 5), "NOT timezone_assumed"), "(SELECT count(*) FROM x JOIN orders o USING (source_row_uid) WHERE x.timezone_assumed <> o.timezone_assumed)"),
    "ORDER_LINEAGE_RAW_RECONCILIATION": (("event_lineage", DROP, _ENDS("source_row_uid", 50)), _gap("raw_orders", "x")),
    "ORDER_LINEAGE_LOGICAL_REPRESENTATIVE": (("event_lineage", "is_canonical_event", _ENDS("order_id", 5), "false"), "(SELECT count(*) FROM (SELECT canonical_event_hash FROM x GROUP BY 1 HAVING count(*) FILTER (WHERE is_canonical_event) <> 1))"),
    "FACT_LATEST_STATE": (("fact_order", DROP, _ENDS("order_id", 5)), "(SELECT count(*) FROM fact_order f ANTI JOIN x USING (order_id))"),
    "LATE_EVENT_FLAG_RECONCILIATION": (("issue_hit", DROP, f"rule_id = 'INC-001' AND {_ENDS('business_key', 2)}"), _SYMMETRIC(_LATE, "SELECT row_uid FROM x WHERE rule_id = 'INC-001'")),
    "QUARANTINED_ORDER_FACT_LEAKAGE": (("entity_disposition", "is_eligible", f"entity_type = 'order' AND {_ENDS('business_key', 5)}", "false"), "(SELECT count(*) FROM fact_order WHERE order_id IN (SELECT business_key FROM x WHERE entity_type = 'order' AND NOT is_eligible))"),
}


class Broken(Mapping):
    """Tables of which one is broken, whole and by dataset."""

    def __init__(self, tables: Mapping[str, DataFrame], what: Break) -> None:
        self.tables, self.what = tables, what

    def __getitem__(self, name: str) -> DataFrame:
        return break_frame(self.tables[name], self.what) if name.split("/")[0] == self.what[0] else self.tables[name]

    def __contains__(self, name: object) -> bool:
        return name in self.tables

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)


#: Checks that list rows of single orders, so that the violations of the whole are those of its shares together.
BY_SHARE = ("LATE_EVENT_FLAG_RECONCILIATION", "TIMEZONE_FACT_SELECTED_SOURCE_FLAG", "FACT_LATEST_STATE")


def _check(name: str) -> Query:
    def panel(t: Mapping[str, DataFrame]) -> DataFrame:
        return validation.panel({name: validation.incremental_checks(Broken(t, CHECK_SQL[name][0]), {})[name]})

    def run(spark: SparkSession, folder: str) -> DataFrame:
        t = built(spark, folder)
        shares = t.shares() if name in BY_SHARE else [t]
        if len(shares) == 1:
            return panel(t)
        total = 0
        for own in shares:
            total += panel(own).first().violation_count
            t.sweep()
        return spark.createDataFrame([(name, total)], "check_id string, violation_count long")

    return run


for _name, (_what, _sql) in CHECK_SQL.items():
    register(f"check_{_name.lower()}", _check(_name), with_(CHAIN | {"x": break_sql(_what)}, f"SELECT '{_name}' AS check_id, CAST({_sql} AS BIGINT) AS violation_count"))


def _ledger_check(name: str, change) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        t = built(spark, folder)
        own = ledger(t)
        change(own)
        return validation.panel({name: validation.incremental_checks(t, own)[name]})

    return run


_DAY1 = C.ORDERS.files[1]
for _name, _change, _n in (
    ("REGISTRY_LOGICAL_FILE_UNIQUENESS", lambda own: own["attempts"].append(own["attempts"][1] | {"batch_order": 9}), 1),
    ("BATCH_RECONCILIATION_UNIQUENESS", lambda own: own["attempts"].extend(own["attempts"][1] | {"file": f} for f in "ab"), 2),
    ("RAW_SOURCE_REGISTRY_RECONCILIATION", lambda own: own["files"].pop(_DAY1), 1),
    ("REGISTRY_SOURCE_ROW_COUNT", lambda own: own["files"][_DAY1].update(rows=-1), 1),
):
    register(f"check_{_name.lower()}", _ledger_check(_name, _change), f"SELECT '{_name}' AS check_id, CAST({_n} AS BIGINT) AS violation_count")

_IDS = sorted([*CHECK_SQL, "REGISTRY_LOGICAL_FILE_UNIQUENESS", "BATCH_RECONCILIATION_UNIQUENESS", "RAW_SOURCE_REGISTRY_RECONCILIATION", "REGISTRY_SOURCE_ROW_COUNT"])
register("check_panel_of_the_whole", lambda spark, d: validation.panel(validation.incremental_checks(built(spark, d).keep("members", "orders", "fact_order", "event_lineage"), ledger(built(spark, d)))), " UNION ALL ".join(f"SELECT '{n}' AS check_id, CAST(0 AS BIGINT) AS violation_count" for n in _IDS))
register("check_base_files", lambda spark, d: validation.panel({"SOURCE_FILE_ALLOWLIST": validation.base_checks(built(spark, d))["SOURCE_FILE_ALLOWLIST"]}), with_(RAW, "SELECT 'SOURCE_FILE_ALLOWLIST' AS check_id, count(*) AS violation_count FROM raw_orders WHERE batch_order > 0"))

# Scans ----------------------------------------------------------------------------------------------


def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Members written as one CSV file, sorted, and read back by the strict scan, with its row numbers and hashes."""
    path = shapes.scratch(spark, "members")
    files.write_result_csv(built(spark, folder)[MEMBERS].select(*C.MEMBERS.names), path, C.MEMBERS.names)
    return files.read_raw(spark, path, C.MEMBERS, C.MEMBERS.files[0]).select(*C.MEMBERS.names, "source_row_number", "row_hash", "source_file", "batch_order")


_JSON = ", ".join(f"'{c}', {c}" for c in C.MEMBERS.names)
register("csv_scan", csv_scan, with_(RAW, f"SELECT {', '.join(C.MEMBERS.names)}, row_number() OVER (ORDER BY {', '.join(C.MEMBERS.names)}) AS source_row_number, sha256(CAST(json_object({_JSON}) AS VARCHAR)) AS row_hash, 'members.csv' AS source_file, 0 AS batch_order FROM raw_members"))


def csv_event_files(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as several CSV files beside others, and those whose names match read back."""
    path = shapes.scratch(spark, "events")
    columns = ["event_id", "user_id", "event_type"]
    own = spark.read.parquet(f"{folder}/events.parquet").select(*(F.col(c).cast("string").alias(c) for c in columns))
    own.repartition(4, "user_id").write.option("header", True).csv(path)
    return files.read_event_files(spark, path, columns, "part-*.csv").select(*columns)


register("csv_event_files", csv_event_files, "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type FROM events")
