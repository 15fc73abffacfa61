"""Queries over the driver's tables, one or more for each operator of the warehouse, each beside SQL that gives the same rows.

Values are whole numbers, decimals as text, or text, so that engines cannot differ in how they show them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.identity import json_hash, surrogate_key
from .functions.money import convert, less, reported
from .operators import rules, scd2, states, tables
from .plans import features, metrics
from .source_shapes import scratch
from .streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str = "") -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.col("ts").cast("date"))


def text(c: Column) -> Column:
    return c.cast("string")


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def at(c: str = "ts") -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


AT = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"

# Latest states, conflicts, duplicates ------------------------------------------------------------


@query(f"SELECT user_id, event_id, event_type, {AT} AS at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def latest_state(spark, d):
    return states.latest(events(spark, d), ["user_id"], "ts", ["event_id"]).select("user_id", "event_id", "event_type", at().alias("at"))


@query("WITH h AS (SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS candidates FROM events GROUP BY ALL) SELECT user_id, candidates FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY h DESC) = 1 AND candidates > 1")
def latest_tie_quarantine(spark, d):
    return states.tied_at_latest(events(spark, d).withColumn("h", F.date_trunc("hour", "ts")), ["user_id"], "h")


@query("SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(DISTINCT event_type) AS types FROM events GROUP BY ALL HAVING count(DISTINCT event_type) > 1")
def same_time_conflict(spark, d):
    own = events(spark, d)
    bad = states.conflicting(own, ["user_id", "day"], ["event_type"])
    return own.join(bad, ["user_id", "day"], "left_semi").groupBy("user_id", text(F.col("day")).alias("day")).agg(F.countDistinct("event_type").alias("types"))


@query("SELECT event_id, types FROM (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events) JOIN (SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_type) AS types FROM events GROUP BY ALL) USING (user_id, day)")
def distinct_count_over(spark, d):
    return states.distinct_over(events(spark, d), ["user_id", "day"], F.col("event_type"), "types").select("event_id", "types")


@query("SELECT sha256(text) AS text_hash, min(doc_id) AS representative, count(*) AS copies FROM documents GROUP BY text")
def exact_duplicate_representative(spark, d):
    return states.representatives(table(spark, d, "documents").withColumn("text_hash", F.sha2("text", 256)), ["text_hash"], "doc_id")


@query("SELECT o_custkey, year(o_orderdate) AS y FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderpriority) > 1")
def invariant_conflict(spark, d):
    return states.conflicting(table(spark, d, "orders").withColumn("y", F.year("o_orderdate").cast("long")), ["o_custkey", "y"], ["o_orderpriority"])


@query("WITH t AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events) SELECT from_state, to_state, count(*) AS transitions FROM t WHERE from_state IS NOT NULL GROUP BY ALL")
def status_transitions(spark, d):
    return states.transitions(events(spark, d), ["user_id"], ["ts", "event_id"], "event_type")


@query("WITH t AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT event_id, user_id, p AS previous, event_type FROM t WHERE p IN ('purchase', 'error') AND event_type IS DISTINCT FROM p")
def terminal_reopen(spark, d):
    return states.reopened(events(spark, d), ["user_id"], ["ts", "event_id"], "event_type", ["purchase", "error"]).select("event_id", "user_id", "previous", "event_type")


@query("SELECT e.event_id, e.batch FROM (SELECT *, event_id % 3 AS batch FROM events) e WHERE EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_id % 3 < e.batch AND p.ts > e.ts)")
def late_arrival(spark, d):
    own = events(spark, d).withColumn("batch", F.col("event_id") % 3)
    return states.late_arrivals(own, ["user_id"], "batch", "ts").select("event_id", "batch")


@query("SELECT field, count(*) FILTER (WHERE n > 1) AS conflicting_keys FROM (SELECT o_custkey, field, count(DISTINCT value) AS n FROM (UNPIVOT (SELECT o_custkey, o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS VARCHAR) AS o_year FROM orders) ON o_orderstatus, o_orderpriority, o_year INTO NAME field VALUE value) GROUP BY ALL) GROUP BY field")
def unpivot_field_conflicts(spark, d):
    own = table(spark, d, "orders").withColumn("o_year", text(F.year("o_orderdate")))
    return states.field_conflicts(own, ["o_custkey"], ["o_orderstatus", "o_orderpriority", "o_year"])


@query("SELECT event_type, count(*) AS copies, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS above, bool_or(value > 450) AS any_large, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type")
def filtered_aggregates(spark, d):
    own = events(spark, d).groupBy("event_type")
    return own.agg(F.count("*").alias("copies"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("above"), F.bool_or(F.col("value") > 450).alias("any_large"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY user_id")
def ordered_distinct_list(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.expr("listagg(DISTINCT event_type, ',') WITHIN GROUP (ORDER BY event_type)").alias("types"))


# Dimensions over time ---------------------------------------------------------------------------

SCD2 = """
days AS (SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN min(event_type) = max(event_type) THEN min(event_type) END AS state FROM events GROUP BY ALL),
marks AS (SELECT *, lag(coalesce(state, '<CONFLICT>')) OVER (PARTITION BY user_id ORDER BY day) AS before FROM days),
bounds AS (SELECT *, coalesce(lead(day) OVER (PARTITION BY user_id ORDER BY day), DATE '9999-12-31') AS valid_to FROM marks WHERE state IS NULL OR before IS NULL OR before <> state),
versions AS (SELECT CAST('0x' || substr(sha256('dim_user|v1|' || user_id || '|' || day), 1, 15) AS BIGINT) AS sk, user_id, state AS event_type, day AS valid_from, valid_to, valid_to = DATE '9999-12-31' AS is_current FROM bounds WHERE state IS NOT NULL)"""


def versions(spark, d):
    return scd2.build(events(spark, d).select("user_id", "day", "event_type"), "user_id", "day", ["event_type"], "dim_user|v1")


@query(f"WITH {SCD2} SELECT sk, user_id, event_type, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to, is_current FROM versions")
def scd2_dim(spark, d):
    return versions(spark, d).select("sk", "user_id", "event_type", text(F.col("valid_from")).alias("valid_from"), text(F.col("valid_to")).alias("valid_to"), "is_current")


@query(f"WITH {SCD2} SELECT e.event_id, coalesce(v.sk, 0) AS sk, v.sk IS NULL AS is_unknown FROM events e LEFT JOIN versions v ON v.user_id = e.user_id AND v.valid_from <= CAST(e.ts AS DATE) AND CAST(e.ts AS DATE) < v.valid_to")
def fact_asof_dim(spark, d):
    return scd2.as_of(events(spark, d), versions(spark, d), "user_id", F.col("day"), ["sk"], {"sk": 0}).select("event_id", "sk", (F.col("sk") == 0).alias("is_unknown"))


@query(f"WITH {SCD2} SELECT 'overlap' AS check_id, count(*) AS n FROM versions a JOIN versions b ON a.user_id = b.user_id AND a.sk <> b.sk AND a.valid_from < b.valid_to AND b.valid_from < a.valid_to UNION ALL SELECT 'current', count(*) FROM versions WHERE is_current UNION ALL SELECT 'several_current', count(*) FROM (SELECT user_id FROM versions WHERE is_current GROUP BY user_id HAVING count(*) > 1)")
def scd2_checks(spark, d):
    v = versions(spark, d)
    several = v.filter("is_current").groupBy("user_id").count().filter("count > 1")
    parts = {"overlap": scd2.overlaps(v, "user_id"), "current": v.filter("is_current"), "several_current": several}
    return rules.panel(parts).withColumnRenamed("violation_count", "n")


@query(f"WITH {SCD2} SELECT d.user_id, CAST(d.day AS VARCHAR) AS day, v.sk FROM days d JOIN versions v ON v.user_id = d.user_id AND v.valid_from <= d.day AND d.day < v.valid_to WHERE d.state IS NOT NULL")
def version_lineage(spark, d):
    own = events(spark, d).groupBy("user_id", "day").agg((F.min("event_type") == F.max("event_type")).alias("one")).filter("one")
    return scd2.lineage(own, versions(spark, d), "user_id", "day").select("user_id", text(F.col("day")).alias("day"), "sk")


@query("""SELECT CAST(x AS VARCHAR) AS full_date, CAST(strftime(x, '%Y%m%d') AS INTEGER) AS date_sk, year(x)::INT AS year, quarter(x)::INT AS quarter, month(x)::INT AS month, day(x)::INT AS day, isoyear(x)::INT AS iso_year, week(x)::INT AS iso_week, isodow(x)::INT AS iso_weekday,
 strftime(x, '%Y-%m') AS year_month, strftime(x, '%B') AS month_name, strftime(x, '%A') AS weekday_name, isodow(x) >= 6 AS is_weekend, CAST(date_trunc('month', x)::DATE AS VARCHAR) AS month_start, CAST(last_day(x) AS VARCHAR) AS month_end, x = last_day(x) AS is_month_end,
 CAST(date_trunc('quarter', x)::DATE AS VARCHAR) AS quarter_start, CAST((date_trunc('quarter', x) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS VARCHAR) AS quarter_end,
 x = date_trunc('month', x) AS is_month_start, x = date_trunc('quarter', x) AS is_quarter_start, x = date_trunc('quarter', x) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS is_quarter_end, x = date_trunc('year', x) AS is_year_start, x = date_trunc('year', x) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS is_year_end
 FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY))::DATE AS x FROM orders)""")
def date_dimension(spark, d):
    own = scd2.calendar(table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("full_date")))
    return own.select(*(text(F.col(c)).alias(c) if t == "date" else F.col(c) for c, t in own.dtypes))


@query("WITH k AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), r AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM k GROUP BY user_id) SELECT user_id, CAST(day AS VARCHAR) AS missing_date FROM r ANTI JOIN k USING (user_id, day)")
def calendar_gap(spark, d):
    return scd2.gaps(events(spark, d), "user_id", "day").select("user_id", text(F.col("missing_date")).alias("missing_date"))


# Money, references, upserts -----------------------------------------------------------------------

RATES = "rates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(1 + (dayofyear(o_orderdate) * 7919 % 100000) / 100000000.0 AS DECIMAL(17,8)) AS rate FROM orders WHERE dayofyear(o_orderdate) % 10 <> 0)"


def rates(spark, d) -> DataFrame:
    """A rate for every day but each tenth of a year."""
    o = table(spark, d, "orders").filter(F.dayofyear("o_orderdate") % 10 != 0)
    rate = (F.lit(100000000) + F.dayofyear("o_orderdate") * 7919 % 100000).cast("decimal(20,0)") / F.lit(100000000).cast("decimal(9,0)")
    return o.select(F.col("o_orderdate").cast("date").alias("day"), rate.cast("decimal(17,8)").alias("rate")).distinct()


@query(f"""WITH {RATES}, x AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(20,4)) * rate AS gross, CAST(o_orderkey % 10 AS DECIMAL(24,4)) AS coupon FROM orders LEFT JOIN rates ON day = CAST(o_orderdate AS DATE))
SELECT o_orderkey, CAST(CAST(gross AS DECIMAL(38,12)) AS VARCHAR) AS gross_exact, CAST(CAST(gross - coupon AS DECIMAL(38,12)) AS VARCHAR) AS net_exact, CAST(CAST(round(gross, 2) AS DECIMAL(28,2)) AS VARCHAR) AS gross_reported FROM x""")
def fx_asof_money(spark, d):
    own = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date")).join(rates(spark, d), "day", "left")
    gross = convert(money("o_totalprice").cast("decimal(24,4)"), F.col("rate"))
    own = own.withColumn("gross", gross).withColumn("net", less(F.col("gross"), (F.col("o_orderkey") % 10).cast("decimal(24,4)")))
    return own.select("o_orderkey", text(F.col("gross")).alias("gross_exact"), text(F.col("net")).alias("net_exact"), text(reported(F.col("gross"))).alias("gross_reported"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_partkey % 10 <> 0)")
def missing_reference_left_anti(spark, d):
    known = table(spark, d, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    return tables.missing_references(table(spark, d, "lineitem"), known, ["l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_custkey, coalesce(n_name, 'UNKNOWN') AS n_name, n_name IS NULL AS is_unknown FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey <> 0")
def unknown_key_fallback(spark, d):
    known = table(spark, d, "nation").filter("n_nationkey <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    own = tables.lookup(table(spark, d, "customer"), known, ["c_nationkey"], {"n_name": "UNKNOWN"})
    return own.select("c_custkey", "n_name", (F.col("n_name") == "UNKNOWN").alias("is_unknown"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def incremental_equals_full(spark, d):
    """Three batches of events, each upserted into what came before; the result is that of all events at once."""
    own = events(spark, d).select("user_id", "event_id", "event_type", "ts")
    state = states.latest(own.filter("event_id % 3 = 0"), ["user_id"], "ts", ["event_id"])
    for n in (1, 2):
        batch = own.filter(f"event_id % 3 = {n}")
        touched = tables.keep_only(state, batch, ["user_id"]).unionByName(batch)
        state = tables.upsert(state, states.latest(touched, ["user_id"], "ts", ["event_id"]), ["user_id"])
    return state.select("user_id", "event_id", "event_type")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ")
def keep_only_wanted(spark, d):
    wanted = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return tables.keep_only(table(spark, d, "customer"), wanted, ["c_custkey"]).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey WHERE CAST(l_extendedprice AS DECIMAL(18,2)) < CAST(p_retailprice AS DECIMAL(18,2)) * CAST(l_quantity AS INT) / 2 OR CAST(l_extendedprice AS DECIMAL(18,2)) > CAST(p_retailprice AS DECIMAL(18,2)) * CAST(l_quantity AS INT) * 2")
def price_ratio_outlier(spark, d):
    """Compared by products, not by a quotient, which engines divide differently."""
    own = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    total = money("p_retailprice") * F.col("l_quantity").cast("int")
    return own.filter((money("l_extendedprice") * 2 < total) | (money("l_extendedprice") > total * 2)).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, w.label FROM orders JOIN (VALUES ('F', DATE '1996-01-01', DATE '1996-12-31', 'f96'), ('O', DATE '1997-01-01', DATE '1997-06-30', 'o97')) AS w(st, a, b, label) ON o_orderstatus = w.st AND CAST(o_orderdate AS DATE) BETWEEN w.a AND w.b")
def inline_contract_windows(spark, d):
    """A join to a contract given inline: two rows, whose bound is the literal itself."""
    w = spark.createDataFrame([("F", "1996-01-01", "1996-12-31", "f96"), ("O", "1997-01-01", "1997-06-30", "o97")], "o_orderstatus string, a string, b string, label string")
    own = table(spark, d, "orders").join(F.broadcast(w), "o_orderstatus")
    return own.filter(F.col("o_orderdate").cast("date").between(F.col("a").cast("date"), F.col("b").cast("date"))).select("o_orderkey", "label")


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE (s_nationkey, s_suppkey % 2) NOT IN (VALUES (1, 0), (2, 1))")
def tuple_not_in(spark, d):
    banned = spark.createDataFrame([(1, 0), (2, 1)], "s_nationkey int, odd long")
    return table(spark, d, "supplier").withColumn("odd", F.col("s_suppkey") % 2).join(F.broadcast(banned), ["s_nationkey", "odd"], "left_anti").select("s_suppkey", "s_nationkey")


@query("SELECT DISTINCT c_custkey FROM customer JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey OR (c_mktsegment = 'BUILDING' AND c_nationkey % 5 = n_nationkey % 5)")
def either_key_join(spark, d):
    """A join on one key or another, as two equi-joins without a nested loop."""
    c = table(spark, d, "customer")
    n = table(spark, d, "nation").filter("n_regionkey = 1")
    one = c.join(n.select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi").select("c_custkey")
    other = c.filter("c_mktsegment = 'BUILDING'").withColumn("k", F.col("c_nationkey") % 5).join(n.select((F.col("n_nationkey") % 5).alias("k")).distinct(), "k", "left_semi").select("c_custkey")
    return one.unionByName(other).distinct()


@query("SELECT DISTINCT CAST(x AS VARCHAR) AS day FROM (SELECT CAST(o_orderdate AS DATE) AS x FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem UNION SELECT CAST(ts AS DATE) FROM events)")
def union_of_dates(spark, d):
    parts = [table(spark, d, t).select(text(F.col(c).cast("date")).alias("day")) for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))]
    return reduce(DataFrame.unionByName, parts).distinct()


# Identity, checksums, profiles -------------------------------------------------------------------


@query("SELECT c_custkey, CAST('0x' || substr(sha256('dim_customer|v1|' || c_custkey), 1, 15) AS BIGINT) AS sk, sha256(to_json(struct_pack(schema_version := 'customer-v1', key := c_custkey, name := c_name, segment := c_mktsegment))) AS row_hash FROM customer")
def surrogate_keys(spark, d):
    own = table(spark, d, "customer")
    row = json_hash(schema_version=F.lit("customer-v1"), key=F.col("c_custkey"), name=F.col("c_name"), segment=F.col("c_mktsegment"))
    return own.select("c_custkey", surrogate_key(F.lit("dim_customer|v1"), text(F.col("c_custkey"))).alias("sk"), row.alias("row_hash"))


@query("""WITH h AS (SELECT sha256(c_custkey || '|' || c_name || '|' || c_mktsegment) AS h FROM customer), p AS (SELECT substr(h, 1, 2) AS part, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM h GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS row_count, sha256(string_agg(h, chr(10) ORDER BY part)) AS checksum FROM p""")
def state_checksum(spark, d):
    return tables.checksum(table(spark, d, "customer"), F.concat_ws("|", text(F.col("c_custkey")), "c_name", "c_mktsegment"), digits=2)


_COLUMNS = {"c_name": "c_name LIKE 'Customer#%'", "c_mktsegment": "true", "c_nation": "true"}


@query(
    "WITH c AS (SELECT c_name, c_mktsegment, nullif(c_nationkey, 0)::VARCHAR AS c_nation FROM customer) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) FILTER (WHERE trim({c}) = '') AS blank_count, count(DISTINCT {c}) AS distinct_count, min(length({c}))::INT AS min_length, max(length({c}))::INT AS max_length, "
        + ("count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY'))" if c == "c_mktsegment" else "0")
        + " AS domain_violations, "
        + ("count(*) FILTER (WHERE NOT regexp_full_match(c_name, 'Customer#[0-9]{8}[0-4]'))" if c == "c_name" else "0")
        + " AS pattern_violations FROM c"
        for c in _COLUMNS
    )
)
def column_profile(spark, d):
    own = table(spark, d, "customer").withColumn("c_nation", text(F.nullif("c_nationkey", F.lit(0))))
    return tables.profile(own, list(_COLUMNS), {"c_mktsegment": ["BUILDING", "MACHINERY"]}, {"c_name": r"\ACustomer#[0-9]{8}[0-4]\z"})


@query("SELECT o_orderstatus, CAST(CAST(quantile_cont(CAST(o_totalprice AS DECIMAL(28,6)), 0.25) AS DECIMAL(30,4)) AS VARCHAR) AS p25, CAST(CAST(median(CAST(o_totalprice AS DECIMAL(28,6))) AS DECIMAL(30,4)) AS VARCHAR) AS p50, count(*) AS n FROM orders GROUP BY 1")
def quantile_profile(spark, d):
    own = table(spark, d, "orders").withColumn("price", money("o_totalprice").cast("decimal(28,6)"))
    q = tables.exact_quantiles(own, ["o_orderstatus"], "price", {"p25": (1, 4), "p50": (1, 2)}, 4)
    n = own.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return q.join(n, "o_orderstatus").select("o_orderstatus", text(F.col("p25")).alias("p25"), text(F.col("p50")).alias("p50"), "n")


@query("SELECT CAST(l_quantity AS INT)::VARCHAR AS value, count(*) AS frequency FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_values(spark, d):
    return tables.top_values(table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("int")), "q")


# Rules --------------------------------------------------------------------------------------------

RULES = """
marked AS (SELECT o.*, count(*) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) AS same_day, count(*) OVER (PARTITION BY o_custkey) AS n, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders o),
hit AS (
 SELECT DISTINCT * FROM (
 SELECT 'customer' AS entity_type, CAST(o_custkey AS VARCHAR) AS business_key, CAST(o_orderkey AS VARCHAR) AS row_uid, 'R-001' AS rule_id, 'NORMALIZE' AS disposition FROM marked WHERE o_orderpriority = '4-NOT SPECIFIED'
 UNION ALL SELECT 'customer', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), 'R-002', 'QUARANTINE' FROM marked WHERE price > 499000
 UNION ALL SELECT 'customer', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), 'R-003', 'QUARANTINE' FROM marked WHERE same_day > 1
 UNION ALL SELECT 'customer', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), 'R-004', 'ACCEPT' FROM marked WHERE o_orderstatus NOT IN ('O', 'F')
 UNION ALL SELECT 'customer', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), 'R-005', 'WARN' FROM marked WHERE n < 5)),
rule AS (SELECT entity_type, business_key, rule_id, max(disposition) AS disposition, count(DISTINCT row_uid) AS row_count FROM hit GROUP BY ALL),
decided AS (SELECT 'customer' AS entity_type, CAST(c_custkey AS VARCHAR) AS business_key, CASE WHEN count(rule_id) FILTER (WHERE disposition = 'QUARANTINE') > 0 THEN 'QUARANTINE' WHEN count(rule_id) > 0 THEN 'ACCEPT_WITH_FLAGS' ELSE 'ACCEPT' END AS disposition, count(rule_id) AS matched_rules FROM customer LEFT JOIN rule ON business_key = CAST(c_custkey AS VARCHAR) GROUP BY c_custkey)"""


def found(spark, d) -> DataFrame:
    own = table(spark, d, "orders").withColumns({"day": F.col("o_orderdate").cast("date"), "uid": text(F.col("o_orderkey"))})
    own = own.withColumns({"same_day": F.count("*").over(Window.partitionBy("o_custkey", "day")), "n": F.count("*").over(Window.partitionBy("o_custkey"))})
    checks = [
        rules.Rule("R-001", rules.NORMALIZE, F.col("o_orderpriority") == "4-NOT SPECIFIED"), rules.Rule("R-002", rules.QUARANTINE, money("o_totalprice") > 499000), rules.Rule("R-003", rules.QUARANTINE, F.col("same_day") > 1),
        rules.Rule("R-004", rules.ACCEPT, ~F.col("o_orderstatus").isin("O", "F")), rules.Rule("R-005", rules.WARN, F.col("n") < 5),
    ]
    return rules.hits(own, "orders", "customer", text(F.col("o_custkey")), "uid", checks)


def decisions(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    hit = found(spark, d)
    by_rule = rules.entity_rules(hit)
    every = table(spark, d, "customer").select(F.lit("customer").alias("entity_type"), text(F.col("c_custkey")).alias("business_key"))
    return hit, by_rule, rules.dispositions(every, by_rule)


@query(f"WITH {RULES} SELECT * FROM hit")
def rule_hits(spark, d):
    return found(spark, d).drop("dataset")


@query(f"WITH {RULES} SELECT * FROM rule")
def entity_rule(spark, d):
    return decisions(spark, d)[1]


@query(f"WITH {RULES} SELECT * FROM decided")
def entity_disposition(spark, d):
    return decisions(spark, d)[2].select("entity_type", "business_key", "disposition", "matched_rules")


@query(f"""WITH {RULES}, bad AS (SELECT business_key FROM decided WHERE disposition = 'QUARANTINE'),
own AS (SELECT row_uid, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS r FROM hit WHERE disposition = 'QUARANTINE' GROUP BY 1), ent AS (SELECT business_key, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS r FROM rule WHERE disposition = 'QUARANTINE' GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS row_uid, CAST(o_custkey AS VARCHAR) AS business_key, coalesce(own.r, ent.r, '<UNSPECIFIED>') AS rule_ids FROM orders JOIN bad ON business_key = CAST(o_custkey AS VARCHAR) LEFT JOIN own ON own.row_uid = CAST(o_orderkey AS VARCHAR) LEFT JOIN ent ON ent.business_key = bad.business_key""")
def quarantine_rows(spark, d):
    hit, by_rule, decided = decisions(spark, d)
    rows = table(spark, d, "orders").select(F.lit("orders").alias("dataset"), F.lit("customer").alias("entity_type"), text(F.col("o_custkey")).alias("business_key"), text(F.col("o_orderkey")).alias("row_uid"))
    return rules.quarantined(rows, decided, hit, by_rule).drop("dataset")


@query("""SELECT 'ORDER_UNIQUENESS' AS check_id, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS violation_count
UNION ALL SELECT 'CUSTOMER_ORPHAN', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'LINE_WITHOUT_ORDER', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 <> 0))
UNION ALL SELECT 'SHIPPED_BEFORE_ORDER', (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate)""")
def validation_panel(spark, d):
    o, l, c = (table(spark, d, t) for t in ("orders", "lineitem", "customer"))  # noqa: E741
    some = o.filter("o_orderkey % 100 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return rules.panel({
        "ORDER_UNIQUENESS": o.groupBy("o_orderkey").count().filter("count > 1"), "CUSTOMER_ORPHAN": tables.missing_references(o, c.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]),
        "LINE_WITHOUT_ORDER": tables.missing_references(l, some, ["l_orderkey"]), "SHIPPED_BEFORE_ORDER": l.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey").filter("l_shipdate < o_orderdate"),
    })


# Sources and sinks --------------------------------------------------------------------------------


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'a,\"b\" ' || c_custkey END AS note FROM customer")
def csv_round_trip(spark, d):
    """A result written as CSV and scanned strictly: all text, blanks kept, header checked."""
    own = table(spark, d, "customer").select(text(F.col("c_custkey")).alias("c_custkey"), "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat(F.lit('a,"b" '), text(F.col("c_custkey")))).alias("note"))
    folder = scratch(spark, "csv")
    own.write.option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(folder)
    back = spark.read.schema(", ".join(f"{c} string" for c in own.columns)).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("escape", '"').csv(folder)
    return back.select(*(F.coalesce(c, F.lit("")).alias(c) for c in own.columns))


# Module queries -----------------------------------------------------------------------------------


@query(f"""WITH {RATES.replace("rates AS", "r0 AS")}, l AS (SELECT DISTINCT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_returnflag FROM lineitem)
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS event_date, coalesce(p_type, 'UNKNOWN') AS destination_country, CAST(CAST(round(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(20,4)) * coalesce(rate, CAST(1 AS DECIMAL(17,8)))), 2) AS DECIMAL(28,2)) AS VARCHAR) AS revenue
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_returnflag = 'N') JOIN orders ON o_orderkey = l_orderkey LEFT JOIN r0 ON day = CAST(o_orderdate AS DATE) LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 10 <> 0 GROUP BY ALL""")
def daily_revenue(spark, d):
    """The daily revenue by country of order events, with lines as events; lines come twice, as if sent again."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), text(F.col("o_orderdate").cast("date")).alias("event_ts"))
    lines = table(spark, d, "lineitem").join(o, "l_orderkey").select(
        F.concat_ws("-", text(F.col("l_orderkey")), text(F.col("l_linenumber")), text(F.col("l_partkey")), text(F.col("l_extendedprice"))).alias("event_id"), F.when(F.col("l_returnflag") == "N", "paid").otherwise("other").alias("event_type"),
        "event_ts", F.lit("USD").alias("currency"), money("l_extendedprice").alias("amount"), F.col("l_partkey").alias("product_id"),
    )
    products = table(spark, d, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("destination_country"))
    own = rates(spark, d).select(text(F.col("day")).alias("rate_date"), F.lit("USD").alias("currency"), F.col("rate").alias("rate_to_twd"))
    return metrics.daily_revenue(lines.unionByName(lines), products, own).withColumn("revenue", text(F.col("revenue")))


STAR = """
fact AS (SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS full_date, o_custkey AS member_id, o_orderkey % (SELECT count(*) FROM part) AS product_sk, CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'F' THEN 'paid' ELSE 'cancelled' END AS order_status, CAST(o_totalprice AS DECIMAL(18,2)) AS amount_twd, CAST(o_orderkey % 10 AS DECIMAL(18,2)) AS coupon_discount_twd FROM orders),
member AS (SELECT c_custkey AS member_id, CASE WHEN c_custkey % 3 = 0 THEN '金卡' ELSE '一般' END AS member_level, 'N' || c_nationkey AS city, DATE '1900-01-02' AS valid_from, DATE '1996-12-31' AS valid_to, false AS is_current FROM customer
 UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '白金' ELSE '一般' END, 'N' || c_nationkey, DATE '1997-01-01', DATE '9999-12-31', true FROM customer),
product AS (SELECT p_partkey AS product_sk, p_name AS product_name, p_type AS product_type, CASE p_size % 4 WHEN 0 THEN 'JP' WHEN 1 THEN 'KR' WHEN 2 THEN 'TW' ELSE 'US' END AS destination_country FROM part),
live AS (SELECT * FROM fact WHERE order_status <> 'cancelled'),
fm AS (SELECT * FROM live JOIN member USING (member_id) WHERE full_date BETWEEN valid_from AND valid_to),
fp AS (SELECT * FROM fact JOIN product USING (product_sk))"""
A, B = "1996-12", "1997-01"


def star(spark, d) -> metrics.Star:
    parts = table(spark, d, "part")
    n = parts.agg(F.count("*").alias("n_parts"))
    fact = table(spark, d, "orders").crossJoin(F.broadcast(n))  # one row, a count
    status = F.when(F.col("o_orderstatus") == "O", "completed").when(F.col("o_orderstatus") == "F", "paid").otherwise("cancelled")
    fact = fact.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("date").alias("full_date"), F.col("o_custkey").alias("member_id"), (F.col("o_orderkey") % F.col("n_parts")).alias("product_sk"), status.alias("order_status"), money("o_totalprice").alias("amount_twd"), (F.col("o_orderkey") % 10).cast("decimal(18,2)").alias("coupon_discount_twd"))
    city = F.concat(F.lit("N"), text(F.col("c_nationkey")))
    customer = table(spark, d, "customer")

    def version(level: Column, a: str, b: str, current: bool) -> DataFrame:
        return customer.select(F.col("c_custkey").alias("member_id"), level.alias("member_level"), city.alias("city"), F.lit(a).cast("date").alias("valid_from"), F.lit(b).cast("date").alias("valid_to"), F.lit(current).alias("is_current"))

    old = version(F.when(F.col("c_custkey") % 3 == 0, "金卡").otherwise("一般"), "1900-01-02", "1996-12-31", False)
    new = version(F.when(F.col("c_custkey") % 2 == 0, "白金").otherwise("一般"), "1997-01-01", "9999-12-31", True)
    country = F.element_at(F.array(*(F.lit(x) for x in ("JP", "KR", "TW", "US"))), F.col("p_size") % 4 + 1)
    product = parts.select(F.col("p_partkey").alias("product_sk"), F.col("p_name").alias("product_name"), F.col("p_type").alias("product_type"), country.alias("destination_country"))
    return {"fact_order": fact, "dim_member": old.unionByName(new), "dim_product": product}


def _div(part: str, whole: str, scale: int = 6) -> str:
    """Whole-number division of decimals with four digits."""
    return f"CAST(CAST(CAST({part} AS DECIMAL(30,4)) * {10**scale} * 10000 AS HUGEINT) // CAST(CAST({whole} AS DECIMAL(30,4)) * 10000 AS HUGEINT) AS BIGINT)"


_REVENUE = "CAST(CAST(sum(amount_twd) AS DECIMAL(28,2)) AS VARCHAR)"
_MONTH = "strftime(full_date, '%Y-%m')"
METRIC_SQL = {
    "q01": f"SELECT {_REVENUE} AS revenue FROM live WHERE {_MONTH} = '{A}'",
    "q02": f"SELECT {_REVENUE} AS revenue FROM fm WHERE {_MONTH} = '{A}' AND member_level = '白金'",
    "q03": f"SELECT first::VARCHAR AS first, second::VARCHAR AS second, CASE WHEN second > first THEN 'up' WHEN second < first THEN 'down' ELSE 'flat' END AS trend FROM (SELECT CAST(sum(amount_twd) FILTER (WHERE {_MONTH} = '{A}') AS DECIMAL(28,2)) AS first, CAST(sum(amount_twd) FILTER (WHERE {_MONTH} = '{B}') AS DECIMAL(28,2)) AS second FROM live)",
    "q04": f"SELECT destination_country, count(*) FILTER (WHERE order_status = 'cancelled') AS cancelled, count(*) AS orders, {_div("count(*) FILTER (WHERE order_status = 'cancelled')", 'count(*)')} AS rate_ppm FROM fp GROUP BY 1 ORDER BY rate_ppm DESC, 1 LIMIT 1",
    "q05": f"SELECT {_div("sum(CASE WHEN member_level IN ('白金', '金卡') THEN amount_twd ELSE 0 END)", 'sum(amount_twd)')} AS share_ppm FROM fm",
    "q06": f"SELECT product_type, {_REVENUE} AS revenue FROM fp WHERE order_status <> 'cancelled' AND {_MONTH} = '{B}' GROUP BY 1",
    "q07": f"SELECT city, {_div('sum(amount_twd - coupon_discount_twd)', 'count(*)', 4)} AS average_net_e4 FROM fm GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "q08": f"SELECT isodow(full_date) >= 6 AS is_weekend, count(*) AS orders FROM fact WHERE {_MONTH} = '{A}' GROUP BY 1",
    "q09": "SELECT count(*) AS members FROM (SELECT member_id FROM fact GROUP BY 1 HAVING count(*) >= 2)",
    "q10": f"SELECT product_sk, r::VARCHAR AS revenue, product_name FROM (SELECT product_sk, CAST(sum(amount_twd) AS DECIMAL(28,2)) AS r FROM live WHERE {_MONTH} = '{B}' GROUP BY 1 ORDER BY r DESC, 1 LIMIT 5) JOIN product USING (product_sk)",
    "q11": f"SELECT order_status = 'cancelled' AS is_cancelled, {_div('sum(coupon_discount_twd)', 'count(*)', 4)} AS average_discount_e4 FROM fact GROUP BY 1",
    "q12": f"SELECT {_MONTH} AS month, {_REVENUE} AS revenue FROM fp WHERE order_status <> 'cancelled' AND destination_country = 'JP' AND {_MONTH} IN ('{A}', '{B}') GROUP BY 1",
    "q13": f"SELECT member_level, {_div('sum(amount_twd)', 'count(*)', 4)} AS average_amount_e4 FROM fm GROUP BY 1",
    "q14": f"SELECT month, n::VARCHAR AS net_revenue FROM (SELECT {_MONTH} AS month, CAST(sum(amount_twd - coupon_discount_twd) AS DECIMAL(28,2)) AS n FROM live WHERE {_MONTH} IN ('{A}', '{B}') GROUP BY 1) ORDER BY n DESC, month LIMIT 1",
    "q15": f"SELECT {_div("count(*) FILTER (WHERE order_status = 'completed')", 'count(*)')} AS share_ppm FROM fact",
}


def _metric(key: str) -> Query:
    def run(spark, d):
        own = metrics.QUESTIONS[key](star(spark, d), A, B)
        return own.select(*(text(F.col(c)).alias(c) if t.startswith("decimal") else F.col(c) for c, t in own.dtypes))

    return run


for _key, _sql in METRIC_SQL.items():
    query(f"WITH {STAR} {_sql}", f"metric_{_key}")(_metric(_key))


_SUM = "CAST(sum(f.amount_twd) AS DECIMAL(28,2)) AS revenue"
_LIVE, _IN_A, _IN_B = "f.order_status <> 'cancelled'", "year(f.full_date) = 1996 AND month(f.full_date) = 12", "year(f.full_date) = 1997 AND month(f.full_date) = 1"
_DATED = "JOIN dim_member m ON f.member_id = m.member_id AND f.full_date BETWEEN m.valid_from AND m.valid_to"
#: Candidate answers, some of which keep to the definitions, and what they depart from.
ANSWERS = [
    ("A01", "q01", f"SELECT {_SUM} FROM fact_order f WHERE {_LIVE} AND {_IN_A}", ""),
    ("A02", "q02", f"SELECT {_SUM} FROM fact_order f {_DATED} WHERE {_IN_A} AND m.member_level = '白金'", "cancelled_counted"),
    ("A03", "q02", f"SELECT {_SUM} FROM fact_order f JOIN dim_member m ON f.member_id = m.member_id WHERE {_LIVE} AND {_IN_A} AND m.member_level = '白金'", "member_undated"),
    ("A04", "q09", "SELECT count(*) AS members FROM (SELECT f.member_id FROM fact_order f GROUP BY f.member_id HAVING count(*) >= 2) t", ""),
    ("A05", "q06", f"SELECT p.product_type, {_SUM} FROM fact_order f JOIN dim_product p ON f.product_sk = p.product_sk WHERE {_LIVE} AND {_IN_B} GROUP BY p.product_type", ""),
    ("A06", "q06", f"SELECT p.product_type, {_SUM} FROM fact_order f JOIN dim_product p ON f.product_sk = p.product_sk WHERE {_LIVE} AND month(f.full_date) = 1 GROUP BY p.product_type", "month_without_year"),
    ("A07", "q07", f"SELECT m.city, CAST(floor(sum(f.amount_twd) * 10000 / count(*)) AS BIGINT) AS average_net_e4 FROM fact_order f {_DATED} WHERE {_LIVE} GROUP BY m.city ORDER BY 2 DESC, 1 LIMIT 1", "gross_for_net"),
    ("A08", "q10", f"SELECT f.product_sk, {_SUM}, min(p.product_name) AS product_name FROM fact_order f JOIN dim_product p ON f.product_sk = p.product_sk WHERE {_LIVE} AND {_IN_B} GROUP BY f.product_sk ORDER BY f.product_sk LIMIT 5", ""),
    ("A09", "q12", f"SELECT '{B}' AS month, {_SUM} FROM fact_order f JOIN dim_product p ON f.product_sk = p.product_sk WHERE {_LIVE} AND p.destination_country = 'JP' AND {_IN_B}", ""),
    ("A10", "q14", f"SELECT '{A}' AS month, CAST(sum(f.amount_twd - f.coupon_discount_twd) AS DECIMAL(28,2)) AS net_revenue FROM fact_order f WHERE {_IN_A}", "cancelled_counted"),
    ("A11", "q15", "SELECT CAST(floor(sum(CASE WHEN f.order_status = 'completed' THEN 1000000 ELSE 0 END) / count(*)) AS BIGINT) AS share_ppm FROM fact_order f WHERE f.order_status <> 'cancelled'", ""),
    ("A12", "q04", "SELECT p.destination_country, avg(f.cancel_flag) AS rate FROM fact_order f JOIN dim_product p ON f.product_sk = p.product_sk GROUP BY p.destination_country", None),
]


def _judged(answer: str, question: str, sql: str, departs: str | None) -> str:
    if departs is None:
        return f"SELECT '{answer}' AS answer_id, '{question}' AS question, 'error' AS verdict, '' AS departures"
    own, right = (f"SELECT CAST(COLUMNS(*) AS VARCHAR) FROM ({x})" for x in (sql, METRIC_SQL[question]))
    return f"SELECT '{answer}', '{question}', CASE WHEN EXISTS (({own} EXCEPT ALL {right}) UNION ALL ({right} EXCEPT ALL {own})) THEN 'wrong' ELSE 'right' END, '{departs}'"


@query(f"WITH {STAR}, fact_order AS (SELECT * FROM fact), dim_member AS (SELECT * FROM member), dim_product AS (SELECT * FROM product) " + " UNION ALL ".join(_judged(*x) for x in reversed(ANSWERS)))
def judged_answers(spark, d):
    """Candidate statements for the metrics' questions, judged by the rows they give."""
    return metrics.judge(spark, star(spark, d), [x[:3] for x in ANSWERS], A, B)


@query("""WITH k AS (SELECT s.event_id, count(o.event_id) AS n_known, coalesce(sum(CASE WHEN o.event_type = 'error' THEN 1 ELSE 0 END), 0)::BIGINT AS label_sum FROM events s LEFT JOIN events o ON o.user_id = s.user_id AND o.ts + INTERVAL 1 DAY < s.ts GROUP BY 1)
SELECT event_id, n_known, label_sum, CAST((label_sum * 1000000 + 2000000) // (n_known + 10) AS BIGINT) AS encoding_ppm FROM k""")
def pit_target_encoding(spark, d):
    """The share of errors in a user's history as known: outcomes count a day after their event."""
    own = events(spark, d).withColumns({"label": (F.col("event_type") == "error").cast("int"), "available": F.col("ts") + F.expr("interval 1 day")})
    known = features.known_history(own, own, ["user_id"], "event_id", "ts", "label", "available")
    return known.select("event_id", "n_known", "label_sum", features.smoothed_ppm(F.col("label_sum"), F.col("n_known"), 200_000, 10).alias("encoding_ppm"))


@query("""WITH e AS (SELECT *, (event_type = 'error')::INT AS y, event_id % 4 AS item FROM events),
a AS (SELECT s.event_id, count(o.event_id) AS n, coalesce(sum(o.y), 0) AS s FROM e s LEFT JOIN e o ON o.user_id = s.user_id AND o.item = s.item AND o.ts + INTERVAL 1 DAY < s.ts GROUP BY 1),
b AS (SELECT s.event_id, count(o.event_id) AS n, coalesce(sum(o.y), 0) AS s FROM e s LEFT JOIN e o ON o.user_id = s.user_id AND o.ts + INTERVAL 1 DAY < s.ts GROUP BY 1)
SELECT a.event_id, CAST(CASE WHEN a.n >= 3 THEN (a.s * 1000000 + 2000000) // (a.n + 10) WHEN b.n >= 3 THEN (b.s * 1000000 + 2000000) // (b.n + 10) ELSE 200000 END AS BIGINT) AS encoding_ppm, CASE WHEN a.n >= 3 THEN 0 WHEN b.n >= 3 THEN 1 ELSE 2 END AS level, a.n < 3 AND b.n < 3 AS cold_start FROM a JOIN b USING (event_id)""")
def pit_hierarchical_encoding(spark, d):
    own = events(spark, d).withColumns({"label": (F.col("event_type") == "error").cast("int"), "available": F.col("ts") + F.expr("interval 1 day"), "item": F.col("event_id") % 4})
    return features.hierarchical(own, own, [["user_id", "item"], ["user_id"]], "event_id", "ts", "label", "available")


@query("SELECT part, count(*) AS events, count(DISTINCT user_id) AS users FROM (SELECT user_id, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'train' WHEN ts < TIMESTAMP '2024-01-22' THEN 'valid' ELSE 'test' END AS part FROM events WHERE ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-30') GROUP BY 1")
def temporal_split_counts(spark, d):
    own = events(spark, d).withColumn("available", F.col("ts") + F.expr("interval 1 day"))
    own = features.matured(own, "available", F.lit("2024-01-30").cast("timestamp"))
    return features.split_by_time(own, "ts", "2024-01-15", "2024-01-22").groupBy("part").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))


@query("WITH p AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-03' THEN 'train' WHEN ts < TIMESTAMP '2024-01-22' THEN 'valid' ELSE 'test' END AS part FROM events) SELECT part, user_id IN (SELECT user_id FROM p WHERE part = 'train') AS seen_user_id, count(*) AS rows FROM p WHERE part <> 'train' GROUP BY ALL")
def cold_start_slices(spark, d):
    return features.cold_slices(features.split_by_time(events(spark, d), "ts", "2024-01-03", "2024-01-22"), ["user_id"])


@query("""WITH p AS (SELECT *, ts + INTERVAL 1 DAY AS known, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'train' WHEN ts < TIMESTAMP '2024-01-22' THEN 'valid' ELSE 'test' END AS part FROM events)
SELECT 'OUTCOME_KNOWN_BEFORE' AS "check", count(*) FILTER (WHERE known <= ts) AS violations FROM p UNION ALL SELECT 'OUTCOME_NOT_MATURE', count(*) FILTER (WHERE known > TIMESTAMP '2024-01-30') FROM p
UNION ALL SELECT 'LOGICAL_ID_CROSSES_PARTS', count(*) FROM (SELECT user_id FROM p GROUP BY 1 HAVING count(DISTINCT part) > 1) UNION ALL SELECT 'PARTS_OVERLAP', 0""")
def leakage_panel(spark, d):
    """A split by time alone, with users as what must not cross it: users do, and the last days' outcomes are not known yet."""
    own = features.split_by_time(events(spark, d).withColumn("available", F.col("ts") + F.expr("interval 1 day")), "ts", "2024-01-15", "2024-01-22")
    return features.leakage_checks(own, "user_id", "ts", "available", F.lit("2024-01-30").cast("timestamp"))


# Streams ------------------------------------------------------------------------------------------

MINUTES = "SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, event_type, count(*) AS n, CAST(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS VARCHAR) AS amount FROM events GROUP BY 1, 2"


def _minutes(df: DataFrame) -> DataFrame:
    return df.select(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "event_type", "n", text(F.col("amount").cast("decimal(28,2)")).alias("amount"))


@query(MINUTES)
def minute_window_counts(spark, d):
    return _minutes(stream.minute_counts(events(spark, d)))


@query(MINUTES)
def stream_minute_counts(spark, d):
    """The same counts from a stream with deduplication and a watermark, run to the end of what is there."""
    return _minutes(stream.run_minutes(spark, f"{d}/events.parquet*", scratch(spark, "stream")))


@query("WITH t AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, count(DISTINCT event_type) AS types FROM events GROUP BY ALL) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, types = 1 AS settled FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) = 1")
def stream_latest_conflicts(spark, d):
    """A stream of two deliveries, stopped between them: the latest row of each user by business day; those whose rows of that day differ are told as conflicts."""
    folder = scratch(spark, "latest")
    rows = table(spark, d, "events")
    for n in range(2):
        rows.filter(f"pmod(hash(event_id), 2) = {n}").write.parquet(f"{folder}/in/{n}")
        own = stream.source(spark, f"{folder}/in/*").withColumns({"day": F.col("ts").cast("date"), "sequence": F.lit(0)})
        state = stream.run_latest(own, f"{folder}/run", "user_id", "day", "sequence", ["event_type"])
    return state.select("user_id", text(F.col("day")).alias("day"), (~F.col("conflict")).alias("settled"))


@query("WITH m AS (SELECT max(ts) AS mark FROM events WHERE event_id % 7 <> 0) SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS late, CAST(sum(event_id) AS BIGINT) AS ids FROM events, m WHERE event_id % 7 = 0 AND ts < mark - INTERVAL 10 MINUTE GROUP BY 1")
def stream_late_side_output(spark, d):
    """Of a stream of two deliveries, the events that came more than ten minutes behind what was there before them."""
    folder = scratch(spark, "late")
    rows = table(spark, d, "events")
    for n, delivered in enumerate(("event_id % 7 <> 0", "event_id % 7 = 0")):
        rows.filter(delivered).write.parquet(f"{folder}/in/{n}")
        _, late = stream.run_on_time(stream.source(spark, f"{folder}/in/*"), f"{folder}/run")
    return late.groupBy(text(F.col("ts").cast("date")).alias("day")).agg(F.count("*").alias("late"), F.sum("event_id").alias("ids"))


@query("SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_id % 50 <> 0) AS provisional_n, count(*) AS final_n FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_id % 50 = 0) > 0")
def provisional_final_reconciliation(spark, d):
    own = events(spark, d).withColumn("day", text(F.col("day")))
    late = stream.late_events(own, own.filter("event_id % 50 <> 0"))
    counted = lambda df: df.groupBy("day").agg(F.count("*").alias("n"))
    return stream.reconcile(counted(own.join(late.select("event_id"), "event_id", "left_anti")), counted(own), ["day"], ["n"])
