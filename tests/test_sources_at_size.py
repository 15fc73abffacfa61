"""What the warehouse's queries do at odd values and on larger tables, beside their SQL."""

import re
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import pytest

from millrace import queries, source_queries
from millrace.plans import curated, gates

SF = "/root/testdata/sf0.001"


def rows_of_sql(sql):
    con = duckdb.connect()
    for t in ("orders", "customer", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.execute(sql).fetchall()


def rounded(x, digits):
    return x.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)


def test_ratios_of_totals_that_may_be_zero(spark):
    """A total of zero is left out, wherever the engine divides; all other ratios are those of plain decimals."""
    valued = rows_of_sql(source_queries.with_(source_queries.RAW, f"SELECT currency, gross, total FROM {source_queries._VALUED} WHERE gross IS NOT NULL AND total IS NOT NULL"))
    assert any(total == 0 for _, _, total in valued)
    ratios = defaultdict(list)
    for currency, gross, total in valued:
        if total > 0:
            ratios[currency].append(rounded(rounded(rounded(gross, 8) / total, 12), 8))

    def quantile(values, a, b):
        low, rest = divmod((len(values) - 1) * a, b)
        first, second = values[low], values[min(low + 1, len(values) - 1)]
        return f"{rounded(first + (second - first) * rest / b, 8):f}"

    wanted = {c: tuple(quantile(sorted(v), a, b) for a, b in ((1, 100), (1, 2), (99, 100))) for c, v in ratios.items()}
    assert {r.currency: (r.p01, r.p50, r.p99) for r in queries.QUERIES["analysis_amount_ratios"](spark, SF).collect()} == wanted


#: Of queries the tables that they write; what they read besides are plans over the sources.
WRITES = {
    "staging_fx_rates": set(),
    "detector_fx_003": set(),
    "gate_prod_002": {"issue_hit/products"},
    "gate_mem_001": {"issue_hit/members"},
    "check_member_sk_collision": {"issue_hit/members", "entity_rule/members", "entity_disposition/members", "dim_member"},
    "check_raw_staging_member_count": set(),
    "check_member_accepted_lineage_reconciliation": {"issue_hit/members", "entity_rule/members", "entity_disposition/members", "dim_member"},
    "detector_mem_001": set(),
    "detector_mem_002": set(),
    "detector_mem_011": set(),
    "check_source_file_allowlist": set(),
    "check_batch_reconciliation_uniqueness": set(),
    "analysis_timestamp_formats": set(),
    "detector_ord_002": set(),
    "detector_ord_018": set(),
    "analysis_status_transitions": set(),
    "gate_entity_rule": {"issue_hit/orders", "issue_hit/members", "issue_hit/products", "issue_hit/fx_rates", "entity_rule/orders", "entity_rule/members", "entity_rule/products", "entity_rule/fx_rates"},
    "check_date_key_format": {"issue_hit/orders", "entity_rule/orders", "entity_disposition/orders", "issue_hit/members", "entity_rule/members", "entity_disposition/members", "issue_hit/fx_rates", "entity_rule/fx_rates", "entity_disposition/fx_rates"},
    "check_late_event_flag_reconciliation": {"issue_hit/orders"},
    "check_timezone_assumption_disposition_partition": {"issue_hit/orders", "entity_rule/orders", "entity_disposition/orders"},
    "check_timezone_fact_selected_source_flag": {"issue_hit/orders", "entity_rule/orders", "entity_disposition/orders", "issue_hit/members", "entity_rule/members", "entity_disposition/members", "dim_member", "issue_hit/products", "entity_rule/products", "entity_disposition/products"},
    "star_event_lineage": set(),
    "check_fact_latest_state": {"issue_hit/orders", "entity_rule/orders", "entity_disposition/orders", "issue_hit/members", "entity_rule/members", "entity_disposition/members", "dim_member", "issue_hit/products", "entity_rule/products", "entity_disposition/products"},
}


@pytest.mark.parametrize("name", sorted(WRITES))
def test_a_query_writes_no_table_of_others(spark, monkeypatch, name):
    """Every query once wrote the whole warehouse, some eight times its input."""
    monkeypatch.setattr(source_queries, "_BUILT", {})
    wrote, put = set(), source_queries.Built.put
    monkeypatch.setattr(source_queries.Built, "put", lambda self, table, df: wrote.add(table) or put(self, table, df))
    queries.QUERIES[name](spark, SF)
    assert wrote == WRITES[name]


#: Queries that begin with the gate of the orders.
IN_SHARES = ["check_late_event_flag_reconciliation", "check_timezone_fact_selected_source_flag", "check_fact_latest_state", "check_date_key_format", "check_timezone_assumption_disposition_partition", "gate_entity_rule", "gate_issue_hit"]


@pytest.mark.parametrize("name", IN_SHARES)
def test_orders_in_shares_give_the_rows_of_the_whole(spark, monkeypatch, name):
    """The gate of the orders once shuffled all of them at once, some 2.9 GB at 9 million orders; a share after the other gives the same rows."""
    monkeypatch.setattr(source_queries, "_BUILT", {})
    monkeypatch.setattr(source_queries, "SHARE", 500, raising=False)
    sizes, found = [], gates.found
    monkeypatch.setattr(gates, "found", lambda t, d: (sizes.append(t["orders"].count()) if d == "orders" else None, found(t, d))[1])
    rows = [tuple(r) for r in queries.QUERIES[name](spark, SF).collect()]
    whole = source_queries.built(spark, SF)[source_queries.ORDERS].count()
    assert sum(sizes) == whole and max(sizes) < 1000 < whole
    assert sorted(rows, key=repr) == sorted(rows_of_sql(queries.ORACLE_SQL[name]), key=repr)


def test_a_share_written_again_replaces_its_first_attempt(spark):
    t = source_queries.Built(spark, SF)

    def broken():
        yield spark.range(3)
        raise RuntimeError

    with pytest.raises(RuntimeError):
        t.put("x", broken())
    assert sorted(r.id for r in t.put("x", (spark.range(i, i + 3) for i in (0, 3))).collect()) == [0, 1, 2, 3, 4, 5]


def plan_nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from plan_nodes(plan.children().apply(i))


def dealt_by(spark, df):
    """What the rows of a plan are dealt by, as if no table were small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_versions_of_members_are_made_where_the_rows_of_a_member_are(spark):
    """Snapshots, as wide as they are, were once dealt anew by their key, by their day and by member again."""
    t = source_queries.Built(spark, SF)
    assert not [x for x in dealt_by(spark, curated.dim_member(t["members"], t["entity_disposition/members"])) if "extract_date" in x or "_key" in x]


def test_the_lineage_of_members_is_made_where_the_rows_of_a_member_are(spark):
    t = source_queries.Built(spark, SF)
    assert [x.split("#")[0] for x in dealt_by(spark, t["member_lineage"]) if "_key" in x] == ["_key"]  # the versions, by member


def test_events_of_orders_meet_by_their_hashes(spark):
    """All that an event's hash is made of was once dealt to where the rows of its order meet, and the hash made there."""
    nodes = plan_nodes(source_queries.Built(spark, SF)["event_lineage"]._jdf.queryExecution().optimizedPlan())
    dealt = [[n.output().apply(i).name() for i in range(n.output().size())] for n in nodes if n.nodeName() == "RepartitionByExpression"]
    assert [sorted(x) for x in dealt] == [["_event", "batch_order", "order_id", "source_row_uid"]]


def calls_in_shares(spark, monkeypatch, query, module, name):
    """How often a query that takes the orders in two shares calls a function."""
    monkeypatch.setattr(source_queries, "_BUILT", {})
    monkeypatch.setattr(source_queries, "SHARE", 1500)
    calls, whole = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a: (calls.append(a), whole(*a))[1])
    queries.QUERIES[query](spark, SF)
    assert len(source_queries.built(spark, SF).shares()) == 2
    return len(calls)


def test_rules_of_orders_are_counted_by_shares(spark, monkeypatch):
    """The hits of all orders once met at once. Rules on members and prices got rows that had been dealt by order for nothing."""
    columns, with_members = [], gates.with_members
    monkeypatch.setattr(gates, "with_members", lambda orders, members: (columns.extend(orders.columns), with_members(orders, members))[1])
    assert calls_in_shares(spark, monkeypatch, "gate_entity_rule", source_queries, "entity_rules") == 2 + 3
    assert "is_canonical_event" not in columns


def test_orders_are_decided_by_shares(spark, monkeypatch):
    assert calls_in_shares(spark, monkeypatch, "check_timezone_assumption_disposition_partition", source_queries, "dispositions") == 2


def test_dates_of_orders_are_told_by_shares(spark, monkeypatch):
    assert calls_in_shares(spark, monkeypatch, "check_date_key_format", curated, "accepted_dates") == 2 + 2
