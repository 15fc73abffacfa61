import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace import contracts as C
from millrace.functions.identity import surrogate_key
from millrace.plans import build, detectors
from millrace.plans.build import Builder, BuildError
from millrace.sources.files import HeaderMismatch, fingerprint, read_all, read_raw

from .conftest import CASES, EACH, HISTORY, SNAPSHOTS, batch, history_ids, ids, member_id, snapshot, write_csv


def uri(path):
    return f"file://{path}"


@pytest.fixture(scope="module")
def base(spark, base_sources, tmp_path_factory):
    b = Builder(spark, uri(base_sources), uri(tmp_path_factory.mktemp("wh")))
    assert set(b.build_base().values()) == {0}
    return {k: df.cache() for k, df in b.tables().items()}


@pytest.fixture(scope="module")
def facts(base):
    return {r.order_id: r for r in base["fact_order"].collect()}


def test_all_base_checks_have_names(base):
    from millrace.plans.validation import base_checks

    assert len(base_checks(base)) == 32


def test_checks_miss_no_snapshot_without_lineage_and_no_row_without_disposition(base):
    from millrace.plans.validation import base_checks

    lineage = "MEMBER_ACCEPTED_LINEAGE_RECONCILIATION"
    zone = "TIMEZONE_ASSUMPTION_DISPOSITION_PARTITION"
    whole, counted = base_checks(base), lambda df: df.first().violation_count
    assert whole[lineage].count() == 0 and counted(whole[zone]) == 0
    assert base_checks(base | {"member_lineage": base["member_lineage"].orderBy("source_row_uid").offset(1)})[lineage].count() == 1
    rows = base["orders"].filter("timezone_assumed").count()
    assert base_checks(base | {"entity_disposition": base["entity_disposition"].filter("entity_type <> 'order'")})[zone].first().violation_count == rows > 0


def test_facts_of_each_case(facts):
    of = lambda name: [facts[i] for i in ids(name)]
    assert set(facts) == {i for name, case in CASES.items() if case.accepted for i in ids(name)}
    assert {f.duplicate_source_row_count for f in of("sent twice")} == {1} and {f.duplicate_source_row_count for f in of("usual")} == {0}
    assert {f.order_status for f in of("moves on")} == {"completed"} and {f.channel for f in of("moves on")} == set(EACH)
    assert all(f.product_sk == 0 and f.unknown_product_flag and f.price_check_not_evaluable for f in of("unknown product"))
    assert all(f.member_sk == 0 and f.unknown_member_flag for f in of("member in a gap")) and all(f.member_sk for f in of("member after a gap"))
    assert {f.gross_amount_twd for name in ("alias of the currency", "dollars", "yen") for f in of(name)} == {Decimal("640.00")}
    assert {(f.original_currency, f.currency) for f in of("alias of the currency")} == {("NTD", "TWD")}
    assert {(f.gross_amount_twd_exact, f.gross_amount_twd) for f in of("half a cent")} == {(Decimal("640.005"), Decimal("640.01"))}
    assert all(f.order_status == "paid" and f.lifecycle_warning for f in of("reopened"))
    assert all(f.fx_date_sk == f.order_date_sk for f in facts.values())


def test_equal_instants_are_one_invariant(base):
    seen = {r.order_id: r.n for r in base["orders"].groupBy("order_id").agg(F.countDistinct("invariant_hash").alias("n")).collect()}
    assert {seen[i] for name in ("same instant in UTC", "same instant without zone") for i in ids(name)} == {1} and {seen[i] for i in ids("created anew")} == {2}


def test_members(base):
    dim = {}
    for r in base["dim_member"].filter("not is_unknown").orderBy("member_id", "valid_from").collect():
        dim.setdefault(r.member_id, []).append(r)
    of = lambda name: dim.get(member_id(name), [])
    day = dt.date
    assert [(r.birth_date, r.birth_date_restatement, r.birth_date_sentinel) for r in of("restated birth")] == [(day(1975, 8, 9), True, True)]
    assert [(r.birth_date, r.birth_date_unknown) for r in of("unknown birth")] == [(None, True)]
    assert not of("two births") and len(of("sent twice")) == 1
    assert [(r.member_level, r.city, r.source_extract_date) for r in of("moved and rose")] == [("一般", "屏東", day(2026, 4, 12)), ("銀卡", "台東", day(2026, 5, 20))]
    assert [(r.valid_from, r.valid_to) for r in of("clash on a day")] == [(day(2026, 4, 12), day(2026, 6, 2)), (day(2026, 6, 25), day(9999, 12, 31))]
    assert base["member_lineage"].join(base["dim_member"].filter(F.col("member_id") == member_id("sent twice")), "member_sk").count() == 2
    unknown = base["dim_member"].filter("is_unknown").first()
    assert unknown.member_sk == 0 and unknown.member_name == "Unknown Member"


def test_every_raw_row_is_accounted_for(base):
    quarantined = {r.row_uid for r in base["quarantine_row"].filter("dataset = 'orders'").collect()}
    refused = {r.business_key for r in base["entity_disposition"].filter("entity_type = 'order' and not is_eligible").collect()}
    rows = base["orders"].select("source_row_uid", "order_id").collect()
    assert {r.source_row_uid for r in rows if r.order_id in refused} == quarantined
    assert base["quarantine_row"].filter("rule_ids = '<UNSPECIFIED>'").count() == 0


def test_dates_are_continuous_without_sentinels(base):
    row = base["dim_date"].agg(F.min("full_date").alias("a"), F.max("full_date").alias("b"), F.count("*").alias("n")).first()
    assert row.a == dt.date(1975, 8, 9) and (row.b - row.a).days + 1 == row.n


def test_published_product_keys(spark):
    import hashlib

    ids = spark.range(1, 301).select(F.concat(F.lit("P"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("p"))
    rows = ids.select("p", surrogate_key(F.lit("dim_product"), F.lit("v1"), F.col("p")).alias("sk")).orderBy("p").collect()
    assert all(0 < r.sk < 2**60 for r in rows) and len({r.sk for r in rows}) == 300
    first = int(hashlib.sha256(b"dim_product|v1|P00001").hexdigest()[:15], 16)
    assert rows[0].sk == first


def test_partitions_do_not_change_the_state(spark, base):
    from millrace.operators.states import latest

    own = base["orders"].filter("is_canonical_event")
    a = latest(own.repartition(7), ["order_id"], "updated_at", ["canonical_event_hash"]).select("order_id", "canonical_event_hash").collect()
    b = latest(own.repartition(2, "product_id"), ["order_id"], "updated_at", ["canonical_event_hash"]).select("order_id", "canonical_event_hash").collect()
    assert sorted(a) == sorted(b)


def test_detectors(spark, base_sources):
    raw = {c.dataset: read_all(spark, uri(base_sources), C.Contract(c.dataset, c.key, c.columns, c.files[:1])).cache() for c in C.CONTRACTS.values()}
    assert len(detectors.DETECTORS) == 47
    got = {r.rule_id: r for r in detectors.summary(raw).collect()}
    counts = {k: r.row_count for k, r in got.items()}
    planted = {r for case in CASES.values() for r in case.found}
    assert {r: counts[r] for r in planted} == {r: len(EACH) * sum(case.found.get(r, 0) for case in CASES.values()) for r in planted}
    assert counts["MEM-001"] == 2 and counts["MEM-003"] == 2 and counts["MEM-009"] == 2 and counts["MEM-011"] == 2 and counts["PROD-006"] == 0 and counts["FX-004"] == 94
    assert got["ORD-002"].finding == "EXPECTED_CONDITION" and got["ORD-006"].finding == "CONTROL_CHECK"
    assert all(len(r.samples or []) == min(3, r.row_count) for r in got.values())
    assert counts == {r: detectors.run(raw, r).count() for r in detectors.DETECTORS}
    for name, analysis in detectors.ANALYSES.items():
        assert analysis(raw).collect() is not None, name
    assert {r.semantics: r.members for r in detectors.birth_semantics(raw).collect()} == {"restated": 1, "unknown": 1}


def test_a_detector_with_other_columns_is_refused(spark, monkeypatch):
    monkeypatch.setitem(detectors.DETECTORS, "ORD-001", lambda raw: raw["orders"])
    with pytest.raises(detectors.DetectorSchema):
        detectors.run({"orders": spark.range(1)}, "ORD-001")


def test_profiles(spark, base_sources):
    from millrace.plans import profiling

    raw = read_raw(spark, f"file://{base_sources}/members.csv", C.MEMBERS, "members.csv").cache()
    got = {r.column_name: r for r in profiling.columns(raw, C.MEMBERS).collect()}
    rows = [(n, *row) for n, own in SNAPSHOTS.values() for row in own]
    assert got["birth_date"].sentinel_count == 2 and got["member_id"].distinct_count == len(SNAPSHOTS) and got["member_level"].domain_violations == 0 and got["extract_date"].parse_failures == 0
    assert {r.column_name: r.minimum for r in profiling.typed_ranges(raw, C.MEMBERS).collect()}["extract_date"] == "2026-04-12"
    one = profiling.files(raw, C.MEMBERS).first()
    assert (one.row_count, one.duplicate_groups, one.surplus_rows, one.repeated_keys) == (len(rows), 1, 1, 2)
    top = {(r.column_name, r.place): (r.value, r.frequency) for r in profiling.top_values(raw, C.MEMBERS).collect()}
    assert top[("member_level", 1)] == ("一般", 5) and top[("member_name", 1)][0] == "<HIDDEN>"
    orders = read_raw(spark, f"file://{base_sources}/orders_base.csv", C.ORDERS, "orders_base.csv")
    assert {r.column_name: str(r.p50) for r in profiling.quantiles(orders, C.ORDERS).collect()}["amount"] == "640.00000000"


def test_csv_is_strict(spark, tmp_path):
    path = tmp_path / "fx_rates.csv"
    write_csv(path, ["rate_date", "currency", "other"], [["2026-05-01", "USD", "1"]])
    with pytest.raises(HeaderMismatch):
        fingerprint(spark, uri(path), C.FX_RATES)
    write_csv(path, C.FX_RATES.names, [["2026-05-01", "", "1"], ["x,y", "a\nb", ' "q" ']])
    rows = read_raw(spark, uri(path), C.FX_RATES, "fx_rates.csv").orderBy("source_row_number").collect()
    assert [(r.rate_date, r.currency, r.rate_to_twd, r.source_row_number) for r in rows] == [("2026-05-01", "", "1", 1), ("x,y", "a\nb", ' "q" ', 2)]
    assert len({r.source_row_uid for r in rows}) == 2


def test_batches_replay_and_lineage(spark, batch_sources, tmp_path):
    b = Builder(spark, uri(batch_sources), uri(tmp_path / "wh"))
    assert b.run_all() == ["BASE", "SUCCEEDED", "SUCCEEDED", "SUCCEEDED"]
    t = b.tables()
    facts = {r.order_id: r for r in t["fact_order"].collect()}
    clash, late = history_ids("turns into a clash"), history_ids("late status")
    assert set(facts) == {i for name in HISTORY for i in history_ids(name)} - set(clash)
    assert all(facts[i].updated_at == dt.datetime(2026, 5, 14, 13, 30) and facts[i].order_status == "paid" and facts[i].late_event_flag for i in late)
    assert {r.business_key for r in t["issue_hit"].filter("rule_id = 'INC-001'").collect()} == set(late)
    copies = t["event_lineage"].filter(F.col("order_id") == clash[0]).groupBy("canonical_event_hash").count().collect()
    assert sorted(r["count"] for r in copies) == [1, 2]
    assert [a["status"] for a in b.warehouse.ledger()["attempts"]] == ["SUCCEEDED"] * 4
    assert b.replay_proof()
    shown = b.evidence()
    assert shown["counts"]["fact_order"] == len(facts) and shown["order_bridge"] == {"all": 2 * len(HISTORY), "refused": 2, "facts": len(facts)} and shown["late"] == {"rows": 2, "facts": 2}
    write_csv(batch_sources / "members.csv", C.MEMBERS.names, [snapshot(1)])
    with pytest.raises(BuildError):
        b.build_base()


def test_two_clean_runs_agree(spark, batch_sources, tmp_path):
    assert build.accepted(spark, uri(batch_sources), uri(tmp_path / "twice"))


def test_order_of_batches_rollback_and_changed_bytes(spark, batch_sources, tmp_path):
    b = Builder(spark, uri(batch_sources), uri(tmp_path / "wh"))
    with pytest.raises(BuildError):
        b.build_base(fail_after_refresh=True)
    assert b.warehouse.current() is None and b.warehouse.ledger()["attempts"][0]["status"] == "FAILED"
    b.build_base()
    version, facts = b.warehouse.current(), b.warehouse.table("fact_order").count()
    with pytest.raises(BuildError, match="follow"):
        b.process_batch("orders_incremental_day2.csv")
    with pytest.raises(BuildError, match="asked for"):
        b.process_batch("orders_incremental_day1.csv", fail_after_refresh=True)
    assert b.warehouse.current() == version and b.warehouse.table("fact_order").count() == facts == 6
    write_csv(batch_sources / "orders_incremental_day1.csv", C.ORDERS.names, batch(1)[:2])
    with pytest.raises(BuildError, match="other bytes"):
        b.process_batch("orders_incremental_day1.csv")
    ledger = b.warehouse.ledger()
    ledger["attempts"].append({"attempt_id": 9, "batch_order": 1, "file": "x", "sha256": "", "status": "RUNNING", "at": ""})
    b._attempt(ledger, 1, "y", "")
    assert [a["status"] for a in b.warehouse.ledger()["attempts"]][-2:] == ["INTERRUPTED", "RUNNING"]


def test_a_writer_lost_while_publishing_leaves_pointer_and_ledger_together(spark, batch_sources, tmp_path, monkeypatch):
    """Version, files and attempts become current by one renamed file: whichever write is lost, the next run goes on."""
    from millrace.sources import warehouse as module

    b = Builder(spark, uri(batch_sources), uri(tmp_path / "wh"))
    b.build_base()
    write, lost = module.write_text, []

    def die(spark, path, text):
        if '"SUCCEEDED"' in text.rsplit("attempt_id", 1)[-1] and not lost:
            lost.append(path)
            raise KeyboardInterrupt
        write(spark, path, text)

    monkeypatch.setattr(module, "write_text", die)
    version = b.warehouse.current()
    with pytest.raises(KeyboardInterrupt):
        b.process_batch("orders_incremental_day1.csv")
    assert b.warehouse.current() == version and "orders_incremental_day1.csv" not in b.warehouse.ledger()["files"]
    assert b.run_all() == ["SUCCEEDED"] * 3 and b.warehouse.table("fact_order").count() == 10


def test_state_tables_are_named():
    assert set(build.STATE) <= set(build.TABLES)
