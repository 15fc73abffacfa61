"""Builds of the warehouse: the base, batches in strict order, replays, and evidence."""

from __future__ import annotations

import hashlib
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts as C
from ..operators.tables import checksum, digits_for
from ..sources.files import canonical_json, fingerprint, read_raw
from ..sources.warehouse import Warehouse
from . import curated, gates, staging, validation

TABLES = ("raw_orders", "raw_members", "raw_products", "raw_fx_rates", "orders", "members", "products", "fx_rates", "issue_hit", "entity_rule", "entity_disposition", "quarantine_row", "dim_product", "dim_member", "member_lineage", "dim_date", "fact_order", "event_lineage")
STATE = ("fact_order", "dim_member", "dim_product", "entity_disposition", "quarantine_row")


class BuildError(RuntimeError):
    """The build was refused or rolled back; nothing was published."""


class Builder:
    """Reads sources under root and keeps the warehouse; one writer at a time."""

    def __init__(self, spark: SparkSession, source: str, root: str):
        self.spark, self.source, self.warehouse = spark, source.rstrip("/"), Warehouse(spark, root)

    def raw(self, orders: list[str]) -> dict[str, DataFrame]:
        out = {f"raw_{c.dataset}": read_raw(self.spark, f"{self.source}/{c.files[0]}", c, c.files[0]) for c in (C.MEMBERS, C.PRODUCTS, C.FX_RATES)}
        for f in orders:
            own = read_raw(self.spark, f"{self.source}/{f}", C.ORDERS, f, C.ORDERS.files.index(f))
            out["raw_orders"] = own if "raw_orders" not in out else out["raw_orders"].unionByName(own)
        return out

    def refresh(self, version: str, raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """All tables of a version. Each is written once and read by what follows, so that nothing is worked out twice and a lost executor costs one table's task."""
        put = lambda name, df: self.warehouse.write(version, name, df)
        t = {k: put(k, df) for k, df in raw.items()}
        t["fx_rates"] = put("fx_rates", staging.stage_fx(t["raw_fx_rates"]))
        t["products"] = put("products", staging.stage_products(t["raw_products"]))
        t["members"] = put("members", staging.stage_members(t["raw_members"]))
        t["orders"] = put("orders", staging.stage_orders(t["raw_orders"], t["fx_rates"]))
        t |= {k: put(k, df) for k, df in gates.apply(t).items()}
        decided = t["entity_disposition"]
        t["dim_product"] = put("dim_product", curated.dim_product(t["products"], decided))
        t["dim_member"] = put("dim_member", curated.dim_member(t["members"], decided))
        t["member_lineage"] = put("member_lineage", curated.member_lineage(t["members"], decided, t["dim_member"]))
        t["dim_date"] = put("dim_date", curated.dim_date(t, decided))
        t["fact_order"] = put("fact_order", curated.fact_order(t["orders"], decided, t["entity_rule"], t["dim_member"], t["dim_product"]))
        t["event_lineage"] = put("event_lineage", curated.event_lineage(t["orders"]))
        return t

    def tables(self, version: str | None = None) -> dict[str, DataFrame]:
        return {k: self.warehouse.table(k, version) for k in TABLES}

    def _attempt(self, ledger: dict, batch: int, file: str, sha: str) -> dict:
        for a in ledger["attempts"]:  # a writer that was lost
            if a["status"] == "RUNNING":
                a["status"] = "INTERRUPTED"
        row = {"attempt_id": 1 + max((a["attempt_id"] for a in ledger["attempts"]), default=0), "batch_order": batch, "file": file, "sha256": sha, "status": "RUNNING", "at": datetime.now(UTC).isoformat()}
        ledger["attempts"].append(row)
        self.warehouse.record(ledger)
        return row

    def _run(self, ledger: dict, attempt: dict, files: dict[str, dict], orders: list[str], fail_after_refresh: bool) -> dict[str, int]:
        version = f"v{attempt['attempt_id']:06d}-{uuid.uuid4().hex[:8]}"
        try:
            tables = self.refresh(version, self.raw(orders))
            if fail_after_refresh:
                raise BuildError("failure asked for after the refresh")
            trial = {"attempts": [*ledger["attempts"][:-1], attempt | {"status": "SUCCEEDED"}], "files": ledger["files"] | files}
            found = validation.violations(validation.incremental_checks(tables, trial) if len(orders) > 1 else validation.base_checks(tables))
            if bad := {k: n for k, n in found.items() if n}:
                raise BuildError(f"checks failed: {bad}")
        except Exception:
            self.warehouse.discard(version)
            attempt["status"] = "FAILED"
            self.warehouse.record(ledger)
            raise
        attempt["status"], attempt["version"] = "SUCCEEDED", version
        ledger["files"] |= files
        self.warehouse.publish(version, ledger)
        return found

    def build_base(self, fail_after_refresh: bool = False) -> dict[str, int]:
        """The first version. Refuses a warehouse that has one."""
        if self.warehouse.current():
            raise BuildError("the warehouse exists")
        ledger = self.warehouse.ledger()
        files = {c.files[0]: fingerprint(self.spark, f"{self.source}/{c.files[0]}", c) | {"dataset": c.dataset, "batch_order": 0} for c in C.CONTRACTS.values()}
        attempt = self._attempt(ledger, 0, C.ORDERS.files[0], files[C.ORDERS.files[0]]["sha256"])
        return self._run(ledger, attempt, files, [C.ORDERS.files[0]], fail_after_refresh)

    def process_batch(self, file: str, fail_after_refresh: bool = False) -> str:
        """Admits the next order file: the same bytes again are a no-op, other bytes under a known name or a batch out of order are refused."""
        ledger = self.warehouse.ledger()
        batch = C.ORDERS.files.index(file)
        own = fingerprint(self.spark, f"{self.source}/{file}", C.ORDERS)
        known = {a["sha256"] for a in ledger["attempts"] if a["file"] == file}
        if file in ledger["files"] and ledger["files"][file]["sha256"] == own["sha256"]:
            return "SKIPPED_ALREADY_APPLIED"
        if known and own["sha256"] not in known or file in ledger["files"]:
            raise BuildError(f"{file} has other bytes than before")
        done = max((v["batch_order"] for v in ledger["files"].values() if v["dataset"] == "orders"), default=-1)
        if batch != done + 1:
            raise BuildError(f"batch {batch} does not follow batch {done}")
        for c in (C.MEMBERS, C.PRODUCTS, C.FX_RATES):
            if fingerprint(self.spark, f"{self.source}/{c.files[0]}", c)["sha256"] != ledger["files"][c.files[0]]["sha256"]:
                raise BuildError(f"{c.files[0]} has other bytes than before")
        attempt = self._attempt(ledger, batch, file, own["sha256"])
        self._run(ledger, attempt, {file: own | {"dataset": "orders", "batch_order": batch}}, list(C.ORDERS.files[: batch + 1]), fail_after_refresh)
        return "SUCCEEDED"

    def run_all(self) -> list[str]:
        """The base, if there is none yet, and all batches whose files are there."""
        out = []
        if not self.warehouse.current():
            self.build_base()
            out.append("BASE")
        for file in C.ORDERS.files[1:]:
            out.append(self.process_batch(file))
        return out

    def state_checksums(self) -> dict[str, str]:
        """SHA-256 of each state table's rows in order; equal states give equal sums, whatever the partitions."""
        out = {}
        for name in STATE:
            df = self.warehouse.table(name)
            line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
            out[name] = checksum(df, line, digits_for(df.count())).first().checksum
        return out

    def replay_proof(self) -> bool:
        """Whether doing all again changes nothing."""
        before = self.state_checksums()
        return set(self.run_all()) <= {"SKIPPED_ALREADY_APPLIED"} and self.state_checksums() == before

    def evidence(self) -> dict[str, object]:
        """Bounded counts, bridges and sums of the current version, as canonical JSON would hold them; every section is a small aggregate."""
        t = self.tables()
        orders, fact, members = t["orders"], t["fact_order"], t["dim_member"].filter("member_sk <> 0")
        decided, by_rule, hit = t["entity_disposition"], t["entity_rule"], t["issue_hit"]
        rows = lambda df, *order: [r.asDict() for r in df.orderBy(*order).collect()]
        one = lambda df: df.first().asDict()
        sums = [F.coalesce(F.sum(c), F.lit(0)).cast("string").alias(c) for c in ("gross_amount_twd_exact", "net_amount_twd_exact", "gross_amount_twd", "net_amount_twd")]
        refused = decided.filter("entity_type = 'order' and not is_eligible").select(F.col("business_key").alias("order_id"))
        rules_of = by_rule.filter("entity_type = 'order' and disposition = 'QUARANTINE'").groupBy("business_key").agg(F.count("*").alias("rules"))
        versions = members.groupBy("member_id").agg(F.count("*").alias("versions"))
        return {
            "batches": [{k: a.get(k) for k in ("attempt_id", "batch_order", "file", "sha256", "status")} for a in self.warehouse.ledger()["attempts"]],
            "counts": {k: df.count() for k, df in t.items()},
            "events": one(orders.agg(F.count("*").alias("physical"), F.countDistinct("canonical_event_hash").alias("logical"), F.countDistinct("order_id").alias("orders"), F.count_if("currency_normalized").alias("currency_normalized"))),
            "dispositions": rows(decided.groupBy("entity_type", "disposition").count(), "entity_type", "disposition"),
            "rules": rows(by_rule.groupBy("rule_id", "disposition").agg(F.count("*").alias("entities"), F.sum("row_count").alias("rows")), "rule_id", "disposition"),
            "order_bridge": {"all": orders.select("order_id").distinct().count(), "refused": refused.count(), "facts": fact.count()},
            "invariant_bridge": {"conflicting": by_rule.filter("rule_id = 'ORD-004'").count(), "in_facts": fact.join(by_rule.filter("rule_id = 'ORD-004'").select(F.col("business_key").alias("order_id")), "order_id", "left_semi").count()},
            "timezone_bridge": {"assumed_rows": orders.filter("timezone_assumed").count(), "assumed_hits": hit.filter("rule_id = 'ORD-012'").count(), "assumed_facts": fact.filter("timezone_assumed").count()},
            "quarantine_overlap": rows(rules_of.groupBy("rules").agg(F.count("*").alias("orders")), "rules"),
            "late": {"rows": hit.filter("rule_id = 'INC-001'").count(), "facts": fact.filter("late_event_flag").count()},
            "members": {"versions": members.count(), "current": members.filter("is_current").count(), "lineage": t["member_lineage"].count()},
            "member_versions": rows(versions.groupBy("versions").agg(F.count("*").alias("members")), "versions"),
            "unknown": one(fact.agg(F.count_if("unknown_member_flag").alias("members"), F.count_if("unknown_product_flag").alias("products"))),
            "dates": one(t["dim_date"].agg(F.min("full_date").cast("string").alias("first"), F.max("full_date").cast("string").alias("last"), F.count("*").alias("days"))),
            "money": one(fact.agg(*sums)),
            "money_by_currency": rows(fact.groupBy("currency").agg(F.count("*").alias("orders"), *sums), "currency"),
            "state": self.state_checksums(),
        }

    def snapshot_checksum(self) -> str:
        """SHA-256 of the evidence as canonical JSON."""
        return hashlib.sha256(canonical_json(self.evidence()).encode()).hexdigest()


def accepted(spark: SparkSession, source: str, root: str) -> bool:
    """Whether two clean runs over the same sources end in the same state and evidence, and a replay of either changes nothing."""
    runs = [Builder(spark, source, f"{root}/run{n}") for n in (1, 2)]
    for b in runs:
        b.run_all()
    return len({b.snapshot_checksum() for b in runs}) == 1 and all(b.replay_proof() for b in runs)
