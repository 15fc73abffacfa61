"""Rules over rows and entities: hits, roll-ups, dispositions and quarantine."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUARANTINE, NORMALIZE, ACCEPT, WARN = "QUARANTINE", "NORMALIZE", "ACCEPT", "WARN"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    disposition: str
    when: Column
    entity_type: str = ""
    key: Column | None = None


def hits(df: DataFrame, dataset: str, entity_type: str, key: Column, uid: str, rules: list[Rule]) -> DataFrame:
    """(dataset, entity_type, business_key, row_uid, rule_id, disposition): one pass for all rules; an unknown condition is no hit."""
    if all(r.key is None and not r.entity_type for r in rules):  # the key stays a column of its own, so that rows dealt by it need not be dealt anew
        names = F.array(*(F.when(r.when, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.disposition).alias("disposition"))) for r in rules))
        rows = df.select(key.alias("business_key"), F.col(uid).alias("row_uid"), F.explode(F.filter(names, lambda x: x.isNotNull())).alias("x"))
        return rows.select(F.lit(dataset).alias("dataset"), F.lit(entity_type).alias("entity_type"), "business_key", "row_uid", "x.rule_id", "x.disposition").distinct()
    found = F.array(*(F.when(r.when, F.struct(F.lit(r.entity_type or entity_type).alias("entity_type"), (key if r.key is None else r.key).alias("business_key"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.disposition).alias("disposition"))) for r in rules))
    rows = df.select(F.col(uid).alias("row_uid"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
    return rows.select(F.lit(dataset).alias("dataset"), "x.entity_type", "x.business_key", "row_uid", "x.rule_id", "x.disposition").distinct()


def entity_rules(found: DataFrame) -> DataFrame:
    """(entity_type, business_key, rule_id, disposition, row_count)."""
    return found.groupBy("entity_type", "business_key", "rule_id").agg(F.max("disposition").alias("disposition"), F.countDistinct("row_uid").alias("row_count"))


def dispositions(entities: DataFrame, by_rule: DataFrame) -> DataFrame:
    """Of every entity (entity_type, business_key), its disposition: any quarantine rule, any rule, or none."""
    counts = by_rule.groupBy("entity_type", "business_key").agg(F.count("rule_id").alias("matched_rules"), F.count_if(F.col("disposition") == QUARANTINE).alias("quarantine_rules"))
    both = entities.distinct().join(counts, ["entity_type", "business_key"], "left").fillna(0, ["matched_rules", "quarantine_rules"])
    name = F.when(F.col("quarantine_rules") > 0, QUARANTINE).when(F.col("matched_rules") > 0, "ACCEPT_WITH_FLAGS").otherwise(ACCEPT)
    return both.select("entity_type", "business_key", name.alias("disposition"), (F.col("quarantine_rules") == 0).alias("is_eligible"), "matched_rules", "quarantine_rules")


def quarantined(rows: DataFrame, decided: DataFrame, found: DataFrame, by_rule: DataFrame) -> DataFrame:
    """(dataset, row_uid, business_key, rule_ids): every row (dataset, entity_type, business_key, row_uid) of an entity that is not eligible, once; its own quarantine rules, else its entities', else <UNSPECIFIED>."""
    out = rows.join(decided.filter(~F.col("is_eligible")).select("entity_type", "business_key"), ["entity_type", "business_key"], "left_semi")
    names = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    own = found.filter(F.col("disposition") == QUARANTINE).groupBy("row_uid").agg(names("rule_id").alias("own_rules"))
    of_entity = by_rule.filter(F.col("disposition") == QUARANTINE).select("entity_type", "business_key", F.col("rule_id").alias("entity_rule"))
    both = out.join(of_entity, ["entity_type", "business_key"], "left").groupBy("dataset", "row_uid").agg(names("business_key").alias("business_key"), names("entity_rule").alias("entity_rules"))
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return both.join(own, "row_uid", "left").select("dataset", "row_uid", "business_key", F.coalesce(some("own_rules"), some("entity_rules"), F.lit("<UNSPECIFIED>")).alias("rule_ids"))


def panel(checks: Mapping[str, DataFrame]) -> DataFrame:
    """(check_id, violation_count) of each check's violating rows; a frame with a column violation_count counts for itself."""
    total = lambda df: F.coalesce(F.sum("violation_count"), F.lit(0)).cast("long") if "violation_count" in df.columns else F.count("*")
    return reduce(DataFrame.unionByName, (df.agg(total(df).alias("violation_count")).select(F.lit(name).alias("check_id"), "violation_count") for name, df in checks.items()))
