"""Slowly changing dimensions, type 2, and joins as of a date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import OPEN_END
from ..functions.identity import surrogate_key


def build(snapshots: DataFrame, key: str, day: str, tracked: list[str], sk_prefix: str = "dim|v1", carried: list[str] | None = None) -> DataFrame:
    """Versions [valid_from, valid_to) of each key, from snapshots by day.

    Snapshots of one day that disagree make the day a conflict: it ends the open version and starts none. A new version starts
    at a key's first snapshot, at the first one after a conflict, and when a tracked column changes. Carried columns are those of
    the snapshot that starts a version.
    """
    state = F.sha2(F.concat_ws(chr(31), *(F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")) for c in tracked)), 256)
    days = snapshots.withColumn("_state", state).groupBy(key, day).agg(F.min("_state").alias("_state"), (F.min("_state") != F.max("_state")).alias("_conflict"), F.min(F.struct("_state", *tracked, *(carried or []))).alias("_first"))
    days = days.select(key, day, "_state", "_conflict", *(F.col(f"_first.{c}").alias(c) for c in [*tracked, *(carried or [])]))
    order = Window.partitionBy(key).orderBy(day)
    marks = days.withColumn("_before", F.lag(F.when(F.col("_conflict"), F.lit("<CONFLICT>")).otherwise(F.col("_state"))).over(order))
    bounds = marks.filter(F.col("_conflict") | F.col("_before").isNull() | (F.col("_before") != F.col("_state")))
    ends = bounds.withColumn("valid_to", F.coalesce(F.lead(day).over(order), F.lit(OPEN_END).cast("date")))
    out = ends.filter(~F.col("_conflict")).withColumnRenamed(day, "valid_from")
    sk = surrogate_key(F.lit(sk_prefix), F.col(key).cast("string"), F.col("valid_from").cast("string"))
    return out.select(sk.alias("sk"), key, *tracked, *(carried or []), "valid_from", "valid_to", (F.col("valid_to") == F.lit(OPEN_END).cast("date")).alias("is_current"), F.col("_state").alias("version_hash"))


def as_of(facts: DataFrame, versions: DataFrame, key: str, day: Column, columns: list[str], unknown: dict | None = None, how: str = "left") -> DataFrame:
    """Facts with columns of the version of their key that covers day. An equi-join on the key with the range as a residual condition: versions of a key are few and do not overlap, so no row fans out."""
    own = versions.select(F.col(key).alias("_key"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = facts.join(own, (facts[key] == F.col("_key")) & (F.col("_from") <= day) & (day < F.col("_to")), how)
    out = joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.lit((unknown or {}).get(c))) for c in columns})
    return out.drop("_key", "_from", "_to", *(f"_{c}" for c in columns))


def overlaps(versions: DataFrame, key: str) -> DataFrame:
    """Versions that begin before the one before them ends: one window instead of a self join."""
    order = Window.partitionBy(key).orderBy("valid_from", "valid_to")
    return versions.withColumn("_end", F.max("valid_to").over(order.rowsBetween(Window.unboundedPreceding, -1))).filter(F.col("valid_from") < F.col("_end")).drop("_end")


def lineage(snapshots: DataFrame, versions: DataFrame, key: str, day: str) -> DataFrame:
    """Snapshots with the sk of the version that covers them."""
    return as_of(snapshots, versions, key, F.col(day), ["sk"], how="inner")


def calendar(*dates: DataFrame) -> DataFrame:
    """All days from the least to the greatest of one-column frames of dates, with their parts."""
    from ..functions.times import calendar_parts

    ends = [d.select(F.min(d.columns[0]).alias("a"), F.max(d.columns[0]).alias("b")) for d in dates]
    both = reduce(DataFrame.unionByName, ends).agg(F.min("a").alias("a"), F.max("b").alias("b")).filter("a is not null")
    day = both.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("full_date"))
    return day.select(*(c.alias(n) for n, c in {"full_date": F.col("full_date"), **calendar_parts(F.col("full_date"))}.items()))


def gaps(df: DataFrame, key: str, day: str) -> DataFrame:
    """(key, missing_date): days within a key's range that have no row. Successive days tell the gap, so that only missing days are made."""
    days = df.select(key, day).distinct()
    after = days.withColumn("_next", F.lead(day).over(Window.partitionBy(key).orderBy(day))).filter(F.datediff("_next", day) > 1)
    return after.select(key, F.explode(F.sequence(F.date_add(day, 1), F.date_sub("_next", 1))).alias("missing_date"))
