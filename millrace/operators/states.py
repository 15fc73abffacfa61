"""Latest states, ties, conflicts, duplicates, transitions and late arrivals of keyed events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], time: str, tie: list[str]) -> DataFrame:
    """One row a key: that of the latest time; tie columns, ascending, decide between equal times, so that any partitioning gives the same row."""
    order = Window.partitionBy(*key).orderBy(F.col(time).desc_nulls_last(), *(F.col(t).asc_nulls_last() for t in tie))
    return df.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")


def tied_at_latest(df: DataFrame, key: list[str], time: str) -> DataFrame:
    """(key, candidates): keys with several rows at their latest time. One aggregation, no join back."""
    counts = df.groupBy(*key, time).agg(F.count("*").alias("candidates"))
    top = counts.groupBy(*key).agg(F.max(F.struct(time, "candidates")).alias("x"))
    return top.select(*key, F.col("x.candidates").alias("candidates")).filter("candidates > 1")


def conflicting(df: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """(key): keys with more than one value in any payload column; min and max tell it without sets of values."""
    ends = [f(F.col(c)).alias(f"{c}_{n}") for c in payload for f, n in ((F.min, "low"), (F.max, "high"))]
    unequal = reduce(lambda a, b: a | b, (F.col(f"{c}_low") != F.col(f"{c}_high") for c in payload))
    return df.groupBy(*key).agg(*ends).filter(unequal).select(*key)


def field_conflicts(df: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(field, conflicting_keys): for each field, keys that hold several values. Fields are unpivoted and counted in one pass."""
    long = df.select(*key, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot(key, fields, "field", "value")
    per_key = long.groupBy(*key, "field").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return per_key.groupBy("field").agg(F.count_if(F.col("low") != F.col("high")).alias("conflicting_keys"))


def representatives(df: DataFrame, identity: list[str], uid: str) -> DataFrame:
    """(identity, representative, copies): of rows alike in identity, the least uid and their number."""
    return df.groupBy(*identity).agg(F.min(uid).alias("representative"), F.count("*").alias("copies"))


def with_previous(df: DataFrame, key: list[str], order: list[str], value: str, name: str = "previous") -> DataFrame:
    """Adds the value of the key's row before; nulls order last, as in the SQL oracle."""
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(*key).orderBy(*(F.col(c).asc_nulls_last() for c in order))))


def transitions(df: DataFrame, key: list[str], order: list[str], state: str) -> DataFrame:
    """(from_state, to_state, transitions) over successive rows of a key."""
    own = with_previous(df, key, order, state).filter("previous is not null")
    return own.groupBy(F.col("previous").alias("from_state"), F.col(state).alias("to_state")).agg(F.count("*").alias("transitions"))


def reopened(df: DataFrame, key: list[str], order: list[str], state: str, terminal: list[str]) -> DataFrame:
    """Rows whose state differs from a terminal state just before."""
    return with_previous(df, key, order, state).filter(F.col("previous").isin(terminal) & ~F.col(state).eqNullSafe(F.col("previous")))


def late_arrivals(df: DataFrame, key: list[str], batch: str, time: str) -> DataFrame:
    """Rows older than what an earlier batch already had for the key; adds known_time. A window by batch instead of a non-equi join."""
    earlier = Window.partitionBy(*key).orderBy(batch).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn("known_time", F.max(time).over(earlier)).filter(F.col(time) < F.col("known_time"))


def distinct_over(df: DataFrame, key: list[str], value: Column, name: str) -> DataFrame:
    """Adds the number of distinct values in each key's rows: count(DISTINCT) OVER, which Spark lacks, as two aggregations and a join."""
    counts = df.groupBy(*key).agg(F.countDistinct(value).alias(name))
    return df.join(counts, reduce(lambda a, b: a & b, (df[k].eqNullSafe(counts[k]) for k in key))).drop(*(counts[k] for k in key))
