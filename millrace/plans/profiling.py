"""Profiles of source files and of their columns by contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import Contract
from ..operators.tables import exact_quantiles


def _like(c: str, contract: Contract) -> tuple[Column, Column, Column]:
    """Of a column's text: whether it fails to parse, lies outside the domain, or is unlike the pattern; blanks are none of these."""
    spec = next(x for x in contract.columns if x.name == c)
    some = F.trim("value") != ""
    parsed = F.lit(False) if spec.type == "string" else some & F.col("value").try_cast(spec.type).isNull()
    outside = some & ~F.col("value").isin(*spec.domain) if spec.domain else F.lit(False)
    unlike = some & ~F.col("value").rlike(spec.pattern) if spec.pattern else F.lit(False)
    return parsed, outside, unlike


def columns(raw: DataFrame, contract: Contract) -> DataFrame:
    """A row for each file and column: rows, nulls, blanks, distinct values, lengths, sentinels, parse failures, values outside domain or pattern. One scan, unpivoted, and one aggregation."""
    long = raw.unpivot(["source_file"], contract.names, "column_name", "value")
    pick = lambda i: reduce(lambda a, c: F.when(F.col("column_name") == c, _like(c, contract)[i]).otherwise(a), contract.names, F.lit(False))
    sentinels = {c.name: c.sentinel for c in contract.columns if c.sentinel}
    sentinel = reduce(lambda a, kv: a | ((F.col("column_name") == kv[0]) & (F.col("value") == kv[1])), sentinels.items(), F.lit(False))
    return long.groupBy("source_file", "column_name").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("value").isNull()).alias("null_count"), F.count_if(F.trim("value") == "").alias("blank_count"), F.countDistinct("value").alias("distinct_count"),
        F.min(F.length("value")).alias("min_length"), F.max(F.length("value")).alias("max_length"), F.count_if(sentinel).alias("sentinel_count"),
        F.count_if(pick(0)).alias("parse_failures"), F.count_if(pick(1)).alias("domain_violations"), F.count_if(pick(2)).alias("pattern_violations"),
    )


def typed_ranges(raw: DataFrame, contract: Contract) -> DataFrame:
    """(source_file, column_name, minimum, maximum) of columns that have a type, as text."""
    typed = [c for c in contract.columns if c.type != "string"]
    ends = [f(F.col(c.name).try_cast(c.type)).cast("string").alias(f"{c.name}_{n}") for c in typed for f, n in ((F.min, "a"), (F.max, "b"))]
    wide = raw.groupBy("source_file").agg(*ends)
    parts = [wide.select("source_file", F.lit(c.name).alias("column_name"), F.col(f"{c.name}_a").alias("minimum"), F.col(f"{c.name}_b").alias("maximum")) for c in typed]
    return reduce(DataFrame.unionByName, parts)


def quantiles(raw: DataFrame, contract: Contract) -> DataFrame:
    """(source_file, column_name, p01, p50, p99) of decimal and whole-number columns, exact."""
    numbers = [c for c in contract.columns if c.type.startswith("decimal") or c.type == "int"]
    long = raw.unpivot(["source_file"], [c.name for c in numbers], "column_name", "text").withColumn("number", F.col("text").try_cast("decimal(24,8)"))
    return exact_quantiles(long, ["source_file", "column_name"], "number", {"p01": (1, 100), "p50": (1, 2), "p99": (99, 100)}, 8)


def top_values(raw: DataFrame, contract: Contract, n: int = 20) -> DataFrame:
    """(source_file, column_name, place, value, frequency): the most frequent values of each column, but of sensitive ones only how often they come."""
    hidden = [c.name for c in contract.columns if c.sensitive]
    counts = raw.unpivot(["source_file"], contract.names, "column_name", "value").groupBy("source_file", "column_name", "value").agg(F.count("*").alias("frequency"))
    order = Window.partitionBy("source_file", "column_name").orderBy(F.desc("frequency"), "value")
    first = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    return first.withColumn("value", F.when(F.col("column_name").isin(*hidden), "<HIDDEN>").otherwise(F.col("value"))) if hidden else first


def files(raw: DataFrame, contract: Contract) -> DataFrame:
    """A row for each file: rows, groups of identical rows and rows beyond the first of each, and repeated keys."""
    whole = raw.groupBy("source_file", "row_hash").agg(F.count("*").alias("n")).groupBy("source_file").agg(F.sum("n").alias("row_count"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.sum(F.col("n") - 1).alias("surplus_rows"))
    keys = raw.groupBy("source_file", *contract.key).agg(F.count("*").alias("n")).groupBy("source_file").agg(F.count_if(F.col("n") > 1).alias("repeated_keys"))
    return whole.join(keys, "source_file")
