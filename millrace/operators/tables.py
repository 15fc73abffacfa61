"""Upserts, unknown keys, missing references, checksums, profiles and quantiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(current: DataFrame, desired: DataFrame, key: list[str]) -> DataFrame:
    """Rows of current whose key desired has not, and all of desired."""
    return current.join(desired.select(*key), key, "left_anti").unionByName(desired)


def keep_only(current: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is wanted: the deletion of what is no longer."""
    return current.join(wanted.select(*key).distinct(), key, "left_semi")


def missing_references(df: DataFrame, dimension: DataFrame, key: list[str]) -> DataFrame:
    return df.join(dimension.select(*key), key, "left_anti")


def lookup(df: DataFrame, dimension: DataFrame, key: list[str], columns: dict[str, object]) -> DataFrame:
    """Adds columns of a dimension with unique keys, with a default where the key is missing. Its size decides how it is joined."""
    return df.join(dimension.select(*key, *columns), key, "left").fillna({c: v for c, v in columns.items() if v is not None and not isinstance(v, bool)})


#: Rows, about, that a task holds for a checksum.
CHECKSUM_ROWS = 100_000


def digits_for(rows: int) -> int:
    """The digits by which a checksum parts so many rows."""
    digits = 1
    while rows > CHECKSUM_ROWS * 16**digits:
        digits += 1
    return digits


def checksum(df: DataFrame, line: Column, digits: int = 1) -> DataFrame:
    """(row_count, checksum): SHA-256 over the sorted SHA-256s of lines. Those that start with the same digits are joined and hashed first, then these hashes in order, so that no task holds all rows."""
    own = df.select(F.sha2(line, 256).alias("_h")).groupBy(F.substring("_h", 1, digits).alias("_part"))
    joined = lambda c: F.sha2(F.concat_ws("\n", c), 256)
    parts = own.agg(F.count("*").alias("n"), joined(F.array_sort(F.collect_list("_h"))).alias("h"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), joined(F.transform(F.array_sort(F.collect_list(F.struct("_part", "h"))), lambda x: x["h"])).alias("checksum"))


def profile(df: DataFrame, columns: list[str], domains: dict[str, list[str]] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """A row for each column: rows, nulls, blanks, distinct values, lengths, values outside domain or pattern. All in one pass over one unpivoted scan."""
    domains, patterns = domains or {}, patterns or {}
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column_name", "value")
    outside = reduce(lambda a, b: a | b, ((F.col("column_name") == c) & ~F.col("value").isin(v) for c, v in domains.items()), F.lit(False))
    unlike = reduce(lambda a, b: a | b, ((F.col("column_name") == c) & ~F.col("value").rlike(p) for c, p in patterns.items()), F.lit(False))
    return long.groupBy("column_name").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("value").isNull()).alias("null_count"), F.count_if(F.trim("value") == "").alias("blank_count"), F.countDistinct("value").alias("distinct_count"),
        F.min(F.length("value")).alias("min_length"), F.max(F.length("value")).alias("max_length"), F.count_if(outside).alias("domain_violations"), F.count_if(unlike).alias("pattern_violations"),
    )


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The most frequent values; ties by value."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), F.col("value").asc_nulls_last()).limit(n)


def _coarse(value: Column, kind: T.DecimalType) -> Column:
    """A decimal cut towards zero to its first four digits, or to four decimals below ten: it never falls as the value grows, and has at most some ten thousand values for each power of ten."""
    size = F.abs(value)
    digits = F.length(F.floor(size).cast("string"))
    cut = F.lit(None)
    for n in range(max(1, kind.precision - kind.scale), 0, -1):
        cut = F.when(digits <= n, F.floor(size, F.lit(4 - n)).cast("decimal(38,4)")).otherwise(cut)
    return F.when(value < 0, -cut).otherwise(cut)


def exact_quantiles(df: DataFrame, group: list[str], value: str, points: dict[str, tuple[int, int]], scale: int = 6) -> DataFrame:
    """Continuous quantiles of decimals without doubles; points are fractions (numerator, denominator).

    Values are counted first, by themselves and by their leading digits. Running totals over the leading digits, of which a group has a
    bounded number, tell where the two places beside each quantile lie; only values with these leading digits are then ordered.
    """
    kind = df.schema[value].dataType
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n")).withColumn("_lead", _coarse(F.col(value), kind))
    order = Window.partitionBy(*group).orderBy("_lead")
    leads = counts.groupBy(*group, "_lead").agg(F.sum("_n").alias("_n")).withColumn("_end", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*group)))
    leads = leads.withColumn("_begin", F.col("_end") - F.col("_n"))

    def places(a: int, b: int) -> tuple[Column, Column, Column]:
        low = F.floor((F.col("_all") - 1) * a / b).cast("long")
        return low, F.least(low + 1, F.col("_all") - 1), (F.col("_all") - 1) * a % b

    holds = lambda place: (F.col("_begin") <= place) & (place < F.col("_end"))
    asked = reduce(lambda x, y: x | y, (holds(place) for p in points.values() for place in places(*p)[:2]))
    leads = leads.filter(asked).select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_lead").alias("_of"), F.col("_begin").alias("_before"), "_all")
    same = reduce(lambda x, y: x & y, (F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)), F.col("_lead") == F.col("_of"))
    within = Window.partitionBy(*group, "_lead").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(leads, same).withColumn("_end", F.col("_before") + F.sum("_n").over(within)).withColumn("_begin", F.col("_end") - F.col("_n"))
    out = []
    for name, (a, b) in points.items():
        low, high, rest = places(a, b)
        first, second = (F.max(F.when(holds(place), F.col(value))) for place in (low, high))
        part = F.max(rest).cast("decimal(10,0)") / F.lit(b).cast("decimal(10,0)")
        out.append((first + (second - first) * part).cast(f"decimal(30,{scale})").alias(name))
    return ranked.groupBy(*group).agg(*out)
