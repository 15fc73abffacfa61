"""Streams of events: deduplication, minute windows, latest states with conflicts, late events, and the batch that reconciles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.states import latest

SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])
WATERMARK = "10 minutes"


def source(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Files as a stream, replayed from the archive whenever a checkpoint starts anew; event times with the session's zone, as watermarks need."""
    reader = spark.readStream.schema(SCHEMA)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def unique_events(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """At least once becomes once: the state of an id is kept as long as the watermark may see it again."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def minute_counts(events: DataFrame) -> DataFrame:
    """(minute, event_type, n, amount) in tumbling minutes; a batch frame or a stream."""
    own = events.groupBy(F.window("ts", "1 minute").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("amount"))
    return own.select(F.col("w.start").alias("minute"), "event_type", "n", "amount")


def run_minutes(spark: SparkSession, path: str, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Runs the stream over what is there and returns every minute's last state. Each micro-batch writes a folder of its own, so that a batch done again replaces its first attempt."""
    counts = minute_counts(unique_events(source(spark, path, files_per_batch)))

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    _replayed(counts, folder, put, "update")
    every = spark.read.schema("minute timestamp, event_type string, n bigint, amount decimal(28,2), batch bigint").parquet(f"{folder}/out")
    return latest(every, ["minute", "event_type"], "batch", ["n"]).drop("batch")


def upsert_latest(state: DataFrame | None, batch: DataFrame, key: str, time: str, sequence: str) -> tuple[DataFrame, DataFrame]:
    """The state after a micro-batch, and conflicts: the latest row of a key by time and sequence; rows of one time and sequence that differ are set aside, not chosen between."""
    every = batch if state is None else state.unionByName(batch)
    every = every.dropDuplicates()
    top = every.groupBy(key).agg(F.max(F.struct(time, sequence)).alias("_top"))
    at_top = every.join(top, key).filter((F.col(time) == F.col(f"_top.{time}")) & (F.col(sequence) == F.col(f"_top.{sequence}"))).drop("_top")
    several = at_top.groupBy(key).count().filter("count > 1").select(key)
    return at_top.join(several, key, "left_anti"), at_top.join(several, key, "left_semi")


def latest_with_conflicts(events: DataFrame, key: str, time: str, sequence: str, payload: list[str]) -> DataFrame:
    """(key, time, sequence, payload, conflict) of each key's latest row; a stream or a batch frame, and no watermark, as a key's latest row is never out of date.

    One aggregation: of the rows at the top, the one with the greatest hash of its payload and the one with the least. If they differ, the
    payloads do, and none is chosen: payload is null then. A key's state is two rows, however many there were.
    """
    h = F.xxhash64(*payload)
    top = lambda by: F.max(F.struct(F.col(time).alias("t"), F.col(sequence).alias("s"), by.alias("h"), F.struct(*payload).alias("p")))
    own = events.groupBy(key).agg(top(h).alias("a"), top(F.bitwise_not(h)).alias("b"))
    conflict = F.col("a.h") != F.bitwise_not("b.h")
    return own.select(key, F.col("a.t").alias(time), F.col("a.s").alias(sequence), *(F.when(~conflict, F.col(f"a.p.{c}")).alias(c) for c in payload), conflict.alias("conflict"))


def _replayed(query: DataFrame, folder: str, put, mode: str) -> None:
    """Runs a stream over what has come since its checkpoint."""
    query.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def run_latest(events: DataFrame, folder: str, key: str, time: str, sequence: str, payload: list[str]) -> DataFrame:
    """Runs a stream of events over what is there, on from its checkpoint, and returns the latest rows with conflicts.

    Each micro-batch writes the keys it changed into a folder of its own, so that a batch done again replaces its first attempt."""
    own = latest_with_conflicts(events, key, time, sequence, payload)
    _replayed(own, folder, lambda df, n: df.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), "update")
    every = events.sparkSession.read.schema(T.StructType([*own.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/out")
    return latest(every, [key], "batch", []).drop("batch")


def run_on_time(events: DataFrame, folder: str, delay: str = WATERMARK) -> tuple[DataFrame, DataFrame]:
    """Runs a stream over what is there, on from its checkpoint, and returns its events on time and those that came late: more than delay before the latest time of any earlier batch.

    The latest time of each batch is written beside its rows; a batch done again finds the same times before it, and replaces its first attempt."""
    spark, rows = events.sparkSession, events.schema

    def put(df: DataFrame, n: int) -> None:
        marks = spark.read.schema("latest timestamp, batch bigint").parquet(f"{folder}/marks").filter(F.col("batch") < n) if n else spark.createDataFrame([], "latest timestamp")
        mark = marks.agg(F.unix_micros(F.max("latest"))).first()[0]
        late = F.lit(False) if mark is None else F.coalesce(F.col("ts") < F.timestamp_micros(F.lit(mark)) - F.expr(f"interval {delay}"), F.lit(False))
        df.withColumn("late", late).write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")
        spark.read.schema(rows).parquet(f"{folder}/rows/batch={n}").agg(F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{folder}/marks/batch={n}")

    _replayed(events, folder, put, "append")
    every = spark.read.schema(T.StructType([*rows.fields, T.StructField("late", T.BooleanType())])).parquet(f"{folder}/rows")
    every = every.select(*rows.names, "late")
    return every.filter("not late").drop("late"), every.filter("late").drop("late")


def late_events(archive: DataFrame, seen: DataFrame) -> DataFrame:
    """Archived events that the stream's result lacks, because they came behind the watermark: kept for the batch."""
    return archive.join(seen.select("event_id"), "event_id", "left_anti")


def reconcile(provisional: DataFrame, final: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Keys whose provisional and final measures differ, with both."""
    a, b = provisional.select(*keys, *(F.col(m).alias(f"provisional_{m}") for m in measures)), final.select(*keys, *(F.col(m).alias(f"final_{m}") for m in measures))
    both = a.join(b, keys, "full_outer")
    unequal = F.lit(False)
    for m in measures:
        unequal = unequal | ~F.col(f"provisional_{m}").eqNullSafe(F.col(f"final_{m}"))
    return both.filter(unequal)
