"""Files: strict CSV scans with lineage, fingerprints, canonical JSON evidence, CSV results and a generator of event files."""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import Contract
from ..functions.identity import row_json


class HeaderMismatch(ValueError):
    """A file's first line is not the contract's header."""


def _bytes(spark: SparkSession, path: str) -> bytes:
    """A small file's content, by Spark's reader, so that any store that Spark knows will do."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0].content)


def fingerprint(spark: SparkSession, path: str, contract: Contract) -> dict[str, object]:
    """SHA-256 of the file and of its header, bytes and rows. Hashing and counting are done where the file is read; only its first bytes come to the driver."""
    head = F.substring("content", 1, 4096).cast("string").alias("head")
    own = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256"), "length", head).first()
    header = own.head.split("\n")[0].lstrip("\ufeff").rstrip("\r").split(",")
    if header != contract.names:
        raise HeaderMismatch(f"{path}: {header}")
    return {"sha256": own.sha256, "schema_sha256": hashlib.sha256(",".join(header).encode()).hexdigest(), "bytes": own.length, "rows": read_raw(spark, path, contract, "").count()}


def read_raw(spark: SparkSession, path: str, contract: Contract, source_file: str, batch_order: int = 0) -> DataFrame:
    """All columns as text, blanks kept, with lineage. Fails on a header or a row that does not fit. One file is one task, which numbers its rows; files are read beside each other."""
    reader = spark.read.schema(contract.raw_schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    own = reader.csv(path).select(*(F.coalesce(c, F.lit("")).alias(c) for c in contract.names), (F.monotonically_increasing_id() + 1).alias("source_row_number"))
    own = own.withColumns({"source_file": F.lit(source_file), "batch_order": F.lit(batch_order), "row_hash": F.sha2(row_json(*contract.names), 256)})
    return own.withColumn("source_row_uid", F.sha2(F.concat_ws("|", "source_file", F.col("source_row_number").cast("string"), "row_hash"), 256))


def read_all(spark: SparkSession, root: str, contract: Contract) -> DataFrame:
    """All files of a contract, in the order of batches."""
    return reduce(DataFrame.unionByName, (read_raw(spark, f"{root}/{f}", contract, f, i) for i, f in enumerate(contract.files)))


def read_event_files(spark: SparkSession, folder: str, columns: list[str], pattern: str = "events_*.csv") -> DataFrame:
    """All event files of a folder whose names match, as text with their file's name; files are split over tasks, as events hold no line breaks."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    own = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("escape", '"').option("pathGlobFilter", pattern).csv(folder)
    return own.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"))


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2, default=str) + "\n"


def write_evidence(spark: SparkSession, folder: str, documents: dict[str, object]) -> dict[str, str]:
    """Writes documents and a manifest of their SHA-256; returns the manifest, whose bundle is the hash over all."""
    manifest = {name: hashlib.sha256(canonical_json(d).encode()).hexdigest() for name, d in sorted(documents.items())}
    manifest["bundle"] = hashlib.sha256("".join(f"{n}:{h}\n" for n, h in sorted(manifest.items())).encode()).hexdigest()
    for name, d in [*documents.items(), ("manifest", manifest)]:
        write_text(spark, f"{folder}/{name}.json", canonical_json(d))
    return manifest


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file by way of Hadoop's file system: written beside, then renamed over the target in one step, so that a reader sees the old or the new content."""
    context = spark.sparkContext
    jvm = context._jvm
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    conf = context._jsc.hadoopConfiguration()
    out = target.getFileSystem(conf).create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    overwrite = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), conf).rename(beside, target, overwrite)


def read_text(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return _bytes(spark, path).decode()


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_result_csv(df: DataFrame, folder: str, order: list[str]) -> None:
    """A bounded, sorted result as one CSV file with a header."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)


def generated_events(spark: SparkSession, rows: int, seed: int = 20260709, days: int = 30, resent: float = 0.01, partitions: int | None = None) -> DataFrame:
    """Order events for performance runs, of which about a hundredth are sent again unchanged; made where they are needed, from hashes of their number."""
    own = spark.range(0, rows, 1, partitions).withColumn("_h", F.xxhash64(F.lit(seed), "id"))
    pick = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "_h"), F.lit(n))
    kind = F.element_at(F.array(*(F.lit(x) for x in ("created", "paid", "cancelled", "completed"))), (pick(1, 4) + 1).cast("int"))
    money = F.element_at(F.array(*(F.lit(x) for x in ("TWD", "USD", "JPY"))), (pick(2, 3) + 1).cast("int"))
    events = own.select(
        F.concat(F.lit("E"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("event_id"), F.concat(F.lit("ORD"), F.lpad((pick(3, max(1, rows // 3))).cast("string"), 8, "0")).alias("order_id"),
        F.concat(F.lit("M"), F.lpad(pick(4, 50000).cast("string"), 6, "0")).alias("member_id"), F.concat(F.lit("P"), F.lpad((pick(5, 300) + 1).cast("string"), 5, "0")).alias("product_id"),
        kind.alias("event_type"), F.date_format(F.timestamp_seconds(F.lit(1780272000) + pick(6, days * 86400)), "yyyy-MM-dd HH:mm:ss").alias("event_ts"), money.alias("currency"),
        (F.lit(100) + pick(7, 4990000) / F.lit(100)).cast("decimal(24,4)").alias("amount"), (pick(8, 4) + 1).cast("int").alias("quantity"), pick(9, 10000).alias("_again"),
    )
    return events.select("*", F.explode(F.when(F.col("_again") < int(resent * 10000), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_again", "_copy")
