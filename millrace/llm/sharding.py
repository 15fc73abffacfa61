"""Operator 10: shards of equal bytes by a k-d tree over metadata.

Rows of one text are a group, which no cut parts: a group's coordinates are its size, the least language and the least source of its
rows, and its digest; its weight is all its rows' bytes. Each coordinate is put into a few bins (of size by quantiles, of the others
by a hash), and one distributed aggregation sums the weights of the cells that bins span; there are at most 64 * 8 * 8 * 16 cells,
however large the table. The tree is grown over these sums: a node is split at the weighted median of the dimension that is
widest in it, as a part of the whole range, until a leaf weighs no more than its target, a LEAVES-th part of a shard, or is one cell.
Leaves then go to the shards, heaviest first, always to the lightest.

So shards differ by no more than a leaf's weight, which is a hundredth of a shard or so, unless one cell weighs more: a single text
that is larger than a shard makes its shard larger.

Defined results: a null text has no bytes, size 1 and digest 0, like an empty one; slots follow a hash of the id; repeated rows get slots of
their own, and rows of equal texts one shard; languages, sources or whole columns may be missing or null; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buffers import discard, materialise

SHARDS, LEAVES = 8, 128
#: Bins of each dimension.
BINS = {"size": 64, "lang": 8, "source": 8, "digest": 16}
#: Rows that one slot bucket holds on average.
SLOT_ROWS = 2000


def grow(cells: np.ndarray, weights: np.ndarray, target: float, widths: tuple[int, ...] = tuple(BINS.values())) -> np.ndarray:
    """The leaf of each cell (a row of bins): leaves are numbered from left to right."""
    leaf, count = np.zeros(len(cells), np.int64), 0
    stack = [np.arange(len(cells))] if len(cells) else []
    while stack:
        own = stack.pop()
        low, high = cells[own].min(axis=0), cells[own].max(axis=0)
        if weights[own].sum() <= target or not (high > low).any():
            leaf[own], count = count, count + 1
            continue
        d = int(np.argmax((high - low) / np.maximum(np.array(widths) - 1, 1)))
        per = np.bincount(cells[own, d] - low[d], weights[own])
        below = np.cumsum(per)
        half = below[-1] / 2
        at = min(int(np.searchsorted(below, half)), len(per) - 2)
        if at and half - below[at - 1] <= below[at] - half:  # the nearer of the two cuts around the median
            at -= 1
        left = cells[own, d] <= low[d] + at
        stack += [own[~left], own[left]]
    return leaf


def deal(weights: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each leaf: heaviest first, each to the lightest shard."""
    load, out = [0.0] * shards, np.zeros(len(weights), np.int64)
    for i in np.lexsort((np.arange(len(weights)), -weights)).tolist():
        out[i] = min(range(shards), key=lambda s: (load[s], s))
        load[out[i]] += float(weights[i])
    return out


def _bins(edges: list[int]) -> list[Column]:
    """Of a group, its bin in each dimension."""
    above = [F.when(F.col("size") > e, 1).otherwise(0) for e in edges]
    size = above[0] if above else F.lit(0)
    for x in above[1:]:
        size = size + x
    hashed = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    return [size.cast("int").alias("size_bin"), hashed("lang", BINS["lang"]).cast("int").alias("lang_bin"), hashed("source", BINS["source"]).cast("int").alias("source_bin"), F.pmod("text_crc32", F.lit(BINS["digest"])).cast("int").alias("digest_bin")]


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row, under the law `bytes`."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")).alias(c)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("same"), named("lang"), named("source"))
    rows = materialise(spark, rows, "sizes")
    same = ["size", "text_crc32", "same"]
    groups = rows.groupBy(*same).agg(F.min("lang").alias("lang"), F.min("source").alias("source"), F.count("*").alias("copies"))
    groups = materialise(spark, groups.withColumn("weight", F.col("copies") * F.col("size")), "groups")
    points = [i / BINS["size"] for i in range(1, BINS["size"])]
    count, total, edges = groups.agg(F.sum("copies"), F.sum("weight"), F.percentile_approx("size", points, 10_000)).first()
    edges = sorted(set(edges or []))
    names = [f"{d}_bin" for d in BINS]
    binned = groups.select(*same, "weight", *_bins(edges))
    found = binned.groupBy(*names).agg(F.sum("weight").alias("weight")).orderBy(*names).toArrow()  # a bounded number of cells
    cells = np.stack([found.column(n).to_numpy() for n in names], axis=1).astype(np.int64)
    weights = found.column("weight").to_numpy().astype(np.float64)
    leaf = grow(cells, weights, (total or 0) / (shards * LEAVES))
    home = deal(np.bincount(leaf, weights), shards)[leaf] if len(leaf) else leaf
    places = spark.createDataFrame([(*map(int, c), int(s)) for c, s in zip(cells, home, strict=True)], ", ".join([*(f"{n} int" for n in names), "shard int"]))
    dealt = materialise(spark, binned.join(F.broadcast(places), names).select(*same, "shard"), "dealt")
    rows = materialise(spark, rows.join(dealt, same).select("id", "size", "text_crc32", "shard"), "shards")
    discard(groups, dealt)

    buckets = max(1, (count or 0) // (shards * SLOT_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size"))
    out = rows.withColumn("place", place).join(first, ["shard", "bucket"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
