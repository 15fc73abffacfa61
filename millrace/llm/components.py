"""Connected components over a table of links, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .buffers import discard, materialise

#: Keys with more than a SPLIT-th part of all rows, and more than FEW of them, are joined where their rows lie; there are at most SPLIT.
SPLIT, FEW = 4096, 256


def join_one(rows: DataFrame, known: DataFrame, key: str, count: int) -> DataFrame:
    """rows (count of them, about) joined to known, which has one row for each key, and as _times how many of rows have it.

    The rows of a key that many of them have stay where they are: what is known of it goes to all tasks. Such keys are at most
    2 * SPLIT, whatever the number of rows, as each has more than count / SPLIT of them.
    """
    many = max(FEW, count // SPLIT)
    held = [c for c in known.columns if c not in (key, "_times")]
    hubs = F.broadcast(known.filter(F.col("_times") > many).select(key, *(F.col(c).alias(f"_hub_{c}") for c in held), F.lit(True).alias("_hub")))
    marked = rows.join(hubs, key, "left")
    hot = marked.filter("_hub").select(*rows.columns, *(F.col(f"_hub_{c}").alias(c) for c in held))
    cold = marked.filter("_hub is null").select(*rows.columns).join(known.filter(F.col("_times") <= many).drop("_times"), key)
    return hot.unionByName(cold)


def with_least(rows: DataFrame, key: str, value: str, count: int) -> DataFrame:
    """rows (count of them, about) and, as least, the least value of each one's key."""
    return join_one(rows, rows.groupBy(key).agg(F.min(value).alias("least"), F.count("*").alias("_times")), key, count)


def gathered(links: DataFrame, count: int) -> DataFrame:
    """(node, label, _times) of every node in links (columns u, v; count of them, each once): the least node at most two links away, and how many links it has. Cliques and stars get one label."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = with_least(both, "u", "v", 2 * count).select("u", F.col("v").alias("node"), "least")
    return near.groupBy("node").agg(F.min(F.least("u", "least")).alias("label"), F.count("*").alias("_times"))


def components(links: DataFrame, name: str = "components", most_rounds: int = 100) -> DataFrame:
    """(node, root) of every node in links (columns u, v of long): root is the least node reachable.

    Alternates large stars and small stars until the set of links stands still; each round is written to the shared folder, and
    the number of rounds grows with the logarithm of the longest chain. A link of a node to itself only names the node, a link that
    comes twice counts once, and links without a node at either end are left out; no links give no rows. Fails loudly if the links
    don't stand still after most_rounds.
    """
    spark = links.sparkSession

    def put(df: DataFrame) -> tuple[DataFrame, dict]:
        """Writes the links; tells their number and a sum over them as they are written."""
        seen = Observation()
        return materialise(spark, df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), name), seen.get

    edges, before = put(links.filter("u is not null and v is not null").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct())
    for _ in range(most_rounds):
        # Large star: every node gives its larger neighbours the least node it knows, itself included.
        real = edges.filter("u <> v")
        both = real.select("u", "v").unionByName(real.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, "u", "v", 2 * before["n"]).filter("v > u").select("v", F.least("u", "least").alias("u")).distinct()
        large = materialise(spark, large, name)
        # Small star: every node gives its smaller neighbours, and itself, the least of them.
        nearer = with_least(large, "v", "u", before["n"])
        small = nearer.select(F.explode(F.array(F.struct(F.greatest("u", "least").alias("v"), F.col("least").alias("u")), F.struct("v", F.col("least").alias("u")))).alias("x")).select("x.v", "x.u")
        after, now = put(small.filter("u <> v").unionByName(edges.filter("u = v").select("v", "u")).distinct())
        discard(edges, large)
        edges = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components are not settled after {most_rounds} rounds")
    linked = edges.filter("u <> v").select(F.col("v").alias("node"), F.col("u").alias("root"))
    return linked.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))
