"""Operator 7: mixing sources to target weights, by hierarchical budgets; DataFrame functions only.

Domains, languages and sources make a tree of three levels. A budget of tokens enters at the root and goes down by the
children's integer weights, but never beyond what a child can give: the tokens below it times the most epochs. What a
child cannot take its siblings share, by weight, as long as they can; since no node is given more than its subtree holds, a
shortage reaches the level above only when all siblings are full. Budgets are whole tokens, rounded down at every node.

A leaf reads its documents epoch by epoch, each in an order of its own that the seed and the epoch decide by md5. Whole epochs take
every document; of the last one, the documents that start before the budget ends are taken. Running totals go over
buckets of the order first, so that a hot leaf is never in one task; only the bucket in which the budget ends is ordered.

Tokens here are the words `[^\\x20\\x09-\\x0D]+`, which SQL counts. Defined results: a null text has no tokens; a null domain, language or
source is a child of its own, the empty name; documents without tokens take part at their place of the order; repeated rows are
ordered by id and tokens and are otherwise alike; an empty table gives no rows; weights are at least 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buffers import materialise

SEED = 17
BUCKETS_HEX = 3  # hex digits of the order that name a bucket
WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
#: Target weights: of domains, then of languages; sources of a language weigh alike.
DOMAIN_WEIGHTS = {"0": 30}
LANG_WEIGHTS = {"en": 40, "de": 20, "fr": 20, "es": 20}
OTHER_WEIGHT = 10


def weight_of(name: str, table: dict[str, int], other: int = OTHER_WEIGHT) -> Column:
    out = F.lit(other)
    for key, w in table.items():
        out = F.when(F.col(name) == key, w).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Divides the column budget of each parent among its children by (weight, cap); adds given."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)).withColumn("place", F.row_number().over(order))
    open_place = F.min(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct("place", "level"))).over(Window.partitionBy(*parent))
    nodes = nodes.withColumn("open", open_place)
    full = F.col("open").isNull() | (F.col("place") < F.col("open.place"))
    return nodes.withColumn("given", F.when(full, F.col("cap")).otherwise(F.floor(F.col("weight") * F.col("open.level")))).drop("level", "place", "open")


def budgets(leaves: DataFrame, budget: Column, epochs: int, weights: dict[str, Column], levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(levels..., available, given): leaves with (levels..., available); weights gives each level's weight."""
    caps = leaves.withColumn("cap", F.col("available") * epochs)
    above = leaves.agg(budget.cast("long").alias("given")).select(F.lit(0).alias("root"), "given")
    known: list[str] = ["root"]
    caps = caps.withColumn("root", F.lit(0))
    for name in levels:
        own = caps.groupBy(*known, name).agg(F.sum("cap").alias("cap"))
        own = own.join(above.withColumnRenamed("given", "budget"), known).withColumn("weight", weights[name])
        above = _share(own, known, name).select(*known, name, "given")
        known = [*known, name]
    return leaves.join(above.drop("root"), list(levels))


def mix(docs: DataFrame, budget_share: tuple[int, int] = (6, 10), epochs: int = 2, seed: int = SEED, id_col: str = "doc_id", domain: Column | None = None, weights: dict[str, Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, domain, lang, source, n_tokens, copies, kept columns): the documents that the mixture takes, and how often; the budget is a share of all tokens. Kept columns go through every exchange: keep keys, not texts."""
    spark = docs.sparkSession
    domain = F.expr("right(source, 1)") if domain is None else domain
    weights = weights or {"domain": weight_of("domain", DOMAIN_WEIGHTS), "lang": weight_of("lang", LANG_WEIGHTS), "source": F.lit(OTHER_WEIGHT).cast("long")}
    name = lambda c: F.coalesce(c, F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    own = materialise(spark, own, "tokens")
    leaves = materialise(spark, own.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("available")), "leaves")
    given = budgets(leaves, F.floor(F.sum("available") * budget_share[0] / budget_share[1]), epochs, weights)
    some = F.col("available") > 0
    whole = F.when(some, F.floor(F.col("given") / F.col("available"))).otherwise(0).cast("long")
    given = given.withColumn("whole", whole).withColumn("rest", F.col("given") - F.col("whole") * F.col("available")).select(*LEVELS, "whole", "rest")
    given = materialise(spark, given, "budgets")

    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("id").cast("string")))
    placed = own.join(given, list(LEVELS)).withColumn("by", key).withColumn("bucket", F.substring("by", 1, BUCKETS_HEX))
    inside = [*LEVELS, "bucket"]
    totals = placed.groupBy(*inside).agg(F.sum("n_tokens").alias("size"), F.first("rest").alias("rest"))
    before = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*inside, (F.col("rest") - F.coalesce(F.sum("size").over(before), F.lit(0))).alias("left"), "size")
    placed = placed.join(totals, inside)
    # Of a bucket, all documents start before the budget ends, or none does, or the budget ends within it.
    settled = placed.filter((F.col("left") <= 0) | (F.col("size") <= F.col("left"))).withColumn("extra", ((F.col("left") > 0)).cast("long"))
    order = Window.partitionBy(*inside).orderBy("by", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    ending = placed.filter((F.col("left") > 0) & (F.col("size") > F.col("left"))).withColumn("extra", (F.coalesce(F.sum("n_tokens").over(order), F.lit(0)) < F.col("left")).cast("long"))
    taken = settled.unionByName(ending).withColumn("copies", F.col("whole") + F.col("extra")).filter("copies > 0")
    return taken.select(F.col("id").alias(id_col), *LEVELS, "n_tokens", "copies", *(F.col(f"kept_{c}").alias(f"kept_{c}") for c in keep))


def mixture(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that the mixture takes, each as often as it is taken. The choice is made on ids and a key of the whole row; rows come in by one join."""
    row = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in docs.columns), *(F.col(c).isNull() for c in docs.columns))
    taken = mix(docs.withColumn("_key", row), id_col=id_col, keep=("_key",), **options)
    taken = taken.groupBy(F.col(id_col).alias("_id"), F.col("kept__key").alias("_of")).agg(F.sum("copies").cast("int").alias("_copies"))
    rows = docs.withColumn("_key", row)
    out = rows.join(taken, (F.col("_key") == F.col("_of")) & F.col(id_col).eqNullSafe(F.col("_id"))).dropDuplicates(["_key", id_col])
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


#: The same mixture in DuckDB's SQL, without buckets.
ORACLE_SQL = f"""
WITH own AS (
  SELECT doc_id, coalesce(right(source, 1), '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS available FROM own GROUP BY ALL),
root AS (SELECT CAST(floor(sum(available) * 6 / 10) AS BIGINT) AS budget FROM leaves),
d0 AS (SELECT domain, sum(available) * 2 AS cap, CASE domain WHEN '0' THEN 30 ELSE 10 END AS weight FROM leaves GROUP BY domain),
d1 AS (SELECT d0.*, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / sum(weight) OVER (ORDER BY cap / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
              row_number() OVER (ORDER BY cap / weight, domain) AS place FROM d0, root),
d2 AS (SELECT *, (SELECT min(place) FROM d1 WHERE cap / weight > level) AS open FROM d1),
d3 AS (SELECT domain, CAST(CASE WHEN open IS NULL OR place < open THEN cap ELSE floor(weight * (SELECT level FROM d1 x WHERE x.place = open)) END AS BIGINT) AS given FROM d2),
l0 AS (SELECT domain, lang, sum(available) * 2 AS cap, CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 WHEN 'es' THEN 20 ELSE 10 END AS weight FROM leaves GROUP BY domain, lang),
l1 AS (SELECT l0.*, (given - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / sum(weight) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
              row_number() OVER (PARTITION BY domain ORDER BY cap / weight, lang) AS place FROM l0 JOIN d3 USING (domain)),
l2 AS (SELECT *, min(CASE WHEN cap / weight > level THEN place END) OVER (PARTITION BY domain) AS open FROM l1),
l3 AS (SELECT a.domain, a.lang, CAST(CASE WHEN a.open IS NULL OR a.place < a.open THEN a.cap ELSE floor(a.weight * b.level) END AS BIGINT) AS given
       FROM l2 a LEFT JOIN l2 b ON a.domain = b.domain AND b.place = a.open),
s0 AS (SELECT domain, lang, source, available, available * 2 AS cap, 10 AS weight FROM leaves),
s1 AS (SELECT s0.*, (given - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / sum(weight) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
              row_number() OVER (PARTITION BY domain, lang ORDER BY cap / weight, source) AS place FROM s0 JOIN l3 USING (domain, lang)),
s2 AS (SELECT *, min(CASE WHEN cap / weight > level THEN place END) OVER (PARTITION BY domain, lang) AS open FROM s1),
s3 AS (SELECT a.domain, a.lang, a.source, a.available, CAST(CASE WHEN a.open IS NULL OR a.place < a.open THEN a.cap ELSE floor(a.weight * b.level) END AS BIGINT) AS given
       FROM s2 a LEFT JOIN s2 b ON a.domain = b.domain AND a.lang = b.lang AND b.place = a.open),
quota AS (SELECT *, CASE WHEN available > 0 THEN given // available ELSE 0 END AS whole FROM s3),
taken AS (
  SELECT doc_id, domain, lang, source, n_tokens, whole, given - whole * available AS rest,
         coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || whole || CASE WHEN doc_id IS NULL THEN '' ELSE ':' || doc_id END), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM own JOIN quota USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN start < rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM taken WHERE whole + CASE WHEN start < rest THEN 1 ELSE 0 END > 0
"""
