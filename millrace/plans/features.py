"""Features as they were known at prediction time, and splits by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_history(samples: DataFrame, outcomes: DataFrame, keys: list[str], sample_id: str, at: str, label: str, available_at: str) -> DataFrame:
    """(sample_id, n_known, label_sum): outcomes of the same keys that were available strictly before each sample's time.

    Two clocks, so not one plain window over rows: outcomes enter at their availability, samples at their time, samples first at
    equal times; a running total over both gives each sample what was known. No join, one exchange by key; the sample's own
    outcome cannot count, as it is available after its time."""
    a = outcomes.select(*keys, F.col(available_at).alias("_time"), F.lit(1).alias("_kind"), F.lit(None).cast(samples.schema[sample_id].dataType).alias(sample_id), F.col(label).cast("long").alias("_y"))
    b = samples.select(*keys, F.col(at).alias("_time"), F.lit(0).alias("_kind"), F.col(sample_id), F.lit(None).cast("long").alias("_y"))
    order = Window.partitionBy(*keys).orderBy("_time", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumns({"n_known": F.count("_y").over(order), "label_sum": F.coalesce(F.sum("_y").over(order), F.lit(0))})
    return both.filter("_kind = 0").select(sample_id, "n_known", "label_sum")


def smoothed_ppm(label_sum: Column, n: Column, prior_ppm: int, weight: int) -> Column:
    """Smoothed mean in millionths, in whole numbers: (sum + weight x prior) / (n + weight), rounded down."""
    return F.floor((label_sum * 1_000_000 + F.lit(prior_ppm * weight)) / (n + weight)).cast("long")


def hierarchical(samples: DataFrame, outcomes: DataFrame, levels: list[list[str]], sample_id: str, at: str, label: str, available_at: str, least: int = 3, prior_ppm: int = 200_000, weight: int = 10) -> DataFrame:
    """(sample_id, encoding_ppm, level, cold_start): the first level with enough known history speaks; without any, the prior, marked cold."""
    out = samples.select(sample_id)
    for i, keys in enumerate(levels):
        known = known_history(samples, outcomes, keys, sample_id, at, label, available_at)
        out = out.join(known.select(sample_id, F.col("n_known").alias(f"_n{i}"), F.col("label_sum").alias(f"_s{i}")), sample_id)
    value, level = F.lit(prior_ppm).cast("long"), F.lit(len(levels))
    for i in reversed(range(len(levels))):
        enough = F.col(f"_n{i}") >= least
        value, level = F.when(enough, smoothed_ppm(F.col(f"_s{i}"), F.col(f"_n{i}"), prior_ppm, weight)).otherwise(value), F.when(enough, i).otherwise(level)
    return out.select(sample_id, value.alias("encoding_ppm"), level.alias("level"), (level == len(levels)).alias("cold_start"))


def matured(df: DataFrame, available_at: str, cutoff: Column) -> DataFrame:
    """Rows whose outcome was available by the cutoff."""
    return df.filter(F.col(available_at) <= cutoff)


def split_by_time(df: DataFrame, at: str, train_end: str, valid_end: str) -> DataFrame:
    """Adds part: train, valid or test, by time alone, so that no boundary is crossed."""
    ts = lambda x: F.lit(x).cast(df.schema[at].dataType)
    return df.withColumn("part", F.when(F.col(at) < ts(train_end), "train").when(F.col(at) < ts(valid_end), "valid").otherwise("test"))


def leakage_checks(split: DataFrame, logical: str, at: str, available_at: str, cutoff: Column) -> DataFrame:
    """(check, violations) of rows split into parts: logical ids in more than one part, parts whose times overlap, outcomes that are known before their own prediction, and outcomes that are not known by the cutoff."""
    parts = split.groupBy("part").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    turn = F.when(F.col("part") == "train", 0).when(F.col("part") == "valid", 1).otherwise(2)
    ordered = parts.withColumn("before", F.max("last").over(Window.orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)))  # three rows
    counted = lambda df, name: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
    rows = split.agg(F.count_if(F.col(available_at) <= F.col(at)).alias("OUTCOME_KNOWN_BEFORE"), F.count_if(F.col(available_at).isNull() | (F.col(available_at) > cutoff)).alias("OUTCOME_NOT_MATURE"))
    crossing = split.groupBy(logical).agg((F.min("part") != F.max("part")).alias("crosses")).filter("crosses")
    rows = rows.unpivot([], ["OUTCOME_KNOWN_BEFORE", "OUTCOME_NOT_MATURE"], "check", "violations")
    return rows.unionByName(counted(crossing, "LOGICAL_ID_CROSSES_PARTS")).unionByName(counted(ordered.filter("first <= before"), "PARTS_OVERLAP"))


def release(checks: DataFrame) -> str:
    """DEPLOY, or NO_DEPLOY if any check has a violation or there are no checks."""
    found = checks.agg(F.count("*").alias("n"), F.coalesce(F.sum("violations"), F.lit(0)).alias("bad")).first()
    return "DEPLOY" if found.n and not found.bad else "NO_DEPLOY"


def cold_slices(df: DataFrame, keys: list[str]) -> DataFrame:
    """(part, seen_..., rows): how many rows of valid and test have keys that train has."""
    train = df.filter("part = 'train'")
    out = df.filter("part <> 'train'")
    for k in keys:
        out = out.join(train.select(k, F.lit(True).alias(f"seen_{k}")).distinct(), k, "left").fillna(False, [f"seen_{k}"])
    return out.groupBy("part", *(f"seen_{k}" for k in keys)).agg(F.count("*").alias("rows"))


def leaky_rate(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The plain mean of labels over all time: the negative control, which sees its own label and the future."""
    return df.withColumn("rate", F.avg(F.col(label).cast("double")).over(Window.partitionBy(*keys)))


def fit_classifier(train: DataFrame, numbers: list[str], label: str):
    """A scaler and a logistic regression, both fitted on the training part alone."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    steps = [VectorAssembler(inputCols=numbers, outputCol="_raw", handleInvalid="error"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), LogisticRegression(featuresCol="_scaled", labelCol=label, regParam=0.01)]
    return Pipeline(stages=steps).fit(train)


def evaluate(model, part: DataFrame, label: str) -> dict[str, float]:
    """Areas under the ROC and the precision-recall curve, and the Brier score."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(part)
    area = lambda metric: BinaryClassificationEvaluator(labelCol=label, metricName=metric).evaluate(scored)
    chance = vector_to_array("probability")[1]
    return {"roc": area("areaUnderROC"), "pr": area("areaUnderPR"), "brier": scored.agg(F.avg((chance - F.col(label)) ** 2)).first()[0]}
