"""Exact match, precision, recall, F1, reports, training-log aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.targets import exact_match
from .scans import prefix_scan


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b as a double; `empty` where b is 0."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return q if empty is None else F.coalesce(q, F.lit(empty))


def seconds_per_sample(seconds: Column, samples: Column) -> Column:
    """Average seconds a sample; 0.0 where there are none."""
    return ratio(seconds, samples)


def hits(prediction: str, target: str) -> Column:
    return F.sum(F.when(exact_match(F.col(prediction), F.col(target)), 1).otherwise(0))


def exact_match_by(df: DataFrame, group: str, prediction: str = "prediction", target: str = "target", seconds: str | None = None) -> DataFrame:
    """group, num_samples, num_matches, accuracy; with a column of seconds also their sum and seconds_per_sample."""
    took = [F.coalesce(F.sum(seconds), F.lit(0.0)).alias("seconds")] if seconds else []
    d = df.groupBy(group).agg(F.count("*").alias("num_samples"), F.coalesce(hits(prediction, target), F.lit(0)).alias("num_matches"), *took)
    d = d.withColumn("accuracy", ratio(F.col("num_matches"), F.col("num_samples"), None))
    return d.withColumn("seconds_per_sample", seconds_per_sample(F.col("seconds"), F.col("num_samples"))) if seconds else d


def micro(by_group: DataFrame) -> DataFrame:
    """Matches over samples of all groups; 0.0 if there are none."""
    d = by_group.agg(F.coalesce(F.sum("num_samples"), F.lit(0)).alias("num_samples"), F.coalesce(F.sum("num_matches"), F.lit(0)).alias("num_matches"))
    return d.withColumn("accuracy", ratio(F.col("num_matches"), F.col("num_samples")))


def exact_match_accuracy(df: DataFrame, prediction: str = "prediction", target: str = "target", initial: int = 0) -> DataFrame:
    """One row; accuracy is null of an empty table. initial: a count to start from, to replay counters that began at 1."""
    d = df.agg(F.count("*").alias("num_samples"), (F.coalesce(hits(prediction, target), F.lit(0)) + initial).alias("num_matches"))
    return d.withColumn("accuracy", ratio(F.col("num_matches"), F.col("num_samples"), None))


def confusion(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """class, tp, predicted, support, precision, recall, f1 of each class in truth or prediction; nothing over zero is 0."""
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("truth").alias("class"), F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(zero).alias("tp"), zero.alias("predicted"), F.col("n").alias("support")),
        F.struct(F.col("prediction").alias("class"), zero.alias("tp"), F.col("n").alias("predicted"), zero.alias("support")),
    )
    d = confusion(df, truth, prediction).select(F.inline(sides)).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])
    d = d.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return d.withColumn("f1", ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")))


def macro(classes: DataFrame) -> DataFrame:
    return classes.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def classification_report(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """label, precision, recall, f1, support: the classes, then accuracy, macro avg and weighted avg. One pass over df."""
    c = per_class(df, truth, prediction)
    n = F.sum("support")
    rows = [
        F.struct(F.lit("accuracy").alias("label"), *[ratio(F.sum("tp"), n).alias(k) for k in ("precision", "recall", "f1")], n.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), *[F.avg(k).alias(k) for k in ("precision", "recall", "f1")], n.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), *[ratio(F.sum(F.col(k) * F.col("support")), n).alias(k) for k in ("precision", "recall", "f1")], n.alias("support")),
    ]
    totals = c.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    return c.select(F.col("class").cast("string").alias("label"), "precision", "recall", "f1", "support").unionByName(totals)


def loss_buckets(steps: DataFrame, every: int = 200) -> DataFrame:
    """epoch, step, mean_loss at each step that closes a bucket: step 0 alone, then every `every` steps; the open tail is
    not reported. Losses are summed as decimals, so the order of rows doesn't matter."""
    d = steps.withColumn("bucket", F.ceil(F.col("step") / every))
    d = d.groupBy("epoch", "bucket").agg(F.sum(F.col("loss").cast("decimal(18,8)")).alias("s"), F.count("*").alias("n"), F.max("step").alias("step"))
    return d.where(F.col("step") == F.col("bucket") * every).select("epoch", "step", (F.col("s").cast("double") / F.col("n")).alias("mean_loss"))


def running_best(accuracies: DataFrame) -> DataFrame:
    """epoch, accuracy, best_before, saved: an epoch is saved if it is strictly better than all before, and than 0."""
    d = prefix_scan(accuracies, ["epoch"], {"best_before": ("max", "accuracy")}, inclusive=False).withColumn("best_before", F.coalesce("best_before", F.lit(0.0)))
    return d.withColumn("saved", F.col("accuracy") > F.col("best_before"))


def distinct_matches(df: DataFrame, key: str = "id", prediction: str = "prediction", target: str = "target") -> DataFrame:
    return df.where(exact_match(F.col(prediction), F.col(target))).agg(F.count_distinct(key).alias("matched_ids"))
