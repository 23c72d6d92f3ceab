"""The evaluations end to end, from tables to metric tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.targets import exact_match, oracle_type, target_from_flag
from ..functions.text import preview, strip
from ..session import cut
from .metrics import exact_match_accuracy, exact_match_by, micro
from .pairing import head, key_join, positional
from .predict import Predictor, predict_column, predict_timed


def predictions_table(df: DataFrame) -> DataFrame:
    """id, test_prefix (its first characters), prediction, target, exact_match."""
    return df.select("id", preview(F.col("test_prefix")).alias("test_prefix"), "prediction", "target", exact_match(F.col("prediction"), F.col("target")).alias("exact_match"))


def load_keyed(inputs: DataFrame, meta: DataFrame) -> DataFrame:
    """Inputs joined with their meta rows by id, with the target; nulls of code columns stay null."""
    have = set(meta.columns)
    assertion = F.col("GTassert") if "GTassert" in have else F.lit("")
    flag = F.coalesce(F.col("assertORexception"), F.lit(0)) if "assertORexception" in have else F.lit(0)
    return key_join(inputs, meta, "id").withColumn("target", target_from_flag(assertion, flag))


def first_rows(d: DataFrame, subset: int | None) -> DataFrame:
    """The first rows of a join, by input order; None and 0 mean all."""
    order = [c for c in ("row_idx", "row_idx_x", "row_idx_y") if c in d.columns] or [c for c in ("id", "doc_id") if c in d.columns]
    return d.orderBy(*order).limit(subset) if subset else d


def evaluate_paired(inputs: DataFrame, meta: DataFrame, make: Callable[[], Predictor], subset: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, one row of metrics) for tables keyed by id; subset takes the first rows of the join, by input order."""
    d = predict_column(first_rows(load_keyed(inputs, meta), subset), make)
    return predictions_table(d), exact_match_accuracy(d)


def load_positional(inputs: DataFrame, meta: DataFrame, subset: int | None = None) -> DataFrame:
    """Rows of one project paired by row_idx as far as the shorter table goes."""
    right = head(meta, subset).select("row_idx", *[F.col(c).alias(c if c not in inputs.columns else f"meta_{c}") for c in meta.columns if c != "row_idx"])
    d = positional(head(inputs, subset), right, "min")
    return d.withColumn("target", F.coalesce(strip(F.col("GT_output")), F.lit("")))


def evaluate_by_project(df: DataFrame, make: Callable[[], Predictor]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, metrics and seconds by project, micro average) of rows with project and target. Predictions are made
    once and kept by a checkpoint, so that all three speak of the same ones."""
    d = cut(predict_timed(df, make))
    by = exact_match_by(d, "project", seconds="seconds")
    return predictions_table(d), by, micro(by)


def evaluate_bugs(df: DataFrame, make: Callable[[], Predictor]) -> DataFrame:
    """Predictions with predicted and true oracle types; flags that are null stop the run, as they do not say what is true."""
    d = predict_column(df, make, "predicted_oracle")
    ok = F.assert_true(F.col("exception_bug").isNotNull() & F.col("assertion_bug").isNotNull(), "a bug flag is null")
    d = d.withColumn("_ok", ok).where(F.col("_ok").isNull()).drop("_ok")
    return d.withColumn("oracle_type", oracle_type(F.col("predicted_oracle"))).withColumn("ground_truth_type", F.when(F.col("exception_bug") != 0, 1).otherwise(0)).withColumn("test_prefix", preview(F.col("test_prefix")))
