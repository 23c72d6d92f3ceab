"""Routing of rows by oracle type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import is_exception_oracle
from ..functions.targets import nan_like

ROUTES = ("exception", "assertion", "prefix_only")


def with_route(df: DataFrame, prefix: str = "test_prefix", assertion: str = "assert_pred") -> DataFrame:
    """Column route by ground truth: exception tests, others with an assertion, the rest. Disjoint and total, in one scan."""
    exception = F.coalesce(is_exception_oracle(F.col(prefix)), F.lit(False))
    return df.withColumn("route", F.when(exception, "exception").when(~nan_like(F.col(assertion)), "assertion").otherwise("prefix_only"))


def by_prediction(df: DataFrame, columns: tuple[str, ...] = ("project", "bug_num", "test_name", "predicted_oracle")) -> dict[str, DataFrame]:
    """Routes by predicted type; prefix_only has every row and four columns."""
    return {"assertion": df.where("oracle_type = 0"), "exception": df.where("oracle_type = 1"), "prefix_only": df.select(*columns)}


def write_routes(df: DataFrame, path: str) -> None:
    df.write.partitionBy("route").parquet(path)
