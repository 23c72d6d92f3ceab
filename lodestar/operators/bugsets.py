"""Sets of found bugs and their comparison."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..sources.readers import exists, load_csv

KEY = ("project", "bug_num")
#: The routes that one comparison of methods looks at; totals look at all three.
COMPARED = ("assertion", "exception")


def bug_set(df: DataFrame, routes: Iterable[str] | None = None, key: tuple[str, ...] = KEY) -> DataFrame:
    """Distinct bugs with a true positive on the routes (None: on any)."""
    d = df.where(F.col("TP"))
    return (d.where(F.col("route").isin(*routes)) if routes is not None else d).select(*key).distinct()


#: Folders of a method's results, by route.
ROUTE_FOLDERS = {"assertion": "assertion_prefix", "exception": "exception_prefix", "prefix_only": "prefix_only"}


def load_results(spark: SparkSession, base: str, method: str) -> DataFrame:
    """project, bug_num, TP, route, method of the routes whose base/<route folder>/<method>_generated/test_data.csv exists."""
    out = spark.createDataFrame([], schemas.TEST_DATA).withColumn("route", F.lit("")).withColumn("method", F.lit(method))
    for route, folder in ROUTE_FOLDERS.items():
        path = f"{base.rstrip('/')}/{folder}/{method.lower()}_generated/test_data.csv"
        if exists(spark, path):
            out = out.unionByName(load_csv(spark, path, schemas.TEST_DATA).withColumn("route", F.lit(route)).withColumn("method", F.lit(method)))
    return out


def union(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def cardinality(s: DataFrame) -> DataFrame:
    return s.distinct().agg(F.count("*").alias("n"))


def summary(df: DataFrame, a: str, b: str, routes: Iterable[str] | None = None) -> DataFrame:
    """total_a, total_b, only_a, only_b, both for two methods: one aggregation over (bug, method)."""
    d = df.where(F.col("TP") & F.col("method").isin(a, b))
    d = d.where(F.col("route").isin(*routes)) if routes is not None else d
    seen = d.groupBy(*KEY).agg(F.max(F.col("method") == a).alias("a"), F.max(F.col("method") == b).alias("b"))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return seen.agg(
        count(F.col("a")).alias("total_a"), count(F.col("b")).alias("total_b"), count(F.col("a") & ~F.col("b")).alias("only_a"),
        count(F.col("b") & ~F.col("a")).alias("only_b"), count(F.col("a") & F.col("b")).alias("both"),
    )
