"""Predictors of oracles behind one interface, and their application to rows."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


class Predictor(Protocol):
    def generate(self, test_prefix: str, focal_method: str | None = None, docstring: str | None = None) -> str: ...


class ConstantPredictor:
    def __init__(self, oracle: str):
        self.oracle = oracle

    def generate(self, test_prefix, focal_method=None, docstring=None) -> str:
        return self.oracle


class RulePredictor:
    """'exception' for a prefix with a try, else a not-null assertion on the first variable it assigns, else ''."""

    def generate(self, test_prefix, focal_method=None, docstring=None) -> str:
        if "try" in test_prefix:
            return "exception"
        m = re.search(r"\bint (\w+) =", test_prefix)
        return f"assertNotNull({m[1]});" if m else ""


class LookupPredictor:
    """From a bounded table of prefixes; '' for others."""

    def __init__(self, table: dict[str, str]):
        self.table = table

    def generate(self, test_prefix, focal_method=None, docstring=None) -> str:
        return self.table.get(test_prefix, "")


def predict_column(df: DataFrame, make: Callable[[], Predictor], out: str = "prediction", prefix: str = "test_prefix", method: str = "focal_method", doc: str = "docstring") -> DataFrame:
    """Apply a predictor, made once per worker task, to every row; a failure gives '', and null parts reach it as None."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        p = make()

        def one(a, b, c) -> str:
            try:
                return p.generate(a, b, c)
            except Exception:  # whatever a model raises: the row keeps its target and gets no oracle
                return ""

        for a, b, c in parts:
            yield pd.Series([one(*x) for x in zip(a, b, c, strict=True)], dtype=object)

    return df.withColumn(out, run(prefix, method, doc))


def predict_scored(df: DataFrame, make: Callable[[], Callable[[list[int]], tuple[str, float]]], inputs: str = "inputs") -> DataFrame:
    """Batched decoding with a score: id, output, score."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = make()
        for b in batches:
            got = [decode(list(x)) for x in b[inputs]]
            yield pd.DataFrame({"id": b["id"], "output": [o for o, _ in got], "score": [float(s) for _, s in got]})

    return df.select("id", inputs).mapInPandas(run, "id bigint, output string, score double")


def top_candidate(df: DataFrame, key: str = "id", score: str = "score", tie: str = "output") -> DataFrame:
    """The best-scored candidate of each key, of equal ones the least; rows without a score come last. Found before anything
    is shuffled, and again after. Scores are numbers."""
    rest = [c for c in df.columns if c != key]
    order = F.struct(F.col(score).isNull(), -F.col(score), F.col(tie))
    d = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_f"))
    return d.select(*[F.col(key) if c == key else F.col("_f")[c].alias(c) for c in df.columns])


def predict_timed(df: DataFrame, make: Callable[[], Predictor], out: str = "prediction", seconds: str = "seconds", prefix: str = "test_prefix", method: str = "focal_method", doc: str = "docstring") -> DataFrame:
    """predict_column() with the seconds that each row took."""
    ship(df.sparkSession)

    @F.pandas_udf("prediction string, seconds double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        p = make()
        for a, b, c in parts:
            rows = []
            for x in zip(a, b, c, strict=True):
                began = time.perf_counter()
                try:
                    got = p.generate(*x)
                except Exception:  # as in predict_column
                    got = ""
                rows.append((got, time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=["prediction", "seconds"])

    # the struct is made once: without the filter on it, each field would call the predictor anew
    d = df.withColumn("_p", run(prefix, method, doc)).where(F.col("_p").isNotNull())
    return d.withColumn(out, F.col("_p.prediction")).withColumn(seconds, F.col("_p.seconds")).drop("_p")


def predict_resumable(df: DataFrame, make: Callable[[], Predictor], path: str, key: str = "id", parts: int = 10, **names: str) -> DataFrame:
    """Predictions kept as they are made, so that a run that was killed goes on where it was. Returns df with what is stored.

    df is read once: its rows whose keys the folder does not hold yet are laid out in `parts` parts by a hash of the key, under
    <path>/<run>/open/part=N, which counts from the moment it is whole. Each part is then read alone, predicted, written
    beside, and published by renaming its folder to <path>/<run>/done/part=N: the names are the ledger. A run that starts
    again first finishes parts that an earlier one left open, and reads no more of them than these. Of rows with equal keys
    one is predicted; null is a key. Names of columns in `names` as in predict_column().
    """
    spark = df.sparkSession
    fs = Folder(spark, path)
    runs = [r for r in fs.names() if fs.has(f"{r}/open/_SUCCESS")]
    schema = df.select(key).withColumn("prediction", F.lit("")).schema
    staged = [spark.read.schema(df.schema).parquet(f"{path}/{r}/open") for r in runs]
    new = df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)))
    if staged:
        held = reduce(DataFrame.unionByName, [d.select(F.col(key).alias("_held")) for d in staged])
        new = new.join(held, F.col(key).eqNullSafe(F.col("_held")), "left_anti")
    run = f"run-{len(fs.names()):06d}-{uuid.uuid4().hex[:8]}"
    new.withColumnRenamed("_part", "part").write.partitionBy("part").parquet(f"{path}/{run}/open")
    for r in [*runs, run]:
        done = set(fs.names(f"{r}/done"))
        for part in sorted(n for n in fs.names(f"{r}/open") if n.startswith("part=") and n not in done):
            todo = spark.read.schema(df.schema).parquet(f"{path}/{r}/open/{part}").dropDuplicates([key])
            beside = f"{r}/writing/{part}-{uuid.uuid4().hex[:8]}"
            predict_column(todo, make, **names).select(key, "prediction").write.parquet(f"{path}/{beside}")
            fs.publish(beside, f"{r}/done/{part}")
    kept = [spark.read.schema(schema).parquet(f"{path}/{r}/done/{n}") for r in [*runs, run] for n in fs.names(f"{r}/done")]
    if not kept:
        return df.withColumn("prediction", F.lit(None).cast("string")).limit(0)
    kept = reduce(DataFrame.unionByName, kept).withColumnRenamed(key, "_held")
    return df.join(kept, F.col(key).eqNullSafe(F.col("_held"))).drop("_held")


class Folder:
    """Names and renames below a folder of any store that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.root, self._fs = path, self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def has(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.has(name) else []

    def publish(self, name: str, to: str) -> None:
        """Rename a folder, unless another run has published it before."""
        self._fs.mkdirs(self._at(to).getParent())
        if self.has(to) or not self._fs.rename(self._at(name), self._at(to)):
            self._fs.delete(self._at(name), True)
            if not self.has(to):
                raise OSError(f"cannot publish {to}")
