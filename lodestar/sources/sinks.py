"""Sinks: CSV, JSON, token corpora, appended metrics, files rewritten where they are."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning
from ..operators.pairing import with_row_index
from ..session import ship


def save_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Quoted as read back by load_csv; one_file only for small results."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").options(header=True, escape='"', quoteAll=False).csv(path)


def save_json(df: DataFrame, path: str) -> None:
    """JSON lines; non-ASCII text stays as it is."""
    df.write.mode("overwrite").json(path)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save_json_array(df: DataFrame, path: str, *keys: str) -> None:
    """One file with one JSON array, indented by two, of any number of rows, in order of the keys (of all columns where none
    is given). Tasks write the rows as text; the driver strings their files together, a buffer at a time. `path` is in any
    store that Spark writes; what is there is replaced."""
    spark = df.sparkSession
    ship(spark)
    columns = df.columns
    d = with_row_index(df.select(F.struct(*columns).alias("row"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys or columns)]), *[f"k{i}" for i in range(len(keys or columns))])
    n = d.count()
    lines = d.select(F.to_json("row", {"ignoreNullFields": "false"}).alias("row"), "row_idx")

    def text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"value": ["  " + json.dumps(json.loads(r), indent=2, ensure_ascii=False).replace("\n", "\n  ") + ("," if i < n - 1 else "") for r, i in zip(b["row"], b["row_idx"], strict=True)]})

    parts = f"{path}-{uuid.uuid4().hex}"
    if n:
        lines.mapInPandas(text, "value string").write.text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files, to = _files(spark, path)
    out = files.create(to, True)
    try:
        out.write(bytearray(b"[\n" if n else b"["))
        found = sorted(f.getPath().toString() for f in files.listStatus(_files(spark, parts)[1])) if n else []
        for name in found:
            if "/part-" in name:
                source = files.open(_files(spark, name)[1])
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
                source.close()
        out.write(bytearray(b"]"))
    finally:
        out.close()
        files.delete(_files(spark, parts)[1], True)


def save_tokens(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("layout", "split").parquet(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def oracle_template(df: DataFrame) -> DataFrame:
    """The table that predictions are filled into: placeholders -1 and 'nan', exception rows first, each by id."""
    rank = F.when(F.col("is_exception"), 0).otherwise(1)
    d = df.withColumn("route_rank", rank).withColumn("except_pred", F.lit(-1)).withColumn("assert_pred", F.lit("nan"))
    return d.orderBy("route_rank", "id").select("id", "project", "bug_num", "test_name", "test_prefix", "except_pred", "assert_pred", "clean_test_prefix")


def save_oracle_template(df: DataFrame, path: str, one_file: bool = True) -> None:
    """The template of test prefixes (id, project, bug_num, test_name, test_prefix) as CSV, in its order; one_file gathers
    the sorted rows in one task, else the files' names are in order."""
    d = df.withColumn("is_exception", cleaning.is_exception_oracle(F.col("test_prefix"))).withColumn("clean_test_prefix", cleaning.clean_prefix(F.col("test_prefix")))
    save_csv(oracle_template(d), path, one_file)


def copy_file(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a file, in any store that Spark reads; a failure is printed, not raised."""
    try:
        (a, p), (b, q) = _files(spark, source), _files(spark, target)
        return bool(spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, spark.sparkContext._jsc.hadoopConfiguration()))
    except Exception as e:  # whatever the store says
        print(f"{source} was not copied to {target}: {str(e).splitlines()[0]}")
        return False


def rewrite_in_place(df: DataFrame, backup: bool = True) -> DataFrame:
    """Rewrite text files (columns path, content) where they are, on a file system that all executors see; what a file held
    is kept beside it as <path>.bak, if asked. Only files that exist and differ are touched, and by a rename, so a task that
    runs again finds its work done. Returns path and changed (null: no such file); nothing happens before it is read, and
    it happens once: the result is checkpointed."""
    from ..session import cut

    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        def one(path: str, content: str) -> bool | None:
            files, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
            if files.get_file_info(at).type != fs.FileType.File:
                return None
            with files.open_input_stream(at) as f:
                old = f.read()
            if old == content.encode():
                return False
            for name, data in ([(f"{at}.bak", old)] if backup else []) + [(at, content.encode())]:
                with files.open_output_stream(f"{at}.new") as f:
                    f.write(data)
                files.move(f"{at}.new", name)
            return True

        for b in batches:
            yield pd.DataFrame({"path": b["path"], "changed": pd.Series([one(p, c) for p, c in zip(b["path"], b["content"], strict=True)], dtype="boolean")})

    return cut(df.select("path", "content").where("path is not null and content is not null").mapInPandas(run, "path string, changed boolean"))


def save_command_log(df: DataFrame, path: str) -> None:
    """A command log as a table, by version and project."""
    df.write.mode("append").partitionBy("version", "project").parquet(path)
