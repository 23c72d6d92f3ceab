"""Shared helpers of the llm subpackage: table access, shared folders, Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoints_go, ship

#: What separates words in every contract of this subpackage: blank, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows (and bytes, where Spark knows that limit) in one Arrow batch, so that long texts cannot fill a worker.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20
#: A key with more rows than this is joined by broadcast: of n rows at most n / HEAVY keys have so many.
HEAVY = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers, and make this package known to these."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all run in
    one process (tests), else an error, as executors don't see each other's disks."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder, of `parts` files at most where that is said: by a caller
    that knows how many rows there may be, as many partitions of a few rows cost a file each. Its files go when the driver ends."""
    shared_dir(df.sparkSession)
    checkpoints_go(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that is read no more, in whatever store it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder that lazy results still read when the driver ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def join_counted(df: DataFrame, right: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """Inner or left join with a table of one row a key, whose column n counts the key's rows in df (and is dropped): keys of
    more than HEAVY rows, which are few, are broadcast and their rows stay where they are; the others are shuffled. right is
    computed twice, so it should be cheap."""
    rare, heavy = right.where(F.col(n) <= HEAVY).drop(n), right.where(F.col(n) > HEAVY).drop(n)
    if heavy.isEmpty():
        return df.join(rare, key, how)
    return df.join(F.broadcast(heavy.select(key)), key, "left_anti").join(rare, key, how).unionByName(df.join(F.broadcast(heavy), key))


def pick(df: DataFrame, columns: dict[str, str], types: dict[str, str] | None = None) -> DataFrame:
    """Exactly the named columns under fixed names, so that extra columns of any name cannot clash."""
    types = types or {}
    return df.select(*[(F.col(c).cast(types[n]) if n in types else F.col(c)).alias(n) for n, c in columns.items()])


def arrow_schema(df: DataFrame, names: list[str], extra: list[tuple[str, pa.DataType]]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    kept = [pa.field(n, to_arrow_type(df.schema[n].dataType)) for n in names]
    return pa.schema(kept + [pa.field(n, t) for n, t in extra])


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str | None]], dict[str, list]]],
    out: list[tuple[str, str, pa.DataType]],
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Run a function over the texts of each Arrow batch; the columns in `keep` pass through untouched.

    make() runs once per task and returns the function: list of texts -> {column: list}. out: (name, SQL type, Arrow type).
    """
    small_batches(df.sparkSession)
    df = df.select(*keep, text)
    schema = arrow_schema(df, list(keep), [(n, t) for n, _, t in out])
    ddl = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep] + [f"`{n}` {t}" for n, t, _ in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            got = f(b.column(b.schema.get_field_index(text)).to_pylist())
            cols = [b.column(b.schema.get_field_index(k)).cast(schema.field(k).type) for k in keep]
            yield pa.RecordBatch.from_arrays([*cols, *(got[n] if isinstance(got[n], pa.Array) else pa.array(got[n], t) for n, _, t in out)], schema=schema)

    return df.mapInArrow(run, ddl)


def aliased(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns under safe names, and the map back: names of computed columns cannot clash with any of them."""
    back = {f"in_{i}": c for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in back.items()]), back


def restored(df: DataFrame, back: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(n).alias(c) for n, c in back.items()])
