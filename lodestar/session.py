"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lodestar", **conf: str) -> SparkSession:
    """A session with what the operators rely on: UTC, ANSI, adaptive execution. Further settings by keyword (dots as __)."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that spark.checkpoint.dir names. Where it is unset, a temporary one if all run in
    one process, else an error, as executors don't see each other's disks."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="lodestar-"))
    checkpoints_go(df.sparkSession)
    return df.checkpoint(eager=True)


_going: set[str] = set()
_shipped: set[str] = set()


def checkpoints_go(spark: SparkSession) -> None:
    """The folder that Spark keeps this application's checkpoints in, which no other can read, goes when the driver ends."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder and folder not in _going:
        _going.add(folder)
        p = sc._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application, so that workers need no installation of it."""
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app in _shipped or not root.is_dir():
        return
    _shipped.add(app)
    path = Path(tempfile.mkdtemp(prefix="lodestar-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(path))
