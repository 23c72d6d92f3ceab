"""Extension: predictions that arrive as files, scored as a stream. Batch results are the same operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.targets import exact_match


def read_predictions(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines of predictions as they arrive below folder/<project>/."""
    d = spark.readStream.schema(schemas.PREDICTIONS).option("maxFilesPerTrigger", files_per_trigger).json(f"{folder.rstrip('/')}/*/")
    return d.withColumn("project", F.element_at(F.split("_metadata.file_path", "/"), -2))


def running_accuracy(stream: DataFrame) -> DataFrame:
    """project, num_samples, num_matches so far: sums, so late files are simply added."""
    hit = F.when(exact_match(F.col("prediction"), F.col("target")), 1).otherwise(0)
    return stream.groupBy("project").agg(F.count("*").alias("num_samples"), F.sum(hit).alias("num_matches"))


def write_running(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep a memory table up to date; takes what is there and stops."""
    return stream.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
