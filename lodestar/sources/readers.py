"""Sources: CSV, JSON, token corpora, Java files, logs, directories of projects, constant tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.text import part

# Texts of CSV cells that mean a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# The projects of the generalisation and mutation studies, in order.
PROJECTS = (
    "async-http-client", "bcel-6.5.0-src", "commons-beanutils-1.9.4", "commons-collections4-4.4-src", "commons-configuration2-2.8.0-src",
    "commons-dbutils-1.7", "commons-geometry-1.0-src", "commons-imaging-1.0-alpha3-src", "commons-jcs3-3.1-src", "commons-jexl3-3.2.1-src",
    "commons-lang3-3.12.0-src", "commons-net-3.8.0", "commons-numbers-1.0-src", "commons-pool2-2.11.1-src", "commons-rng-1.4-src",
    "commons-validator-1.7", "commons-vfs-2.9.0", "commons-weaver-2.0-src", "http-request", "joda-time", "JSON-java", "jsoup",
    "scribejava", "spark", "springside4",
)
# Backbones and the names they go by.
MODELS = (
    ("microsoft/CodeGPT-small-java", "codegpt"), ("codeparrot/codeparrot-small-multi", "codeparrot"), ("Salesforce/codegen-350M-multi", "codegen-350M"),
    ("NinedayWang/PolyCoder-0.4B", "polycoder"), ("microsoft/phi-1", "phi-1"), ("Salesforce/codegen-2B-multi", "codegen-2B"), ("NinedayWang/PolyCoder-2.7B", "polycoder-2B"),
)


def missing_to_null(c: Column) -> Column:
    return F.when(~c.isin(*MISSING), c)


def load_csv(spark: SparkSession, path: str | list[str], schema: str | StructType, *more: Column) -> DataFrame:
    """CSV with a header and multi-line quoted cells. Columns are found by name, whatever their order; missing optional
    ones are null; a blank before a header's name is forgiven; cells that mean a missing value are null. more: further columns of the raw rows."""
    want = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    raw = spark.read.options(header=True, multiLine=True, escape='"', inferSchema=False).csv(path)
    have = {c.strip(): c for c in raw.columns}
    out = []
    for f in want:
        c = missing_to_null(F.col(f"`{have[f.name]}`")) if f.name in have else F.lit(None)
        kind = f.dataType.simpleString()
        if kind in ("int", "bigint") and f.name in have:
            c = c.try_cast("double")  # a column with gaps is written with decimals
        out.append((c.try_cast(f.dataType) if f.name in have else c.cast(f.dataType)).alias(f.name))
    return raw.select(*out, *more)


def load_json(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A file that is one JSON array, or JSON lines of objects that may span lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def load_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def load_tokens(spark: SparkSession, path: str, layout: str | None = None, split: str | None = None) -> DataFrame:
    """A token corpus; layout and split prune its folders."""
    d = spark.read.schema(schemas.TOKENS).parquet(path)
    for c, v in (("layout", layout), ("split", split)):
        d = d.where(F.col(c) == v) if v is not None else d
    return d


def load_java(spark: SparkSession, base: str) -> DataFrame:
    """project, relative_path, source of every .java file below base/<project>/; files that are not UTF-8 are skipped."""
    raw = spark.read.format("binaryFile").options(pathGlobFilter="*.java", recursiveFileLookup=True).load(base)
    below = F.regexp_replace("path", r"^.*\Q" + base.rstrip("/").rpartition(":")[2] + r"\E/", "")
    d = raw.where(F.is_valid_utf8(F.col("content").cast("string"))).withColumn("below", below)
    source = F.replace(F.decode("content", "UTF-8"), F.lit("\r\n"), F.lit("\n"))
    return d.select(F.substring_index("below", "/", 1).alias("project"), F.regexp_replace("below", "^[^/]*/", "").alias("relative_path"), source.alias("source"))


def load_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("stdout"))


def load_project_predictions(spark: SparkSession, base: str) -> DataFrame:
    """Predictions of every project folder that holds a predictions.json, with the project's name and the row's place."""
    d = spark.read.schema(schemas.PREDICTIONS).option("multiLine", True).json(f"{base.rstrip('/')}/*/predictions.json")
    return d.select("*", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("project"), F.monotonically_increasing_id().alias("pred_seq"))


def load_project_meta(spark: SparkSession, base: str, name: str = "meta_llm.csv") -> DataFrame:
    """Meta rows of every project folder that holds such a file, with the project's name and the row's place (at)."""
    place = (F.element_at(F.split("_metadata.file_path", "/"), -2).alias("project"), F.monotonically_increasing_id().alias("at"))
    return load_csv(spark, f"{base.rstrip('/')}/*/{name}", schemas.META_LLM, *place)


def exists(spark: SparkSession, path: str) -> bool:
    """Through Hadoop's file systems, so that any store Spark reads will do."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_existing(spark: SparkSession, paths: dict[str, str], schema: str, required: bool = False) -> DataFrame:
    """The CSVs that exist, with their name in column name; with required, a missing one is an error."""
    out = spark.createDataFrame([], schema).withColumn("name", F.lit(""))
    for name, path in paths.items():
        if exists(spark, path):
            out = out.unionByName(load_csv(spark, path, schema).withColumn("name", F.lit(name)))
        elif required:
            raise FileNotFoundError(path)
    return out


def projects(spark: SparkSession, n: int | None = None) -> DataFrame:
    rows = [(i, p) for i, p in enumerate(PROJECTS)][: n or None]
    return spark.createDataFrame(rows, "row_idx bigint, project string")


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, b, n) for i, (b, n) in enumerate(MODELS)], "row_idx bigint, backbone string, model_name string")


def test_method(test_name: Column) -> Column:
    return part(test_name, "::", 1)
