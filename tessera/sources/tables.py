"""Parquet tables as views, and round trips through the file formats that Spark writes by itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Make a temporary view of each table; scans stay lazy, so filters and columns reach the files."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share, or in a temporary one where none is set and Spark runs in this process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"


#: Rows of a written file at most: a file of a format that can't be split, such as XML, is read by one task.
FILE_ROWS = 50_000


def round_trip(df: DataFrame, kind: str, partition_by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Write df as `kind` and read it back with its own schema, never an inferred one."""
    path = scratch(df.sparkSession)
    df.write.format(kind).option("maxRecordsPerFile", FILE_ROWS).options(**options).partitionBy(*partition_by).save(path)
    return df.sparkSession.read.format(kind).schema(df.schema).options(**options).load(path).select(*df.columns)


def held(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: written once, so that every later read sees the same rows in the same files."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
