"""Reading tables the engine's way."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; zone-less timestamps become instants in the session zone."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df.select(*columns) if columns else df
    naive = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def write(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "error") -> None:
    out = df.write.mode(mode)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that all executors reach: under ``spark.checkpoint.dir``, or local on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named.rstrip('/')}/tables-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
    return Path(tempfile.mkdtemp(prefix="tallyframe-")).as_uri()


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Plain columns with a header, such as a table of importances."""
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a declared schema, so no pass is spent on guessing it."""
    return spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(schema).csv(path)
