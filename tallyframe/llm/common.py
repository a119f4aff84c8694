"""Shared plumbing: durable intermediate tables, code shipping, table access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the setting is absent (a single machine, as in tests) a
    temporary folder of this process is used instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = Path(tempfile.mkdtemp(prefix="tallyframe-")).as_uri()
    return _LOCAL_FALLBACK[app]


class Scratch:
    """Durable tables in the shared folder; they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, records: int = 1000, megabytes: int = 8) -> DataFrame:
        """Write ``df`` once and return a scan of what was written.

        Meanwhile an Arrow batch holds at most so many rows and megabytes; the
        session's own setting is put back.
        """
        with batches_of(self.spark, records, megabytes):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path(name))
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of any cluster."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="ship-")), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(file.relative_to(package.parent)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


@contextmanager
def batches_of(spark: SparkSession, records: int, megabytes: int) -> Iterator[None]:
    """Bound what one Arrow batch holds while a job runs, by rows and by bytes."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(records), "spark.sql.execution.arrow.maxBytesPerBatch": str(megabytes << 20)}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def unused(names: list[str], *wanted: str) -> tuple[str, ...]:
    """Column names like those wanted that none of ``names`` clashes with."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text):
    """Lower-case A-Z and nothing else; the cheap path covers pure ASCII rows."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def partitions_for(spark: SparkSession, nbytes: int, target_mb: int = 32, least: int | None = None) -> int:
    """Shuffle partitions so that each holds about ``target_mb``."""
    floor = least if least is not None else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, -(-int(nbytes) // (target_mb << 20)))
