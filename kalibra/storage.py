"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset and the session is one local process does a folder
    of our own serve.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"/tmp/checkpoints/kalibra-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _remove(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):  # the gateway may be gone, or the folder
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


#: Spark's setting by which a query's shuffle files go when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written here go when it is written, not when the driver happens to collect its garbage: no later plan reads them."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


class Scratch:
    """Tables written to the shared folder, which cut the lineage of later plans.

    Results are lazy and read them, so they stay until the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/kalibra-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(_remove, spark._jvm, spark._jsc.hadoopConfiguration(), self.root)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        with tidy(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kalibra_path = path
        return out

    def append(self, table: DataFrame | None, df: DataFrame) -> DataFrame:
        """A table of write() with the rows of df added."""
        if table is None:
            return self.write(df)
        with tidy(self.spark):
            df.write.mode("append").parquet(table._kalibra_path)
        out = self.spark.read.schema(table.schema).parquet(table._kalibra_path)
        out._kalibra_path = table._kalibra_path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of write() that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._kalibra_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Delete all tables, which no later plan reads."""
        _remove(self.spark._jvm, self.spark._jsc.hadoopConfiguration(), self.root)


#: Rows of a task where they are dealt out by the size of their table, so that a task's memory doesn't grow with it.
ROWS = 500_000


def tasks(table: DataFrame, rows: int | None = None) -> int:
    """Tasks of about so many rows of a table, whose count is read from its footers."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // (rows or ROWS)))
