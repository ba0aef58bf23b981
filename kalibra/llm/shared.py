"""Small helpers of the operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalibra.operators.graph import connected_components
from kalibra.storage import Scratch, shared_folder

__all__ = ["Scratch", "components", "fresh", "partitions", "release", "released", "shared_folder", "table", "worker_cache"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names beginning with the given ones that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache(owner: str) -> dict:
    """A dict that lives as long as the Python worker, across tasks, until another operator asks for its own."""
    box = sys.modules.setdefault("_kalibra_worker_cache", types.ModuleType("_kalibra_worker_cache"))
    if getattr(box, "owner", None) != owner:
        box.owner, box.held = owner, {}
    return box.held


def release() -> None:
    """Give free memory back to the system, for allocators keep what the largest task took, and so would idle workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function for mapInArrow, with release() when its task ends."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b) but the roots, the least of each component."""
    return connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
