"""Rendezvous hashing of record keys over weighted shards, with DataFrame functions alone.

Every shard gets a score for a key, ``-weight / ln(u)`` with u in (0, 1) from the
XXH64 of key and shard, and the highest score wins.  Key and shards alone decide:
one more shard takes rows only into itself, its share of each, and a shard that
goes hands its rows to the others.  The law is ``key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kalibra.llm.shared import Scratch, table

SHARDS = 8


def shard_of(key: Column, weights: list[float]) -> Column:
    """The number of the shard, from 0; a null key is a key too."""
    scores = []
    for i, w in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0null")), F.lit(i)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        scores.append(F.struct((F.lit(-float(w)) / F.ln(u)).alias("score"), F.lit(-i).alias("shard")))
    return -F.array_max(F.array(*scores))["shard"]


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: list[float] | None = None, more: float = 1.0) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard): a row per row of docs.

    size is the text's UTF-8 bytes plus 1 and a null text has none; grown_shard
    is the shard with one more of the weight ``more``; clashing columns play no
    part, and an empty table gives no rows.  Slots count from 0 in
    each shard without gaps: rows are numbered within their scan task, and the
    few task counts before them are added, so no shard and no repeated key is
    ever gathered in one task.
    """
    weights = weights or [1.0] * SHARDS
    scratch = Scratch(docs.sparkSession)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = scratch.write(
        docs.select(
            F.col(key),
            size.alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            shard_of(F.col(key), weights).alias("shard"),
            shard_of(F.col(key), [*weights, more]).alias("grown_shard"),
            F.spark_partition_id().alias("task"),
        )
    )
    counts = rows.groupBy("shard", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "task").orderBy(key, "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(within))
    return numbered.join(counts, ["shard", "task"]).select(
        key,
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("before") + F.col("at") - 1).alias("slot"),
        "grown_shard",
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
