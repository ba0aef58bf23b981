"""Exact top-k search of binary codes by incremental multi-index hashing.

A code of BITS bits is cut into segments, and an index keeps for every segment
the codes by its value.  A search looks up its own segments first, then all
values at one bit's distance, and so on.  Once s segments have been searched up
to r bits and the others up to r - 1, every code within
``segments * r + s - 1`` bits has been met; the search ends when the k-th best
distance is no more than that, so its k answers are exact.

Codes are dealt over shards, each with an index of its own, and queries visit
all shards; the shards' answers are merged.  Rows of one code are folded into
their k lowest ids, plus one, before any shuffle: others can't be among k
answers, whoever asks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kalibra.llm.shared import Scratch, partitions, table

BITS, K, EVERY = 64, 10, 100
#: Distinct codes of a shard, about; there are at least as many shards as shuffle partitions.
SHARD = 1 << 18


def code_of(vector: Column) -> Column:
    """Bit i tells whether the i-th of 64 numbers is positive; missing and null ones aren't."""
    out = F.lit(0).cast("long")
    for i in range(BITS):
        out = out.bitwiseOR(F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


class Index:
    """The multi-index of one shard's distinct codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.size = 16 if len(codes) >= 1 << 15 else 8
        self.m = BITS // self.size
        self.order, self.bounds = [], []
        for s in range(self.m):
            values = self.segment(codes, s)
            self.order.append(np.argsort(values, kind="stable"))
            self.bounds.append(np.searchsorted(values[self.order[-1]], np.arange((1 << self.size) + 1)))
        self.flips = [np.array([sum(1 << p for p in c) for c in combinations(range(self.size), r)], np.int64) for r in range(self.size + 1)]

    def segment(self, codes, s: int):
        return (codes >> np.uint64(s * self.size) & np.uint64((1 << self.size) - 1)).astype(np.int64)

    def search(self, code: int, counts: np.ndarray, k: int) -> np.ndarray:
        """The positions of codes that hold all of the k nearest rows; counts tells the rows of each code."""
        code = np.uint64(code)
        met = np.zeros(len(self.codes), bool)
        found, apart = np.empty(0, np.int64), np.empty(0, np.int64)
        for r in range(self.size + 1):
            for s in range(self.m):
                values = int(self.segment(code, s)) ^ self.flips[r]
                lo, hi = self.bounds[s][values], self.bounds[s][values + 1]
                full = hi > lo
                if full.any():
                    new = np.concatenate([self.order[s][a:b] for a, b in zip(lo[full].tolist(), hi[full].tolist())])
                    new = new[~met[new]]
                    if len(new):
                        met[new] = True
                        found = np.concatenate((found, new))
                        apart = np.concatenate((apart, np.bitwise_count(self.codes[new] ^ code).astype(np.int64)))
                covered = self.m * r + s
                if len(found) and counts[found[apart <= covered]].sum() >= k:
                    break
            else:
                continue
            break
        if not len(found):
            return found
        order = np.argsort(apart, kind="stable")
        rows = np.cumsum(counts[found[order]])
        kth = apart[order][min(int(np.searchsorted(rows, k)), len(order) - 1)]
        return found[apart <= kth]


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, itself: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k rows nearest to each query, by (distance, vec_id).

    Both tables have vec_id and code.  A query's own id is no answer unless
    itself is set.  Rows with a null code or id are none and queries with a null
    code get no answer; repeated rows of one id and code are one; with fewer
    than k rows all are answers; clashing columns play no part, and an empty
    table gives no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    lowest = Window.partitionBy("code").orderBy("vec_id")
    folded = rows.where("code is not null and vec_id is not null").withColumn("n", F.dense_rank().over(lowest)).where(F.col("n") <= k + 1)
    folded = scratch.write(folded.groupBy("code").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")))
    shards = max(partitions(spark), -(-folded.count() // SHARD))
    left = folded.select(F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int").alias("shard"), "code", "ids", F.lit(None).cast("long").alias("query_id"))
    asked = queries.where("code is not null and vec_id is not null").select("vec_id", "code").distinct()
    none = F.lit(None).cast("array<bigint>")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "code", none.alias("ids"), F.col("vec_id").alias("query_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each shard the index rows come first, then the queries."""
        shard, codes, ids, index, counts = None, [], [], None, None
        for b in batches:
            out = []
            for s, code, own, query in zip(*(c.to_pylist() for c in b.columns)):
                if s != shard:
                    shard, codes, ids, index = s, [], [], None
                if query is None:
                    codes.append(code)
                    ids.append(own)
                    continue
                if not codes:
                    continue
                if index is None:
                    index = Index(np.array(codes, np.int64).view(np.uint64))
                    counts = np.array([len(x) for x in ids], np.int64)
                mine = np.uint64(code & (1 << 64) - 1)
                near = index.search(int(mine), counts, k + 1)
                best = sorted((d, x) for p, d in zip(near.tolist(), np.bitwise_count(index.codes[near] ^ mine).tolist()) for x in ids[p] if itself or x != query)
                out += [(query, d, x) for d, x in best[:k]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64()))], names=["query_id", "distance", "vec_id"])

    both = left.union(right).repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("query_id").asc_nulls_first())
    found = scratch.write(both.mapInArrow(run, "query_id long, distance int, vec_id long"))
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every hundredth id's code, the sign bits of its vector, the ten nearest other rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("embedding").isNotNull(), code_of(F.col("embedding"))).alias("code"))
    return nearest(rows, rows.where(F.pmod("vec_id", F.lit(EVERY)) == 0))
