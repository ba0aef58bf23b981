"""Centroid clustering of integer vectors by kd-tree filtering.

Vectors are laid out once: a task sorts blocks of about BLOCK vectors into
kd-trees, and writes their leaves, of up to LEAF vectors, in order.  A row has a leaf's
vectors with their count, sums and box, and the tree above it follows by
adding up neighbours, so any batch of rows is a forest with no further state.

A round filters the centroids down each tree.  Of those that may be nearest to a
vector of a node's box, the one nearest to its middle strictly dominates another if
it is nearer to the box's corner that lies farthest towards the other.  That
corner decides for the whole box, as the difference of the two distances is linear.
Dominated ones are pruned.  A node with one centroid left is assigned whole, by its
count and sums; leaves with several left are resolved exactly, the smaller number
winning ties, which domination never decides.

Tasks fold their sums before the shuffle, so a round brings one row per
centroid to the driver.  Sums are decimals, and all is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kalibra.llm.shared import Scratch, table

SIZE, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
BLOCK, LEAF = 1 << 14, 32
#: Larger numbers could have squared distances that no long holds.
LARGEST = 1 << 26
#: Up to here products and sums over SIZE components are exact in doubles too.
FAST = 1 << 20


def scaled(vector: Column, size: int = SIZE, scale: int = SCALE) -> Column:
    """floor(scale * x) of the components as doubles; null unless there are just size, none of them null or not finite."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(vector) == size) & sound, F.transform(numbers, lambda x: F.floor(x * scale)))


def leaves_of(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """The leaves of a kd-tree, as places of its points: every node is halved along its box's longest side."""
    out = []

    def split(at: np.ndarray) -> None:
        if len(at) <= leaf:
            out.append(at)
            return
        own = points[at]
        side = int(np.argmax(own.max(0) - own.min(0)))
        half = len(at) // 2
        order = np.argpartition(own[:, side], half)
        split(at[order[:half]])
        split(at[order[half:]])

    split(np.arange(len(points)))
    return out


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The exact squared distances, as longs."""
    if max(np.abs(points).max(initial=0), np.abs(centres).max(initial=0)) <= FAST:
        a, b = points.astype(float), centres.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centres], 1)


class Tree:
    """The levels of a kd-tree above consecutive leaves: counts, sums and boxes; level 0 has the leaves."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.levels = [(counts, sums, low, high)]
        while len(counts) > 1:
            at = np.arange(0, len(counts), 2)
            counts, sums = np.add.reduceat(counts, at), np.add.reduceat(sums, at)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((counts, sums, low, high))

    def filtered(self, centres: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(level, nodes, mask of the centroids left) of the nodes with one left, and of the leaves with several."""
        nodes, alive = np.zeros(1, np.int64), np.ones((1, len(centres)), bool)
        for level in range(len(self.levels) - 1, -1, -1):
            low, high = (x[nodes] for x in self.levels[level][2:])
            apart = distances(low + high, 2 * centres)
            best = np.where(alive, apart, np.iinfo(np.int64).max).argmin(1)
            for z, centre in enumerate(centres):
                asked = np.flatnonzero(alive[:, z] & (best != z))
                if not len(asked):
                    continue
                own = centres[best[asked]]
                corner = np.where(centre > own, high[asked], low[asked])
                # Only what is strictly farther from every point of the box goes.
                alive[asked[((centre - own) * (centre + own - 2 * corner)).sum(1) > 0], z] = False
            one = alive.sum(1) == 1
            done = one if level else np.ones(len(nodes), bool)
            if done.any():
                yield level, nodes[done], alive[done]
            nodes, alive = nodes[~done], alive[~done]
            if not len(nodes):
                return
            inside = np.stack((2 * nodes, 2 * nodes + 1), 1).ravel()
            alive = np.repeat(alive, 2, 0)
            kept = inside < len(self.levels[level - 1][0])
            nodes, alive = inside[kept], alive[kept]


class Forest:
    """The trees of a batch of rows of leaves."""

    def __init__(self, batch: pa.RecordBatch, size: int):
        self.ids, self.size = batch.column(2), size
        numbers = lambda i: np.array([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(i)]).reshape(-1, size)
        self.points = batch.column(3)
        self.counts, self.sums, self.low, self.high = batch.column(4).to_numpy(), numbers(5), numbers(6), numbers(7)
        block = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        self.trees = [(a, Tree(*(x[a:b] for x in (self.counts, self.sums, self.low, self.high)))) for a, b in zip(cuts, cuts[1:]) if b > a]

    def vectors(self, leaf: int) -> np.ndarray:
        return np.frombuffer(self.points[leaf].as_buffer(), np.int32).reshape(-1, self.size).astype(np.int64)

    def assigned(self, centres: np.ndarray) -> Iterator[tuple[int, int, Tree, int, np.ndarray]]:
        """(first leaf, leaf after the last, tree, node or -1, centroids left) of the parts that filtering yields."""
        for first, tree in self.trees:
            total = len(tree.levels[0][0])
            for level, nodes, alive in tree.filtered(centres):
                for node, left in zip(nodes.tolist(), alive):
                    yield first + (node << level), first + min(total, node + 1 << level), tree.levels[level], node, np.flatnonzero(left)


def laid_out(vectors: DataFrame, size: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """The leaves of kd-trees of (id, x): block, leaf, ids, points, count, sums, low, high."""
    id_type = vectors.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, n
            whole = pa.Table.from_batches(held).combine_chunks()
            ids = whole.column(0).combine_chunks()
            points = whole.column(1).combine_chunks().flatten().to_numpy().reshape(-1, size)
            if np.abs(points).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST}; its squared distances may not fit a long")
            found = leaves_of(points, leaf)
            parts = [points[at] for at in found]
            data = lambda rows: pa.array([np.ascontiguousarray(x).tobytes() for x in rows], pa.binary())
            out = [
                pa.array([number] * len(found), pa.int64()),
                pa.array(range(len(found)), pa.int32()),
                pa.array([ids.take(pa.array(at)).to_pylist() for at in found], pa.list_(ids.type)),
                data(p.astype(np.int32) for p in parts),
                pa.array([len(p) for p in parts], pa.int64()),
                data(p.sum(0) for p in parts),
                data(p.min(0) for p in parts),
                data(p.max(0) for p in parts),
            ]
            number, held, n = number + 1, [], 0
            return pa.RecordBatch.from_arrays(out, names=["block", "leaf", "ids", "points", "n", "sums", "low", "high"])

        for b in batches:
            for at in range(0, b.num_rows, block):
                held.append(b.slice(at, block))
                n += held[-1].num_rows
                if n >= block:
                    yield flush()
        if n:
            yield flush()

    return vectors.mapInArrow(run, f"block long, leaf int, ids array<{id_type}>, points binary, n long, sums binary, low binary, high binary")


def moved(leaves: DataFrame, centres: np.ndarray, size: int) -> np.ndarray:
    """The centroids after one round: floors of their vectors' exact means, and those without any as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centres)
        for b in batches:
            counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
            forest = Forest(b, size)
            for first, _, level, node, left in forest.assigned(centres):
                if len(left) == 1:
                    counts[left[0]] += level[0][node]
                    sums[left[0]] += level[1][node]
                else:
                    points = forest.vectors(first)
                    own = left[distances(points, centres[left]).argmin(1)]
                    counts += np.bincount(own, minlength=k)
                    np.add.at(sums, own, points)
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(counts), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = leaves.mapInArrow(run, "cluster int, n long, sums array<long>")
    total = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    out = centres.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():  # one row per centroid
        if row["n"]:
            out[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(size)]
    return out


def assignments(leaves: DataFrame, centres: np.ndarray, size: int, key: str, kind: str) -> DataFrame:
    """(key, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forest = Forest(b, size)
            order, clusters, apart = [], [], []
            for first, last, _, _, left in forest.assigned(centres):
                for leaf in range(first, last):
                    near = distances(forest.vectors(leaf), centres[left])
                    own = near.argmin(1)
                    order.append(leaf)
                    clusters.append(left[own])
                    apart.append(near[np.arange(len(own)), own])
            if order:
                ids = forest.ids.take(pa.array(order)).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(clusters), pa.int32()), pa.array(np.concatenate(apart), pa.int64())], names=[key, "cluster", "distance"])

    return leaves.mapInArrow(run, f"`{key}` {kind}, cluster int, distance long")


def clustered(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """A row per kept vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of just size components, none null or not finite, and a
    component is floor(scale * x).  The first centroids are the k vectors with
    the least SHA-256 of "seed:key"; repeated rows count each, those of one
    key being ordered by their components, and null keys come last.  Fewer
    vectors than k are all centroids.  Clashing columns play no part; an empty table
    gives no rows.  A component beyond LARGEST raises an error in its task.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    own = rows.select(F.col(key), scaled(F.col(vector), size, scale).alias("x" if key != "x" else "x_"))
    x = own.columns[1]
    own = own.where(F.col(x).isNotNull())
    leaves = scratch.write(laid_out(own, size))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    firsts = own.orderBy(order.asc_nulls_last(), x).limit(k).collect()
    centres = np.array([r[1] for r in firsts], np.int64).reshape(-1, size)
    for _ in range(rounds if len(centres) else 0):
        centres = moved(leaves, centres, size)
    found = scratch.write(assignments(leaves, centres, size, key, kind))
    scratch.drop(leaves)
    per = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}
    total = sum(per.values())
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    known = spark.createDataFrame([(i, per[i], total, digest(c)) for i, c in enumerate(centres) if i in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op11_kdmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def oracle(k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> str:
    """The same in SQL, with every distance."""
    parts = [
        f"kept as (select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings where len(embedding) = {size} and len(list_filter(embedding, lambda x: isfinite(x))) = {size})",
        f"c0 as (select row_number() over (order by sha256('{seed}:' || vec_id), v) - 1 as c, v from kept qualify c < {k})",
    ]
    for i in range(rounds + 1):
        apart = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::bigint"
        parts.append(f"a{i} as (select vec_id, v, min({{'d': d, 'c': c}}) as best from (select k.vec_id, k.v, c.c, {apart} as d from kept k cross join c{i} c) group by vec_id, v)")
        if i < rounds:
            parts += [
                f"s{i} as (select c, i, sum(x)::bigint as s, count(*) as n from (select best.c as c, unnest(v) as x, unnest(range(1, {size + 1})) as i from a{i}) group by c, i)",
                f"m{i} as (select c, list((s - ((s % n) + n) % n) // n order by i) as v from s{i} group by c)",
                f"c{i + 1} as (select c{i}.c, coalesce(m{i}.v, c{i}.v) as v from c{i} left join m{i} using (c))",
            ]
    return f"with {', '.join(parts)} select vec_id, best.c::int as cluster, best.d as distance, sum(best.d) over (partition by best.c)::bigint as cluster_inertia, sum(best.d) over ()::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256 from a{rounds} join c{rounds} c on c.c = best.c"
