"""Weighted graphs as edge tables: cleaning, components, random walks and closures."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalibra.functions.ranks import safe_divide, to_sum_one
from kalibra.storage import Scratch

#: Edges of a task whose moves are added up at a time.
SPAN = 1 << 21


def on_unit_scale(edges: DataFrame, score: str = "score") -> DataFrame:
    """Scores up to 1000 become shares; those up to 1 stay."""
    largest = edges.agg(F.max(score).alias("_m"))
    out = edges.crossJoin(largest)  # one row
    return out.withColumn(score, F.when(F.col("_m") <= 1, F.col(score)).otherwise(F.col(score) / 1000.0)).drop("_m")


def cleaned(edges: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """(u, v, score) with u < v: undirected pairs of different nodes at their largest score, from the threshold up."""
    kept = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")) & (F.col(score) >= threshold))
    return kept.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max(score).alias("score"))


def both_ways(edges: DataFrame, score: str = "score") -> DataFrame:
    one = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col(score).alias("w"))
    return one.union(one.select("dst", "src", "w"))


def transition(edges: DataFrame, score: str = "score") -> DataFrame:
    """(src, dst, w, p): p is the weight over all of src's."""
    return to_sum_one(Scratch(edges.sparkSession).write(both_ways(edges, score)), "w", ["src"], "p")


def node_stats(edges: DataFrame, score: str = "score") -> DataFrame:
    """(node, degree, strength)."""
    return both_ways(edges, score).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of all nodes of the edges (u, v) but the roots, the least node of each component.

    Alternates the large-star and small-star steps until the edges no longer
    change; each round is written to the shared folder.  Minima are combined
    before the shuffle, so a hub costs no more than its edges.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    now = scratch.write(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).withColumn("m", F.least("k", "m"))
        large = both.join(low, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("k"))
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("k", "m"))
        new = scratch.write(small.distinct())
        seen = tuple(new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        scratch.drop(now)
        if seen == mark:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now, mark = new, seen


def component_sizes(edges: DataFrame) -> DataFrame:
    """(node, component, size) of all nodes."""
    rest = connected_components(edges)
    sizes = rest.groupBy("root").agg((F.count("*") + 1).alias("size"))
    every = rest.union(sizes.select(F.col("root").alias("node"), "root"))
    return every.join(sizes, "root").select("node", F.col("root").alias("component"), "size")


def seeds(weights: DataFrame, nodes: DataFrame) -> DataFrame:
    """(profile, node, x): weights on the graph's nodes, scaled to 1 in each profile."""
    kept = weights.join(nodes.select("node").distinct(), "node", "left_semi").where("weight > 0")
    return to_sum_one(Scratch(nodes.sparkSession).write(kept.select("profile", "node", "weight")), "weight", ["profile"], "x").drop("weight")


def seeded_mass(weights: DataFrame, nodes: DataFrame) -> DataFrame:
    """(profile, mass, seeded, share): the weight of a profile, and what of it lies on the graph's nodes."""
    known = nodes.select("node").distinct().withColumn("_on", F.lit(1))
    rows = weights.join(known, "node", "left").groupBy("profile").agg(F.sum("weight").alias("mass"), F.sum(F.when(F.col("_on").isNotNull(), F.col("weight")).otherwise(0.0)).alias("seeded"))
    return rows.withColumn("share", safe_divide(F.col("seeded"), F.col("mass")))


def walk_step(p: DataFrame, x: DataFrame, start: DataFrame, restart: float | Column, by: list[str], adjoint: bool = False) -> DataFrame:
    """One step of the walk with restart: a share of start, the rest moved along the edges, or against them if adjoint."""
    at, to = ("dst", "src") if adjoint else ("src", "dst")
    r = F.lit(restart) if isinstance(restart, float) else restart
    moved = x.join(p.select(F.col(at).alias("node"), F.col(to).alias("_to"), "p"), "node")
    moved = moved.select(*by, F.col("_to").alias("node"), ((1 - r) * F.col("p") * F.col("x")).alias("x"))
    back = start.select(*by, "node", (r * F.col("x")).alias("x"))
    return moved.unionByName(back).groupBy(*by, "node").agg(F.sum("x").alias("x"))


def walked(
    p: DataFrame,
    start: DataFrame,
    restart: float = 0.5,
    by: list[str] | None = None,
    tolerance: float = 1e-12,
    most: int = 10_000,
    adjoint: bool = False,
    norm: str = "l1",
    steps: int | None = None,
) -> DataFrame:
    """(by, node, x): the walk's limit, or its state after a number of steps.

    Iterates to a tolerance of the change in L1, or in the largest entry; four
    steps are planned at a time and then written to the shared folder.
    """
    by = by if by is not None else ["profile"]
    scratch = Scratch(start.sparkSession)
    p, start = scratch.write(p.select("src", "dst", "p")), scratch.write(start.select(*by, "node", "x"))
    x = start
    if steps is not None:
        for i in range(steps):
            x = walk_step(p, x, start, restart, by, adjoint)
            if i % 4 == 3:
                x = scratch.write(x)
        return x
    for _ in range(0, most, 4):
        before = x
        for _ in range(3):
            before = walk_step(p, before, start, restart, by, adjoint)
        before = scratch.write(before)
        new = scratch.write(walk_step(p, before, start, restart, by, adjoint))
        both = new.withColumnRenamed("x", "_y").join(before, [*by, "node"], "full_outer")
        gap = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("_y", F.lit(0.0)))
        if norm == "l1":
            change = both.groupBy(*by).agg(F.sum(gap).alias("g")).agg(F.max("g")).first()[0]
        else:
            change = both.agg(F.max(gap)).first()[0]
        if x is not start:
            scratch.drop(x)
        scratch.drop(before)
        x = new
        if change is None or change <= tolerance:
            return x
    raise RuntimeError(f"no convergence in {most} steps")


def scored_seeds(start: DataFrame, q: DataFrame) -> DataFrame:
    """(profile, score): sum of x * q, q the adjoint walk of one score vector."""
    return start.join(q.select("node", F.col("x").alias("q")), "node").groupBy("profile").agg(F.sum(F.col("x") * F.col("q")).alias("score"))


def by_source(p: DataFrame) -> DataFrame:
    """(src, dsts, ps): the edges (src, dst, p) of a source as few rows, none longer than a batch of Arrow's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src = b.column(0).to_numpy()
            at = np.flatnonzero(np.diff(src, prepend=src[:1] - 1))
            ends = pa.array([*at, len(src)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(src[at]), *[pa.ListArray.from_arrays(ends, b.column(c)) for c in (1, 2)]], names=["src", "dsts", "ps"])

    long = p.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("p").cast("double").alias("p"))
    return long.repartition("src").sortWithinPartitions("src").mapInArrow(run, "src long, dsts array<long>, ps array<double>")


def moved(p: DataFrame, x: DataFrame, names: list[str]) -> DataFrame:
    """(node, names): what one move along edges of by_source() makes of x (node, names); tasks add up what goes to a node before they send it."""
    many, span = len(names), SPAN

    def added(held: list[np.ndarray]) -> list[np.ndarray]:
        to, *parts = [np.concatenate(x) for x in zip(*held)]
        nodes, at = np.unique(to, return_inverse=True)
        return [nodes, *[np.bincount(at, x, len(nodes)) for x in parts]]

    def told(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in columns], names=["node", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            at = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(0)).to_numpy())
            share = b.column(1).flatten().to_numpy()
            held.append([b.column(0).flatten().to_numpy(), *[b.column(2 + c).to_numpy()[at] * share for c in range(many)]])
            n += len(at)
            if n > span:
                held = [added(held)]
                n = len(held[0][0])
                if n > span // 2:
                    yield from told(held.pop())
                    n = 0
        if held:
            yield from told(added(held))

    both = p.join(x.withColumnRenamed("node", "src").hint("shuffle_hash"), "src").select("dsts", "ps", *names)
    return both.mapInArrow(run, ", ".join(["node long", *[f"{n} double" for n in names]])).groupBy("node").agg(*[F.sum(n).alias(n) for n in names])


def settled(new: DataFrame, old: DataFrame, names: list[str], most: float) -> bool:
    """Whether none of the names changed by more in L1, and new has no node that old lacks."""
    both = new.withColumn("_new", F.lit(1)).join(old.select("node", F.lit(1).alias("_old"), *[F.col(n).alias(f"_{n}") for n in names]), "node", "full_outer")
    gaps = [F.sum(F.abs(F.coalesce(n, F.lit(0.0)) - F.coalesce(f"_{n}", F.lit(0.0)))) for n in names]
    change, more = both.agg(F.greatest(*gaps, F.lit(0.0)), F.count(F.when(F.col("_old").isNull(), 1))).first()
    return change <= most and not more


def walked_together(p: DataFrame, start: DataFrame, restarts: dict[str, float], tolerance: float = 1e-12, seeds_of: dict[str, str] | None = None) -> DataFrame:
    """(node, names): the limits of many walks at once, a column for each of the names of restarts; nodes are whole numbers.

    start has their seeds in columns of these names, or of those that seeds_of gives
    them, as walks from the same seeds share their moves: a limit is the sum over k of
    r (1 - r)^k times the seeds after k moves along the edges without restarts.  A move widens no
    gap in L1, so once two moves change no seeds by more than a share of the tolerance, and reach no more nodes,
    the last two states serve for all later ones, in turn, and no limit is off by more than the tolerance in L1.
    Else moves go on until the rest of the sum is as small as that.
    """
    names, of = list(restarts), seeds_of or {n: n for n in restarts}
    if len(names) > 200:
        raise ValueError("more than 200 walks in one pass")
    each, least = list(dict.fromkeys(of[n] for n in names)), min(restarts.values())
    scratch = Scratch(start.sparkSession)
    p = scratch.write(by_source(p))
    sums = p.select("src", F.aggregate("ps", F.lit(0.0), lambda a, b: a + b).alias("p")).groupBy("src").agg(F.sum("p").alias("p"))
    most = sums.agg(F.max("p")).first()[0]
    if most is not None and most > 1 + 1e-9:
        raise RuntimeError(f"rows of p don't sum to 1, but up to {most}")
    states = [scratch.write(start.select(F.col("node").cast("long").alias("node"), *[F.coalesce(n, F.lit(0.0)).cast("double").alias(n) for n in each]))]
    for k in range(1, max(2, math.ceil(math.log(tolerance / 4) / math.log(1 - least))) + 1):
        states.append(scratch.write(moved(p, states[-1], each)))
        if k >= 2 and settled(states[k], states[k - 2], each, tolerance * least / 4):
            break

    def share(r: float, k: int) -> float:
        return r * (1 - r) ** k / (1 - (1 - r) ** 2 if k >= len(states) - 2 else 1)

    rows = [s.select("node", *[(F.col(of[n]) * share(restarts[n], k)).alias(n) for n in names]) for k, s in enumerate(states)]
    out = scratch.write(functools.reduce(DataFrame.unionByName, rows).groupBy("node").agg(*[F.sum(n).alias(n) for n in names]))
    for x in [p, *states]:
        scratch.drop(x)
    return out.withColumn("node", F.col("node").cast(start.schema["node"].dataType))


def closure(edges: DataFrame, most: int = 40) -> DataFrame:
    """(node, ancestor): all ancestors over edges (child, parent), the node itself included; cycles end.

    Ancestors nearer than a power of two are joined with those just so far, which
    are then joined with themselves, so there are as many rounds as the depth has
    bits; a round without new ancestors is the last.
    """
    scratch = Scratch(edges.sparkSession)
    far = scratch.write(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct())
    found = scratch.write(far.select("node").union(far.select("ancestor")).distinct().select("node", F.col("node").alias("ancestor")))
    for _ in range(most):
        up = far.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_up"))
        new = found.join(up, "ancestor").select("node", F.col("_up").alias("ancestor")).distinct()
        new = scratch.write(new.join(found, ["node", "ancestor"], "left_anti"))
        if new.isEmpty():
            return found
        before, found = found, scratch.write(found.union(new))
        scratch.drop(before)
        scratch.drop(new)
        last, far = far, scratch.write(far.join(up, "ancestor").select("node", F.col("_up").alias("ancestor")).distinct())
        scratch.drop(last)
    raise RuntimeError(f"deeper than 2 ** {most}")


def propagated(annotations: DataFrame, ancestors: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(feature, term): annotations carried up to all ancestors, those of dead terms left out."""
    rows = annotations.join(ancestors.withColumnRenamed("node", "term"), "term").select("feature", F.col("ancestor").alias("term")).distinct()
    return rows if live is None else rows.join(live.select("term").distinct(), "term", "left_semi")
