"""Degree-preserving rewiring of bipartite graphs, its null distributions, and the mixing of its chains.

A Curveball trade redistributes what two left nodes don't share, keeping how
many each has.  A graph has a row for each left node, with its right nodes in order,
so a trade needs two rows and no others.  In a round the left nodes of a bucket are
paired at random and all pairs trade: a round of n left nodes is n / 2 trades.

A bucket holds about MOST edges, of 4 bytes each.  A chain of a graph that small is one bucket, as
any pair of its nodes may meet in a round, and all of its rounds are one task's, side by side with the other chains, with
the figures of its kept graphs; a larger
graph is dealt out to new buckets every EPOCH rounds, each epoch a table in the
shared folder, which goes when its graphs are summarised.  Pairs and trades are ordered by keyed hashes of (seed, chain,
round, nodes), so chains depend neither on partitions nor on each other, and any
SQL engine can replay them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalibra.functions.keyed import PRIME, SHIFT, fifths, mixed, mixed_sql
from kalibra.functions.ranks import lag_correlation, safe_divide
from kalibra.operators.projection import left_degrees, right_stats
from kalibra.storage import Scratch

#: Edges of a bucket, about, and the rounds that its nodes stay together.
MOST, EPOCH = 1 << 26, 16
#: Edges of pairs that trade at a time, which fit the caches, and edges whose figures are summed at a time.
BLOCK, SUMMED = 1 << 14, 1 << 21
#: Edges of the kept graphs that are summarised at a time, about, or of one draw of all chains if those are more.
PIECE = 1 << 28


def trade(rows: list[np.ndarray], sizes: np.ndarray, pairs: np.ndarray, keys: np.ndarray) -> None:
    """The trades of pairs (i, j) of ordered rows, in place: of what either has alone, as many as were the first one's go to it, by the least hash."""
    order = pairs.ravel().tolist()
    x = np.concatenate([rows[i] for i in order])
    many, both = sizes[pairs[:, 0]], sizes[pairs].sum(axis=1)
    ends = np.cumsum(both).tolist()
    spans = list(zip([0, *ends], ends))
    for a, b in spans:
        x[a:b].sort(kind="stable")
    h = np.repeat(((keys + SHIFT) % PRIME).astype(np.uint64), both)
    np.add(h, x, out=h, casting="unsafe")
    h = fifths(h).astype(np.int32)
    twin = x[1:] == x[:-1]
    twin[np.array(ends[:-1], np.int64) - 1] = False
    at = np.flatnonzero(twin)
    h[at], h[at + 1] = -1, PRIME  # what both have stays with both, so the first one gets as many as it had
    least = [np.partition(h[a:b], n - 1)[n - 1] if n else -2 for (a, b), n in zip(spans, many.tolist())]
    first = h <= np.repeat(np.array(least, np.int32), both)
    for k, out in enumerate((x[np.flatnonzero(first)], x[np.flatnonzero(~first)])):  # by places, as a random mask takes thrice the time
        own = np.cumsum(sizes[pairs[:, k]]).tolist()
        for i, a, b in zip(order[k::2], [0, *own], own):
            rows[i] = out[a:b]


def played(nodes: np.ndarray, rows: list[np.ndarray], seed: int, chain: int, first: int, last: int) -> Iterator[int]:
    """The rounds after the first up to the last of one bucket, each changing rows in place."""
    sizes = np.array([len(x) for x in rows], np.int64)
    for step in range(first + 1, last + 1):
        keys = mixed(mixed(mixed(seed, chain), step), nodes)
        order = np.lexsort((nodes, keys))
        pairs = order[: len(order) // 2 * 2].reshape(-1, 2)
        pairs = pairs[sizes[pairs].sum(axis=1) > 0]
        at = np.flatnonzero(np.diff(np.cumsum(sizes[pairs].sum(axis=1)) // BLOCK, prepend=-1)).tolist()
        for i, j in zip(at, [*at[1:], len(pairs)]):
            trade(rows, sizes, pairs[i:j], keys[pairs[i:j, 0]])
        yield step


def checked(nodes: list[int], rows: list[np.ndarray]) -> np.ndarray:
    """A bucket's left nodes, if they and the right nodes can be hashed."""
    left = np.array(nodes, np.int64)
    if len(left) and (left.min() < 0 or left.max() >= PRIME or any(len(r) and (r[0] < 0 or r[-1] >= PRIME) for r in rows)):
        raise ValueError(f"nodes must be numbers from 0 to {PRIME - 1}")
    return left


def epoch(graph: DataFrame, chains: int, buckets: int, seed: int, first: int, last: int, kept: range) -> DataFrame:
    """(chain, step, left, rights): the graphs (chain, left, rights) after the kept rounds up to the last, and after that."""
    bucket = F.expr(f"cast({mixed_sql(mixed_sql(mixed_sql(str(seed + 1), 'cast(chain as bigint)'), str(first)), 'left')} % {buckets} as int)")
    placed = graph.select((F.col("chain") * buckets + bucket).cast("int").alias("slot"), "chain", "left", "rights")
    placed = placed.repartitionById(chains * buckets, "slot").sortWithinPartitions("slot", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turned(chain: int, nodes: list[int], rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            left = checked(nodes, rows)
            for step in played(left, rows, seed, chain, first, last):
                if step in kept or step == last:
                    ends = np.cumsum([0, *map(len, rows)])
                    arrays = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))
                    same = lambda x: pa.array(np.full(len(rows), x, np.int32))
                    yield pa.RecordBatch.from_arrays([same(chain), same(step), pa.array(left), arrays.cast(pa.list_(pa.int32()))], names=["chain", "step", "left", "rights"])

        slot, chain, nodes, rows = None, 0, [], []
        for b in batches:
            for s, c, node, rights in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if s != slot:
                    if rows:
                        yield from turned(chain, nodes, rows)
                    slot, chain, nodes, rows = s, c, [], []
                nodes.append(node)
                rows.append(rights.values.to_numpy())
        if rows:
            yield from turned(chain, nodes, rows)

    return placed.mapInArrow(run, "chain int, step int, left long, rights array<int>")


def counted_rows(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """as_rows(), written, and the number of edges."""
    one = scratch.write(as_rows(edges))
    return one, one.agg(F.sum(F.size("rights"))).first()[0] or 0


def as_rows(edges: DataFrame) -> DataFrame:
    """(left, rights): edges (left, right) by left node, each right node once and in order."""
    return edges.groupBy(F.col("left").cast("long").alias("left")).agg(F.array_sort(F.collect_set(F.col("right").cast("int"))).alias("rights"))


class Figures:
    """Figures of whole graphs, worked out in the tasks that hold them.

    Called with kept graphs (chain, draw, left, rights) and a scratch it has the same of
    graphs that no task holds.
    """

    #: The columns after chain and draw.
    shape: str

    def __call__(self, graphs: DataFrame, scratch: Scratch) -> DataFrame:
        raise NotImplementedError

    def beside(self, one: DataFrame) -> DataFrame:
        """(left, rights, w) of the graph (left, rights): w an array of doubles of each node, and rows of anything else with left below 0."""
        return one.select("left", "rights", F.lit(None).cast("array<double>").alias("w"))

    def of(self) -> Callable:
        """A function of the observed graph's rows, their w and the rows beside it, which gives one of a graph's rows with its figures as tuples; it's sent to the tasks."""
        raise NotImplementedError


def figured(one: DataFrame, chains: int, draws: int, burn: int, thin: int, seed: int, figures: Figures) -> DataFrame:
    """(chain, draw, ...): the figures of the graphs of each chain, all of whose rounds are one task's."""
    begin, last = figures.of(), burn + (draws - 1) * thin
    own = figures.beside(one).select(F.explode(F.sequence(F.lit(0), F.lit(chains - 1))).alias("chain"), "left", "rights", "w")
    own = own.repartitionById(chains, "chain").sortWithinPartitions("chain", "left")
    fields = figures.shape.split(", ")

    def turned(chain: int, nodes: list[int], rows: list[np.ndarray], w: list, more: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        left, found = checked(nodes, rows), []
        told = begin(rows, w, more)
        for step in played(left, rows, seed, chain, 0, last):
            if step >= burn and (step - burn) % thin == 0:
                found += [(chain, (step - burn) // thin, *x) for x in told(rows)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], names=["chain", "draw", *(f.split()[0] for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, nodes, rows, w, more = None, [], [], [], []
        for b in batches:
            for c, node, rights, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                if c != chain:
                    if rows:
                        yield from turned(chain, nodes, rows, w, more)
                    chain, nodes, rows, w, more = c, [], [], [], []
                if node == BESIDE:
                    more.append(rights.values.to_numpy())
                    continue
                nodes.append(node)
                rows.append(rights.values.to_numpy())
                w.append(x)
        if rows:
            yield from turned(chain, nodes, rows, w, more)

    return own.mapInArrow(run, f"chain long, draw long, {figures.shape}").withColumns({c: F.col(c).cast("int") for c in ("chain", "draw")})


#: The left node of rows that are no graph's.
BESIDE = -(1 << 62)


class Places:
    """Right nodes as places in arrays: themselves, or if these would be long, their ranks."""

    def __init__(self, rows: list[np.ndarray]):
        top = max((int(r[-1]) for r in rows if len(r)), default=-1)
        self.known = np.unique(np.concatenate(rows)) if top > 1 << 24 else None
        self.size = top + 1 if self.known is None else len(self.known)

    def __call__(self, rights: np.ndarray) -> np.ndarray:
        return (rights if self.known is None else np.searchsorted(self.known, rights)).astype(np.intp)

    def blocks(self, rows: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(i, j, places) of about SUMMED edges of the rows i to j at a time."""
        ends = np.cumsum([len(r) for r in rows])
        at = np.flatnonzero(np.diff(ends // SUMMED, prepend=-1)).tolist()
        for i, j in zip(at, [*at[1:], len(rows)]):
            yield i, j, self(np.concatenate(rows[i:j]))

    def degrees(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(self.size, np.int64)
        for _, _, x in self.blocks(rows):
            out += np.bincount(x, minlength=self.size)
        return out


def pieces(one: DataFrame, n: int, chains: int, draws: int, burn: int, thin: int, seed: int, most: int) -> Iterator[tuple[DataFrame, bool]]:
    """Of a written graph (left, rights) of n edges the kept graphs (chain, draw, left, rights), of whole draws, about PIECE edges at a time, and whether these are all; a piece goes when the next is asked for."""
    scratch = Scratch(one.sparkSession)
    buckets, rounds = max(1, -(-n // most)), burn + (draws - 1) * thin
    kept, span = range(burn, rounds + 1, thin), rounds if buckets == 1 else EPOCH
    graph, before = one.select(F.explode(F.sequence(F.lit(0), F.lit(chains - 1))).alias("chain"), "left", "rights"), None
    for at in range(0, rounds, span):
        to = min(rounds, at + span)
        held = scratch.write(epoch(graph, chains, buckets, seed, at, to, kept))
        if before is not None:
            scratch.drop(before)
        since = F.col("step") - burn
        found = held.where((since >= 0) & (since % thin == 0)).select("chain", F.floor(since / thin).cast("int").alias("draw"), "left", "rights")
        if buckets == 1:
            yield found, True
        else:
            steps = [s for s in kept if at < s <= to]
            some = max(1, PIECE // (chains * n))
            for i in range(0, len(steps), some):
                yield found.where(F.col("draw").isin([(s - burn) // thin for s in steps[i : i + some]])), False
            if to < rounds:
                before = scratch.write(held.where(F.col("step") == to).drop("step"))
                graph = before
        scratch.drop(held)
    scratch.clear()


def rewired(edges: DataFrame, chains: int, draws: int, burn: int, thin: int, seed: int, most: int = MOST) -> DataFrame:
    """(chain, draw, left, rights): of every chain the graphs after burn rounds and then every thin.

    Nodes are whole numbers from 0 to PRIME - 1.  A left node's right nodes are one
    value, so they should be fewer than some millions.  All graphs are held; where
    figures of each will do, summarised() holds those of an epoch.
    """
    scratch, out = Scratch(edges.sparkSession), None
    for found, whole in pieces(*counted_rows(edges, scratch), chains, draws, burn, thin, seed, most):
        if whole:
            return found
        out = scratch.append(out, found)
    return out


def summarised(edges: DataFrame, chains: int, draws: int, burn: int, thin: int, seed: int, summary: Callable[[DataFrame, Scratch], DataFrame], most: int = MOST) -> DataFrame:
    """What summary(graphs, scratch) has of the graphs of rewired(), each graph by itself; it may write to the scratch, which goes with the graphs.

    Figures of graphs that one task holds are worked out there.
    """
    keep, out = Scratch(edges.sparkSession), None
    one, n = counted_rows(edges, keep)
    if n <= most and isinstance(summary, Figures):
        return keep.write(figured(one, chains, draws, burn, thin, seed, summary))
    for found, _ in pieces(one, n, chains, draws, burn, thin, seed, most):
        own = Scratch(edges.sparkSession)
        out = keep.append(out, summary(found, own))
        own.clear()
    return out


def as_edges(graphs: DataFrame) -> DataFrame:
    """(chain, draw, left, right) of kept graphs."""
    return graphs.select("chain", "draw", "left", F.explode("rights").alias("right"))


class layered(Figures):
    """layers() as figures, for summarised(); what all graphs share is worked out once."""

    shape = "layer string, gjsd double, common_mass double"

    def __init__(self, weights: DataFrame, edges: DataFrame, members: DataFrame | None = None):
        once = Scratch(edges.sparkSession)
        self.names = [r[0] for r in weights.select("profile").distinct().orderBy("profile").limit(201).collect()]
        if len(self.names) > 200:
            raise ValueError("more than 200 profiles")
        own = weights.join(left_degrees(edges), "left").groupBy("left").agg(*[F.sum(F.when(F.col("profile") == p, F.col("weight") / F.col("degree"))).alias(f"w{i}") for i, p in enumerate(self.names)])
        self.own, self.idf, self.members = once.write(own), once.write(right_stats(edges).select("right", "idf")), members

    def __call__(self, graphs: DataFrame, scratch: Scratch) -> DataFrame:
        names, each = self.names, range(len(self.names))
        rows = graphs.join(self.own, "left").select("chain", "draw", *[f"w{i}" for i in each], F.explode("rights").alias("right"))
        rows = rows.groupBy("chain", "draw", "right").agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in each])
        rows = rows.join(self.idf, "right").select("chain", "draw", "right", *[(F.col(f"w{i}") * F.col("idf")).alias(f"x{i}") for i in each])
        rows = scratch.write(rows)
        total = rows.groupBy("chain", "draw").agg(*[F.sum(f"x{i}").alias(f"t{i}") for i in each])
        here = sum(((F.col(f"t{i}").isNotNull()).cast("int") for i in each), F.lit(0)).alias("k")
        rows = rows.join(total.select("*", here), ["chain", "draw"]).select("chain", "draw", "right", "k", *[F.coalesce(safe_divide(F.col(f"x{i}"), F.col(f"t{i}")), F.lit(0.0)).alias(f"p{i}") for i in each])

        def divergence(of: DataFrame, layer: str) -> DataFrame:
            term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
            mass = sum((F.col(f"p{i}") for i in each), F.lit(0.0))
            part = sum((term(F.col(f"p{i}"), F.lit(1.0)) for i in each), F.lit(0.0)) - term(mass, F.col("k"))
            low = F.when(F.col("k") == len(names), F.least(*[F.col(f"p{i}") for i in each], F.lit(1.0))).otherwise(0.0)
            found = of.groupBy("chain", "draw").agg((F.sum(part) / F.first("k")).alias("gjsd"), F.sum(low).alias("common_mass"))
            return found.select("chain", "draw", F.lit(layer).alias("layer"), "gjsd", "common_mass")

        out = divergence(rows, "feature")
        if self.members is not None:
            up = rows.join(self.members, "right").groupBy("chain", "draw", "module").agg(F.first("k").alias("k"), *[F.sum(f"p{i}").alias(f"p{i}") for i in each])
            out = out.unionByName(divergence(up, "module"))
        return out

    def beside(self, one: DataFrame) -> DataFrame:
        """Weights over degrees of the left nodes, null where a profile has none, the right nodes' idf, and each module's members."""
        w = self.own.select(F.col("left").cast("long").alias("left"), F.array(*[f"w{i}" for i in range(len(self.names))]).cast("array<double>").alias("w"))
        rows = one.join(w, "left", "left").select("left", "rights", "w")
        if self.members is not None:
            of = self.members.groupBy("module").agg(F.collect_list(F.col("right").cast("int")).alias("rights"))
            rows = rows.unionByName(of.select(F.lit(BESIDE).alias("left"), "rights", F.lit(None).cast("array<double>").alias("w")))
        return rows

    def of(self) -> Callable:
        many = len(self.names)

        def begin(rows: list[np.ndarray], w: list, more: list[np.ndarray]) -> Callable:
            places = Places(rows)
            degrees = places.degrees(rows)
            idf = np.log((sum(len(r) > 0 for r in rows) + 1) / (degrees + 1)) + 1
            own = np.array([[np.nan] * many if x is None else [np.nan if y is None else y for y in x] for x in w], float).reshape(-1, many)
            known = ~np.isnan(own)
            k, any_ = int(known[[len(r) > 0 for r in rows]].any(axis=0).sum()), known.any()
            own[~known] = 0.0
            seen = degrees > 0
            more = [m[np.isin(m, places.known) if places.known is not None else (m >= 0) & (m < places.size)] for m in more]
            more = [m for m in map(places, more) if seen[m].any()]
            at, which = np.concatenate([np.empty(0, np.intp), *more]), np.repeat(np.arange(len(more)), [len(m) for m in more])

            def figures(layer: str, p: np.ndarray) -> tuple:
                term = lambda x, m: x * np.log2(np.where(x > 0, x / m, 1.0))
                part = sum(float(term(x, 1.0).sum()) for x in p) - float(term(p.sum(axis=0), k).sum())
                return layer, part / k, float(np.minimum(p.min(axis=0), 1.0).sum()) if k == many else 0.0

            def told(rows: list[np.ndarray]) -> list[tuple]:
                if not any_:
                    return []
                p = np.zeros((many, places.size))
                for i, j, x in places.blocks(rows):
                    sizes = [len(r) for r in rows[i:j]]
                    for c in range(many):
                        p[c] += np.bincount(x, np.repeat(own[i:j, c], sizes), places.size)
                for x in p:
                    x *= idf
                    total = x.sum()
                    x /= total if total > 0 else np.inf
                out = [figures("feature", p)]
                if more:
                    out.append(figures("module", np.array([np.bincount(which, x[at], len(more)) for x in p])))
                return out

            return told

        return begin


def layers(graphs: DataFrame, weights: DataFrame, edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(chain, draw, layer, gjsd, common_mass) of the profiles recomputed from kept graphs that have the degrees of edges.

    The layer feature has the right nodes, and module what members (right, module)
    of them add up to.  All profiles are columns of one row, so edges are not
    repeated for them; there may be 200 at most.
    """
    return layered(weights, edges, members)(graphs, Scratch(edges.sparkSession))


def r_hat(samples: DataFrame, x: str) -> DataFrame:
    """One row: the potential scale reduction of chains (chain, draw, x)."""
    per = samples.groupBy("chain").agg(F.avg(x).alias("m"), F.var_samp(x).alias("v"), F.count("*").alias("n"))
    out = per.agg(F.avg("v").alias("within"), F.var_samp("m").alias("between"), F.avg("n").alias("n"))
    return out.select(F.when(F.col("within") > 0, F.sqrt((F.col("n") - 1) / F.col("n") + F.col("between") / F.col("within"))).alias("r_hat"))


def mixing(samples: DataFrame, x: str, most_lag: float = 0.1, most_r: float = 1.01, lags: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(chain, lag1, ..., r_hat, mixed): autocorrelations of each chain (chain, draw, x); the first lag's and r_hat decide."""
    lag = lag_correlation(samples, x, ["chain"], "draw", lags).groupBy("chain").agg(*[F.max(F.when(F.col("lag") == k, F.col("autocorrelation"))).alias(f"lag{k}") for k in lags])
    out = lag.crossJoin(r_hat(samples, x))  # one row
    ok = (F.abs(f"lag{lags[0]}") <= most_lag) & (F.col("r_hat") <= most_r)
    return out.withColumn("mixed", ok)


class Observed(NamedTuple):
    """A graph's rows (left, own) and the degrees (right, e), written once, that kept graphs are held against."""

    rows: DataFrame
    rights: DataFrame


def observed(edges: DataFrame) -> Observed:
    scratch = Scratch(edges.sparkSession)
    rows = scratch.write(as_rows(edges).withColumnRenamed("rights", "own"))
    return Observed(rows, scratch.write(rows.select(F.explode("own").alias("right")).groupBy("right").agg(F.count("*").alias("e"))))


def against(graphs: DataFrame, seen: Observed) -> DataFrame:
    """(chain, draw, n_edges, left_gap, right_gap, share): degrees_kept() and changed_share() in one."""
    d, own = F.size("rights"), F.coalesce("own", F.array().cast("array<int>"))
    lefts = graphs.join(seen.rows, "left", "left").select("chain", "draw", d.alias("d"), F.abs(d - F.size(own)).alias("gap"), F.size(F.array_except("rights", own)).alias("new"))
    share = safe_divide(F.sum("new").cast("double"), F.sum("d").cast("double")).alias("share")
    lefts = lefts.groupBy("chain", "draw").agg(F.sum("d").alias("n_edges"), F.max("gap").cast("long").alias("left_gap"), share)
    rights = as_edges(graphs).groupBy("chain", "draw", "right").agg(F.count("*").alias("d")).join(seen.rights, "right", "left")
    rights = rights.groupBy("chain", "draw").agg(F.max(F.abs(F.col("d") - F.coalesce("e", F.lit(0)))).alias("right_gap"))
    return lefts.join(rights, ["chain", "draw"]).select("chain", "draw", "n_edges", "left_gap", "right_gap", "share")


class kept_figures(Figures):
    """against() of the graphs of rewired(edges), for summarised()."""

    shape = "n_edges long, left_gap long, right_gap long, share double"

    def __init__(self, edges: DataFrame):
        self.edges, self.seen = edges, None

    def __call__(self, graphs: DataFrame, scratch: Scratch) -> DataFrame:
        self.seen = self.seen or observed(self.edges)
        return against(graphs, self.seen)

    def of(self) -> Callable:
        def begin(rows: list[np.ndarray], w: list, more: list) -> Callable:
            first, places = list(rows), Places(rows)
            degrees, mark = places.degrees(rows), np.zeros(places.size, bool)

            def told(rows: list[np.ndarray]) -> list[tuple]:
                new, n = 0, sum(len(r) for r in rows)
                if not n:
                    return []
                for own, now in zip(first, rows):
                    own = places(own)
                    mark[own] = True
                    new += len(now) - int(np.count_nonzero(mark[places(now)]))
                    mark[own] = False
                d = places.degrees(rows)
                return [(n, max(abs(len(a) - len(b)) for a, b in zip(first, rows)), int(np.abs(d - degrees)[d > 0].max()), new / n)]

            return told

        return begin


def degrees_kept(graphs: DataFrame, edges: DataFrame) -> DataFrame:
    """(chain, draw, n_edges, left_gap, right_gap): the largest differences of kept graphs' degrees from the observed ones."""
    return against(graphs, observed(edges)).drop("share")


def changed_share(graphs: DataFrame, edges: DataFrame) -> DataFrame:
    """(chain, draw, share): how many edges of each kept graph the observed one lacks."""
    return against(graphs, observed(edges)).select("chain", "draw", "share")


def verdict(row: DataFrame, rules: list[tuple[str, object]], otherwise: str) -> DataFrame:
    """row with verdict: the label of the first rule that holds."""
    out = F.lit(otherwise)
    for label, rule in reversed(rules):
        out = F.when(rule, F.lit(label)).otherwise(out)
    return row.withColumn("verdict", out)
