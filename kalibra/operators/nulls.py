"""Structural null models: matched strata, keyed permutations and alignments.

Randomness is a hash of (seed, replicate, place), so results depend neither on
the order of evaluation nor on partitions, and any SQL engine can replay them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kalibra.functions.keyed import chained, chained_sql, mixed_places, mixed_sql
from kalibra.functions.ranks import exact_quantiles, numbered
from kalibra.storage import Scratch

#: Strata of up to LARGE features are worked out in arrays, for BLOCK replicates at a time.
LARGE, BLOCK = 1 << 22, 64
#: Replicates whose permutations a task holds at once, and rows of all blocks that are worth a task.
TOGETHER, SPLIT = 16, 1 << 16


def with_each_rep(df: DataFrame, replicates: int) -> DataFrame:
    """Every row once for each replicate, in the column rep."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))


def quantile_bins(df: DataFrame, x: str, by: list[str], name: str = "bin", n: int = 4, wide: bool = False) -> DataFrame:
    """df with bins from 1 by linear quantiles, which keep ties together; equal edges are one, null values have no bin.

    wide for few groups with more distinct values than one task should hold; counts,
    such as degrees, have few.
    """
    cuts = [i / n for i in range(1, n)]
    if wide:
        found = exact_quantiles(df, x, by, {"_lo": 0.0} | {f"_q{i}": q for i, q in enumerate(cuts)})
        agg = found.select(*by, F.array(*[f"_q{i}" for i in range(len(cuts))]).alias("_q"), "_lo")
    else:
        agg = df.groupBy(*by).agg(F.percentile(x, F.array(*map(F.lit, cuts))).alias("_q"), F.min(x).alias("_lo"))
    if wide:  # groups of null values alone have no quantiles
        rows = df.join(agg, by, "left") if by else df.join(agg, how="left")
    else:
        rows = df.join(agg, by) if by else df.crossJoin(agg)  # one row
    edges = F.array_distinct(F.filter("_q", lambda e: e > F.col("_lo")))
    found = F.when(F.col(x).isNotNull(), 1 + F.size(F.filter(edges, lambda e: F.col(x) > e)))
    return rows.withColumn(name, found).drop("_q", "_lo")


def matched_strata(universe: DataFrame, network: str, ubiquity: str, none: str = "NO_NET") -> DataFrame:
    """universe with stratum: the bin of the network degree, or none where it has none, and that of the ubiquity."""
    rows = quantile_bins(quantile_bins(universe, network, [], "_d"), ubiquity, [], "_u")
    label = F.concat(F.coalesce(F.concat(F.lit("D"), F.col("_d")), F.lit(none)), F.lit("|U"), F.col("_u"))
    return rows.withColumn("stratum", label).drop("_d", "_u")


def strata_of(universe: DataFrame, key: str) -> DataFrame:
    """(stratum, s): the strata, numbered from 0 in order; one row for each, so they fit one task."""
    return universe.select("stratum").distinct().withColumn("s", F.row_number().over(Window.orderBy("stratum")) - 1)


def packs(rows: DataFrame, replicates: int, key: str, work: Callable, shape: str) -> DataFrame:
    """What work(s, first, columns) makes of every stratum's features, in order of the key, for each block of replicates from first.

    rows (stratum, key, ...) are dealt out by stratum and block, and a task gathers
    one at a time: columns has the arrays of the key and of all other columns, lists
    of equal length as matrices.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in ("stratum", key)]
    rows = Scratch(spark).write(rows.join(F.broadcast(strata_of(rows, key)), "stratum").select("s", key, *names))
    blocks = -(-replicates // BLOCK)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(rows.select("s").distinct().count() * blocks, rows.count() * blocks // SPLIT))
    every = rows.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(BLOCK))))
    every = every.select("s", "first", key, *names).repartition(n, "s", "first").sortWithinPartitions("s", "first", key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            s, first = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(s) != 0) | (np.diff(first) != 0)) + 1).tolist(), len(s)]
            for i, j in zip(cuts, cuts[1:]):
                if j > i and (s[i], first[i]) != at:
                    if held:
                        yield from work(int(at[0]), int(at[1]), held)
                    at, held = (s[i], first[i]), []
                held.append([b.column(c).slice(i, j - i) for c in range(2, b.num_columns)])
        if held:
            yield from work(int(at[0]), int(at[1]), held)

    return every.mapInArrow(run, shape)


def gathered(held: list, c: int, make: Callable) -> np.ndarray:
    """make() of a column's pieces, in one array; the pieces go."""
    out = np.concatenate([make(x[c]) for x in held])
    for x in held:
        x[c] = None
    return out


def donors(size: int, seed: int, rep: int, *more: int) -> np.ndarray:
    """The places whose members go to the places 0, 1, ... of a stratum."""
    # hashes have 31 bits, so hash and place are sorted as one number
    return np.sort(mixed_places(chained(seed, rep, *more), size) << 32 | np.arange(size)) & 0xFFFFFFFF


def largest_stratum(universe: DataFrame) -> int:
    return universe.groupBy("stratum").count().agg(F.max("count")).first()[0] or 0


def names_of(table: DataFrame, column: str, most: int = 200) -> list:
    """A column's few values, in order."""
    found = [r[0] for r in table.select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values of {column}")
    return found


def permutations(universe: DataFrame, replicates: int, seed: int, by_profile: DataFrame | None = None, key: str = "feature", large: int = LARGE) -> DataFrame:
    """(rep, key, donor): in each replicate and stratum the members change places.

    One permutation serves all profiles, or with by_profile, a table of few
    profiles, each has its own, in a column more.  A task permutes a stratum for a
    block of replicates; beyond large features in a stratum, ranges of it do.
    """
    names = names_of(by_profile, "profile") if by_profile is not None else [None]
    keys = ["rep"] if by_profile is None else ["rep", "profile"]
    if largest_stratum(universe) > large:
        return spread_permutations(universe, replicates, seed, names, keys, key)
    kind, each = universe.schema[key].dataType.simpleString(), by_profile is not None

    def work(s: int, first: int, held: list) -> Iterator[pa.RecordBatch]:
        own = pa.concat_arrays([x[0] for x in held])
        draws = [(rep, p) for rep in range(first, min(first + BLOCK, replicates)) for p in range(len(names))]
        for a in range(0, len(draws), TOGETHER):
            some = draws[a : a + TOGETHER]
            drawn = np.empty((len(own), len(some)), np.int32)
            for i, (rep, p) in enumerate(some):
                drawn[:, i] = donors(len(own), seed, rep, p, s) if each else donors(len(own), seed, rep, s)
            reps, whose = np.array([rep for rep, _ in some]), [names[p] for _, p in some]
            step = max(1, (1 << 16) // len(some))
            for i in range(0, len(own), step):  # a feature's replicates lie together, as runs of one value
                part = drawn[i : i + step]
                cols = [pa.array(np.tile(reps, len(part))), *([pa.array(whose * len(part), pa.string())] if each else [])]
                cols += [own.take(pa.array(np.repeat(np.arange(i, i + len(part)), len(some)))), own.take(pa.array(part.ravel()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, key, "donor"])

    shape = f"rep long, {'profile string, ' if len(keys) > 1 else ''}`{key}` {kind}, donor {kind}"
    return packs(universe.select("stratum", key), replicates, key, work, shape)


def spread_permutations(universe: DataFrame, replicates: int, seed: int, names: list, keys: list[str], key: str) -> DataFrame:
    """permutations() of strata of any size: members are numbered over ranges, in the key's order and in that of each replicate."""
    scratch = Scratch(universe.sparkSession)
    own = numbered(universe.select(key, "stratum"), ["stratum"], [key], "n", scratch)
    draws = with_each_rep(strata_of(universe, key), replicates)
    if len(keys) > 1:
        draws = draws.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(n).alias("profile"), F.lit(i).cast("long").alias("p")) for i, n in enumerate(names)]))).select("*", "_p.*").drop("_p")
    draws = draws.withColumn("_k", F.expr(chained_sql(str(seed), "rep", *(["p"] if len(keys) > 1 else []), "cast(s as bigint)"))).select("stratum", *keys, "_k")
    rows = scratch.write(own).join(draws, "stratum")
    drawn = numbered(rows.select(*keys, "stratum", F.col(key).alias("donor"), F.expr(mixed_sql("_k", "n")).alias("_h"), F.col("n").alias("_at")), [*keys, "stratum"], ["_h", "_at"], "n", scratch)
    return rows.join(drawn, [*keys, "stratum", "n"]).select(*keys, key, "donor")


def alignment(weights: DataFrame, scores: DataFrame, by: list[str], key: str = "feature") -> DataFrame:
    """(by, num, den, alignment): weight times score over the weight of measured features; a null score isn't measured."""
    return aligned(weights.join(scores.select(key, "z"), key, "left"), by)


def aligned(rows: DataFrame, by: list[str]) -> DataFrame:
    """alignment() of rows (by, weight, z)."""
    out = rows.groupBy(*by).agg(
        F.sum(F.col("weight") * F.coalesce("z", F.lit(0.0))).alias("num"), F.sum(F.when(F.col("z").isNotNull(), F.col("weight")).otherwise(0.0)).alias("den")
    )
    return out.withColumn("alignment", F.when(F.col("den") > 0, F.col("num") / F.col("den")))


def merged(rows: DataFrame) -> DataFrame:
    """rows as a side of a join that broadcasts neither: Spark takes what comes from Python to be as small as what goes there, however many replicates that has."""
    return rows.hint("merge")


def permuted_weights(weights: DataFrame, drawn: DataFrame, key: str = "feature") -> DataFrame:
    """(rep, profile, key, weight): every feature has its donor's weight."""
    return given(weights, drawn, key).select("rep", "profile", key, "weight")


def given(weights: DataFrame, drawn: DataFrame, key: str) -> DataFrame:
    """drawn with the donors' weights, a row for each profile."""
    own = weights.select("profile", F.col(key).alias("donor"), "weight")
    on = ["donor", "profile"] if "profile" in drawn.columns else ["donor"]
    return drawn.join(merged(own), on)


def alignment_null(weights: DataFrame, scores: DataFrame, drawn: DataFrame, key: str = "feature") -> DataFrame:
    """alignment() of permuted_weights(); scores are joined before the weights, as there is a row for each profile after these."""
    return aligned(given(weights, drawn.join(merged(scores.select(key, "z")), key, "left"), key), ["rep", "profile"])


def wide_weights(weights: DataFrame, names: list, key: str) -> DataFrame:
    """(key, w): the profiles' weights as an array in the order of names, 0 where there is none."""
    return weights.groupBy(key).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("profile") == n, F.col("weight"))), F.lit(0.0)) for n in names]).alias("w"))


def alignment_blocks(universe: DataFrame, weights: DataFrame, scores: DataFrame, replicates: int, seed: int, key: str = "feature", large: int = LARGE) -> DataFrame:
    """alignment_null() under permutations(), worked out for a stratum and a block of replicates at a time as products of arrays.

    Strata of more than large features take the way over tables of rows.
    """
    if largest_stratum(universe) > large:
        return alignment_null(weights, scores, Scratch(universe.sparkSession).write(permutations(universe, replicates, seed, key=key, large=large)), key)
    names = names_of(weights, "profile")
    rows = universe.select("stratum", key).join(merged(wide_weights(weights, names, key)), key, "left").join(merged(scores.select(key, "z")), key, "left")

    def work(s: int, first: int, held: list) -> Iterator[pa.RecordBatch]:
        z, w = gathered(held, 2, floats), gathered(held, 1, lambda x: matrix(x, len(names)))
        seen = ~np.isnan(z)
        left = np.stack((np.where(seen, z, 0.0), seen.astype(float)))
        reps = range(first, min(first + BLOCK, replicates))
        both = np.array([left @ w[donors(len(z), seed, rep, s)] for rep in reps])
        cols = [pa.array(np.repeat(reps, len(names))), pa.array(names * len(reps), pa.string()), pa.array(both[:, 0].ravel()), pa.array(both[:, 1].ravel())]
        yield pa.RecordBatch.from_arrays(cols, names=["rep", "profile", "num", "den"])

    parts = packs(rows, replicates, key, work, "rep long, profile string, num double, den double")
    out = parts.groupBy("rep", "profile").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return out.withColumn("alignment", F.when(F.col("den") > 0, F.col("num") / F.col("den")))


def mass_blocks(universe: DataFrame, weights: DataFrame, members: DataFrame, replicates: int, seed: int, key: str = "feature", large: int = LARGE) -> DataFrame:
    """(rep, profile, module, mass): what members (key, module) add up to under permutations(), in blocks as alignment_blocks()."""
    if largest_stratum(universe) > large:
        drawn = Scratch(universe.sparkSession).write(permutations(universe, replicates, seed, key=key, large=large))
        return permuted_weights(weights, drawn, key).join(members, key).groupBy("rep", "profile", "module").agg(F.sum("weight").alias("mass"))
    names = names_of(weights, "profile")
    own = members.groupBy(key).agg(F.collect_list("module").alias("modules"))
    rows = universe.select("stratum", key).join(wide_weights(weights, names, key), key, "left").join(own, key, "left")

    def work(s: int, first: int, held: list) -> Iterator[pa.RecordBatch]:
        w, lists = gathered(held, 1, lambda x: matrix(x, len(names))), pa.concat_arrays([x[2] for x in held])
        at = pc.list_parent_indices(lists).to_numpy()
        found = lists.flatten().dictionary_encode()
        modules, which = found.dictionary, found.indices.to_numpy().astype(np.int64)
        held.clear()
        if not len(modules):
            return
        reps, k = range(first, min(first + BLOCK, replicates)), len(modules)
        out = np.empty((len(reps), len(names), k))
        for i, rep in enumerate(reps):
            given = w[donors(len(w), seed, rep, s)[at]]
            for p in range(len(names)):
                out[i, p] = np.bincount(which, given[:, p], k)
        many = len(reps) * len(names)
        cols = [pa.array(np.repeat(reps, len(names) * k)), pa.array(np.tile(np.repeat(names, k), len(reps)).tolist(), pa.string()), modules.take(pa.array(np.tile(np.arange(k), many))), pa.array(out.ravel())]
        yield pa.RecordBatch.from_arrays(cols, names=["rep", "profile", "module", "mass"])

    parts = packs(rows, replicates, key, work, "rep long, profile string, module string, mass double")
    return parts.groupBy("rep", "profile", "module").agg(F.sum("mass").alias("mass"))


def floats(column: pa.Array) -> np.ndarray:
    """A column's numbers, NaN for nulls."""
    return column.to_numpy(zero_copy_only=False).astype(float)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of equal length as rows, zeros for nulls."""
    out = np.zeros((len(column), width))
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def contrasts(values: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    """(by, first, second, difference) of each two profiles under the same replicate."""
    by = by or []
    a = values.select(*by, F.col("profile").alias("first"), F.col(x).alias("a"))
    b = values.select(*by, F.col("profile").alias("second"), F.col(x).alias("b"))
    both = a.join(b, by) if by else a.crossJoin(b)
    return both.where("first < second").select(*by, "first", "second", (F.col("a") - F.col("b")).alias("difference"))


def invariants(weights: DataFrame, strata: DataFrame, by: list[str], key: str = "feature") -> DataFrame:
    """Per group and stratum: positive and zero weights, and their sum; permutations keep them."""
    rows = weights.join(strata.select(key, "stratum"), key)
    x = F.col("weight")
    return rows.groupBy(*by, "stratum").agg(F.sum((x > 0).cast("long")).alias("n_positive"), F.sum((x == 0).cast("long")).alias("n_zero"), F.sum(x).alias("total"))


def stratum_summary(universe: DataFrame, x: str) -> DataFrame:
    return universe.groupBy("stratum").agg(F.count("*").alias("n"), F.min(x).alias("low"), F.median(x).alias("middle"), F.max(x).alias("high"))


def mixture(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The alignment of a whole from its components' num and den."""
    by = by or []
    out = parts.groupBy(*by).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return out.withColumn("alignment", F.when(F.col("den") > 0, F.col("num") / F.col("den")))


def guarded(mass: Column, x: Column, otherwise: float = -1.0) -> Column:
    """A degenerate null, without mass, has a value below all others."""
    return F.when(mass <= 0, F.lit(otherwise)).otherwise(x)


def drawn_subjects(subjects: DataFrame, replicates: int, seed: int, by: list[str], key: str, large: int = 1 << 20) -> DataFrame:
    """(rep, by, key, times): as many draws with replacement as a group has subjects; those not drawn have no row.

    A task draws a group's subjects for a block of replicates, by hits(); beyond
    large subjects in a group, rows are drawn each.
    """
    scratch = Scratch(subjects.sparkSession)
    own = scratch.write(numbered(subjects.select(*by, key).distinct(), by, [key], "n", scratch))
    groups = own.groupBy(*by).agg(F.count("*").alias("size")).withColumn("_g", (F.row_number().over(Window.orderBy(*by)) - 1).cast("long"))  # a row for each group
    if (groups.agg(F.max("size")).first()[0] or 0) > large:
        draws = with_each_rep(groups, replicates)
        draws = draws.withColumn("_h", F.expr(chained_sql(str(seed), "rep", "_g")))
        drawn = own.select(*by, F.col("n").alias("_n")).join(draws, by).select("rep", *by, F.expr(f"{mixed_sql('_h', '_n')} % size").alias("n"))
        return drawn.groupBy("rep", *by, "n").agg(F.count("*").alias("times")).join(own.select(*by, key, "n"), [*by, "n"]).select("rep", *by, key, "times")
    kinds = [subjects.schema[c].dataType.simpleString() for c in (*by, key)]
    rows = own.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", key))).alias("rows")).join(groups.select(*by, "_g"), by)
    rows = rows.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(BLOCK)))).repartition(*by, "first").select("_g", "first", "rows", *by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (g, first, rows) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))):
                own = rows.values.field(1)
                for rep in range(first, min(first + BLOCK, replicates)):
                    times = hits(len(own), seed, rep, g)
                    at = pa.array(np.flatnonzero(times))
                    group = [b.column(3 + c).take(pa.array(np.full(len(at), i))) for c in range(len(by))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), rep)), *group, own.take(at), pa.array(times[times > 0])], names=["rep", *by, key, "times"])

    return rows.mapInArrow(run, ", ".join(["rep long", *(f"`{c}` {k}" for c, k in zip((*by, key), kinds)), "times long"]))


def hits(size: int, seed: int, rep: int, group: int) -> np.ndarray:
    """How often each of a group's subjects is drawn."""
    return np.bincount(mixed_places(chained(seed, rep, group), size) % size, minlength=size)
