"""Module-level scores: masses of feature sets, their calibration, and conditioned endpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kalibra.functions.ranks import numbered, safe_divide, spearman, to_sum_one, wide_average_rank
from kalibra.operators.nulls import hits
from kalibra.storage import Scratch, tasks

#: Rows of values that a task holds for its resamples, about.
PART = 1 << 21


def eligibility(members: DataFrame, universe: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """(module, n, broad, eligible) of all modules: enough features of the universe, but not over a share of it."""
    total = universe.select("feature").distinct().agg(F.count("*").alias("total"))
    rows = members.join(universe.select("feature").distinct(), "feature", "left_semi").groupBy("module").agg(F.countDistinct("feature").alias("n")).crossJoin(total)  # one row
    broad = F.col("n") > F.col("total") * share
    return rows.select("module", "n", broad.alias("broad"), ((F.col("n") >= least) & ~broad).alias("eligible"))


def masses(weights: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """(by, module, mass): the weight of each module's features."""
    return weights.join(members, "feature").groupBy(*by, "module").agg(F.sum("weight").alias("mass"))


def means(values: DataFrame, members: DataFrame, by: list[str], least: int = 15) -> DataFrame:
    """(by, module, n, mean) of modules with enough measured features."""
    rows = values.where("value is not null").join(members, "feature")
    return rows.groupBy(*by, "module").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).where(F.col("n") >= least)


def affinity(observed: DataFrame, null: DataFrame) -> DataFrame:
    """(profile, module, mass, null_mean, null_sd, affinity, positive, flat): standardised masses, 0 where the null is flat; positive has the negative ones at 0."""
    moments = null.groupBy("profile", "module").agg(F.avg("mass").alias("null_mean"), F.stddev_samp("mass").alias("null_sd"))
    rows = observed.join(moments, ["profile", "module"])
    a = safe_divide(F.col("mass") - F.col("null_mean"), F.col("null_sd"))
    rows = rows.withColumns({"affinity": a, "flat": ~(F.col("null_sd") > 0)})
    return rows.withColumn("positive", F.greatest("affinity", F.lit(0.0)))


def null_affinity(null: DataFrame, affinities: DataFrame) -> DataFrame:
    """(rep, profile, module, positive): the replicates' own masses on the scale of the null's mean and deviation."""
    rows = null.join(affinities.select("profile", "module", "null_mean", "null_sd"), ["profile", "module"])
    a = safe_divide(F.col("mass") - F.col("null_mean"), F.col("null_sd"))
    return rows.select("rep", "profile", "module", F.greatest(a, F.lit(0.0)).alias("positive"))


def differential(affinities: DataFrame, by: list[str], x: str = "affinity") -> DataFrame:
    """The affinity less the mean of the other profiles', in the column difference."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    return affinities.withColumn("difference", F.when(n > 1, F.col(x) - (F.sum(x).over(w) - F.col(x)) / (n - 1)))


def percentile_modules(values: DataFrame, members: DataFrame, by: list[str], least: int = 15) -> DataFrame:
    """(by, module, n, raw, scaled): means of the features' percentiles, scaled to length 1 over the modules."""
    kept = values.where("value is not null")
    size = kept.groupBy(*by).agg(F.count("*").alias("_size"))
    ranked = wide_average_rank(kept, "value", by, "_r").join(size, by).withColumn("value", F.col("_r") / (F.col("_size") + 1))
    rows = means(ranked, members, by, least).withColumnRenamed("mean", "raw")
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*by)))  # as many rows as modules
    return rows.withColumn("scaled", safe_divide(F.col("raw"), norm))


def enough(eligible: DataFrame, least: int = 40) -> DataFrame:
    """eligible, if at least so many of its modules are; else an error ends the job."""
    if (found := eligible.where("eligible").count()) < least:
        raise ValueError(f"{found} eligible modules, of {least} needed")
    return eligible


def compatibility(disease: DataFrame, affinities: DataFrame) -> DataFrame:
    """(profile, compatibility): the cosine of (module, d) and the positive affinities."""
    rows = affinities.join(disease, "module")
    d, a = F.col("d"), F.col("positive")
    return rows.groupBy("profile").agg(safe_divide(F.sum(d * a), F.sqrt(F.sum(d * d) * F.sum(a * a))).alias("compatibility"))


def conditioned(disease: DataFrame, affinities: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, module, product, scaled): d times the positive affinity, scaled to 1; without any mass, 0."""
    by = by or ["profile"]
    rows = affinities.join(disease, "module").select(*by, "module", (F.col("d") * F.col("positive")).alias("product"))
    return to_sum_one(Scratch(disease.sparkSession).write(rows), "product", by, "scaled")


def predicted_correlation(predictions: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, rho): Spearman of predictions (by, module, scaled) and the observed (profile, module, o)."""
    return spearman(predictions.join(observed, ["profile", "module"]), "scaled", "o", by)


def selectivity(predictions: DataFrame, observed: DataFrame) -> DataFrame:
    """(profile, own, others, selectivity, status): a prediction's correlation with its own profile less the mean with the others'.

    With two profiles the measure is the same for both by construction: it is
    null then, and the status NOT_IDENTIFIABLE.
    """
    a = predictions.select(F.col("profile").alias("p"), "module", "scaled")
    b = observed.select(F.col("profile").alias("q"), "module", "o")
    rho = spearman(a.join(b, "module"), "scaled", "o", ["p", "q"])
    out = rho.groupBy(F.col("p").alias("profile")).agg(
        F.max(F.when(F.col("p") == F.col("q"), F.col("rho"))).alias("own"), F.avg(F.when(F.col("p") != F.col("q"), F.col("rho"))).alias("others"), F.count("*").alias("k")
    )
    known = F.col("k") > 2
    return out.select("profile", "own", "others", F.when(known, F.col("own") - F.col("others")).alias("selectivity"), F.when(known, "TESTED").otherwise("NOT_IDENTIFIABLE").alias("status"))


def recovered(predictions: DataFrame, affinities: DataFrame) -> DataFrame:
    """(module, d): the disease vector up to scale where some profile's positive affinity shows it, as the mean over profiles."""
    rows = predictions.join(affinities.select("profile", "module", "positive"), ["profile", "module"])
    return rows.groupBy("module").agg(F.avg(F.when(F.col("positive") > 0, F.col("product") / F.col("positive"))).alias("d"))


def parts_of(rows: int, profiles: int, least: int) -> int:
    """Parts of a profile's features: of some PART rows each, or smaller ones if that makes fewer parts in all than tasks, down to 2^15 rows."""
    return max(1, -(-rows // (PART * profiles)), min(-(-least // profiles), rows // (profiles << 15)))


def resampled(values: DataFrame, case: str, replicates: int, seed: int, digits: int, shape: str, emit: Callable, also: str = "feature") -> DataFrame:
    """What emit(rep, profile, part, kept, effects, features, also) makes of each resample's effects of a part of a profile's features.

    Effects are whole numbers, the difference of means times 10^digits, of the
    features at the places kept; also is another column that a feature has one
    value of.  A task draws all of a profile's subjects for each resample, however
    few of them its part has, so parts are few and large.
    """
    spark, scratch = values.sparkSession, Scratch(values.sparkSession)
    people = numbered(values.select("profile", "subject").distinct(), ["profile"], ["subject"], "n", scratch)
    sizes = people.groupBy("profile").agg(F.count("*").alias("size")).withColumn("g", F.row_number().over(Window.orderBy("profile")) - 1)  # a row for each profile
    sizes, n = scratch.write(sizes), tasks(values)
    known = values.where("value is not null").repartition(n, "profile", "subject")
    rows = scratch.write(known.join(people.repartition(n, "profile", "subject"), ["profile", "subject"]).join(sizes, "profile").drop("subject"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many, parts = sizes.count(), parts_of(rows.count(), max(1, sizes.count()), least)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("feature"), F.lit(parts)).cast("int"))
    slot = (F.col("g") * parts + F.col("part")).cast("int")
    rows = rows.select(slot.alias("slot"), "profile", "part", "g", "size", F.col("n").cast("int").alias("n"), F.col(case).cast("int").alias("case"), "value", "feature", F.col(also).alias("also"))
    rows = rows.repartition(max(least, many * parts), "slot").sortWithinPartitions("slot", "feature")

    def effects(head: dict, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = lambda c: np.concatenate([b.column(c).to_numpy() for b in held])
        found = pa.chunked_array([b.column("feature") for b in held]).combine_chunks().dictionary_encode()
        k, at, value = len(found.dictionary), column("n").astype(np.int64), column("value")
        which = found.indices.to_numpy()
        first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        other = pa.chunked_array([b.column("also") for b in held]).take(pa.array(first)).combine_chunks()
        side = which.astype(np.int64) * 2 + column("case")
        held.clear()
        for rep in range(replicates):
            times = hits(head["size"], seed, rep, head["g"])[at].astype(float)
            n = np.bincount(side, times, 2 * k).reshape(-1, 2)
            total = np.bincount(side, times * value, 2 * k).reshape(-1, 2)
            kept = np.flatnonzero((n >= 2).all(1))
            means = total[kept] / n[kept]
            effect = (means[:, 1] - means[:, 0]) * 10**digits
            yield from emit(rep, head["profile"], head["part"], kept, np.copysign(np.floor(np.abs(effect) + 0.5), effect) + 0.0, found.dictionary, other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, head, held = None, None, []
        keep = ["n", "case", "value", "feature", "also"]
        for b in batches:
            slots = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(slots)]
            for a, z in zip(cuts, cuts[1:]):
                if z > a and slots[a] != slot:
                    if held:
                        yield from effects(head, held)
                    slot, held = slots[a], []
                    head = {c: b.column(c)[a].as_py() for c in ("profile", "part", "g", "size")}
                held.append(b.slice(a, z - a).select(keep))
        if held:
            yield from effects(head, held)

    return rows.mapInArrow(run, shape)


def resampled_effects(values: DataFrame, case: str, replicates: int, seed: int, digits: int = 6) -> DataFrame:
    """(rep, profile, part, features, effects): the difference of means between case and other subjects, by feature, of each resample.

    values (profile, subject, feature, value) have one row for a subject and
    feature.  A task holds a part of a profile's features, of some PART rows, and
    counts every subject as often as hits() draws it; features with under two draws
    on a side have no effect.
    """
    kind = values.schema["feature"].dataType.simpleString()

    def emit(rep, profile, part, kept, effects, features, _):
        lists = [pa.ListArray.from_arrays([0, len(kept)], x) for x in (features.take(pa.array(kept)), pa.array(effects / 10**digits + 0.0))]
        yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([profile]), pa.array([part], pa.int32()), *lists], names=["rep", "profile", "part", "features", "effects"])

    return resampled(values, case, replicates, seed, digits, f"rep long, profile string, part int, features array<{kind}>, effects array<double>", emit)


def classes(members: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """(feature, class) and (class, module): features of the same modules are a class, from 1; and how many classes there are."""
    sets = scratch.write(members.where("module is not null").groupBy("feature").agg(F.array_sort(F.collect_list("module")).alias("modules")))
    named = scratch.write(numbered(sets.select("modules").distinct(), [], ["modules"], "class", scratch).withColumn("class", (F.col("class") + 1).cast("int")))
    return sets.join(named, "modules").select("feature", "class"), named.select("class", F.explode("modules").alias("module")), named.count()


def packed(effects: np.ndarray, kinds: np.ndarray, bits: int) -> tuple[int, int, bytes]:
    """Sorted pairs of effect and class as the first one, in one whole number, and the gaps; with a width of 0, if they don't fit one, as they are."""
    if len(effects) and np.abs(effects).max() >= 2.0 ** (61 - bits):
        return 0, 0, effects.tobytes() + kinds.astype(np.int32).tobytes()
    keys = np.sort(effects.astype(np.int64) << bits | kinds)
    gaps = np.diff(keys)
    width = 4 if gaps.max(initial=0) < 1 << 32 else 8
    return int(keys[0]) if len(keys) else 0, width, gaps.astype(f"<u{width}").tobytes()


def shares_of(pieces: list[tuple[int, int, bytes]], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, n, sum) of the average ranks, over the number of effects plus 1, of all effects that pieces of packed() hold."""
    if all(width for _, width, _ in pieces):
        keys = np.sort(np.concatenate([np.cumsum(np.concatenate(([first], np.frombuffer(gaps, f"<u{width}").astype(np.int64)))) for first, width, gaps in pieces]))
        effects, kinds = keys >> bits, keys & ((1 << bits) - 1)
    else:
        effects, kinds = [], []
        for first, width, rest in pieces:
            if width:
                keys = np.cumsum(np.concatenate(([first], np.frombuffer(rest, f"<u{width}").astype(np.int64))))
                effects.append((keys >> bits).astype(float))
                kinds.append(keys & ((1 << bits) - 1))
            else:
                n = len(rest) // 12
                effects.append(np.frombuffer(rest, float, n))
                kinds.append(np.frombuffer(rest, np.int32, n, 8 * n).astype(np.int64))
        effects, kinds = np.concatenate(effects), np.concatenate(kinds)
        order = np.argsort(effects, kind="stable")
        effects, kinds = effects[order], kinds[order]
    edges = np.flatnonzero(np.concatenate(([True], effects[1:] != effects[:-1], [True])))
    ranks = np.repeat((edges[:-1] + edges[1:] + 1) / 2, np.diff(edges))
    n, total = np.bincount(kinds), np.bincount(kinds, ranks)
    seen = np.flatnonzero(n)
    return seen, n[seen], total[seen] / (len(effects) + 1)


def resampled_modules(values: DataFrame, case: str, members: DataFrame, replicates: int, seed: int, least: int, digits: int = 6) -> DataFrame:
    """(rep, profile, module, n, mean): means of the percentiles of resampled effects, of modules with enough of them.

    Effects go to the task that ranks them as sorted numbers with their class of
    features, in some 4 bytes each, and that task sends a row for each class.  It
    holds a profile's effects of one resample, as many as there are features.
    """
    scratch = Scratch(values.sparkSession)
    which, what, many = classes(members, scratch)
    bits, n = many.bit_length(), tasks(values)
    values = scratch.write(values.repartition(n, "feature").join(which.repartition(n, "feature"), "feature", "left").withColumn("class", F.coalesce("class", F.lit(0))))

    def emit(rep, profile, part, kept, effects, _, kinds):
        if len(kept):
            first, width, gaps = packed(effects, kinds.to_numpy()[kept], bits)
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([profile]), pa.array([first], pa.int64()), pa.array([width], pa.int32()), pa.array([gaps], pa.binary())], names=["rep", "profile", "first", "width", "gaps"])

    def ranked(table: pa.Table) -> pa.Table:
        pieces = [(x, width, gaps.as_py()) for x, width, gaps in zip(table["first"].to_pylist(), table["width"].to_pylist(), table["gaps"])]
        seen, n, total = shares_of(pieces, bits)
        one = lambda c, t: pa.array([table[c][0].as_py()] * len(seen), t)
        return pa.table([one("rep", pa.int64()), one("profile", pa.string()), pa.array(seen, pa.int32()), pa.array(n, pa.int64()), pa.array(total)], names=["rep", "profile", "class", "n", "total"])

    every = resampled(values, case, replicates, seed, digits, "rep long, profile string, first long, width int, gaps binary", emit, "class")
    shares = scratch.write(every.groupBy("rep", "profile").applyInArrow(ranked, "rep long, profile string, class int, n long, total double"))
    out = shares.join(what, "class").groupBy("rep", "profile", "module").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return out.where(F.col("n") >= least).select("rep", "profile", "module", "n", (F.col("total") / F.col("n")).alias("mean"))


def bootstrap_difference(values: DataFrame, case: str, members: DataFrame, first: DataFrame, second: DataFrame, replicates: int, seed: int, least: int = 15) -> DataFrame:
    """(rep, profile, difference): under each resample, how much better one prediction (profile, module, scaled) fits than another.

    The effects of resampled_effects() become percentile modules, and both
    predictions are correlated with them.
    """
    scratch = Scratch(values.sparkSession)
    raw = resampled_modules(values, case, members, replicates, seed, least)
    norm = F.sqrt(F.sum(F.col("mean") * F.col("mean")).over(Window.partitionBy("rep", "profile")))  # as many rows as modules
    seen = scratch.write(raw.select("rep", "profile", "module", F.round(safe_divide(F.col("mean"), norm), 9).alias("o")))
    rho = [spearman(seen.join(p, ["profile", "module"]), "scaled", "o", ["rep", "profile"]).select("rep", "profile", F.col("rho").alias(n)) for n, p in (("a", first), ("b", second))]
    return rho[0].join(rho[1], ["rep", "profile"]).select("rep", "profile", (F.col("a") - F.col("b")).alias("difference"))
