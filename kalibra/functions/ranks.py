"""Ranks, correlations, multiplicity and other statistics, as windows and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kalibra.functions.special import student_two_sided
from kalibra.storage import Scratch


def average_rank(x: str, by: list[str]) -> Column:
    """Ranks from 1 where ties share their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / F.lit(2.0)


def spread(df: DataFrame, x: str, by: list[str], scratch: Scratch) -> DataFrame:
    """(by, x, _n, _task, _upto): the distinct values of few groups of very many rows, how often each occurs, and how many rows are below it.

    Equal values are folded and dealt out in order, each task numbers its own,
    and the tasks' few totals are added up, so no group is sorted in one task.
    Null values have no row.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folded = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_n"))
    folded = scratch.write(folded.repartitionByRange(parts, *by, x).withColumn("_task", F.spark_partition_id()))
    upto = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = folded.groupBy(*by, "_task").agg(F.sum("_n").alias("_n"))
    totals = totals.withColumn("_base", upto(Window.partitionBy(*by).orderBy("_task"))).drop("_n")
    own = folded.withColumn("_own", upto(Window.partitionBy(*by, "_task").orderBy(x))).join(totals, [*by, "_task"])
    return own.select(*by, x, "_n", "_task", (F.col("_base") + F.col("_own")).alias("_upto"))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """df with numbers from 0 within few groups of very many rows, in an order without ties.

    Rows are dealt out in order, each task numbers its own, and the tasks' few
    totals are added up, so no group is sorted in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.write(df.repartitionByRange(parts, *by, *order).withColumn("_task", F.spark_partition_id()))
    totals = rows.groupBy(*by, "_task").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*by, "_task").orderBy(*order)) - 1
    return rows.withColumn("_own", own).join(totals, [*by, "_task"]).withColumn(name, F.col("_base") + F.col("_own")).drop("_base", "_own", "_task")


def wide_average_rank(df: DataFrame, x: str, by: list[str], name: str, least: bool = False) -> DataFrame:
    """df with average ranks, or the least of ties, for few groups of very many rows; null values have no row."""
    found = spread(df, x, by, Scratch(df.sparkSession))
    rank = F.col("_upto") + (F.lit(1) if least else (F.col("_n") + 1) / F.lit(2.0))
    return df.join(found.select(*by, x, rank.alias(name)), [*by, x])


def exact_quantiles(df: DataFrame, x: str, by: list[str], at: dict[str, float]) -> DataFrame:
    """(by, the names of at): linearly interpolated quantiles of few groups of very many rows.

    The two rows around each are picked by their numbers, so no group's values are
    held in one task.  Null values have no part; a group without others has no row.
    """
    rows = spread(df, x, by, Scratch(df.sparkSession))
    size = rows.groupBy(*by).agg(F.sum("_n").alias("_m"))
    rows = rows.join(size, by) if by else rows.crossJoin(size)  # one row
    place = {n: (F.col("_m") - 1) * F.lit(float(q)) for n, q in at.items()}
    held = lambda i: F.max(F.when((F.col("_upto") <= i) & (i < F.col("_upto") + F.col("_n")), F.col(x)))
    both = [c for n, p in place.items() for c in (held(F.floor(p)).alias(f"_a_{n}"), held(F.ceil(p)).alias(f"_b_{n}"))]
    out = rows.groupBy(*by, "_m").agg(*both)
    share = {n: p - F.floor(p) for n, p in place.items()}
    return out.select(*by, *[(F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * w).alias(n) for n, w in share.items()])


def adjusted(df: DataFrame, p: str, by: list[str], name: str, score, down: bool) -> DataFrame:
    """df with the running extreme of score(p, its first and last rank, the family's size) over a family's P values in order, at most 1.

    The minimum from the largest P value down, or the maximum from the least up.
    """
    scratch = Scratch(df.sparkSession)
    rows = spread(df, p, by, scratch)
    size = rows.groupBy(*by).agg(F.sum("_n").alias("_m"))
    rows = rows.join(size, by) if by else rows.crossJoin(size)  # one row
    rows = rows.select(*by, p, "_task", score(F.col(p), F.col("_upto") + 1, F.col("_upto") + F.col("_n"), F.col("_m")).alias("_s"))
    rows = scratch.write(rows)
    pick, best = (F.min, F.least) if down else (F.max, F.greatest)
    order = lambda w, c: w.orderBy(F.desc(c) if down else F.asc(c))
    before = order(Window.partitionBy(*by), "_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = rows.groupBy(*by, "_task").agg(pick("_s").alias("_e")).withColumn("_e", pick("_e").over(before))
    own = pick("_s").over(order(Window.partitionBy(*by, "_task"), p).rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("_own", own).join(tasks, [*by, "_task"])
    found = found.select(*by, p, F.least(F.lit(1.0), best("_own", F.coalesce("_e", "_own"))).alias(name))
    return df.join(found, [*by, p], "left")


def with_bh(df: DataFrame, p: str, by: list[str], name: str = "q") -> DataFrame:
    """df with q-values within families in the column name; null P values are no tests."""
    return adjusted(df, p, by, name, lambda p, first, last, m: p * m / last, True)


def with_holm(df: DataFrame, p: str, by: list[str], name: str = "holm") -> DataFrame:
    """df with Holm's adjusted P values in the column name."""
    return adjusted(df, p, by, name, lambda p, first, last, m: (m - first + 1) * p, False)


def min_rank(x: str, by: list[str]) -> Column:
    return F.rank().over(Window.partitionBy(*by).orderBy(F.desc(x)))


def first_rank(x: str, by: list[str], tie: str) -> Column:
    """Ranks from 1, the largest first, ties by another column."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(x), tie))


def top(df: DataFrame, x: str, by: list[str], tie: str, k: int) -> DataFrame:
    return df.withColumn("rank", first_rank(x, by, tie)).where(F.col("rank") <= k)


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def to_sum_one(df: DataFrame, x: str, by: list[str], name: str) -> DataFrame:
    """df with x over its group's sum; the sums, combined before they are shuffled, are joined.

    df is evaluated twice, so it should be a table or cheap to make.
    """
    total = df.groupBy(*by).agg(F.sum(x).alias("_total"))
    return df.join(total, by).withColumn(name, safe_divide(F.col(x), F.col("_total"))).drop("_total")


def pearson(a: str, b: str) -> Column:
    """Aggregate: null where a side is constant."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    both = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(both > 0, F.covar_pop(x, y) / both)


def spearman(df: DataFrame, a: str, b: str, by: list[str], wide: bool = False) -> DataFrame:
    """(by, n, rho) of average ranks over rows with both values; wide for few groups of very many rows."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    if wide:
        rows = wide_average_rank(wide_average_rank(rows, a, by, "_ra"), b, by, "_rb")
    else:
        rows = rows.withColumns({"_ra": average_rank(a, by), "_rb": average_rank(b, by)})
    return rows.groupBy(*by).agg(F.count("*").alias("n"), pearson("_ra", "_rb").alias("rho"))


def spearman_p(rho: DataFrame) -> DataFrame:
    """rho (..., n, rho) with p: two-sided, by Student's t of n - 2 df; 0 where rho is 1 or -1, null under three rows."""
    df = (F.col("n") - 2).cast("double")
    t = F.col("rho") * F.sqrt(df / (1 - F.col("rho") * F.col("rho")))
    rows = rho.withColumns({"_df": F.when(df > 0, df), "_t": F.when(F.abs("rho") < 1, t)})
    return rows.withColumn("p", F.when(F.col("_df").isNotNull() & (F.abs("rho") >= 1), F.lit(0.0)).otherwise(student_two_sided("_t", "_df"))).drop("_df", "_t")


def lag_correlation(df: DataFrame, x: str, by: list[str], order: str, lags: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(by, lag, autocorrelation): the correlation of a series with itself some rows before."""
    w = Window.partitionBy(*by).orderBy(order)
    cols = df.withColumns({f"_l{k}": F.lag(x, k).over(w) for k in lags})
    rows = cols.select(*by, x, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_l{k}").alias("y")) for k in lags])).alias("_p"))
    rows = rows.select(*by, x, "_p.*").where("y is not null")
    return rows.groupBy(*by, "lag").agg(pearson(x, "y").alias("autocorrelation"))


def empirical(df: DataFrame, observed: str, null: str, by: list[str], centred: bool = True, wide: bool = False) -> DataFrame:
    """P values of an observed value against its null, (1 + as extreme) / (1 + n), and the null's moments and quantiles.

    The two-sided P counts null values as far from the null's mean as the
    observed one if centred, else it is twice the smaller tail.  df is evaluated
    twice, so it should be a table.  Quantiles are exact, which takes a buffer of
    a group's distinct null values: some 10,000 replicates at most, as a rule.  For
    more, wide picks them by their ranks over all tasks.
    """
    rows = df.join(df.groupBy(*by).agg(F.avg(null).alias("_mu")), by)
    at = {"q025": 0.025, "q250": 0.25, "q500": 0.5, "q750": 0.75, "q975": 0.975}
    o, x, mu = F.col(observed), F.col(null), F.col("_mu")
    up, low = F.sum((x >= o).cast("long")), F.sum((x <= o).cast("long"))
    n = F.count(null)
    out = rows.groupBy(*by).agg(
        n.alias("n_null"),
        F.first(observed).alias("observed"),
        F.avg(null).alias("null_mean"),
        F.stddev_samp(null).alias("null_sd"),
        ((up + 1) / (n + 1)).alias("p_upper"),
        ((low + 1) / (n + 1)).alias("p_lower"),
        ((F.sum((F.abs(x - mu) >= F.abs(o - mu)).cast("long")) + 1) / (n + 1)).alias("_both"),
        *([] if wide else [F.percentile(null, F.array(*map(F.lit, at.values()))).alias("_q")]),
    )
    both = F.col("_both") if centred else F.least(F.lit(1.0), 2 * F.least("p_upper", "p_lower"))
    if wide:
        out = out.join(exact_quantiles(df, null, by, at), by, "left") if by else out.crossJoin(exact_quantiles(df, null, by, at))  # one row each
    quantiles = {} if wide else {n: F.col("_q")[i] for i, n in enumerate(at)}
    z = F.when(F.col("null_sd") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_sd"))
    return out.withColumns({"p_two_sided": both, "z": z, **quantiles}).drop("_both", "_q")


def all_of(x: Column) -> Column:
    return F.bool_and(x)


def any_of(x: Column) -> Column:
    return F.bool_or(x)


def flagged(pairs: dict[str, Column], sep: str = ";") -> Column:
    """The names of the conditions that hold, joined."""
    return F.concat_ws(sep, *[F.when(c, F.lit(n)) for n, c in pairs.items()])


def direction(x: Column) -> Column:
    return F.when(x > 0, "UP").when(x < 0, "DOWN").otherwise("ZERO")


def least_of(names: list[str]) -> Column:
    return reduce(F.least, map(F.col, names))
