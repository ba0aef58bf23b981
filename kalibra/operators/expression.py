"""Two-group statistics of long expression tables (feature, sample, value), and their combination over cohorts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kalibra.functions.ranks import safe_divide, spread, wide_average_rank
from kalibra.functions.smooth import interpolated, lowess
from kalibra.functions.special import digamma_sql, student_two_sided, trigamma_inverse_sql, trigamma_sql, two_sided_p
from kalibra.storage import Scratch


def collapsed(df: DataFrame, how: str = "median") -> DataFrame:
    """Several probes of a feature in a sample become their median, or mean."""
    return df.groupBy("feature", "sample").agg((F.median("value") if how == "median" else F.avg("value")).alias("value"))


def log_cpm(counts: DataFrame) -> DataFrame:
    """log2 of counts per million plus 1, by the sample's library size."""
    size = counts.groupBy("sample").agg(F.sum("value").alias("_size"))
    return counts.join(size, "sample").withColumn("value", F.log2(safe_divide(F.col("value"), F.col("_size")) * 1e6 + 1)).drop("_size")


def welch(df: DataFrame, by: list[str], case: Column, weight: Column | None = None) -> DataFrame:
    """(by, n1, n2, m1, m2, effect, t, df): Welch's test of the case rows against the rest, each counted weight times.

    Without variance in both groups t is null and its P is 1.
    """
    x = F.col("value")
    parts = {}
    for i, c in (("1", case), ("2", ~case)):
        on = c & x.isNotNull()
        own = F.when(on, x)
        if weight is None:
            parts |= {f"n{i}": F.sum(on.cast("double")), f"m{i}": F.avg(own), f"v{i}": F.var_samp(own)}
            continue
        n, s, q = (F.sum(F.when(on, weight * t).otherwise(0.0)) for t in (F.lit(1.0), x, x * x))
        spread = F.greatest((q - s / n * s) / (n - 1), F.lit(0.0))  # a difference of large sums, which may leave some where values are alike
        parts |= {f"n{i}": n, f"m{i}": s / n, f"v{i}": F.when(F.min(own) < F.max(own), spread).otherwise(0.0)}
    rows = df.groupBy(*by).agg(*[v.alias(n) for n, v in parts.items()]).where("n1 >= 2 and n2 >= 2")
    for i in "12":
        rows = rows.withColumn(f"e{i}", F.col(f"v{i}") / F.col(f"n{i}"))
    se = F.col("e1") + F.col("e2")
    effect = F.col("m1") - F.col("m2")
    degrees = se * se / (F.col("e1") * F.col("e1") / (F.col("n1") - 1) + F.col("e2") * F.col("e2") / (F.col("n2") - 1))
    return rows.select(*by, "n1", "n2", "m1", "m2", effect.alias("effect"), F.when(se > 0, effect / F.sqrt(se)).alias("t"), F.when(se > 0, degrees).alias("df"))


def with_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p", F.when(F.col("t").isNull(), F.lit(1.0)).otherwise(student_two_sided("t", "df")))


def effective_n(n1: Column, n2: Column) -> Column:
    return n1 * n2 / (n1 + n2)


def combined(a: DataFrame, b: DataFrame, na: float = 1.0, nb: float = 1.0) -> DataFrame:
    """(feature, z_a, z_b, z, p, z_weighted, concordant): Stouffer's sum of two cohorts (feature, z), equal and by effective n."""
    both = a.select("feature", F.col("z").alias("z_a")).join(b.select("feature", F.col("z").alias("z_b")), "feature")
    wa, wb = math.sqrt(na), math.sqrt(nb)
    out = both.withColumn("z", (F.col("z_a") + F.col("z_b")) / math.sqrt(2.0))
    out = out.withColumns({"p": two_sided_p("z"), "z_weighted": (F.col("z_a") * wa + F.col("z_b") * wb) / math.sqrt(na + nb)})
    return out.withColumn("concordant", F.signum("z_a") == F.signum("z_b"))


def tiers(rows: DataFrame, least: float) -> DataFrame:
    """One row: the share of concordant features, and the tier that it gives."""
    out = rows.agg(F.count("*").alias("n"), F.avg(F.col("concordant").cast("double")).alias("concordance"))
    return out.withColumn("tier", F.when(F.col("concordance") >= least, "A").when(F.col("concordance") > 0.5, "STRESS_TEST").otherwise("B"))


def quantile_normalised(df: DataFrame) -> DataFrame:
    """Every sample gets the mean distribution; ties get the mean of their ranks' values.  Samples must be complete."""
    df = df.select("feature", "sample", "value")
    own = spread(df, "value", ["sample"], Scratch(df.sparkSession))
    own = own.select("sample", "value", F.explode(F.sequence(F.col("_upto") + 1, F.col("_upto") + F.col("_n"))).alias("r"))
    mean = own.groupBy("r").agg(F.avg("value").alias("m"))
    new = own.join(mean, "r").groupBy("sample", "value").agg(F.avg("m").alias("_new"))
    return df.join(new, ["sample", "value"]).select("feature", "sample", F.col("_new").alias("value"))


def imputed(df: DataFrame, most_missing: float = 0.2) -> DataFrame:
    """Features with few missing values and some variance; missing ones become the feature's mean.

    Values are put on the log2 scale first where the largest is over 50.
    """
    big = df.agg(F.max("value").alias("_m"))
    df = df.crossJoin(big).withColumn("value", F.when(F.col("_m") > 50, F.log2(F.greatest(F.col("value"), F.lit(0.0)) + 1)).otherwise(F.col("value"))).drop("_m")  # one row
    w = Window.partitionBy("feature")
    rows = df.withColumns({"_n": F.count("*").over(w), "_k": F.count("value").over(w), "_mean": F.avg("value").over(w), "_sd": F.stddev_pop("value").over(w)})
    kept = rows.where((1 - F.col("_k") / F.col("_n") <= most_missing) & (F.col("_sd") > 0))
    return kept.select("feature", "sample", F.coalesce("value", "_mean").alias("value"))


def prior_sql(engine: str = "spark") -> tuple[str, str, str, str]:
    """SQL of the evidence of a variance (of s2, d), of the prior's df from what varies beyond chance (rest), and of its variance (of centre, d0; and of centre alone where there is no rest)."""
    return (
        f"(ln(s2) - {digamma_sql('(d / 2)')} + ln(d / 2))",
        f"(case when rest > 0 then 2 * {trigamma_inverse_sql('rest', engine)} end)",
        f"exp(centre + {digamma_sql('(d0 / 2)')} - ln(d0 / 2))",
        "exp(centre)",
    )


def moderated(tests: DataFrame, by: list[str]) -> DataFrame:
    """(by, effect, t, df, p) of pooled variances shrunk to their common prior.

    tests has n1, n2, effect and s2, the pooled variance, each with its own residual
    df.  What the logged variances vary beyond the sampling of their own df gives the
    prior's df; without any, all variances are the prior's.  No test has more df
    than all residuals together.  A column u has the effect's variance in units of
    s2 where rows are weighted; else it is 1 / n1 + 1 / n2.
    """
    unit = F.col("u") if "u" in tests.columns else 1 / F.col("n1") + 1 / F.col("n2")
    evidence, d0, shrunk, alone = prior_sql()
    spark = tests.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but each P value is a long fold
    rows = Scratch(spark).write(tests.repartition(parts, *by)).withColumn("d", F.col("n1") + F.col("n2") - 2)  # read three times
    seen = rows.where("s2 > 0").select(F.expr(evidence).alias("e"), F.expr(trigamma_sql("(d / 2)")).alias("v"))
    prior = seen.agg(F.avg("e").alias("centre"), (F.coalesce(F.var_samp("e"), F.lit(0.0)) - F.avg("v")).alias("rest"))
    prior = prior.crossJoin(rows.agg(F.sum("d").alias("most")))  # one row each
    prior = prior.withColumn("d0", F.expr(d0)).withColumn("s0", F.expr(f"case when d0 is null then {alone} else {shrunk} end"))
    rows = rows.crossJoin(prior.select("d0", "s0", "most"))
    s2 = F.when(F.col("d0").isNull(), F.col("s0")).otherwise((F.col("d0") * F.col("s0") + F.col("d") * F.col("s2")) / (F.col("d0") + F.col("d")))
    total = F.least(F.coalesce(F.col("d0") + F.col("d"), F.col("most")), F.col("most"))
    t = F.col("effect") / F.sqrt(s2 * unit)
    out = rows.select(*by, "effect", t.alias("t"), total.cast("double").alias("df"))
    return out.withColumn("p", F.when(F.col("t").isNull(), F.lit(1.0)).otherwise(student_two_sided("t", "df")))


def pooled(df: DataFrame, by: list[str], case: Column) -> DataFrame:
    """(by, n1, n2, effect, s2) for moderated()."""
    x = F.col("value")
    on, off = case & x.isNotNull(), ~case & x.isNotNull()
    rows = df.groupBy(*by).agg(
        F.sum(on.cast("double")).alias("n1"), F.sum(off.cast("double")).alias("n2"), F.avg(F.when(on, x)).alias("m1"), F.avg(F.when(off, x)).alias("m2"),
        F.var_samp(F.when(on, x)).alias("v1"), F.var_samp(F.when(off, x)).alias("v2"),
    ).where("n1 >= 2 and n2 >= 2")
    s2 = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    return rows.select(*by, "n1", "n2", (F.col("m1") - F.col("m2")).alias("effect"), s2.alias("s2"))


def expressed(counts: DataFrame, least: float = 10.0, samples: int = 2, total: float = 15.0) -> DataFrame:
    """The counts of features that reach, in enough samples, the counts per million of least in a library of median size, and total in all."""
    size = counts.groupBy("sample").agg(F.sum("value").alias("_size"))
    cut = size.agg((F.lit(least) / F.median("_size") * 1e6).alias("_cut"))
    rows = counts.join(size, "sample").crossJoin(cut)  # one row
    high = (safe_divide(F.col("value"), F.col("_size")) * 1e6 >= F.col("_cut")).cast("long")
    kept = rows.groupBy("feature").agg(F.sum(high).alias("n"), F.sum("value").alias("all")).where((F.col("n") >= samples) & (F.col("all") >= total))
    return counts.join(kept.select("feature"), "feature", "left_semi")


def tmm_factors(counts: DataFrame, reference: str, trim_m: float = 0.3, trim_a: float = 0.05) -> DataFrame:
    """(sample, factor): trimmed weighted means of log ratios to a reference sample, scaled to a product of 1."""
    scratch = Scratch(counts.sparkSession)
    counts = scratch.write(counts.select("feature", "sample", "value"))
    size = counts.groupBy("sample").agg(F.sum("value").alias("size"))
    rows = counts.join(size, "sample").where("value > 0")
    ref = rows.where(F.col("sample") == reference).select("feature", F.col("value").alias("rv"), F.col("size").alias("rs"))
    both = rows.join(ref, "feature")
    p, q = F.col("value") / F.col("size"), F.col("rv") / F.col("rs")
    both = scratch.write(both.withColumns({"m": F.round(F.log2(p / q), 12), "a": F.round(F.log2(p * q) / 2, 12), "v": (1 - p) / F.col("value") + (1 - q) / F.col("rv")}))
    n = both.groupBy("sample").agg(F.count("*").alias("n"))
    both = wide_average_rank(wide_average_rank(both, "m", ["sample"], "rm", True), "a", ["sample"], "ra", True).join(n, "sample")
    kept = both.where(
        (F.col("rm") > F.floor(F.col("n") * trim_m)) & (F.col("rm") <= F.col("n") - F.floor(F.col("n") * trim_m))
        & (F.col("ra") > F.floor(F.col("n") * trim_a)) & (F.col("ra") <= F.col("n") - F.floor(F.col("n") * trim_a))
    )
    raw = kept.groupBy("sample").agg((F.sum(safe_divide(F.col("m"), F.col("v"))) / F.sum(safe_divide(F.lit(1.0), F.col("v")))).alias("f"))
    raw = counts.select("sample").distinct().join(raw, "sample", "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
    return raw.select("sample", F.pow(F.lit(2.0), F.col("f") - F.avg("f").over(Window.partitionBy())).alias("factor"))


def voom(counts: DataFrame, groups: DataFrame, factors: DataFrame | None = None, span: float = 0.5) -> DataFrame:
    """(feature, sample, case, value, weight): log2 counts per million of complete counts, with the precision of each.

    groups is (sample, case), one row a sample; samples and features without counts are left out.
    factors (sample, factor) scales the library sizes.  The root of a feature's residual deviation by groups is smoothed
    over its mean log count; the fit at what a sample's group predicts, to the power of -4, is the weight.
    """
    scratch = Scratch(counts.sparkSession)
    size = counts.groupBy("sample").agg(F.sum("value").cast("double").alias("_lib")).where("_lib > 0")
    if factors is not None:
        size = size.join(factors, "sample").withColumn("_lib", F.col("_lib") * F.col("factor")).drop("factor")
    some = counts.groupBy("feature").agg(F.sum("value").alias("_all")).where("_all > 0").select("feature")
    size = scratch.write(size.join(groups.select("sample", "case"), "sample"))  # a row for each sample
    rows = counts.select("feature", "sample", "value").join(some, "feature", "left_semi").join(size, "sample")
    rows = scratch.write(rows.withColumn("value", F.log2((F.col("value") + 0.5) / (F.col("_lib") + 1) * 1e6)))
    level = size.agg(F.avg(F.log2(F.col("_lib") + 1)) - math.log2(1e6)).first()[0]
    on, off = F.when(F.col("case"), F.col("value")), F.when(~F.col("case"), F.col("value"))
    means = rows.groupBy("feature").agg(
        F.avg(on).alias("_m1"), F.avg(off).alias("_m2"), F.avg("value").alias("_m"), F.count(on).alias("_n1"), F.count(off).alias("_n2"), F.var_pop(on).alias("_v1"), F.var_pop(off).alias("_v2")
    )
    means = scratch.write(means.where("_n1 >= 1 and _n2 >= 1 and _n1 + _n2 > 2"))
    s2 = (F.col("_n1") * F.col("_v1") + F.col("_n2") * F.col("_v2")) / (F.col("_n1") + F.col("_n2") - 2)
    at, fits = lowess(means.select((F.col("_m") + F.lit(level)).alias("x"), F.pow(s2, F.lit(0.25)).alias("y")), span=span)
    predicted = F.when(F.col("case"), F.col("_m1")).otherwise(F.col("_m2")) - math.log2(1e6) + F.log2(F.col("_lib") + 1)
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but each row is looked up among the places
    out = rows.repartition(parts, "feature").join(means.select("feature", "_m1", "_m2"), "feature")
    return out.select("feature", "sample", "case", "value", F.pow(interpolated(predicted, at, fits), F.lit(-4.0)).alias("weight"))


def weighted_pooled(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n1, n2, effect, s2, u) of voom()'s rows for moderated(): least squares by groups, each row with its weight."""
    w, x = F.col("weight"), F.col("value")
    sums = {}
    for i, c in (("1", F.col("case")), ("2", ~F.col("case"))):
        sums |= {f"n{i}": F.sum(c.cast("double")), f"w{i}": F.sum(F.when(c, w)), f"x{i}": F.sum(F.when(c, w * x))}
    own = rows.join(rows.groupBy(*by).agg(*[v.alias(f"_{n}") for n, v in sums.items()]).where("_n1 >= 2 and _n2 >= 2"), by)
    off = x - F.when(F.col("case"), F.col("_x1") / F.col("_w1")).otherwise(F.col("_x2") / F.col("_w2"))
    out = own.groupBy(*by, *[f"_{n}" for n in sums]).agg(F.sum(w * off * off).alias("_q"))
    return out.select(
        *by, F.col("_n1").alias("n1"), F.col("_n2").alias("n2"), (F.col("_x1") / F.col("_w1") - F.col("_x2") / F.col("_w2")).alias("effect"),
        (F.col("_q") / (F.col("_n1") + F.col("_n2") - 2)).alias("s2"), (1 / F.col("_w1") + 1 / F.col("_w2")).alias("u"),
    )


def differential(tests: DataFrame, q: str = "q", effect: str = "effect", most: float = 0.05, least: float = 1.0) -> DataFrame:
    """tests with class: Up, Down or NS by q-value and effect."""
    hit = (F.col(q) < most) & (F.abs(effect) >= least)
    return tests.withColumn("class", F.when(hit & (F.col(effect) > 0), "Up").when(hit & (F.col(effect) < 0), "Down").otherwise("NS"))


def direction_flow(a: DataFrame, b: DataFrame) -> DataFrame:
    """(from_class, to_class, n, share) of features over two tests (feature, class)."""
    both = a.select("feature", F.col("class").alias("from_class")).join(b.select("feature", F.col("class").alias("to_class")), "feature")
    out = both.groupBy("from_class", "to_class").agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # at most nine rows


def most_variable(df: DataFrame, k: int = 5000) -> DataFrame:
    """The rows of the k features of the largest variance, ties by name."""
    best = df.groupBy("feature").agg(F.var_samp("value").alias("v")).orderBy(F.desc("v"), "feature").limit(k)
    return df.join(best.select("feature"), "feature", "left_semi")
