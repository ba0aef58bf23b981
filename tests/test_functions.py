import math
from statistics import NormalDist

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kalibra.functions import ranks, smooth, special, text


def test_signed_z(spark):
    ps = [1.0, 0.05, 1e-17, 1e-300, 0.0, 0.3]
    df = spark.createDataFrame([(p, s) for p in ps for s in (1.0, 0.0, -1.0)], "p double, e double")
    for r in df.withColumn("z", special.signed_z("p", "e")).collect():
        want = -NormalDist().inv_cdf(max(r.p, 1e-300) / 2) * np.sign(r.e)
        assert r.z == pytest.approx(want, abs=1e-12)


def test_two_sided_p(spark):
    zs = [0.0, 0.3, -1.0, 1.96, 3.5, -6.0, 12.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.withColumn("p", special.two_sided_p("z")).collect():
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-12)


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return out


def student_p(t, df) -> np.ndarray:
    """Two-sided P of Student's t, NaN where t is."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    x = np.clip(df / (df + t * t), 0, 1)
    a, b = df / 2, np.full_like(x, 0.5)
    lg = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(all="ignore"):
        front = np.exp(lg(np.where(a > 0, a, 1) + b) - lg(np.where(a > 0, a, 1)) - lg(b) + a * np.log(x) + b * np.log1p(-x))
        direct = x < (a + 1) / (a + b + 2)
        low = front * beta_fraction(a, b, np.where(direct, x, 0.5)) / a
        high = 1 - front * beta_fraction(b, a, np.where(direct, 0.5, 1 - x)) / b
        out = np.where(direct, low, high)
    out = np.where(t == 0, 1.0, np.where(np.isinf(t), 0.0, out))
    return np.where(np.isnan(t) | ~(df > 0), np.nan, out)


def test_student_p(spark):
    t = np.array([0.0, 0.5, 1.0, 3.0, -2.0])
    assert student_p(t, np.ones(5)) == pytest.approx(1 - 2 * np.arctan(np.abs(t)) / math.pi)
    assert student_p(t, np.full(5, 2.0)) == pytest.approx(1 - np.abs(t) / np.sqrt(2 + t * t))
    assert student_p(1.96, 1e7) == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-5)
    rows = [(t, df) for df in (0.3, 1.0, 1.7, 4.0, 31.5, 300.0, 5e4, 1e6) for t in (0.0, 1e-9, 0.01, -0.7, 1.0, 2.5, -6.0, 30.0, 1e4)]
    own = spark.createDataFrame(rows, "t double, df double").withColumn("p", special.student_two_sided("t", "df")).collect()
    con = duckdb.connect()
    con.execute("create table x (t double, df double)")
    con.executemany("insert into x values (?, ?)", rows)
    other = {(a, b): p for a, b, p in con.sql(f"select t, df, {special.student_p_sql('t', 'df', 'duckdb')} from x").fetchall()}
    for r in own:
        want = float(student_p(np.array([r.t]), np.array([r.df]))[0])
        near = pytest.approx(want, rel=1e-9 if r.df < 1e5 else 1e-6, abs=1e-300)  # the plain version loses digits in its logs
        assert r.p == near and other[r.t, r.df] == near and r.p == pytest.approx(other[r.t, r.df], rel=1e-12, abs=1e-300), (r, want)


def test_gamma_functions_in_sql(spark):
    """Against known values, recurrences and, of the inverse, itself."""
    xs = [1e-3, 0.1, 0.5, 1.0, 2.25, 7.5, 300.0, 1e6]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    sql = {"d": special.digamma_sql("x"), "d1": special.digamma_sql("(x + 1)"), "t": special.trigamma_sql("x"), "t1": special.trigamma_sql("(x + 1)"), "q": special.tetragamma_sql("x"), "q1": special.tetragamma_sql("(x + 1)"), "g": special.half_gamma_ratio_sql("x")}
    rows = {r.x: r for r in df.select("x", *[F.expr(v).alias(k) for k, v in sql.items()]).collect()}
    assert rows[1.0].d == pytest.approx(-0.5772156649015329, rel=1e-13) and rows[1.0].t == pytest.approx(math.pi**2 / 6, rel=1e-13) and rows[1.0].q == pytest.approx(-2 * 1.2020569031595942, rel=1e-13)
    for x, r in rows.items():
        assert r.d1 - r.d == pytest.approx(1 / x, rel=1e-8) and r.t - r.t1 == pytest.approx(1 / x**2, rel=1e-4, abs=1e-13) and r.q1 - r.q == pytest.approx(2 / x**3, rel=1e-4, abs=1e-16)
        assert r.g == pytest.approx(math.exp(math.lgamma(x + 0.5) - math.lgamma(x)), rel=1e-7)
    back = df.withColumn("y", F.expr(special.trigamma_inverse_sql("x"))).withColumn("z", F.expr(special.trigamma_sql("y"))).collect()
    assert all(r.z == pytest.approx(r.x, rel=1e-9) for r in back)


def test_student_p_of_nulls(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 3.0)], "t double, df double")
    assert [r[0] for r in df.select(special.student_two_sided("t", "df")).collect()] == [pytest.approx(0.5), None]


def test_average_rank(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,), (5.0,), (5.0,)], "x double")
    got = sorted(r.r for r in df.withColumn("r", ranks.average_rank("x", [])).collect())
    assert got == [1.0, 2.5, 2.5, 5.0, 5.0, 5.0]


def test_correlation_of_constant(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 5.0)], "g string, x double, y double")
    got = {r.g: r.rho for r in ranks.spearman(df, "x", "y", ["g"]).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.0)


def test_multiplicity(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.02, 0.03, 0.04, None])], "i int, p double").withColumn("f", F.lit(1))
    bh = {r.i: r.q for r in ranks.with_bh(df, "p", ["f"]).collect()}
    assert [bh[i] for i in range(4)] == pytest.approx([0.04] * 4) and bh[4] is None
    holm = {r.i: r.holm for r in ranks.with_holm(df, "p", ["f"]).collect()}
    assert [holm[i] for i in range(4)] == pytest.approx([0.04, 0.06, 0.06, 0.06]) and holm[4] is None


def test_multiplicity_of_tied_and_many(spark):
    rng = np.random.default_rng(7)
    for n, digits in ((1, 2), (400, 2), (400, 9)):
        ps = np.round(rng.random(n) ** 3, digits)
        df = spark.createDataFrame([(i, float(p), i % 2) for i, p in enumerate(ps)], "i int, p double, f int").repartition(5)
        for f in range(2 if n > 1 else 1):
            own = ps[f::2]
            order = np.argsort(own, kind="stable")
            m, k = len(own), np.arange(1, len(own) + 1)
            bh, holm = np.empty(m), np.empty(m)
            bh[order] = np.minimum(1, np.minimum.accumulate((own[order] * m / k)[::-1])[::-1])
            holm[order] = np.minimum(1, np.maximum.accumulate((m - k + 1) * own[order]))
            got = {r.i: (r.q, r.holm) for r in ranks.with_holm(ranks.with_bh(df, "p", ["f"]), "p", ["f"]).where(f"f = {f}").collect()}
            assert [got[i][0] for i in range(f, n, 2)] == pytest.approx(list(bh)) and [got[i][1] for i in range(f, n, 2)] == pytest.approx(list(holm))
    one = ranks.with_holm(spark.createDataFrame([(0.01,), (0.04,)], "p double"), "p", [])
    assert sorted(r.holm for r in one.collect()) == pytest.approx([0.02, 0.04])


def test_empirical_p_floor_and_variants(spark):
    null = [float(i) for i in range(9)]
    df = spark.createDataFrame([("a", 100.0, x) for x in null] + [("b", 4.0, x) for x in null], "g string, o double, x double")
    one = {r.g: r for r in ranks.empirical(df, "o", "x", ["g"]).collect()}
    two = {r.g: r for r in ranks.empirical(df, "o", "x", ["g"], False).collect()}
    assert one["a"].p_upper == pytest.approx(1 / 10) and one["a"].p_two_sided == pytest.approx(1 / 10)
    assert two["a"].p_two_sided == pytest.approx(2 / 10)
    assert one["b"].p_two_sided == 1.0 and two["b"].p_two_sided == 1.0
    assert one["b"].q500 == 4.0 and one["b"].null_sd == pytest.approx(np.std(null, ddof=1))


def test_text(spark):
    df = spark.createDataFrame([(" a b\t", "NM_1 // TP53 /// NM_2 // TP53", "x /// y"), (None, "NM_1 // A /// NM_2 // B", None)], "a string, b string, c string")
    got = df.select(text.squeezed(F.col("a"), True).alias("a"), text.only_symbol(F.col("b")).alias("b"), text.trimmed_upper(F.col("a")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("AB", "TP53", "A B"), ("", None, "")]
    assert text.restart_label(0.5) == "r0p50"


def test_quantile_bins_like_pandas(spark):
    from kalibra.operators.nulls import quantile_bins

    rng = np.random.default_rng(5)
    rows = [(g, float(x)) for g in range(20) for x in rng.integers(0, rng.integers(2, 12), 25)]
    got = quantile_bins(spark.createDataFrame(rows, "g int, x double"), "x", ["g"]).toPandas()
    for _, own in got.groupby("g"):
        want = pd.qcut(own.x, 4, labels=False, duplicates="drop") + 1
        assert list(own["bin"]) == list(want)


def test_wide_ranks_like_plain_ones(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(x)) for g in "ab" for x in rng.integers(0, 40, 300)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = sorted((r.g, r.x, r.r) for r in ranks.wide_average_rank(df, "x", ["g"], "r").collect())
    want = df.where("x is not null").withColumn("r", ranks.average_rank("x", ["g"]))
    assert got == sorted((r.g, r.x, r.r) for r in want.collect())
    assert ranks.wide_average_rank(df.where("false"), "x", ["g"], "r").count() == 0


def test_small_sets_are_unfolded(spark):
    from kalibra.operators.mapping import grid, on_universe, with_each

    a, b = spark.createDataFrame([(1,), (2,), (2,)], "x int"), spark.createDataFrame([("p", 1.0), ("p", 1.0), ("q", 2.0)], "k string, v double")
    assert sorted(map(tuple, with_each(a, b).collect())) == [(1, "p", 1.0), (1, "q", 2.0), (2, "p", 1.0), (2, "p", 1.0), (2, "q", 2.0), (2, "q", 2.0)]
    assert grid(a, b.select("k")).count() == 4
    filled = on_universe(grid(a, b.select("k")), spark.createDataFrame([(1, "p", 5.0)], "x int, k string, y double"), ["x", "k"], "y")
    assert sorted((r.x, r.k, r.y, r.measured) for r in filled.collect()) == [(1, "p", 5.0, True), (1, "q", 0.0, False), (2, "p", 0.0, False), (2, "q", 0.0, False)]


def test_flags_and_directions(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (0.0,)], "x double")
    got = df.select(ranks.direction(F.col("x")).alias("d"), ranks.flagged({"NEG": F.col("x") < 0, "ODD": F.abs("x") == 1}).alias("f")).collect()
    assert [tuple(r) for r in got] == [("UP", "ODD"), ("DOWN", "NEG;ODD"), ("ZERO", "")]


def test_lag_correlation(spark):
    x = [1.0, 3.0, 2.0, 5.0, 4.0, 6.0, 8.0]
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(x)], "c string, i int, x double")
    got = {r.lag: r.autocorrelation for r in ranks.lag_correlation(df, "x", ["c"], "i", (1, 2)).collect()}
    assert got == pytest.approx({k: np.corrcoef(x[k:], x[:-k])[0, 1] for k in (1, 2)})


def plain_lowess(x, y, at, span: float = 0.5, steps: int = 3):
    """smooth.lowess() by all pairs."""
    x, y, at = np.asarray(x, float), np.asarray(y, float), np.asarray(at, float)
    k = min(max(int(span * len(x) + 1e-7), 2), len(x))
    robust, fits = np.ones(len(x)), np.zeros(len(at))
    for step in range(steps + 1):
        for i, a in enumerate(at):
            d = abs(x - a)
            h = np.sort(d)[k - 1]
            w = np.where(d <= 0.999 * h, np.where(d <= 0.001 * h, 1.0, (1 - (d / (h or 1)) ** 3) ** 3), 0.0) * robust
            if w.sum() > 0:
                w /= w.sum()
                m = w @ x
                c = w @ (x - m) ** 2
                slope = (w @ ((x - m) * y)) / c if c**0.5 > 0.001 * (x.max() - x.min()) else 0.0
                fits[i] = w @ y + slope * (a - m)
        r = abs(y - np.interp(x, at, fits))
        scale = 6 * np.median(r)
        if step == steps or scale < 1e-7 * r.mean() or not scale:
            return fits
        robust = np.where(r <= 0.001 * scale, 1.0, np.where(r <= 0.999 * scale, (1 - (r / scale) ** 2) ** 2, 0.0))
    return fits


@pytest.mark.parametrize(("n", "own"), [(60, True), (400, False), (3, True)])
def test_lowess_like_all_pairs(spark, n, own):
    rng = np.random.default_rng(n)
    x = np.round(rng.uniform(0, 12, n), 1)  # with ties
    y = np.sin(x) + rng.normal(0, 0.1, n)
    y[::17] += 5  # outliers
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist()), (None, 1.0), (float("nan"), 2.0)], "x double, y double")
    at, fits = smooth.lowess(df, sorted(set(x.tolist())) if own else None)
    np.testing.assert_allclose(fits, plain_lowess(x, y, at), atol=1e-9, rtol=0)
    line = df.where("x >= 0").select("x", smooth.interpolated(F.col("x"), at, fits).alias("f")).toPandas()
    np.testing.assert_allclose(line.f[~line.x.isna()], np.interp(line.x[~line.x.isna()], at, fits), atol=1e-12)


def test_lowess_of_little(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert smooth.lowess(empty) == ([], [])
    same = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "x double, y double")
    assert smooth.lowess(same) == ([2.0], [2.0])


def test_exact_quantiles_like_percentile(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(700)) / 8.0).alias("x"))
    at = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.731, "e": 1.0}
    got = ranks.exact_quantiles(df, "x", ["g"], at).orderBy("g").collect()
    want = df.groupBy("g").agg(*[F.percentile("x", F.lit(q)).alias(n) for n, q in at.items()]).orderBy("g").collect()
    np.testing.assert_allclose(np.array(got, float), np.array(want, float), atol=1e-12)


def test_wide_groups_like_narrow_ones(spark):
    from kalibra.operators.nulls import quantile_bins

    df = spark.range(4000).select((F.col("id") % 3).alias("g"), F.lit(0.4).alias("o"), F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(900)) / 900.0).alias("x"))
    bins = lambda wide: sorted(map(str, quantile_bins(df, "x", ["g"], wide=wide).collect()))
    assert bins(True) == bins(False)
    one = quantile_bins(df.drop("g"), "x", [], wide=True).groupBy("bin").count().orderBy("bin").collect()
    assert [r.bin for r in one] == [None, 1, 2, 3, 4]
    assert quantile_bins(df.where("false"), "x", [], wide=True).count() == 0
    a, b = (ranks.empirical(df, "o", "x", ["g"], wide=w).toPandas().sort_values("g").set_index("g") for w in (False, True))
    pd.testing.assert_frame_equal(a[sorted(a.columns)], b[sorted(a.columns)], rtol=0, atol=1e-12)


def test_student_p_takes_as_long_for_any_df(spark):
    """The fraction's depth is bounded, and its value that of the full depth."""
    import time

    from kalibra.functions.special import student_p_sql

    spark.sql(f"select {student_p_sql('t', 'df')} from values (2.0D, 9.0D) as x(t, df)").collect()
    rows = spark.range(400).selectExpr("cast(id / 40.0 + 0.01 as double) as t", "cast(1e9 as double) as df").coalesce(1)
    began = time.monotonic()
    got = rows.select("t", F.expr(student_p_sql("t", "df")).alias("p")).collect()
    assert time.monotonic() - began < 20
    assert all(r.p == pytest.approx(math.erfc(r.t / math.sqrt(2)), rel=1e-6) for r in got)
    some = spark.sql("select t, df from (select explode(array(0.1D, 1.7D, 1.8D, 4.0D)) as t), (select explode(array(1.0D, 40.0D, 3000.0D, 40000.0D)) as df)")
    full = student_p_sql("t", "df").replace("least(ceil(30 + 6 * sqrt(df)), 80)", "ceil(30 + 6 * sqrt(df))")
    assert "least(ceil" not in full
    assert all(r.a == r.b for r in some.select(F.expr(student_p_sql("t", "df")).alias("a"), F.expr(full).alias("b")).collect())


def test_binary_logarithms_are_right_to_the_last_digit(spark):
    """The mean of two prices of the tables lies next to half a unit of the ninth digit, where a quotient of natural logarithms is rounded up."""
    import math

    from pyspark.sql import functions as F

    from kalibra.functions.special import log2

    x = [64783.687499999985, 1.0, 2.0, 8.0, 0.1, 3.0, 1e300, 5e-324, 1023.9999999999999]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", log2("x").alias("y"), F.round(log2("x"), 9).alias("z")).collect()
    assert all(abs(r.y - math.log2(r.x)) <= math.ulp(math.log2(r.x)) for r in rows)
    assert rows[0].z == 15.983342968
    assert spark.createDataFrame([(0.0,), (-1.0,), (None,)], "x double").where(log2("x").isNotNull()).count() == 0
