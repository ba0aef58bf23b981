import math
import pathlib
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kalibra import storage
from kalibra.functions import ranks
from kalibra.functions.keyed import chained, mixed
from kalibra.operators import divergence, evidence, expression, graph, mapping, modules, nulls, projection, rewire
from kalibra.storage import Scratch


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_support_weight(spark):
    rows = [("p", a, "x") for a in range(4)] + [("p", a, "y") for a in range(41)]
    got = {r.left: r.weight for r in evidence.support_weights(frame(spark, rows + rows, "profile string, article int, left string")).collect()}
    assert got["x"] == pytest.approx(4.5 / 42)


def chain(spark):
    return graph.transition(frame(spark, [("A", "B", 1.0), ("B", "C", 1.0)], "u string, v string, score double"))


def test_walk_on_a_chain(spark):
    start = frame(spark, [("p", "A", 1.0)], "profile string, node string, x double")
    got = {r.node: r.x for r in graph.walked(chain(spark), start, 0.5).collect()}
    assert got == pytest.approx({"A": 7 / 12, "B": 1 / 3, "C": 1 / 12}, abs=1e-11)
    assert sum(got.values()) == pytest.approx(1.0, abs=1e-12)


def test_adjoint_scores_like_the_walk(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 12, 40), rng.integers(0, 12, 40), rng.random(40))]
    clean = graph.cleaned(frame(spark, edges, "u int, v int, score double"), 0.0)
    p = graph.transition(clean)
    nodes = [r.node for r in graph.node_stats(clean).collect()]
    start = graph.seeds(frame(spark, [(s, n, float(rng.random())) for s in "ab" for n in nodes], "profile string, node int, weight double"), graph.node_stats(clean))
    x = frame(spark, [(n, float(rng.normal())) for n in nodes], "node int, x double")
    q = graph.walked(p, x, 0.5, [], adjoint=True, norm="max")
    by_adjoint = {r.profile: r.score for r in graph.scored_seeds(start, q).collect()}
    walk = graph.walked(p, start, 0.5)
    by_walk = {r.profile: r.s for r in walk.join(x.withColumnRenamed("x", "y"), "node").groupBy("profile").agg(F.sum(F.col("x") * F.col("y")).alias("s")).collect()}
    assert by_adjoint == pytest.approx(by_walk, abs=1e-10)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: (r.component, r["size"]) for r in graph.component_sizes(frame(spark, edges, "u int, v int")).collect()}
    assert got[40] == (0, 41) and got[115] == (100, 31) and len(got) == 72


def test_closure_with_diamond_and_cycle(spark):
    edges = frame(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x")], "child string, parent string")
    got = {(r.node, r.ancestor) for r in graph.closure(edges).collect()}
    assert {a for n, a in got if n == "a"} == {"a", "b", "c", "d"} and {a for n, a in got if n == "x"} == {"x", "y"}


def test_divergence_limits(spark):
    same = frame(spark, [(p, r, 0.5) for p in "ab" for r in (1, 2)], "profile string, right int, p double")
    apart = frame(spark, [("a", 1, 1.0), ("b", 2, 1.0)], "profile string, right int, p double")
    assert divergence.gjsd(same, "p").first().gjsd == pytest.approx(0.0, abs=1e-12)
    got = divergence.gjsd(apart, "p").first()
    assert got.gjsd == pytest.approx(1.0) and got.common_mass == 0.0


def test_projection_keeps_mass_and_splits(spark):
    rng = np.random.default_rng(2)
    edges = frame(spark, [(int(a), int(b)) for a, b in {(x, y) for x, y in zip(rng.integers(0, 9, 60), rng.integers(0, 15, 60))}], "left int, right int")
    w = frame(spark, [(p, l, float(rng.random())) for p in "abc" for l in range(9) if rng.random() < 0.8], "profile string, left int, weight double")
    assert projection.mass_check(w, edges).agg(F.max("gap")).first()[0] < 1e-12
    assert projection.linear_identity(w, edges).agg(F.max("max_gap")).first()[0] < 1e-12


def test_permutations_stay_in_their_stratum(spark):
    u = frame(spark, [(i, "s" + str(i % 3)) for i in range(30)], "feature int, stratum string")
    got = nulls.permutations(u, 5, 7).toPandas()
    assert (got.feature % 3 == got.donor % 3).all()
    assert got.groupby("rep").donor.apply(lambda x: sorted(x) == list(range(30))).all()
    again = nulls.permutations(u.repartition(3), 5, 7).toPandas()
    key = ["rep", "feature"]
    assert got.sort_values(key).donor.tolist() == again.sort_values(key).donor.tolist()


def test_welch_and_its_edges(spark):
    rows = [("a", str(i), float(v), i < 3) for i, v in enumerate([1, 2, 4, 7, 9, 13, 8])] + [("flat", str(i), 5.0, i < 2) for i in range(4)]
    got = {r.feature: r for r in expression.with_p(expression.welch(frame(spark, rows, "feature string, sample string, value double, case_ boolean"), ["feature"], F.col("case_"))).collect()}
    a, b = np.array([1, 2, 4.0]), np.array([7, 9, 13, 8.0])
    se = a.var(ddof=1) / 3 + b.var(ddof=1) / 4
    assert got["a"].t == pytest.approx((a.mean() - b.mean()) / np.sqrt(se))
    assert got["flat"].t is None and got["flat"].p == 1.0


def test_welch_takes_no_rounding_for_variance(spark):
    """Of 0.03 three times and 0.1 five times, sums of squares less their mean's leave some 1e-18; large values lose their variance."""
    rows = [("flat", x, x < 0.05) for x in [0.03] * 3 + [0.1] * 5] + [("far", 1e9 + x, x < 3) for x in (0.0, 1.0, 2.0, 3.0, 5.0, 10.0)]
    df = frame(spark, rows, "feature string, value double, case_ boolean").coalesce(1)
    for weight in (None, F.lit(1.0)):
        got = {r.feature: r for r in expression.welch(df, ["feature"], F.col("case_"), weight).collect()}
        assert got["flat"].t is None
        if weight is None:
            assert got["far"].t == pytest.approx(-5 / np.sqrt(1 / 3 + 13 / 3))


def test_quantile_normalisation(spark):
    rows = [("f1", "s", 2.0), ("f2", "s", 4.0), ("f3", "s", 4.0), ("f1", "t", 10.0), ("f2", "t", 20.0), ("f3", "t", 30.0)]
    got = {(r.feature, r["sample"]): r.value for r in expression.quantile_normalised(frame(spark, rows, "feature string, sample string, value double")).collect()}
    assert got["f1", "s"] == 6.0 and got["f2", "s"] == got["f3", "s"] == (12 + 17) / 2 and got["f3", "t"] == 17.0


def small_null(spark):
    rng = np.random.default_rng(12)
    u = frame(spark, [(i, f"s{i % 3}") for i in range(70)], "feature int, stratum string")
    w = frame(spark, [(p, i, float(rng.random())) for p in "abc" for i in range(70) if rng.random() < 0.8], "profile string, feature int, weight double")
    z = frame(spark, [(i, float(rng.normal()) if i % 7 else None) for i in range(65)], "feature int, z double")
    m = frame(spark, [(int(i), f"m{j}") for j in range(4) for i in rng.choice(70, 30, False)], "feature int, module string")
    return u, w, z, m


@pytest.mark.parametrize("seed", [0, 1, 1729])
def test_donors_are_random(seed):
    """All orders of four places come alike, and how many of the first tenth stay there is hypergeometric."""
    orders = {}
    for rep in range(12_000):
        o = tuple(nulls.donors(4, seed, rep, 0))
        orders[o] = orders.get(o, 0) + 1
    assert len(orders) == 24 and sum((n - 500) ** 2 / 500 for n in orders.values()) < 50  # chi-square of 23 degrees
    stay = np.array([(nulls.donors(120, seed, rep, 2)[:12] < 12).sum() for rep in range(4000)])
    assert abs(stay.mean() - 1.2) < 0.06 and abs(stay.var() - 12 * 0.1 * 0.9 * 108 / 119) < 0.09
    follow = np.mean([(np.diff(nulls.donors(120, seed, rep, 2)) == 1).sum() for rep in range(2000)])
    assert abs(follow - 119 / 120) < 0.1


def test_blocks_equal_rows(spark):
    """Sums over blocks of replicates are those over rows within 1e-12, and both ways to permute agree."""
    u, w, z, m = small_null(spark)
    reps = nulls.BLOCK + 6
    drawn = nulls.permutations(u, reps, 7)
    assert drawn.exceptAll(nulls.permutations(u.repartition(3), reps, 7, large=5)).count() == 0
    profiles = w.select("profile").distinct()
    own = nulls.permutations(u, 4, 7, profiles)
    assert own.count() == 4 * 3 * 70 and own.exceptAll(nulls.permutations(u, 4, 7, profiles, large=5)).count() == 0
    a = nulls.alignment_null(w, z, drawn).toPandas().sort_values(["rep", "profile"])
    c = modules.masses(nulls.permuted_weights(w, drawn), m, ["rep", "profile"]).toPandas().sort_values(["rep", "profile", "module"])
    for large in (5, 1000):
        b = nulls.alignment_blocks(u, w, z, reps, 7, large=large).toPandas().sort_values(["rep", "profile"])
        assert list(b.profile) == list(a.profile) and len(b) == 3 * reps
        assert all(np.abs(a[x].values - b[x].values).max() < 1e-12 for x in ("rep", "num", "den", "alignment"))
        d = nulls.mass_blocks(u, w, m, reps, 7, large=large).toPandas().sort_values(["rep", "profile", "module"])
        assert list(d.module) == list(c.module) and np.abs(c.mass.values - d.mass.values).max() < 1e-12


def test_numbers_within_groups(spark):
    rows = [(g, k) for g, n in (("a", 50), ("b", 1), ("c", 9)) for k in range(n)]
    got = ranks.numbered(frame(spark, rows, "g string, k int").repartition(3), ["g"], ["k"], "n", Scratch(spark)).collect()
    assert sorted((r.g, r.k, r.n) for r in got) == [(g, k, k) for g, k in rows]


def test_resampled_effects_like_pandas(spark):
    rng = np.random.default_rng(13)
    rows = [(p, s, s % 2 == 0, f, float(rng.normal())) for p in "ab" for s in range(20) for f in range(9) if rng.random() < 0.6]
    v = frame(spark, rows, "profile string, subject int, case_ boolean, feature int, value double")
    got = {(r.rep, r.profile, f): e for r in modules.resampled_effects(v, "case_", 5, 3).collect() for f, e in zip(r.features, r.effects)}
    times = {(r.rep, r.profile, r.subject): r.times for r in nulls.drawn_subjects(v, 5, 3, ["profile"], "subject").collect()}
    want = {}
    for rep in range(5):
        for p in "ab":
            for f in range(9):
                side = {c: [(times.get((rep, q, s), 0), x) for q, s, k, g, x in rows if (q, g, k) == (p, f, c)] for c in (True, False)}
                if all(sum(t for t, _ in x) >= 2 for x in side.values()):
                    mean = {c: sum(t * x for t, x in y) / sum(t for t, _ in y) for c, y in side.items()}
                    want[rep, p, f] = mean[True] - mean[False]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def plain_moderated(rows):
    """Shrunk variances by the prior of unequal df, step by step."""
    digamma = lambda x: (math.lgamma(x + 1e-4) - math.lgamma(x - 1e-4)) / 2e-4

    def trigamma(x):
        out = 0.0
        while x < 30:
            out, x = out + 1 / x**2, x + 1
        return out + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5)

    d = np.array([a + b - 2 for a, b, _, _ in rows])
    s2 = np.array([x[3] for x in rows])
    e = np.array([math.log(s) - digamma(k / 2) + math.log(k / 2) for s, k in zip(s2, d)])
    rest = e.var(ddof=1) - np.mean([trigamma(k / 2) for k in d])
    if rest > 0:
        low, high = 1e-6, 1e6
        for _ in range(200):
            mid = math.sqrt(low * high)
            low, high = (mid, high) if trigamma(mid) > rest else (low, mid)
        d0 = 2 * low
        shrunk = (d0 * math.exp(e.mean() + digamma(d0 / 2) - math.log(d0 / 2)) + d * s2) / (d0 + d)
        total = np.minimum(d + d0, d.sum())
    else:
        shrunk, total = np.full(len(d), math.exp(e.mean())), np.full(len(d), d.sum())
    return [(x[2] / math.sqrt(v * (1 / x[0] + 1 / x[1])), k) for x, v, k in zip(rows, shrunk, total)]


@pytest.mark.parametrize("spread", [1.0, 0.0])
def test_variances_of_unequal_df_are_shrunk(spark, spread):
    rng = np.random.default_rng(21)
    rows = []
    for _ in range(80):
        a, b = (float(x) for x in rng.integers(2, 12, 2))
        d = a + b - 2
        chance = rng.chisquare(d) / d if spread else 1.0 + rng.random() / 100
        rows.append((a, b, float(rng.normal()), float(chance * math.exp(spread * rng.normal()))))
    df = frame(spark, [(i, *x) for i, x in enumerate(rows)], "feature int, n1 double, n2 double, effect double, s2 double")
    got = {r.feature: r for r in expression.moderated(df, ["feature"]).collect()}
    for i, (t, total) in enumerate(plain_moderated(rows)):
        assert got[i].t == pytest.approx(t, rel=1e-5) and got[i].df == pytest.approx(total, rel=1e-4) and 0 < got[i].p <= 1


def test_bootstrap_draws_as_many_as_there_are(spark):
    s = frame(spark, [(p, i) for p, n in (("a", 7), ("b", 11)) for i in range(n)], "profile string, k int")
    drawn = nulls.drawn_subjects(s, 6, 3, ["profile"], "k")
    assert drawn.exceptAll(nulls.drawn_subjects(s, 6, 3, ["profile"], "k", large=5)).count() == 0
    got = drawn.groupBy("rep", "profile").agg(F.sum("times").alias("n")).collect()
    assert {(r.profile, r.n) for r in got} == {("a", 7), ("b", 11)} and len(got) == 12


def played_plainly(edges, chain, draws, burn, thin, seed, buckets=1):
    """The kept graphs of a chain, by sets."""
    rows = {}
    for a, b in edges:
        rows.setdefault(a, set()).add(b)
    out = []
    for step in range(1, burn + (draws - 1) * thin + 1):
        first = (step - 1) // rewire.EPOCH * rewire.EPOCH if buckets > 1 else 0
        key = {a: chained(seed, chain, step, a) for a in rows}
        bucket = {a: chained(seed + 1, chain, first, a) % buckets for a in rows}
        for k in range(buckets):
            order = sorted((a for a in rows if bucket[a] == k), key=lambda a: (key[a], a))
            for a, b in zip(order[::2], order[1::2]):
                alone, shared = sorted(rows[a] ^ rows[b], key=lambda x: (mixed(key[a], x), x)), rows[a] & rows[b]
                n = len(rows[a]) - len(shared)
                rows[a], rows[b] = shared | set(alone[:n]), shared | set(alone[n:])
        if step >= burn and (step - burn) % thin == 0:
            out.append({(a, b) for a, own in rows.items() for b in own})
    return out


def some_edges(spark, lefts, rights, n):
    rng = np.random.default_rng(6)
    rows = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, lefts, n), rng.integers(0, rights, n))})
    return rows, frame(spark, rows, "left int, right int")


@pytest.mark.parametrize("most, buckets", [(1 << 20, 1), (400, 4)])
def test_rewired_like_sets(spark, most, buckets):
    rows, e = some_edges(spark, 150, 60, 1500)
    assert -(-len(rows) // most) == buckets
    got = {}
    for r in rewire.as_edges(rewire.rewired(e.repartition(3), 2, 3, 15, 4, 9, most)).collect():
        got.setdefault((r.chain, r.draw), set()).add((r.left, r.right))
    assert got == {(c, i): g for c in range(2) for i, g in enumerate(played_plainly(rows, c, 3, 15, 4, 9, buckets))}


def test_curveball(spark):
    board = frame(spark, [(0, 0), (1, 1)], "left int, right int")
    kept = rewire.degrees_kept(rewire.rewired(board, 2, 6, 3, 3, 1), board).collect()
    assert len(kept) == 12 and all(r.left_gap == r.right_gap == 0 and r.n_edges == 2 for r in kept)
    full = frame(spark, [(i, j) for i in range(3) for j in range(4)], "left int, right int")
    graphs = rewire.rewired(full, 1, 2, 1, 1, 1)
    assert {r.n for r in rewire.as_edges(graphs).groupBy("draw").agg(F.countDistinct("left", "right").alias("n")).collect()} == {12}
    assert {r.share for r in rewire.changed_share(graphs, full).collect()} == {0.0}
    with pytest.raises(Exception, match="nodes must be numbers"):
        rewire.rewired(frame(spark, [(-1, 0), (1, 1)], "left int, right int"), 1, 1, 1, 1, 1).count()


def test_trades_visit_all_graphs_alike(spark):
    """Of the 6 graphs of 4 left nodes with one of 2 right nodes each, two and two, every one about as often."""
    board = frame(spark, [(0, 0), (1, 0), (2, 1), (3, 1)], "left int, right int")
    got = rewire.as_edges(rewire.rewired(board, 4, 1500, 10, 2, 5)).where("right = 0").groupBy("chain", "draw").agg(F.sum(F.expr("cast(pow(2, left) as int)")).alias("g"))
    counts = [r["count"] for r in got.groupBy("g").count().collect()]
    assert len(counts) == 6 and min(counts) > 850 and max(counts) < 1150


def test_trades_of_many_nodes(spark):
    """Over several buckets and partitions: degrees stay, edges change and repeat nowhere, and chains differ."""
    rows, e = some_edges(spark, 150, 60, 1500)
    graphs = rewire.rewired(e, 2, 2, 2, 1, 9, 200)
    assert all(r.left_gap == r.right_gap == 0 and r.n_edges == len(rows) for r in rewire.degrees_kept(graphs, e).collect())
    flat = rewire.as_edges(graphs)
    assert flat.distinct().count() == flat.count() == 4 * len(rows)
    assert all(r.share > 0.3 for r in rewire.changed_share(graphs, e).collect())
    draw = lambda c: flat.where(f"chain = {c} and draw = 0").select("left", "right")
    assert draw(0).exceptAll(draw(1)).count() > 0


def test_layers_of_the_observed_graph(spark):
    rng = np.random.default_rng(8)
    e = frame(spark, sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 9, 60), rng.integers(0, 15, 60))}), "left int, right int")
    w = frame(spark, [(p, n, float(rng.random())) for p in "abc" for n in range(9)], "profile string, left int, weight double")
    seen = rewire.as_rows(e).select(F.lit(0).alias("chain"), F.lit(0).alias("draw"), "left", "rights")
    got = rewire.layers(seen, w, e).first()
    want = divergence.gjsd(projection.project(w, e), "sum1").first()
    assert got.gjsd == pytest.approx(want.gjsd) and got.common_mass == pytest.approx(want.common_mass)


def test_closure_takes_as_many_rounds_as_its_depth_has_bits(spark):
    n = 600
    got = graph.closure(frame(spark, [(i, i + 1) for i in range(n)], "child int, parent int"), most=11)
    assert got.count() == (n + 1) * (n + 2) // 2 and got.where("ancestor < node").count() == 0
    loop = graph.closure(frame(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (2, 3), (0, 3)], "child int, parent int"), most=4)
    assert sorted(map(tuple, loop.collect())) == sorted([(a, b) for a in range(3) for b in range(4)] + [(3, 3)])


def test_walks_together_like_numpy(spark):
    rng = np.random.default_rng(31)
    a = rng.random((12, 12)) * (rng.random((12, 12)) < 0.4)
    a[a.sum(1) == 0, 0] = 1.0
    p = a / a.sum(1, keepdims=True)
    rows = [(i, j, float(p[i, j])) for i in range(12) for j in range(12) if p[i, j] > 0]
    seeds = rng.dirichlet(np.ones(12), 2)
    start = frame(spark, [(i, float(seeds[0, i]), float(seeds[1, i])) for i in range(12)], "node int, a double, b double")
    got = {r.node: r for r in graph.walked_together(frame(spark, rows, "src int, dst int, p double"), start, {"a": 0.3, "b": 0.7}).collect()}
    for k, (name, r) in enumerate((("a", 0.3), ("b", 0.7))):
        want = r * np.linalg.solve(np.eye(12) - (1 - r) * p.T, seeds[k])
        assert all(got[i][name] == pytest.approx(want[i], abs=1e-11) for i in range(12) if want[i] > 0)


def test_guards(spark):
    m = frame(spark, [("m", 6, False, True)], "module string, n int, broad boolean, eligible boolean")
    with pytest.raises(ValueError):
        modules.enough(m, 2)
    assert modules.enough(m, 1) is m
    df = frame(spark, [(0.0, 0.3), (2.0, 0.3)], "mass double, x double")
    assert sorted(r.g for r in df.select(nulls.guarded(F.col("mass"), F.col("x")).alias("g")).collect()) == [-1.0, 0.3]
    shares = graph.on_unit_scale(frame(spark, [(1, 2, 0.4), (2, 3, 0.9)], "u int, v int, score double"))
    thousands = graph.on_unit_scale(frame(spark, [(1, 2, 400.0), (2, 3, 900.0)], "u int, v int, score double"))
    assert sorted(map(tuple, shares.collect())) == sorted(map(tuple, thousands.collect()))


def test_controls(spark):
    """Mass in one module stands out from its null; permuting random weights doesn't."""
    rng = np.random.default_rng(3)
    n = 120
    u = frame(spark, [(i, "s") for i in range(n)], "feature int, stratum string")
    mem = frame(spark, [(i, f"m{i // 12}") for i in range(n)], "feature int, module string")
    w = [("hit", i, 10.0 if i < 12 else 0.1) for i in range(n)] + [("none", i, float(rng.random())) for i in range(n)]
    w = frame(spark, w, "profile string, feature int, weight double")
    drawn = nulls.permutations(u, 60, 1)
    null = modules.masses(nulls.permuted_weights(w, drawn), mem, ["rep", "profile"])
    a = modules.affinity(modules.masses(w, mem, ["profile"]), null).toPandas()
    hit = a[a.profile == "hit"].set_index("module").affinity
    assert hit.idxmax() == "m0" and hit["m0"] > 5
    assert a[a.profile == "none"].affinity.abs().max() < 4


def test_two_profiles_have_no_selectivity(spark):
    p = frame(spark, [(q, m, x) for q in "ab" for m, x in (("u", 0.1), ("v", 0.9))], "profile string, module string, scaled double")
    o = frame(spark, [(q, m, x) for q in "ab" for m, x in (("u", 0.2), ("v", 0.3))], "profile string, module string, o double")
    assert {(r.selectivity, r.status) for r in modules.selectivity(p, o).collect()} == {(None, "NOT_IDENTIFIABLE")}


def test_contracts(spark):
    df = frame(spark, [(1, "x"), (1, "y")], "a int, b string")
    with pytest.raises(ValueError):
        mapping.require_unique(df, ["a"])
    with pytest.raises(ValueError):
        mapping.checked_join(df, df, ["a"], "one_to_one")
    assert mapping.require(df, ["a"]) is df
    assert mapping.detect_column(["Gene Symbol", "logFC"], ["logfc"]) == "logFC"
    assert mapping.detect_column(["Gene Symbol", "logFC"], ["symbol"]) == "Gene Symbol"
    row = mapping.compared(df.withColumn("x", F.lit(1.0)), df.withColumn("x", F.lit(None).cast("double")), ["a", "b"], "x", 1e-9).first()
    assert row.n_masks == 2 and not row.agree


def test_gjsd_like_numpy(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.ones(6), 3)
    rows = [(f"p{i}", j, float(p[i, j])) for i in range(3) for j in range(6)]
    m = p.mean(0)
    want = np.mean([(q * np.log2(q / m)).sum() for q in p])
    df = frame(spark, rows, "profile string, right int, p double")
    assert divergence.gjsd(df, "p").first().gjsd == pytest.approx(want)
    assert divergence.gjsd(df.where("right <> 9"), "p").first().common_mass == pytest.approx(p.min(0).sum())


def test_tmm_of_equal_libraries(spark):
    rows = [(f"f{i}", s, float(10 + i)) for i in range(40) for s in ("a", "b")]
    got = expression.tmm_factors(frame(spark, rows, "feature string, sample string, value double"), "a").toPandas()
    assert isinstance(got, pd.DataFrame) and np.allclose(got.factor, 1.0)


def test_evidence_is_dealt_out_by_its_size(spark, monkeypatch):
    """Tasks have about as many rows as they may, however large the tables are."""
    from kalibra.plans import stand_ins
    from tests.compare import DATA

    d = f"{DATA}/sf0.001"
    n = stand_ins.table(spark, d, "lineitem").count()
    monkeypatch.setattr(stand_ins, "ROWS", n // 12)
    got = stand_ins.evidence(spark, d)
    sizes = got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert len(sizes) >= 12 and max(r.n for r in sizes) < n / 4
    assert got.count() == n


def held_at_most(monkeypatch):
    """The most bytes of tables that a Scratch held at once, at writes, in a list of one."""
    from kalibra.storage import Scratch

    most, write, append = [0], Scratch.write, Scratch.append

    def seen(f):
        def run(self, *args):
            out = f(self, *args)
            folder = pathlib.Path(self.root).parent
            most[0] = max(most[0], sum(x.stat().st_size for x in folder.glob("kalibra-*/*/part-*")))
            return out

        return run

    monkeypatch.setattr(Scratch, "write", seen(write))
    monkeypatch.setattr(Scratch, "append", seen(append))
    return most


@pytest.mark.parametrize("piece", [1, 1 << 28])
def test_summarised_graphs_hold_one_epoch(spark, monkeypatch, tmp_path, piece):
    """Figures are those of all kept graphs, and what lies in the shared folder doesn't grow with the draws."""
    monkeypatch.setattr(rewire, "PIECE", piece)
    rows, e = some_edges(spark, 300, 400, 6000)
    w = frame(spark, [(p, n, 1.0 + (n * k) % 7) for k, p in enumerate("abc", 1) for n in range(300)], "profile string, left int, weight double")
    rounded = lambda df: {(r.chain, r.draw): (round(r.gjsd, 10), round(r.common_mass, 10)) for r in df.collect()}
    want = rounded(rewire.layers(rewire.rewired(e, 2, 4, 6, 7, 9, 2000), w, e))
    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(tmp_path))
    most = held_at_most(monkeypatch)
    assert rounded(rewire.summarised(e, 2, 4, 6, 7, 9, rewire.layered(w, e), 2000)) == want and len(want) == 8
    few, most[0] = most[0], 0
    seen = rewire.observed(e)
    got = rewire.summarised(e, 2, 12, 6, 7, 9, lambda g, _: rewire.against(g, seen), 2000).collect()
    assert len(got) == 24 and all(r.left_gap == r.right_gap == 0 and r.n_edges == len(rows) for r in got)
    assert most[0] < 2 * few


def test_shuffles_of_scratch_tables_go_with_their_write(spark, tmp_path):
    from kalibra.storage import TIDY, Scratch

    folder = pathlib.Path(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()[0].getPath())
    before = set(folder.rglob("shuffle_*.data"))
    out = Scratch(spark).write(spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).count())
    left = []
    for _ in range(50):  # they are deleted by messages
        left = [x for x in set(folder.rglob("shuffle_*.data")) - before]
        if not left:
            break
        time.sleep(0.1)
    assert not left and out.count() == 1000 and spark.conf.get(TIDY, "false") == "false"


def test_articles_are_counted_where_they_lie(spark):
    """Evidence dealt out by article is shuffled for its few counts only, not by article again; an article counts once for each profile."""
    rows = [("p", a, n) for a in range(40) for n in range(a % 3 + 1)] + [("q", a, 0) for a in range(7)]
    dealt = frame(spark, rows + rows, "profile string, article int, left int").repartition(6, "article")
    first = evidence.Window.partitionBy("profile", "article").orderBy("left")
    plan = dealt.distinct().withColumn("n", F.row_number().over(first))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r.profile, r.left): (r.support, r.articles) for r in evidence.support_weights(dealt).collect()}
    assert got == {("p", 0): (40, 40), ("p", 1): (26, 40), ("p", 2): (13, 40), ("q", 0): (7, 7)}


def test_mass_check_joins_edges_once(spark):
    e = frame(spark, [(n, r) for n in range(9) for r in range(n + 1)], "left int, right int")
    w = frame(spark, [("p", n, 1.0 + n) for n in range(9)], "profile string, left int, weight double")
    plan = projection.mass_check(w, e)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


def test_parts_of_resamples_are_few_and_large():
    """A part's task draws all subjects, so its rows don't shrink as there are more profiles; small tables still have some parts for the tasks."""
    rows = 100 * modules.PART
    assert modules.parts_of(rows, 5, 12) * 5 <= 2 * rows / modules.PART
    assert modules.parts_of(3_000_000, 5, 12) * 5 >= 12 and modules.parts_of(10, 5, 12) == 1


@pytest.mark.parametrize("scale", [1.0, 1e13])
def test_resampled_modules_like_ranks_of_effects(spark, scale):
    """Percentiles of packed effects are those of the effects themselves, also of features in several modules or in none, and of values too large to pack."""
    rng = np.random.default_rng(5)
    rows = [(p, s, s % 2 == 0, f, float(rng.integers(0, 9)) * scale) for p in "ab" for s in range(30) for f in range(12) if rng.random() < 0.7]
    v = Scratch(spark).write(frame(spark, rows, "profile string, subject int, case_ boolean, feature int, value double"))
    pairs = [(f, m) for f in range(11) for m in ("x", "y", "z") if (f + ord(m)) % 3 or f == 4]
    m = frame(spark, pairs, "feature int, module string")
    got = modules.resampled_modules(v, "case_", m, 6, 3, 2)
    got = {(r.rep, r.profile, r.module): (r.n, r.mean) for r in got.collect()}
    want = {}
    seen = {}
    for r in modules.resampled_effects(v, "case_", 6, 3).collect():
        seen.setdefault((r.rep, r.profile), []).extend(zip(r.features, r.effects))
    for (rep, p), every in seen.items():
        rank = {f: (sum(y < x for _, y in every) + (sum(y == x for _, y in every) + 1) / 2) / (len(every) + 1) for f, x in every}
        for name in "xyz":
            own = [rank[f] for f, k in pairs if k == name and f in rank]
            if len(own) >= 2:
                want[rep, p, name] = (len(own), sum(own) / len(own))
    assert got.keys() == want.keys() and len(want) == 36
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_hashes_of_places_are_those_of_sql(spark):
    """Without divisions, as with them, also at hashes next to the prime."""
    from kalibra.functions import keyed

    for h in (0, 1, 7, keyed.PRIME - 1, keyed.PRIME - 1 - keyed.SHIFT, 2 * keyed.PRIME - keyed.SHIFT - 40_000):
        assert (keyed.mixed_places(h, 70_000) == keyed.mixed(h, np.arange(70_000))).all()


def test_strata_are_gathered_from_rows(spark):
    """No row holds a stratum, and a feature's replicates lie together where permutations are written."""
    u, w, z, m = small_null(spark)
    for out in (nulls.alignment_blocks(u, w, z, 70, 7), nulls.mass_blocks(u, w, m, 70, 7), nulls.permutations(u, 70, 7)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "first" in plan
    rows = nulls.permutations(u, 5, 7).coalesce(1).collect()
    assert all([r.rep for r in rows[i : i + 5]] == list(range(5)) and len({r.feature for r in rows[i : i + 5]}) == 1 for i in range(0, len(rows), 5))


def test_degrees_of_parts_take_no_doubled_rows(spark):
    from kalibra.plans import stand_ins

    found = stand_ins.universe(spark, "/root/testdata/sf0.001").select("feature", "network", "ubiquity").collect()
    items = stand_ins.table(spark, "/root/testdata/sf0.001", "lineitem").toPandas().groupby("l_partkey").agg(n=("l_orderkey", "nunique"), u=("l_suppkey", "nunique"))
    assert {(r.feature, r.network, r.ubiquity) for r in found} == {(k, float(r.n) if r.n >= 10 else None, float(r.u)) for k, r in items.iterrows()}


def test_profiles_go_with_an_edge_as_one_row(spark, monkeypatch):
    """Few profiles don't fan out over the edges, whose tasks are as many as their size asks for; many profiles give the same as rows."""
    pairs = [(n, r) for n in range(9) for r in range(n % 4 + 1)] + [(50, 70), (50, 1)]
    e = Scratch(spark).write(frame(spark, pairs, "left int, right int"))
    w = Scratch(spark).write(frame(spark, [(p, n, 1.0 + n * k) for k, p in enumerate("abc") for n in range(9) if n % 3 != k], "profile string, left int, weight double"))
    got = {(r.profile, r.right): r for r in projection.project(w, e).collect()}
    gaps = {r.profile: r.max_gap for r in projection.linear_identity(w, e).collect()}
    prior = {(r.profile, r.right): r.weight for r in projection.prior(w, e).collect()}
    monkeypatch.setattr(storage, "ROWS", 2)
    plan = projection.scores(w, e)._jdf.queryExecution().optimizedPlan().toString()
    assert "profile" in plan and "RepartitionByExpression [left" in plan and f", {-(-len(pairs) // 2)}" in plan and plan.count("Join ") == 3
    monkeypatch.setattr(projection, "few_profiles", lambda *_: None)
    want = {(r.profile, r.right): r for r in projection.project(w, e).collect()}
    assert got.keys() == want.keys() and len(got) == 3 * 5
    assert all(abs(got[k][c] - want[k][c]) < 1e-12 for k in got for c in ("binary_union", "weighted_raw", "degree_normalised", "ubiquity_corrected", "contributing", "sum1"))
    assert {k: v for k, v in prior.items()} == pytest.approx({(r.profile, r.right): r.weight for r in projection.prior(w, e).collect()})
    assert gaps.keys() == {"a", "b", "c"} and max(gaps.values()) < 1e-12


def test_permuted_rows_are_never_broadcast(spark):
    """Spark estimates what comes from Python by what goes there, so a null of many replicates looked small enough to send to the driver."""
    u, w, z, m = small_null(spark)
    drawn = nulls.permutations(u, 70, 7)
    for out in (nulls.alignment_null(w, z, drawn), nulls.permuted_weights(w, drawn)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("by", [0, 1 << 26])
def test_figures_of_whole_graphs_are_those_of_their_rows(spark, monkeypatch, tmp_path, by):
    """Worked out in the tasks that hold the graphs, which are written nowhere; also where right nodes are far above the number of edges."""
    rows, e = some_edges(spark, 60, 90, 1500)
    rows, e = [(a, b + by) for a, b in rows], e.withColumn("right", F.col("right") + by)
    w = frame(spark, [(p, n, 1.0 + (n * k) % 7) for k, p in enumerate("abc", 1) for n in range(70) if n % 5 != k], "profile string, left int, weight double")
    m = frame(spark, [(r + by, f"m{r % 4}") for r in range(5, 99)] + [(by + 7, "m0"), (3, "m9")], "right int, module string")
    graphs = Scratch(spark).write(rewire.rewired(e, 2, 12, 6, 2, 9))
    close = lambda df: {(r.chain, r.draw, r.layer): (pytest.approx(r.gjsd, abs=1e-12), pytest.approx(r.common_mass, abs=1e-12)) for r in df.collect()}
    want, gaps = close(rewire.layers(graphs, w, e, m)), sorted(map(tuple, rewire.against(graphs, rewire.observed(e)).collect()))
    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(tmp_path))
    most = held_at_most(monkeypatch)
    got = close(rewire.summarised(e, 2, 12, 6, 2, 9, rewire.layered(w, e, m)))
    assert got.keys() == want.keys() and len(got) == 48
    assert all(x.expected == y for k in want for x, y in zip(got[k], want[k]))
    assert sorted(map(tuple, rewire.summarised(e, 2, 12, 6, 2, 9, rewire.kept_figures(e)).collect())) == gaps and len(gaps) == 24
    assert most[0] < 24 * 4 * len(rows) / 2


def test_fifth_powers_without_divisions():
    from kalibra.functions.keyed import PRIME, fifths

    x = [0, 1, 2, PRIME - 1, PRIME, PRIME + 1, 2 * PRIME - 2, 2 * PRIME, 123_456_789, 65_536, 3_000_000_000]
    assert fifths(np.array(x, np.uint64)).tolist() == [pow(v % PRIME, 5, PRIME) for v in x]


@pytest.mark.parametrize("span", [1, 1 << 21])
def test_walks_from_the_same_seeds_share_their_moves(spark, monkeypatch, span):
    """Limits are those of numpy, and moves end when two of them change nothing, also where states alternate between two sides."""
    monkeypatch.setattr(graph, "SPAN", span)
    rng = np.random.default_rng(5)
    w = rng.integers(1, 9, (20, 7)).astype(float)
    both = np.block([[np.zeros((20, 20)), w], [w.T, np.zeros((7, 7))]])
    p = both / both.sum(1, keepdims=True)
    rows = [(i, j, float(p[i, j])) for i in range(27) for j in range(27) if p[i, j] > 0]
    x = np.concatenate((rng.dirichlet(np.ones(20)), np.zeros(7)))
    start = frame(spark, [(i, float(x[i])) for i in range(20)], "node long, s double")
    moves, moved = [], graph.moved
    monkeypatch.setattr(graph, "moved", lambda *a: moves.append(1) or moved(*a))
    restarts = {"a": 0.3, "b": 0.5, "c": 0.7}
    got = {r.node: r for r in graph.walked_together(frame(spark, rows, "src long, dst long, p double"), start, restarts, seeds_of=dict.fromkeys(restarts, "s")).collect()}
    assert len(got) == 27 and len(moves) < 30
    for name, r in restarts.items():
        want = r * np.linalg.solve(np.eye(27) - (1 - r) * p.T, x)
        assert all(abs(got[i][name] - want[i]) < 1e-13 for i in range(27))


def test_long_paths_are_walked_to_their_end(spark):
    """What moves reach later than their change is small is in the limit, too."""
    rows = [(i, j, 0.999 if j == i else 0.001) for i in range(7) for j in (i, i + 1)] + [(7, 7, 1.0)]
    got = {r.node: r.a for r in graph.walked_together(frame(spark, rows, "src int, dst int, p double"), frame(spark, [(0, 1.0)], "node int, a double"), {"a": 0.9}).collect()}
    p = np.zeros((8, 8))
    for i, j, x in rows:
        p[i, j] += x
    want = 0.9 * np.linalg.solve(np.eye(8) - 0.1 * p.T, np.eye(8)[0])
    assert len(got) == 8 and all(abs(got[i] - want[i]) < 1e-12 for i in range(8))
    with pytest.raises(RuntimeError, match="don't sum to 1"):
        graph.walked_together(frame(spark, [(0, 0, 1.5)], "src int, dst int, p double"), frame(spark, [(0, 1.0)], "node int, a double"), {"a": 0.9})


def test_mixing_needs_no_observed_graph(spark, monkeypatch):
    """Figures of kept graphs come from the tasks that hold them, and the observed graph's only where they are asked for."""
    from kalibra.plans.registry import QUERIES

    def fails(*_):
        raise AssertionError("graphs as rows")

    monkeypatch.setattr(rewire.layered, "__call__", fails)
    assert QUERIES["chain_mixing"](spark, "/root/testdata/sf0.001").count() == 4
