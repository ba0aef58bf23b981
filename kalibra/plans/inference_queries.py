"""Queries of null models, inference, graphs, expression statistics and modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from kalibra.functions import ranks
from kalibra.functions.keyed import chained_sql, mixed_sql
from kalibra.functions.special import erfc_sql, log2, signed_z_sql, student_p_sql, student_two_sided, trigamma_sql, two_sided_p_sql
from kalibra.operators import expression, graph, mapping, modules, nulls, rewire
from kalibra.plans import stand_ins as S
from kalibra.plans.stand_ins import SEED, r, sql
from kalibra.storage import Scratch

QUERIES, ORACLES = {}, {}
#: P values have a floor of 1 / (REPS + 1).
REPS = 999
#: Resamples, whose intervals need fewer.
BOOTS = 199


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLES[f.__name__] = text
        return f

    return add


# Null models

DRAW = {
    "reps": f"select unnest(range({REPS}))::bigint as rep",
    "num": "select feature, stratum, dense_rank() over (order by stratum) - 1 as s, row_number() over (partition by stratum order by feature) - 1 as n from uni",
    "own": "select rep, feature, stratum, n from num cross join reps",
    "drawn": f"select rep, feature as donor, stratum, row_number() over (partition by rep, stratum order by {chained_sql(str(SEED), 'rep', 's', 'n')}, n) - 1 as n from num cross join reps",
    "perm": "select rep, feature, donor from own join drawn using (rep, stratum, n)",
    "obs": "select profile, sum(weight * coalesce(z, 0)) / sum(case when z is not null then weight else 0 end) as alignment from feat left join z using (feature) group by profile",
    "nul": "select rep, profile, sum(weight * coalesce(z, 0)) / sum(case when z is not null then weight else 0 end) as alignment from perm join (select profile, feature as donor, weight from feat) using (donor) left join z using (feature) group by rep, profile",
}


@query(sql("select feature, network, ubiquity, stratum from uni", "uni"))
def matched_strata(spark, d):
    """NM3, NM4."""
    return S.universe(spark, d).select("feature", "network", "ubiquity", "stratum")


@query(sql("select stratum, count(*) as n, min(ubiquity) as low, median(ubiquity) as middle, max(ubiquity) as high from uni group by all", "uni"))
def stratum_summary(spark, d):
    """AG14."""
    return nulls.stratum_summary(S.universe(spark, d), "ubiquity")


@query(sql("select rep, feature, donor from perm", "uni", **{k: DRAW[k] for k in ("reps", "num", "own", "drawn", "perm")}))
def permutation(spark, d):
    """NM5."""
    return nulls.permutations(S.universe(spark, d), REPS, SEED)


@query(
    sql(
        "select rep, profile, feature, donor from own join drawn using (rep, profile, stratum, n)",
        "uni",
        reps="select unnest(range(99))::bigint as rep",
        num=DRAW["num"],
        ps="select profile, row_number() over (order by profile) - 1 as p from (select distinct c_mktsegment as profile from customer)",
        own="select rep, profile, feature, stratum, n from num cross join reps cross join ps",
        drawn=f"select rep, profile, feature as donor, stratum, row_number() over (partition by rep, profile, stratum order by {chained_sql(str(SEED), 'rep', 'p', 's', 'n')}, n) - 1 as n from num cross join reps cross join ps",
    )
)
def permutation_by_profile(spark, d):
    """NM6."""
    profiles = S.table(spark, d, "customer").select(F.col("c_mktsegment").alias("profile"))
    return nulls.permutations(S.universe(spark, d), 99, SEED, profiles)


@query(
    sql(
        "select profile, stratum, sum((weight > 0)::int)::bigint as n_positive, sum((weight = 0)::int)::bigint as n_zero, round(sum(weight), 8) as total from feat join uni using (feature) group by all",
        "feat", "uni",
    )
)
def null_invariants(spark, d):
    """AG15."""
    return nulls.invariants(S.features(spark, d), S.universe(spark, d), ["profile"]).withColumn("total", r("total"))


@query(
    sql(
        "select profile, round(sum(weight * coalesce(z, 0)), 8) as num, round(sum(case when z is not null then weight else 0 end), 8) as den, round(sum(weight * coalesce(z, 0)) / sum(case when z is not null then weight else 0 end), 8) as alignment from feat left join z using (feature) group by profile",
        "feat", "z",
    )
)
def alignment(spark, d):
    """NM7, AG16, JN2."""
    out = nulls.alignment(S.features(spark, d), S.scores(spark, d), ["profile"])
    return out.withColumns({c: r(c) for c in ("num", "den", "alignment")})


@query(
    sql(
        "select profile, score, round(sum(weight * coalesce(x, 0)) / sum(case when x is not null then weight else 0 end), 8) as alignment from feat left join zs using (feature) group by all",
        "feat", "z", zs="select feature, 'signed' as score, z as x from z union all select feature, 'absolute', abs(z) from z union all select feature, 'squared', z * z from z",
    )
)
def alignment_of_scores(spark, d):
    """NM8, AG12, MD15."""
    z = S.scores(spark, d).select("feature", F.col("z").alias("signed"), F.abs("z").alias("absolute"), (F.col("z") * F.col("z")).alias("squared"))
    long = z.unpivot("feature", ["signed", "absolute", "squared"], "score", "z")
    rows = S.features(spark, d).join(long, "feature")
    out = rows.groupBy("profile", "score").agg(F.sum(F.col("weight") * F.coalesce("z", F.lit(0.0))).alias("a"), F.sum(F.when(F.col("z").isNotNull(), F.col("weight")).otherwise(0.0)).alias("b"))
    return out.select("profile", "score", r(F.col("a") / F.col("b")).alias("alignment"))


@query(sql("select rep, profile, round(alignment, 8) as alignment from nul", "feat", "z", "uni", **{k: v for k, v in DRAW.items() if k != "obs"}))
def alignment_null(spark, d):
    """NM5, NM7, NM14."""
    return null_alignments(spark, d).select("rep", "profile", r("alignment").alias("alignment"))


def null_alignments(spark, d, w=None):
    return nulls.alignment_blocks(S.universe(spark, d), w or S.features(spark, d), S.scores(spark, d), REPS, SEED)


def with_null(spark, d):
    w = Scratch(spark).write(S.features(spark, d))
    own = nulls.alignment(w, S.scores(spark, d), ["profile"]).select("profile", F.round("alignment", 10).alias("observed"))
    null = null_alignments(spark, d, w).select("profile", F.round("alignment", 10).alias("null"))
    return Scratch(spark).write(null.join(own, "profile"))


EMPIRICAL = """select profile, count(*) as n_null, any_value(o) as observed, round(avg(x), 8) as null_mean, round(stddev_samp(x), 8) as null_sd, (sum((x >= o)::int) + 1)::double / (count(*) + 1) as p_upper, (sum((x <= o)::int) + 1)::double / (count(*) + 1) as p_lower,
    {both} as p_two_sided, round((any_value(o) - avg(x)) / stddev_samp(x), 6) as z, round(quantile_cont(x, 0.025), 8) as q025, round(quantile_cont(x, 0.25), 8) as q250, round(quantile_cont(x, 0.5), 8) as q500, round(quantile_cont(x, 0.75), 8) as q750, round(quantile_cont(x, 0.975), 8) as q975
    from (select *, avg(x) over (partition by profile) as mu from (select profile, round(nul.alignment, 10) as x, round(obs.alignment, 10) as o from nul join obs using (profile))) group by profile"""


def digest(out):
    return out.withColumns({c: r(c) for c in ("null_mean", "null_sd", "q025", "q250", "q500", "q750", "q975")}).withColumn("z", r("z", 6))


@query(sql(EMPIRICAL.format(both="(sum((abs(x - mu) >= abs(o - mu))::int) + 1)::double / (count(*) + 1)"), "feat", "z", "uni", **DRAW))
def empirical_centred(spark, d):
    """ST1, ST26, AG7, AG9."""
    return digest(ranks.empirical(with_null(spark, d), "observed", "null", ["profile"]))


@query(
    sql(
        EMPIRICAL.format(both="least(1, 2 * least((sum((x >= o)::int) + 1)::double / (count(*) + 1), (sum((x <= o)::int) + 1)::double / (count(*) + 1)))"),
        "feat", "z", "uni", **DRAW,
    )
)
def empirical_two_tails(spark, d):
    """ST2."""
    return digest(ranks.empirical(with_null(spark, d), "observed", "null", ["profile"], False))


@query(
    sql(
        "select a.rep, a.profile as first, b.profile as second, round(a.alignment - b.alignment, 8) as difference from nul a join nul b using (rep) where a.profile < b.profile",
        "feat", "z", "uni", **{k: v for k, v in DRAW.items() if k != "obs"},
    )
)
def null_contrasts(spark, d):
    """ST24."""
    null = Scratch(spark).write(null_alignments(spark, d))
    return nulls.contrasts(null, "alignment", ["rep"]).withColumn("difference", r("difference"))


@query(
    sql(
        "select round(sum(n) / sum(d), 8) as alignment, round(sum(n), 8) as num, round(sum(d), 8) as den from (select profile, sum(weight * coalesce(z, 0)) as n, sum(case when z is not null then weight else 0 end) as d from feat left join z using (feature) group by profile)",
        "feat", "z",
    )
)
def mixture(spark, d):
    """NM10."""
    return nulls.mixture(nulls.alignment(S.features(spark, d), S.scores(spark, d), ["profile"])).select(*[r(c).alias(c) for c in ("alignment", "num", "den")])


@query(
    f"""with subj as (select c_mktsegment as profile, c_custkey as k, dense_rank() over (order by c_mktsegment) - 1 as g, row_number() over (partition by c_mktsegment order by c_custkey) - 1 as n, count(*) over (partition by c_mktsegment) as size from customer),
    hits as (select rep, profile, {chained_sql(str(SEED), 'rep', 'g', 'n')} % size as n from subj cross join (select unnest(range({BOOTS}))::bigint as rep))
    select rep, h.profile, k as customer, count(*) as times from hits h join subj using (profile, n) group by all"""
)
def bootstrap_draws(spark, d):
    """NM12."""
    people = S.table(spark, d, "customer").select(F.col("c_mktsegment").alias("profile"), F.col("c_custkey").alias("customer"))
    return nulls.drawn_subjects(people, BOOTS, SEED, ["profile"], "customer")


@query(
    f"""with subj as (select c_mktsegment as profile, c_custkey as k, c_acctbal as x, c_nationkey as y, dense_rank() over (order by c_mktsegment) - 1 as g, row_number() over (partition by c_mktsegment order by c_custkey) - 1 as n, count(*) over (partition by c_mktsegment) as size from customer),
    hits as (select rep, profile, {chained_sql(str(SEED), 'rep', 'g', 'n')} % size as n from subj cross join (select unnest(range({BOOTS}))::bigint as rep)),
    est as (select rep, h.profile, sum(case when y < 12 then x end) / sum((y < 12)::int) - sum(case when y >= 12 then x end) / sum((y >= 12)::int) as delta from hits h join subj using (profile, n) group by all)
    select profile, round(quantile_cont(delta, 0.025), 9) as low, round(quantile_cont(delta, 0.5), 9) as middle, round(quantile_cont(delta, 0.975), 9) as high from est group by profile"""
)
def bootstrap_interval(spark, d):
    """ST22, AG9: a difference of means under integer multiplicities."""
    people = S.table(spark, d, "customer").select(F.col("c_mktsegment").alias("profile"), F.col("c_custkey").alias("customer"), F.col("c_acctbal").alias("value"), (F.col("c_nationkey") < 12).alias("case_"))
    times = nulls.drawn_subjects(people, BOOTS, SEED, ["profile"], "customer")
    tests = expression.welch(times.join(people, ["profile", "customer"]), ["rep", "profile"], F.col("case_"), F.col("times").cast("double"))
    out = tests.groupBy("profile").agg(F.percentile("effect", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return out.select("profile", *[r(F.col("q")[i], 9).alias(n) for i, n in enumerate(("low", "middle", "high"))])


# Multiplicity

# Of parts, Welch's test of the prices of open and shipped lines.
STUDENT = student_p_sql("t", "df", "duckdb")
TESTED = "round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 5) as t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) as df"
P = {
    "pg": "select feature, count(*) filter (o) as n1, count(*) filter (not o) as n2, avg(value) filter (o) as m1, avg(value) filter (not o) as m2, var_samp(value) filter (o) as v1, var_samp(value) filter (not o) as v2 from (select *, status = 'O' as o from px) group by all",
    "pt": f"select feature, {TESTED}, round(m1 - m2, 4) as effect from pg where n1 >= 2 and n2 >= 2 and v1 + v2 > 0",
    "t": f"select feature as part, p_brand as family, {STUDENT} as p, effect from pt join part on p_partkey = feature",
}


def tested(rows, case):
    """(feature, n1, n2, t, df, p, effect)."""
    out = expression.welch(rows, ["feature"], case).where("t is not null").withColumns({"t": r("t", 5), "df": r("df", 4), "effect": r("effect", 4)})
    return out.withColumn("p", student_two_sided("t", "df"))


def p_values(spark, d):
    part = S.table(spark, d, "part").select(F.col("p_partkey").alias("feature"), F.col("p_brand").alias("family"))
    rows = tested(S.prices(spark, d), F.col("status") == "O").join(part, "feature")
    return Scratch(spark).write(rows.select(F.col("feature").alias("part"), "family", "p", "effect"))


@query(
    sql(
        "select part, family, round(least(1, min(p * m / k) over (partition by family order by k desc rows unbounded preceding)), 10) as q from (select *, row_number() over (partition by family order by p, part) as k, count(*) over (partition by family) as m from t)",
        "px", **P,
    )
)
def benjamini_hochberg(spark, d):
    """ST3, WN5, R6."""
    return ranks.with_bh(p_values(spark, d), "p", ["family"]).select("part", "family", r("q", 10).alias("q"))


HOLM = "round(least(1, max((m - k + 1) * p) over (partition by family order by k rows unbounded preceding)), 10) as holm from (select *, row_number() over (partition by family order by p, part) as k, count(*) over (partition by family) as m from {t})"


@query(sql(f"select part, family, {HOLM.format(t='t')}", "px", **P))
def holm(spark, d):
    """ST4, WN5."""
    return ranks.with_holm(p_values(spark, d), "p", ["family"]).select("part", "family", r("holm", 10).alias("holm"))


@query(
    sql(
        f"select context, family, part, {HOLM.format(t='u')}",
        "px", "pd", **P, dg=P["pg"].replace("from px", "from pd"), dt=P["pt"].replace("from pg", "from dg"),
        v=f"select 'price' as context, part, p from t union all select 'discount', feature, {STUDENT} from dt",
        u="select context, 'global' as family, part, p from v union all select context, context, part, p from v",
    )
)
def global_holm(spark, d):
    """ST5, SE1: the parts' tests of prices and of discounts as one family over both contexts, and each context as one of its own."""
    discounts = tested(S.discounts(spark, d), F.col("status") == "O").select(F.lit("discount").alias("context"), F.col("feature").alias("part"), "p")
    both = Scratch(spark).write(p_values(spark, d).select(F.lit("price").alias("context"), "part", "p").unionByName(discounts))
    every = both.withColumn("family", F.lit("global")).unionByName(both.withColumn("family", F.col("context")))
    return ranks.with_holm(every, "p", ["family"]).select("context", "family", "part", r("holm", 10).alias("holm"))


# Expression statistics

WELCH = {
    "g": "select feature, count(*) filter (big) as n1, count(*) filter (not big) as n2, avg(value) filter (big) as m1, avg(value) filter (not big) as m2, var_samp(value) filter (big) as v1, var_samp(value) filter (not big) as v2 from px group by all",
    "wt": "select *, v1 / n1 as e1, v2 / n2 as e2 from g where n1 >= 2 and n2 >= 2",
}


@query(
    sql(
        "select feature, n1::double as n1, n2::double as n2, round(m1 - m2, 4) as effect, round((m1 - m2) / sqrt(e1 + e2), 5) as t, round((e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)), 4) as df from wt",
        "px", **WELCH,
    )
)
def welch(spark, d):
    """ST8."""
    out = expression.welch(S.prices(spark, d), ["feature"], F.col("big"))
    return out.select("feature", "n1", "n2", r("effect", 4).alias("effect"), r("t", 5).alias("t"), r("df", 4).alias("df"))


@query(sql(f"select feature, round({STUDENT}, 10) as p from (select feature, round((m1 - m2) / sqrt(e1 + e2), 5) as t, round((e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)), 4) as df from wt)", "px", **WELCH))
def student_p(spark, d):
    """ST9: P values of welch()."""
    out = expression.welch(S.prices(spark, d), ["feature"], F.col("big")).withColumns({"t": r("t", 5), "df": r("df", 4)})
    return expression.with_p(out).select("feature", r("p", 10).alias("p"))


@query(sql(f"select part, round({signed_z_sql('p', 'effect')}, 8) as z, round({two_sided_p_sql('(p * 3)')}, 12) as tail, round({erfc_sql('(p * 3)')}, 12) as erfc from t", "px", **P))
def signed_z(spark, d):
    """SC10, SC11, SC9."""
    out = p_values(spark, d)
    return out.select("part", r(F.expr(signed_z_sql("p", "effect")), 8).alias("z"), r(F.expr(two_sided_p_sql("(p * 3)")), 12).alias("tail"), r(F.expr(erfc_sql("(p * 3)")), 12).alias("erfc"))


# Two cohorts, open and shipped lines, in each of which large and small orders' discounts are compared.
COHORT = {
    "cg": "select feature, status, count(*) filter (big) as n1, count(*) filter (not big) as n2, avg(value) filter (big) as m1, avg(value) filter (not big) as m2, var_samp(value) filter (big) as v1, var_samp(value) filter (not big) as v2 from pd group by all",
    "ct": f"select feature, status, {TESTED}, round(m1 - m2, 4) as eff from cg where n1 >= 2 and n2 >= 2 and v1 + v2 > 0",
    "cp": f"select feature, status, eff, {STUDENT} as p from ct",
    "co": f"select feature, status, {signed_z_sql('p', 'eff')} as z from cp",
    "bo": "select a.feature, a.z as za, b.z as zb from co a join co b using (feature) where a.status = 'O' and b.status = 'F'",
    "ne": "select status, count(*) filter (big)::double * count(*) filter (not big) / count(*) as n from pd group by all",
    "nn": "select max(n) filter (status = 'O') as na, max(n) filter (status = 'F') as nb from ne",
}


def cohort(spark, d, status):
    rows = tested(S.discounts(spark, d).where(F.col("status") == status), F.col("big"))
    return Scratch(spark).write(rows.select("feature", "p", "effect")).select("feature", F.expr(signed_z_sql("p", "effect")).alias("z"))


def effective_sizes(spark, d):
    """Of both cohorts, from their numbers of cases and others."""
    rows = S.discounts(spark, d).groupBy("status").agg(F.sum(F.col("big").cast("double")).alias("n1"), F.sum((~F.col("big")).cast("double")).alias("n2"))
    found = {x.status: x.n for x in rows.select("status", expression.effective_n(F.col("n1"), F.col("n2")).alias("n")).collect()}  # two rows
    return found["O"], found["F"]


@query(
    sql(
        f"select feature, round(za, 8) as z_a, round(zb, 8) as z_b, round((za + zb) / sqrt(2.0::double), 8) as z, round({two_sided_p_sql('((za + zb) / sqrt(2.0::double))')}, 10) as p, round((za * sqrt(na) + zb * sqrt(nb)) / sqrt(na + nb), 8) as z_weighted, sign(za) = sign(zb) as concordant, case when za > 0 then 'UP' when za < 0 then 'DOWN' else 'ZERO' end as direction from bo cross join nn",
        "pd", **COHORT,
    )
)
def stouffer(spark, d):
    """ST10, ST11, SC12, FIL14."""
    out = expression.combined(cohort(spark, d, "O"), cohort(spark, d, "F"), *effective_sizes(spark, d))
    return out.withColumns({**{c: r(c) for c in ("z_a", "z_b", "z", "z_weighted")}, "p": r("p", 10), "direction": ranks.direction(F.col("z_a"))})


@query(
    sql(
        "select count(*) as n, round(avg((sign(za) = sign(zb))::int), 8) as concordance, case when avg((sign(za) = sign(zb))::int) >= 0.7 then 'A' when avg((sign(za) = sign(zb))::int) > 0.5 then 'STRESS_TEST' else 'B' end as tier from bo",
        "pd", **COHORT,
    )
)
def concordance(spark, d):
    """ST12, AG18."""
    out = expression.combined(cohort(spark, d, "O"), cohort(spark, d, "F"))
    return expression.tiers(out, 0.7).withColumn("concordance", r("concordance"))


@query(sql("select feature, status, median(value) as value from px group by all", "px"))
def median_collapse(spark, d):
    """AG4."""
    return expression.collapsed(S.prices(spark, d).withColumn("sample", F.col("status"))).select("feature", F.col("sample").alias("status"), "value")


@query(sql("select feature, status, round(log2(sum(value) / sum(sum(value)) over (partition by status) * 1e6 + 1), 8) as value from px group by feature, status", "px"))
def log_cpm(spark, d):
    """AG17."""
    counts = S.prices(spark, d).groupBy("feature", F.col("status").alias("sample")).agg(F.sum("value").alias("value"))
    return expression.log_cpm(counts).select("feature", F.col("sample").alias("status"), r("value").alias("value"))


FULL = {
    "ds": "select feature, status, avg(value) as value from px group by all",
    "ok": "select * from ds where feature in (select feature from ds group by feature having count(*) = 2)",
    "rn": "select *, row_number() over (partition by status order by value, feature) as rn from ok",
    "mn": "select rn, avg(value) as m from rn group by rn",
}


@query(sql("select feature, status, round(log2(avg(m) over (partition by status, value)), 9) as log_value from rn join mn using (rn)", "px", **FULL))
def quantile_normalised(spark, d):
    """R2."""
    rows = S.prices(spark, d).groupBy("feature", F.col("status").alias("sample")).agg(F.avg("value").alias("value"))
    full = rows.join(rows.groupBy("feature").agg(F.count("*").alias("n")).where("n = 2").select("feature"), "feature", "left_semi")
    return expression.quantile_normalised(full).select("feature", F.col("sample").alias("status"), r(log2("value"), 9).alias("log_value"))


EVIDENCE, PRIOR_DF, PRIOR, NO_REST = expression.prior_sql("duckdb")
MODERATED = {
    "pl": "select feature, n1, n2, m1 - m2 as effect, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) as s2, (n1 + n2 - 2)::double as d from g where n1 >= 2 and n2 >= 2",
    "pe": f"select avg(e) as centre, var_samp(e) - avg(v) as rest from (select {EVIDENCE} as e, {trigamma_sql('(d / 2)')} as v from pl where s2 > 0)",
    "p0": f"select centre, {PRIOR_DF} as d0, (select sum(d) from pl) as most from pe",
    "p1": f"select d0, most, case when d0 is null then {NO_REST} else {PRIOR} end as s0 from p0",
    "mt": "select feature, effect, effect / sqrt((case when d0 is null then s0 else (d0 * s0 + d * s2) / (d0 + d) end) * (1.0::double / n1 + 1.0::double / n2)) as t, least(coalesce(d0 + d, most), most) as df from pl cross join p1",
}


@query(sql(f"select feature, round(effect, 4) as effect, round(t, 6) as t, round(df, 4) as df, round({STUDENT}, 8) as p from mt", "px", g=WELCH["g"], **MODERATED))
def moderated_t(spark, d):
    """R3, R5, ST9: variances, each with its own residual df, shrunk to a common prior."""
    out = expression.moderated(expression.pooled(S.prices(spark, d), ["feature"], F.col("big")), ["feature"])
    return out.select("feature", r("effect", 4).alias("effect"), r("t", 6).alias("t"), r("df", 4).alias("df"), r("p", 8).alias("p"))


TMM = {
    "ct": "select l_partkey as feature, s_nationkey as sample, sum(l_quantity) as value from lineitem join supplier on l_suppkey = s_suppkey group by all",
    "sz": "select *, sum(value) over (partition by sample) as size from ct",
    "bt": "select a.sample, round(log2((a.value / a.size) / (b.value / b.size)), 12) as m, round(log2((a.value / a.size) * (b.value / b.size)) / 2, 12) as a, (1 - a.value / a.size) / a.value + (1 - b.value / b.size) / b.value as v from sz a join sz b on a.feature = b.feature and b.sample = (select min(sample) from ct) where a.value > 0 and b.value > 0",
    "rt": "select *, rank() over (partition by sample order by m) as rm, rank() over (partition by sample order by a) as ra, count(*) over (partition by sample) as n from bt",
    "ft": "select sample, sum(case when v > 0 then m / v else 0 end) / sum(case when v > 0 then 1 / v else 0 end) as f from rt where rm > floor(n * 0.3) and rm <= n - floor(n * 0.3) and ra > floor(n * 0.05) and ra <= n - floor(n * 0.05) group by all",
    "st": "select sample, coalesce(f, 0) as f from (select distinct sample from ct) left join ft using (sample)",
}


@query(sql("select sample, round(pow(2, f - (select avg(f) from st)), 6) as factor from st", **TMM).replace("with  ct", "with ct"))
def tmm(spark, d):
    """R4: normalisation factors of nations as samples, against the first of them."""
    items = S.table(spark, d, "lineitem").join(S.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = Scratch(spark).write(items.groupBy(F.col("l_partkey").alias("feature"), F.col("s_nationkey").alias("sample")).agg(F.sum("l_quantity").alias("value")))
    return expression.tmm_factors(counts, counts.agg(F.min("sample")).first()[0]).select("sample", r("factor", 6).alias("factor"))


@query(
    "with ct as (select l_partkey as feature, s_nationkey as sample, sum(l_quantity) as value from lineitem join supplier on l_suppkey = s_suppkey group by all), sz as (select sample, sum(value) as size from ct group by all) select feature, sample, value from ct where feature in (select feature from ct join sz using (sample) where value / size * 1e6 >= 10 / (select quantile_cont(size, 0.5) from sz) * 1e6 group by feature having count(*) >= 2) and feature in (select feature from ct group by feature having sum(value) >= 15)"
)
def expressed(spark, d):
    """R4's filter: features that reach the counts per million of 10 in a library of median size in two samples, and 15 in all."""
    items = S.table(spark, d, "lineitem").join(S.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = Scratch(spark).write(items.groupBy(F.col("l_partkey").alias("feature"), F.col("s_nationkey").alias("sample")).agg(F.sum("l_quantity").alias("value")))
    return expression.expressed(counts, 10.0, 2, 15.0)


def fit_sql(step: int) -> dict[str, str]:
    """Tables of one pass of the robust smoother: the lines by the points pt around the places ha, and the weights of the next pass."""
    w = "(case when abs(x - a) <= 0.001 * h then 1 else pow(1 - pow(abs(x - a) / h, 3), 3) end) * rw"
    before = "select *, 1.0::double as rw from pt" if not step else f"select * from rw{step}"
    return {
        f"su{step}": f"select pos, a, sum(w) as w, sum(w * (x - a)) as u, sum(w * (x - a) * (x - a)) as uu, sum(w * y) as y, sum(w * (x - a) * y) as uy from (select pos, a, x, y, {w} as w from ha, ({before}) p where abs(x - a) <= 0.999 * h and rw > 0) group by all",
        f"ft{step}": f"select pos, a, y / w - case when uu / w - u / w * u / w > 0 and sqrt(uu / w - u / w * u / w) > 0.001 * (select max(x) - min(x) from pt) then u / w * (uy / w - u / w * y / w) / (uu / w - u / w * u / w) else 0 end as f from su{step}",
        f"ln{step}": f"select a, f, lead(a) over (order by a) as b, lead(f) over (order by a) as g from ft{step}",
        f"of{step}": f"select x, y, abs(y - case when b is null then f else f + (x - a) / (b - a) * (g - f) end) as r from pt asof join ln{step} on x >= a",
        f"sc{step}": f"select 6 * median(r) as s from of{step}",
        f"rw{step + 1}": f"select x, y, case when r <= 0.001 * s then 1 when r <= 0.999 * s then pow(1 - r / s * r / s, 2) else 0 end as rw from of{step}, sc{step}",
    }


VOOM = {
    "c0": TMM["ct"],
    "z0": "select sample, sum(value) as size from c0 group by all",
    "ct": "select * from c0 where feature in (select feature from c0 join z0 using (sample) where value / size * 1e6 >= 10 / (select quantile_cont(size, 0.5) from z0) * 1e6 group by feature having count(*) >= 2) and feature in (select feature from c0 group by feature having sum(value) >= 15)",
    **{k: v for k, v in TMM.items() if k != "ct"},
    "lb": "select sample, sample % 2 = 1 as big, sum(value)::double * any_value(pow(2, f - (select avg(f) from st))) as lib from ct join st using (sample) group by sample",
    "lc": "select feature, sample, big, lib, log2((coalesce(value, 0) + 0.5) / (lib + 1) * 1e6) as v from (select distinct feature from ct) cross join lb left join ct using (feature, sample)",
    "mn": "select feature, avg(v) filter (big) as m1, avg(v) filter (not big) as m2, avg(v) as m, count(*) filter (big) as n1, count(*) filter (not big) as n2, var_pop(v) filter (big) as v1, var_pop(v) filter (not big) as v2 from lc group by feature",
    "pt": "select m + (select avg(log2(lib + 1)) from lb) - log2(1e6) as x, pow((n1 * v1 + n2 * v2) / (n1 + n2 - 2), 0.25) as y from mn",
    "pl0": "select unnest(range(201)) as pos, (select min(x) from pt) as low, (select max(x) from pt) as high",
    "pl1": "select pos, low + (high - low) * pos / 200 as a from pl0",
    "en": "select x, lead(x, greatest(floor(0.5 * (select count(*) from pt) + 1e-7)::int, 2) - 1) over (order by x) as z from pt",
    "ha": "select pos, a, min(greatest(a - x, z - a)) as h from pl1, en where z is not null group by all",
    **fit_sql(0), **fit_sql(1), **fit_sql(2), **{k: v for k, v in fit_sql(3).items() if k in ("su3", "ft3", "ln3")},
    "pr": "select feature, sample, big, v, case when big then m1 else m2 end - log2(1e6) + log2(lib + 1) as x from lc join mn using (feature)",
    "wt": "select p.*, pow(case when a is null then (select f from ln3 order by a limit 1) when b is null then f else f + (x - a) / (b - a) * (g - f) end, -4) as weight from pr p asof left join ln3 on x >= a",
}
VOOM_TEST = {
    "gw": "select feature, big, count(*) as n, sum(weight) as w, sum(weight * v) / sum(weight) as m from wt group by all",
    "qw": "select feature, sum(weight * (v - m) * (v - m)) as q from wt join gw using (feature, big) group by feature",
    "pl": "select feature, effect, u, q / (n1 + n2 - 2) as s2, (n1 + n2 - 2)::double as d from (select feature, any_value(m) filter (big) - any_value(m) filter (not big) as effect, sum(1 / w) as u, sum(n) filter (big) as n1, sum(n) filter (not big) as n2 from gw group by feature) join qw using (feature) where n1 >= 2 and n2 >= 2",
    **{k: v for k, v in MODERATED.items() if k in ("pe", "p0", "p1")},
    "mt": MODERATED["mt"].replace("(1.0::double / n1 + 1.0::double / n2)", "u"),
}


def voomed(spark, d):
    """Counts of parts by nations, those expressed, with every nation; odd nations against even ones."""
    items = S.table(spark, d, "lineitem").join(S.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    scratch = Scratch(spark)
    counts = scratch.write(items.groupBy(F.col("l_partkey").alias("feature"), F.col("s_nationkey").alias("sample")).agg(F.sum("l_quantity").alias("value")))
    kept = scratch.write(expression.expressed(counts, 10.0, 2, 15.0))
    samples = kept.select("sample").distinct()
    grid = kept.select("feature").distinct().crossJoin(F.broadcast(samples))  # as many samples as nations
    full = grid.join(kept, ["feature", "sample"], "left").withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(0.0)))
    factors = expression.tmm_factors(kept, kept.agg(F.min("sample")).first()[0])
    return scratch.write(expression.voom(full, samples.withColumn("case", F.col("sample") % 2 == 1), factors))


@query(sql("select feature, sample, round(v, 6) as value, round(weight, 5) as weight from wt", **VOOM).replace("with  c0", "with c0"))
def voom_weights(spark, d):
    """R4: log counts per million and the precision that the trend of deviations gives each."""
    return voomed(spark, d).select("feature", "sample", r("value", 6).alias("value"), r("weight", 5).alias("weight"))


@query(sql(f"select feature, round(effect, 4) + 0.0 as effect, round(t, 5) + 0.0 as t, round(df, 3) as df, round({STUDENT}, 6) as p from mt", **VOOM, **VOOM_TEST).replace("with  c0", "with c0"))
def voom_t(spark, d):
    """R4, R5: weighted least squares of voom_weights, variances shrunk."""
    tests = expression.weighted_pooled(voomed(spark, d), ["feature"]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, but each P value is a long fold
    out = expression.moderated(tests, ["feature"])
    signless = lambda c, n: (r(c, n) + 0.0).alias(c)  # noqa: E731, of -0.0
    return out.select("feature", signless("effect", 4), signless("t", 5), r("df", 3).alias("df"), r("p", 6).alias("p"))


IMPUTED = {
    "ga": "select l_partkey as feature, l_linestatus || l_returnflag || (l_linenumber % 2) as sample, avg(case when l_quantity > 6 then l_extendedprice end) as value from lineitem group by all",
    "lg": "select feature, sample, log2(greatest(value, 0) + 1) as value from ga",
    "st": "select *, count(*) over (partition by feature) as n, count(value) over (partition by feature) as k, avg(value) over (partition by feature) as m, stddev_pop(value) over (partition by feature) as sd from lg",
}


@query(sql("select feature, sample, round(coalesce(value, m), 8) as value from st where 1 - k::double / n <= 0.2 and sd > 0", **IMPUTED).replace("with  ga", "with ga"))
def imputed(spark, d):
    """R1: logs, few missing values, and the features' means for them."""
    items = S.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature"), F.concat("l_linestatus", "l_returnflag", F.col("l_linenumber") % 2).alias("sample"))
    rows = items.agg(F.avg(F.when(F.col("l_quantity") > 6, F.col("l_extendedprice"))).alias("value"))
    return expression.imputed(rows).withColumn("value", r("value"))


# Of either status, tests of the logged prices of large against small lines, with q-values over all features.
FOLDS = {
    "lg": "select feature, status, count(*) filter (big) as n1, count(*) filter (not big) as n2, avg(x) filter (big) as m1, avg(x) filter (not big) as m2, var_samp(x) filter (big) as v1, var_samp(x) filter (not big) as v2 from (select *, log2(value) as x from px) group by all",
    "lt": f"select feature, status, {TESTED}, round(m1 - m2, 4) as fold from lg where n1 >= 2 and n2 >= 2 and v1 + v2 > 0",
    "lp": f"select feature, status, fold, {STUDENT} as p from lt",
    "lq": "select feature, status, fold, round(least(1, min(p * m / k) over (partition by status order by k desc rows unbounded preceding)), 10) as q from (select *, row_number() over (partition by status order by p, feature) as k, count(*) over (partition by status) as m from lp)",
    "lc": "select feature, status, fold, q, case when q < 0.05 and fold >= 1 then 'Up' when q < 0.05 and fold <= -1 then 'Down' else 'NS' end as class from lq",
}


def folds(spark, d):
    """(feature, status, fold, q, class)."""
    rows, out = S.prices(spark, d).withColumn("value", F.log2("value")), None
    for status in ("O", "F"):
        one = tested(rows.where(F.col("status") == status), F.col("big")).select(F.lit(status).alias("status"), "feature", "p", F.col("effect").alias("fold"))
        out = one if out is None else out.unionByName(one)
    out = ranks.with_bh(Scratch(spark).write(out), "p", ["status"]).withColumn("q", r("q", 10))
    return expression.differential(out, effect="fold")


@query(sql("select * from lc", "px", **FOLDS))
def volcano(spark, d):
    """R8, R6: classes by q-value and fold change."""
    return folds(spark, d).select("feature", "status", "fold", "q", "class")


@query(sql("select feature, status, fold, q from lc where class <> 'NS'", "px", **FOLDS))
def differential_features(spark, d):
    """R6: the features of q < .05 and a fold change of two."""
    return folds(spark, d).where("class <> 'NS'").select("feature", "status", "fold", "q")


@query(sql("select a.class as from_class, b.class as to_class, count(*) as n, round(count(*)::double / sum(count(*)) over (), 8) as share from lc a join lc b using (feature) where a.status = 'O' and b.status = 'F' group by all", "px", **FOLDS))
def direction_flow(spark, d):
    """R8, R9."""
    found = Scratch(spark).write(folds(spark, d))
    one = lambda s: found.where(F.col("status") == s)
    return expression.direction_flow(one("O"), one("F")).withColumn("share", r("share"))


@query(
    sql(
        """select feature, round(q, 8) as q, q < 0.5 and sign(za) = sign(zb) as replicated, q < 0.5 and sign(za) = sign(zb) and least(abs(za), abs(zb)) >= 0.5 as strict
        from (select *, least(1, min(p * m / k) over (order by k desc rows unbounded preceding)) as q from (select *, row_number() over (order by p, feature) as k, count(*) over () as m from (select *, round({p}, 12) as p from bo)))""".format(p=two_sided_p_sql("((za + zb) / sqrt(2.0::double))")),
        "pd", **COHORT,
    )
)
def replicated(spark, d):
    """FIL15: features whose combined P value passes a false discovery rate and whose cohorts agree in sign; strictly, with some effect in each."""
    both = expression.combined(cohort(spark, d, "O"), cohort(spark, d, "F")).withColumn("p", F.round("p", 12))
    out = ranks.with_bh(Scratch(spark).write(both), "p", [])
    flag = (F.col("q") < 0.5) & F.col("concordant")
    return out.select("feature", r("q").alias("q"), flag.alias("replicated"), (flag & (F.least(F.abs("z_a"), F.abs("z_b")) >= 0.5)).alias("strict"))


@query(sql("select round(corr(za, zb), 8) as correlation, round(regr_slope(zb, za), 8) as slope, round(regr_intercept(zb, za), 8) as intercept from bo", "pd", **COHORT))
def effect_regression(spark, d):
    """R10, ST7."""
    both = expression.combined(cohort(spark, d, "O"), cohort(spark, d, "F"))
    return both.agg(r(ranks.pearson("z_a", "z_b")).alias("correlation"), r(F.regr_slope("z_b", "z_a")).alias("slope"), r(F.regr_intercept("z_b", "z_a")).alias("intercept"))


@query(sql("select feature, count(*) as n from px where feature in (select feature from px group by feature order by var_samp(value) desc nulls last, feature limit 50) group by all", "px"))
def most_variable(spark, d):
    """R7's selection, SO2."""
    return expression.most_variable(S.prices(spark, d), 50).groupBy("feature").agg(F.count("*").alias("n"))


# Graphs

NET = {
    "sc0": "select u, v, score * 1000.0::double / (select max(score) from net0) as score from net0",
    "sc": "select u, v, case when (select max(score) from sc0) <= 1 then score else score / 1000.0::double end as score from sc0",
    "cl": "select least(u, v) as u, greatest(u, v) as v, max(score) as score from sc where u <> v and score >= 0.3 group by all",
    "tw": "select u as src, v as dst, score as w from cl union all select v, u, score from cl",
    "tp": "select src, dst, w, w / sum(w) over (partition by src) as p from tw",
}


def clean(spark, d):
    """Scores in thousandths of the largest, which are detected to be no shares and scaled."""
    net = S.network(spark, d)
    top = net.agg(F.max("score").alias("m"))
    scaled = graph.on_unit_scale(net.crossJoin(top).select("u", "v", (F.col("score") * 1000.0 / F.col("m")).alias("score")))  # one row
    return Scratch(spark).write(graph.cleaned(scaled, 0.3))


@query(sql("select u, v, round(score, 8) as score from cl", "net0", **NET))
def clean_edges(spark, d):
    """GR1, FIL11, FIL12."""
    return clean(spark, d).withColumn("score", r("score"))


@query(sql("select u, v, round(score, 8) as score from cl", "net0", **(NET | {"sc0": "select u, v, score::double / (select max(score) from net0) as score from net0"})))
def clean_shares(spark, d):
    """GR1, FIL11, FIL12: scores that are shares already, and stay."""
    net = S.network(spark, d)
    shares = net.crossJoin(net.agg(F.max("score").alias("m"))).select("u", "v", (F.col("score").cast("double") / F.col("m")).alias("score"))  # one row
    return graph.cleaned(graph.on_unit_scale(shares), 0.3).withColumn("score", r("score"))


@query(sql("select src, dst, round(p, 8) as p from tp", "net0", **NET))
def transitions(spark, d):
    """GR2."""
    return graph.transition(clean(spark, d)).select("src", "dst", r("p").alias("p"))


@query(sql("select src as node, count(*) as degree, round(sum(w), 8) as strength from tw group by src", "net0", **NET))
def node_stats(spark, d):
    """GR10."""
    return graph.node_stats(clean(spark, d)).withColumn("strength", r("strength"))


@query(
    "with recursive ed as (select 'c' || o_custkey as u, 's' || l_suppkey as v from lineitem join orders on l_orderkey = o_orderkey group by all having sum(l_quantity) >= 120), tw as (select u, v from ed union select v, u from ed), reach(node, other) as (select u, u from tw union select r.node, t.v from reach r join tw t on t.u = r.other) select node, min(other) as component, count(*) as size from reach group by node"
)
def components(spark, d):
    """GR3: customers and suppliers, joined where they trade a quantity of 120 or more."""
    items = S.table(spark, d, "lineitem").join(S.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = items.groupBy(F.concat(F.lit("c"), "o_custkey").alias("u"), F.concat(F.lit("s"), "l_suppkey").alias("v")).agg(F.sum("l_quantity").alias("score"))
    return graph.component_sizes(graph.cleaned(rows, 120.0))


SEEDS = {"s0": "select profile, node, n::double / sum(n) over (partition by profile) as x from (select c_mktsegment as profile, c_nationkey as node, count(*) as n from customer where c_nationkey in (select src from tp) group by all)"}


def starts(spark, d):
    people = S.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("profile"), F.col("c_nationkey").alias("node")).agg(F.count("*").cast("double").alias("weight"))
    return graph.seeds(Scratch(spark).write(people), graph.node_stats(clean(spark, d)))


def walk_sql(start: str, steps: int, restart: float, adjoint: bool = False, by: str = "profile, ") -> dict[str, str]:
    at, to = ("dst", "src") if adjoint else ("src", "dst")
    out, last = {}, start
    for i in range(steps):
        out[f"x{i + 1}"] = f"select {by}node, sum(x) as x from (select {by}{to} as node, {1 - restart} * p * x as x from {last} join tp on {at} = node union all select {by}node, {restart} * x from {start}) group by {by}node"
        last = f"x{i + 1}"
    return out


@query(sql("select profile, node, round(x, 9) as x from s0", "net0", **NET, **SEEDS))
def walk_seeds(spark, d):
    """GR4, JN5, WN4."""
    return starts(spark, d).withColumn("x", r("x", 9))


@query(sql("select profile, node, round(x, 9) as x from x6", "net0", **NET, **SEEDS, **walk_sql("s0", 6, 0.5)))
def random_walk(spark, d):
    """GR5 after six steps."""
    out = graph.walked(graph.transition(clean(spark, d)), starts(spark, d), 0.5, steps=6)
    return out.withColumn("x", r("x", 9))


@query(sql("select node, round(x, 9) as x from x5", "net0", **NET, q0="select s_nationkey as node, avg(s_acctbal) / 10000 as x from supplier where s_nationkey in (select src from tp) group by all", **walk_sql("q0", 5, 0.5, True, "")))
def adjoint_walk(spark, d):
    """GR6 after five steps."""
    p = graph.transition(clean(spark, d))
    firms = S.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("node")).agg((F.avg("s_acctbal") / 10000).alias("x"))
    start = firms.join(p.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    return graph.walked(p, start, 0.5, [], adjoint=True, steps=5).withColumn("x", r("x", 9))


@query(sql("select profile, round(sum(s0.x * x5.x), 9) as score from s0 join x5 using (node) group by profile", "net0", **NET, **SEEDS, q0="select s_nationkey as node, avg(s_acctbal) / 10000 as x from supplier where s_nationkey in (select src from tp) group by all", **walk_sql("q0", 5, 0.5, True, "")))
def scored_seeds(spark, d):
    """GR7, NM9."""
    p = graph.transition(clean(spark, d))
    firms = S.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("node")).agg((F.avg("s_acctbal") / 10000).alias("x"))
    start = firms.join(p.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    q = graph.walked(p, start, 0.5, [], adjoint=True, steps=5)
    return graph.scored_seeds(starts(spark, d), q).withColumn("score", r("score", 9))


LONG = walk_sql("s0", 60, 0.5)


@query(
    sql(
        "select profile, round(sum(n), 8) as mass, round(sum(n) filter (node in (select src from tp)), 8) as seeded, round(sum(n) filter (node in (select src from tp)) / sum(n), 8) as share from (select c_mktsegment as profile, c_nationkey as node, count(*)::double as n from customer group by all) group by all",
        "net0", **NET,
    )
)
def seeded_mass(spark, d):
    """GR4: what of the profiles' weight the network has."""
    people = S.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("profile"), F.col("c_nationkey").alias("node")).agg(F.count("*").cast("double").alias("weight"))
    return graph.seeded_mass(people, graph.node_stats(clean(spark, d))).withColumns({c: r(c) for c in ("mass", "seeded", "share")})


@query(
    sql(
        "select profile, node, round(x, 9) as x, abs(sum(x) over (partition by profile) - 1) <= 1e-10 as kept_mass from x60",
        "net0", **NET, **SEEDS, **LONG,
    )
)
def converged_walk(spark, d):
    """GR5: the walk to a change of 1e-12, and whether its mass is 1 within 1e-10; SQL takes sixty steps."""
    x = Scratch(spark).write(graph.walked(graph.transition(clean(spark, d)), starts(spark, d), 0.5))
    mass = x.groupBy("profile").agg((F.abs(F.sum("x") - 1) <= 1e-10).alias("kept_mass"))
    return x.join(mass, "profile").select("profile", "node", r("x", 9).alias("x"), "kept_mass")


FIRMS = {"q0": "select s_nationkey as node, avg(s_acctbal) / 10000 as x from supplier where s_nationkey in (select src from tp) group by all"}


def firms(spark, d, p):
    rows = S.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("node")).agg((F.avg("s_acctbal") / 10000).alias("x"))
    return rows.join(p.select(F.col("src").alias("node")).distinct(), "node", "left_semi")


@query(sql("select profile, round(sum(x60.x * q0.x), 9) as score, true as agree from x60 join q0 using (node) group by profile", "net0", **NET, **SEEDS, **LONG, **FIRMS))
def walk_cross_check(spark, d):
    """GR6, GR7, NM9: the converged adjoint walk scores seeds as the converged walk's end does, within 1e-9."""
    p, start = Scratch(spark).write(graph.transition(clean(spark, d))), Scratch(spark).write(starts(spark, d))
    y = Scratch(spark).write(firms(spark, d, p))
    by_adjoint = graph.scored_seeds(start, graph.walked(p, y, 0.5, [], adjoint=True, norm="max"))
    by_walk = graph.scored_seeds(graph.walked(p, start, 0.5), y)
    both = by_walk.join(by_adjoint.select("profile", F.col("score").alias("other")), "profile")
    return both.select("profile", r("score", 9).alias("score"), (F.abs(F.col("score") - F.col("other")) <= 1e-9).alias("agree"))


@query(
    sql(
        "select a.profile, round(corr(a.r, b.r), 6) as rho from (select profile, node, rank() over (partition by profile order by round(x, 12)) + (count(*) over (partition by profile, round(x, 12)) - 1) / 2.0::double as r from s0) a join (select profile, node, rank() over (partition by profile order by round(x, 12)) + (count(*) over (partition by profile, round(x, 12)) - 1) / 2.0::double as r from x6 where (profile, node) in (select profile, node from s0)) b using (profile, node) group by all",
        "net0", **NET, **SEEDS, **walk_sql("s0", 6, 0.5),
    )
)
def diffusion_similarity(spark, d):
    """GR8, GR9."""
    start = starts(spark, d)
    after = graph.walked(graph.transition(clean(spark, d)), start, 0.5, steps=6)
    both = start.select("profile", "node", F.round("x", 12).alias("a")).join(after.select("profile", "node", F.round("x", 12).alias("b")), ["profile", "node"])
    return ranks.spearman(both, "a", "b", ["profile"]).select("profile", r("rho", 6).alias("rho"))


RESTARTS = {
    "s1": "select profile, node, x, rs as r from s0 cross join (select unnest([0.3::double, 0.5, 0.7]) as rs)",
    **{k: v.replace("0.5 * p * x", "(1 - r) * p * x").replace("0.5 * x from", "r * x from") for k, v in walk_sql("s1", 4, 0.5, by="profile, r, ").items()},
    "rr": "select profile, r, node, rank() over (partition by profile, r order by round(x, 12)) + (count(*) over (partition by profile, r, round(x, 12)) - 1) / 2.0::double as a, row_number() over (partition by profile, r order by round(x, 12) desc, node) as n from x4",
}


@query(
    sql(
        "select a.profile, a.r as restart, round(corr(a.a, b.a), 6) as rho, sum((greatest(a.n, b.n) <= 8)::int)::bigint as top_overlap from rr a join rr b using (profile, node) where b.r = 0.5 and a.r <> 0.5 group by all",
        "net0", **NET, **SEEDS, **RESTARTS,
    )
)
def restart_sensitivity(spark, d):
    """GR8, SE3: walks of other restart shares against that of 0.5, after four steps."""
    start = starts(spark, d).withColumn("r", F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7))))
    x = graph.walked(graph.transition(clean(spark, d)), start, F.col("r"), ["profile", "r"], steps=4).withColumn("x", F.round("x", 12))
    x = x.withColumn("n", ranks.first_rank("x", ["profile", "r"], "node"))
    one = x.where("r <> 0.5").withColumnRenamed("r", "restart")
    both = one.join(x.where("r = 0.5").select("profile", "node", F.col("x").alias("y"), F.col("n").alias("m")), ["profile", "node"])
    top = both.groupBy("profile", "restart").agg(F.sum((F.greatest("n", "m") <= 8).cast("long")).alias("top_overlap"))
    rho = ranks.spearman(both, "x", "y", ["profile", "restart"]).select("profile", "restart", r("rho", 6).alias("rho"))
    return rho.join(top, ["profile", "restart"])


# Walks on the graph of customers and suppliers, c and s, with an edge for each pair that trades, by quantity.
RESTARTS = (0.3, 0.5, 0.7)
TRADE = {
    "te": "select 'c' || o_custkey as u, 's' || l_suppkey as v, sum(l_quantity)::double as w from lineitem join orders on l_orderkey = o_orderkey group by all",
    "tr": "select src, dst, w / sum(w) over (partition by src) as p from (select u as src, v as dst, w from te union all select v, u, w from te)",
    "ts0": "select distinct c_mktsegment as profile, u as node from te join customer on u = 'c' || c_custkey",
    "ts": "select profile, node, 1.0::double / count(*) over (partition by profile) as x from ts0",
    "rr": f"select unnest([{', '.join(f'{x}::double' for x in RESTARTS)}]) as r",
    "wk": """select 0 as step, profile, r, node, x from ts cross join rr union all (
        with now as (select * from wk where step < 96)
        select step, profile, r, node, sum(x) as x from (select step + 1 as step, profile, r, dst as node, (1 - r) * p * x as x from now join tr on src = node
        union all select step + 1, profile, r, node, r * x from (select distinct step from now) cross join ts cross join rr) group by all)""",
    "fin": "select profile, r, node, round(x, 12) as x from wk where step = 96",
    "tp": "select *, row_number() over (partition by profile, r order by x desc, node) as k from fin",
}


def trade_walks(spark, d):
    """(profile, restart, node, x) of the converged walks of all segments' customers, and the nodes' number."""
    rows = S.table(spark, d, "lineitem").join(S.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    firms, people = (F.col("l_suppkey").cast("long") * 2 + 1).alias("v"), (F.col("o_custkey").cast("long") * 2).alias("u")  # numbers, as every step shuffles them
    e = rows.groupBy(people, firms).agg(F.sum("l_quantity").cast("double").alias("score"))
    p = graph.transition(Scratch(spark).write(e))
    people = S.table(spark, d, "customer").select(F.col("c_mktsegment").alias("profile"), (F.col("c_custkey").cast("long") * 2).alias("node"), F.lit(1.0).alias("weight"))
    own = Scratch(spark).write(graph.seeds(people, p.select(F.col("src").alias("node"))))
    profiles = nulls.names_of(own, "profile")
    walks = {f"x{i}_{j}": (name, x) for i, name in enumerate(profiles) for j, x in enumerate(RESTARTS)}
    start = own.groupBy("node").agg(*[F.sum(F.when(F.col("profile") == name, F.col("x"))).alias(f"s{i}") for i, name in enumerate(profiles)])
    found = graph.walked_together(p, start, {c: x for c, (_, x) in walks.items()}, seeds_of={c: f"s{profiles.index(name)}" for c, (name, _) in walks.items()})
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("profile"), F.lit(x).alias("restart"), F.round(c, 12).alias("x")) for c, (name, x) in walks.items()]))
    name = F.concat(F.when(F.col("node") % 2 == 0, "c").otherwise("s"), F.floor(F.col("node") / 2).cast("string"))
    return found.select(name.alias("node"), each.alias("w")).select("w.profile", "w.restart", "node", "w.x")


@query(
    sql(
        """select a.profile, a.r as restart, count(b.node)::double / (400 - count(b.node)) as jaccard, any_value(m.mass) as mass from (select * from tp where k <= 200 and r <> 0.5) a left join (select * from tp where k <= 200 and r = 0.5) b using (profile, node)
        join (select profile, r, round(sum(x), 9) as mass from fin group by all) m on m.profile = a.profile and m.r = a.r group by a.profile, a.r""",
        **TRADE,
    ).replace("with ", "with recursive ", 1).replace(" tr as (", " tr as materialized (").replace(" fin as (", " fin as materialized (").replace(" ts as (", " ts as materialized (")
)
def restart_stability(spark, d):
    """GR2, GR4, GR5, GR8: walks of all segments at three restarts on the graph of customers and suppliers, their mass, and how their 200 largest nodes agree with those at 0.5."""
    found = Scratch(spark).write(trade_walks(spark, d))
    best = Scratch(spark).write(ranks.top(found, "x", ["profile", "restart"], "node", 200).select("profile", "restart", "node"))
    middle = best.where("restart = 0.5").select("profile", "node", F.lit(1).alias("on"))
    rows = best.where("restart <> 0.5").join(middle, ["profile", "node"], "left").groupBy("profile", "restart").agg(F.count("on").alias("n"))
    mass = found.groupBy("profile", "restart").agg(r(F.sum("x"), 9).alias("mass"))
    return rows.join(mass, ["profile", "restart"]).select("profile", "restart", (F.col("n") / (400 - F.col("n"))).alias("jaccard"), "mass")


DAG = "select distinct 'c' || c_custkey as child, 'n' || c_nationkey as parent from customer union select 'n' || n_nationkey, 'r' || n_regionkey from nation union select 'r' || r_regionkey, 'world' from region"


def dag(spark, d):
    t = lambda name: S.table(spark, d, name)
    up = lambda df, a, b, p, q: df.select(F.concat(F.lit(p), a).alias("child"), F.concat(F.lit(q), b).alias("parent"))
    rows = up(t("customer"), "c_custkey", "c_nationkey", "c", "n").union(up(t("nation"), "n_nationkey", "n_regionkey", "n", "r"))
    return rows.union(t("region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("world"))).distinct()


CLOSURE = f"with recursive ed as ({DAG}), cl(node, ancestor) as (select child, child from ed union select parent, parent from ed union select cl.node, ed.parent from cl join ed on ed.child = cl.ancestor)"


@query(f"{CLOSURE} select node, ancestor from cl")
def ancestor_closure(spark, d):
    """GR11."""
    return graph.closure(dag(spark, d))


@query(
    f"{CLOSURE} select distinct o_orderpriority as feature, ancestor as term from orders join cl on node = 'c' || o_custkey where ancestor <> 'r0'"
)
def propagated(spark, d):
    """GR12, FIL21, JN6."""
    notes = S.table(spark, d, "orders").select(F.col("o_orderpriority").alias("feature"), F.concat(F.lit("c"), "o_custkey").alias("term")).distinct()
    up = graph.closure(dag(spark, d))
    return graph.propagated(notes, up, up.where("ancestor <> 'r0'").select(F.col("ancestor").alias("term")))


# Modules

MODS = {
    "obs": "select profile, module, sum(weight) as mass from feat join mem using (feature) group by all",
    "nul": "select rep, profile, module, sum(weight) as mass from perm join (select profile, feature as donor, weight from feat) using (donor) join mem using (feature) group by all",
    "mo": "select profile, module, avg(mass) as mu, stddev_samp(mass) as sd from nul group by all",
    "af": "select profile, module, mass, mu, sd, case when sd > 0 then (mass - mu) / sd else 0 end as a from obs join mo using (profile, module)",
    "po": "select *, greatest(a, 0) as pos from af",
    "dis": "select module, (p - min(p) over () + 1) / 100 as d from (select p_brand as module, avg(p_retailprice) as p from part group by all)",
    "pred": "select profile, module, d * pos as product, case when sum(d * pos) over (partition by profile) > 0 then d * pos / sum(d * pos) over (partition by profile) else 0 end as scaled from po join dis using (module)",
    "seen": "select c_mktsegment as profile, p_brand as module, avg(l_discount) as o from lineitem join part on p_partkey = l_partkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all",
}
MOD = {k: v for k, v in DRAW.items() if k not in ("obs", "nul")} | MODS


def affinities(spark, d):
    w, m = S.features(spark, d), S.members(spark, d)
    return Scratch(spark).write(modules.affinity(modules.masses(w, m, ["profile"]), null_masses(spark, d, w, m)))


def null_masses(spark, d, w, m):
    return Scratch(spark).write(nulls.mass_blocks(S.universe(spark, d), w, m, REPS, SEED))


def disease(spark, d):
    part = S.table(spark, d, "part").groupBy(F.col("p_brand").alias("module")).agg(F.avg("p_retailprice").alias("p"))
    return part.crossJoin(part.agg(F.min("p").alias("m"))).select("module", ((F.col("p") - F.col("m") + 1) / 100).alias("d"))


def seen(spark, d):
    items = S.table(spark, d, "lineitem").join(S.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = items.join(S.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(S.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("profile"), F.col("p_brand").alias("module")).agg(F.avg("l_discount").alias("o"))


@query("select p_brand as module, count(*) as n, count(*) > (select count(*) from part where p_size < 40) * 0.045::double as broad, count(*) >= 40 and not count(*) > (select count(*) from part where p_size < 40) * 0.045::double as eligible from part where p_size < 40 group by all")
def module_eligibility(spark, d):
    """FIL9, MD13."""
    part = S.table(spark, d, "part").where("p_size < 40").select(F.col("p_partkey").alias("feature"))
    return modules.eligibility(S.members(spark, d), part, 40, 0.045)


@query("with m as (select p_type as module, count(distinct p_partkey) as n from part join lineitem on l_partkey = p_partkey group by all) select module, n from m where n >= 2 and (select count(*) from m where n >= 2) >= 5")
def enough_modules(spark, d):
    """FIL10: eligible modules, types of at least two sold parts, of which at least five are needed to go on."""
    sold = S.table(spark, d, "lineitem").select(F.col("l_partkey").alias("feature")).distinct()
    types = S.table(spark, d, "part").select(F.col("p_partkey").alias("feature"), F.col("p_type").alias("module"))
    return modules.enough(modules.eligibility(types, sold, 2, 1.0), 5).where("eligible").select("module", "n")


@query(sql("select profile, module, round(mass, 9) as mass from obs", "feat", "mem", obs=MODS["obs"]))
def module_mass(spark, d):
    """MD1, AG16."""
    return modules.masses(S.features(spark, d), S.members(spark, d), ["profile"]).withColumn("mass", r("mass", 9))


@query(sql("select profile, module, round(mass, 9) as mass, round(mu, 9) as null_mean, round(sd, 9) as null_sd, round(a, 6) as affinity, round(pos, 6) as positive, not sd > 0 as flat from po", "feat", "mem", "uni", **{k: MOD[k] for k in MOD if k not in ("dis", "pred", "seen")}))
def module_affinity(spark, d):
    """MD2."""
    out = affinities(spark, d)
    return out.select("profile", "module", *[r(c, 9).alias(c) for c in ("mass", "null_mean", "null_sd")], r("affinity", 6).alias("affinity"), r("positive", 6).alias("positive"), "flat")


@query(sql("select profile, module, round(a - (sum(a) over (partition by module) - a) / 4, 6) as difference from af", "feat", "mem", "uni", **{k: MOD[k] for k in MOD if k not in ("po", "dis", "pred", "seen")}))
def module_difference(spark, d):
    """MD3."""
    return modules.differential(affinities(spark, d), ["module"]).select("profile", "module", r("difference", 6).alias("difference"))


@query(
    """with v as (select c_mktsegment as profile, l_partkey as feature, avg(l_extendedprice) as value from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all),
    k as (select profile, feature, (rank() over (partition by profile order by round(value, 6)) + (count(*) over (partition by profile, round(value, 6)) - 1) / 2.0::double) / (count(*) over (partition by profile) + 1) as pc from v),
    m as (select profile, p_brand as module, count(*) as n, avg(pc) as raw from k join part on p_partkey = feature group by all having count(*) >= 15)
    select profile, module, n, round(raw, 8) as raw, round(raw / sqrt(sum(raw * raw) over (partition by profile)), 8) as scaled from m"""
)
def percentile_modules(spark, d):
    """MD4, AG5, FIL10, WN8."""
    items = S.table(spark, d, "lineitem").join(S.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(S.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    v = items.groupBy(F.col("c_mktsegment").alias("profile"), F.col("l_partkey").alias("feature")).agg(F.round(F.avg("l_extendedprice"), 6).alias("value"))
    return modules.percentile_modules(v, S.members(spark, d), ["profile"]).withColumns({"raw": r("raw"), "scaled": r("scaled")})


@query(sql("select profile, round(sum(d * pos) / sqrt(sum(d * d) * sum(pos * pos)), 7) as compatibility from po join dis using (module) group by profile", "feat", "mem", "uni", **{k: MOD[k] for k in MOD if k not in ("pred", "seen")}))
def compatibility(spark, d):
    """MD5."""
    return modules.compatibility(disease(spark, d), affinities(spark, d)).withColumn("compatibility", r("compatibility", 7))


@query(sql("select profile, module, round(product, 7) as product, round(scaled, 6) as scaled from pred", "feat", "mem", "uni", **{k: MOD[k] for k in MOD if k != "seen"}))
def conditioned_modules(spark, d):
    """MD6."""
    return modules.conditioned(disease(spark, d), affinities(spark, d)).withColumns({"product": r("product", 7), "scaled": r("scaled", 6)})


RANKED = "select {k}, round(corr(a, b), 7) as rho from (select {k}, rank() over (partition by {k} order by x) + (count(*) over (partition by {k}, x) - 1) / 2.0::double as a, rank() over (partition by {k} order by o) + (count(*) over (partition by {k}, o) - 1) / 2.0::double as b from j) group by all"


@query(sql(RANKED.format(k="profile"), "feat", "mem", "uni", **MOD, j="select profile, module, round(scaled, 9) as x, round(o, 9) as o from pred join seen using (profile, module)"))
def predicted_correlation(spark, d):
    """MD7, MD8's statistic."""
    p = modules.conditioned(disease(spark, d), affinities(spark, d)).withColumn("scaled", F.round("scaled", 9))
    out = modules.predicted_correlation(p, seen(spark, d).withColumn("o", F.round("o", 9)), ["profile"])
    return out.select("profile", r("rho", 7).alias("rho"))


@query(
    sql(
        "select p as profile, round(max(rho) filter (p = q), 6) as own, round(avg(rho) filter (p <> q), 6) as others, round(max(rho) filter (p = q) - avg(rho) filter (p <> q), 6) as selectivity, 'TESTED' as status from rh group by p",
        "feat", "mem", "uni", **MOD, j="select a.profile as p, b.profile as q, round(scaled, 9) as x, round(o, 9) as o from pred a join seen b using (module)", rh=RANKED.replace("round(corr(a, b), 7)", "corr(a, b)").format(k="p, q"),
    )
)
def selectivity(spark, d):
    """MD9."""
    p = modules.conditioned(disease(spark, d), affinities(spark, d)).withColumn("scaled", F.round("scaled", 9))
    return modules.selectivity(p, seen(spark, d).withColumn("o", F.round("o", 9))).withColumns({c: r(c, 6) for c in ("own", "others", "selectivity")})


@query(sql("select module, round(avg(product / pos) filter (pos > 0), 7) as d from pred join po using (profile, module) group by module", "feat", "mem", "uni", **{k: MOD[k] for k in MOD if k != "seen"}))
def recovered_vector(spark, d):
    """MD10."""
    a = affinities(spark, d)
    return modules.recovered(modules.conditioned(disease(spark, d), a), a).withColumn("d", r("d", 7))


NULLS = {k: MOD[k] for k in MOD if k not in ("dis", "pred", "seen")}


@query(
    sql(
        """select profile, module, p_upper, round(least(1, min(p_upper * m / k) over (partition by profile order by k desc rows unbounded preceding)), 10) as q from (select *, row_number() over (partition by profile order by p_upper, module) as k, count(*) over (partition by profile) as m from
        (select profile, module, (sum((round(nul.mass, 10) >= round(obs.mass, 10))::int) + 1)::double / (count(*) + 1) as p_upper from nul join obs using (profile, module) group by all))""",
        "feat", "mem", "uni", **{k: NULLS[k] for k in NULLS if k not in ("mo", "af", "po")},
    )
)
def module_tests(spark, d):
    """MD2, MD3, ST1, ST3: every module's mass against its matched null, and q-values over a profile's modules."""
    w, m = S.features(spark, d), S.members(spark, d)
    own = modules.masses(w, m, ["profile"]).select("profile", "module", F.round("mass", 10).alias("observed"))
    null = null_masses(spark, d, w, m).select("profile", "module", F.round("mass", 10).alias("null"))
    tests = ranks.empirical(Scratch(spark).write(null.join(own, ["profile", "module"])), "observed", "null", ["profile", "module"])
    tests = Scratch(spark).write(tests.select("profile", "module", "p_upper"))
    return ranks.with_bh(tests, "p_upper", ["profile"]).select("profile", "module", "p_upper", r("q", 10).alias("q"))


ENDPOINT = {
    **MOD,
    "na": "select rep, profile, module, greatest(case when sd > 0 then (nul.mass - mu) / sd else 0 end, 0) as pos from nul join mo using (profile, module)",
    "np": "select rep, profile, module, d * pos as product, sum(d * pos) over (partition by rep, profile) as total from na join dis using (module)",
    "ob": "select profile, round(corr(a, b), 7) as rho from (select profile, rank() over (partition by profile order by x) + (count(*) over (partition by profile, x) - 1) / 2.0::double as a, rank() over (partition by profile order by o) + (count(*) over (partition by profile, o) - 1) / 2.0::double as b from (select profile, module, round(scaled, 9) as x, round(o, 9) as o from pred join seen using (profile, module))) group by all",
    "nr": "select rep, profile, total, round(corr(a, b), 7) as rho from (select rep, profile, total, rank() over (partition by rep, profile order by x) + (count(*) over (partition by rep, profile, x) - 1) / 2.0::double as a, rank() over (partition by rep, profile order by o) + (count(*) over (partition by rep, profile, o) - 1) / 2.0::double as b from (select rep, profile, total, round(case when total > 0 then product / total else 0 end, 9) as x, round(o, 9) as o from np join seen using (profile, module))) group by all",
    "pv": "select profile, ob.rho, (sum((case when total <= 0 then -1 else nr.rho end >= ob.rho)::int) + 1)::double / (count(*) + 1) as p from nr join ob using (profile) group by all",
}


@query(
    sql(
        "select profile, rho, p, round(least(1, max((m - k + 1) * p) over (order by k rows unbounded preceding)), 10) as holm from (select *, row_number() over (order by p, profile) as k, count(*) over () as m from pv)",
        "feat", "mem", "uni", **ENDPOINT,
    )
)
def first_endpoint(spark, d):
    """MD7, NM13, ST4: the predicted modules' correlation with the observed ones, its P by the structural null, a null without mass below all others, and Holm over the profiles."""
    w, m = S.features(spark, d), S.members(spark, d)
    null = null_masses(spark, d, w, m)
    a = Scratch(spark).write(modules.affinity(modules.masses(w, m, ["profile"]), null))
    sick, o = disease(spark, d), Scratch(spark).write(seen(spark, d).withColumn("o", F.round("o", 9)))
    rounded = lambda x: x.withColumn("scaled", F.round("scaled", 9))
    own = modules.predicted_correlation(rounded(modules.conditioned(sick, a)), o, ["profile"]).select("profile", F.round("rho", 7).alias("observed"))
    p = modules.conditioned(sick, modules.null_affinity(null, a), ["rep", "profile"])
    mass = p.groupBy("rep", "profile").agg(F.sum("product").alias("mass"))
    rho = modules.predicted_correlation(rounded(p), o, ["rep", "profile"]).join(mass, ["rep", "profile"])
    rho = rho.select("profile", nulls.guarded(F.col("mass"), F.round("rho", 7)).alias("null"))
    tests = ranks.empirical(Scratch(spark).write(rho.join(own, "profile")), "observed", "null", ["profile"])
    tests = Scratch(spark).write(tests.select("profile", F.col("observed").alias("rho"), F.col("p_upper").alias("p")))
    return ranks.with_holm(tests, "p", []).select("profile", "rho", "p", r("holm", 10).alias("holm"))


SECOND = {
    **MOD,
    "v": "select c_mktsegment as profile, o_custkey as k, c_nationkey < 12 as case_, l_partkey as feature, avg(l_extendedprice) as value from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all",
    "subj": "select profile, k, dense_rank() over (order by profile) - 1 as g, row_number() over (partition by profile order by k) - 1 as n, count(*) over (partition by profile) as size from (select distinct profile, k from v)",
    "hits": f"select rep, profile, {chained_sql(str(SEED), 'rep', 'g', 'n')} % size as n from subj cross join reps where rep < {BOOTS}",
    "tm": "select rep, profile, k, count(*) as times from hits join subj using (profile, n) group by all",
    "ef": "select rep, profile, feature, round(sum(times * value) filter (case_) / sum(times) filter (case_) - sum(times * value) filter (not case_) / sum(times) filter (not case_), 6) as value from tm join v using (profile, k) group by all having sum(times) filter (case_) >= 2 and sum(times) filter (not case_) >= 2",
    "pc": "select rep, profile, feature, (rank() over (partition by rep, profile order by value) + (count(*) over (partition by rep, profile, value) - 1) / 2.0::double) / (count(*) over (partition by rep, profile) + 1) as pc from ef",
    "bm": "select rep, profile, module, avg(pc) as raw from pc join mem using (feature) group by all having count(*) >= 2",
    "sc": "select rep, profile, module, round(raw / sqrt(sum(raw * raw) over (partition by rep, profile)), 9) as o from bm",
    "jx": "select rep, profile, module, o, round(scaled, 9) as x, round(pos, 9) as y from sc join pred using (profile, module) join po using (profile, module)",
    "rk": "select rep, profile, " + ", ".join(f"rank() over (partition by rep, profile order by {c}) + (count(*) over (partition by rep, profile, {c}) - 1) / 2.0::double as r{c}" for c in "oxy") + " from jx",
    "di": "select rep, profile, round(corr(rx, ro) - corr(ry, ro), 7) as difference from rk group by rep, profile",
}


@query(
    sql(
        "select profile, count(*) as n, round(quantile_cont(difference, 0.025), 6) as low, round(quantile_cont(difference, 0.5), 6) as middle, round(quantile_cont(difference, 0.975), 6) as high, quantile_cont(difference, 0.025) > 0 as supported from di group by profile",
        "feat", "mem", "uni", **SECOND,
    )
)
def second_endpoint(spark, d):
    """ST22, MD8: how much better the conditioned prediction fits than the affinities alone, with an interval from resampled subjects."""
    rows = S.table(spark, d, "lineitem").join(S.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(S.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    keys = [F.col("c_mktsegment").alias("profile"), F.col("o_custkey").alias("subject"), (F.col("c_nationkey") < 12).alias("case_"), F.col("l_partkey").alias("feature")]
    rows = rows.select(*keys, "l_extendedprice").repartition(S.tasks(S.table(spark, d, "lineitem")), "subject", "feature")
    values = Scratch(spark).write(rows.groupBy("profile", "subject", "case_", "feature").agg(F.avg("l_extendedprice").alias("value")))
    a = affinities(spark, d)
    first = modules.conditioned(disease(spark, d), a).select("profile", "module", F.round("scaled", 9).alias("scaled"))
    second = a.select("profile", "module", F.round("positive", 9).alias("scaled"))
    out = modules.bootstrap_difference(values, "case_", S.members(spark, d), first, second, BOOTS, SEED, 2).withColumn("difference", r("difference", 7))
    q = out.groupBy("profile").agg(F.count("*").alias("n"), F.percentile("difference", F.array(*map(F.lit, (0.025, 0.5, 0.975)))).alias("q"))
    return q.select("profile", "n", *[r(F.col("q")[i], 6).alias(n) for i, n in enumerate(("low", "middle", "high"))], (F.col("q")[0] > 0).alias("supported"))


# Rewiring

CHAINS, DRAWS, BURN, THIN = 4, 50, 8, 3
#: Graphs of all rounds of the chains, replayed; of up to rewire.MOST edges, so each chain is one bucket.
GRAPHS = {
    "steps": f"""select 0::bigint as step, chain, "left", "right" from edges cross join (select unnest(range({CHAINS}))::bigint as chain) union all (
        with now as (select chain, step + 1 as step, {chained_sql(str(SEED), 'chain', 'step + 1')} as h, "left", "right" from steps where step < {BURN + (DRAWS - 1) * THIN}),
        keyed as (select chain, "left", {mixed_sql('h', '"left"')} as key from (select distinct chain, h, "left" from now)),
        placed as (select *, row_number() over (partition by chain order by key, "left") - 1 as k from keyed),
        paired as (select chain, "left", k // 2 as pair, k % 2 as side, first_value("left") over w as a, last_value("left") over w as b, first_value(key) over w as ka from placed window w as (partition by chain, k // 2 order by k rows between unbounded preceding and unbounded following)),
        met as (select now.chain, step, pair, "right", count(*) as n, min(side) as side, any_value(a) as a, any_value(b) as b, any_value(ka) as ka from now join paired using (chain, "left") group by now.chain, step, pair, "right"),
        told as (select *, row_number() over (partition by chain, pair, n order by {mixed_sql('ka', '"right"')}, "right") as place, sum((side = 0)::int) over (partition by chain, pair, n) as own from met)
        select step, chain, unnest(case when n = 2 then [a, b] when place <= own then [a] else [b] end), "right" from told)""",
    "gr": f'select chain, (step - {BURN}) // {THIN} as draw, "left", "right" from steps where step >= {BURN} and (step - {BURN}) % {THIN} = 0',
}


def replayed(body: str, *names: str, **more: str) -> str:
    """sql() with the recursion of GRAPHS; what metrics are read from is computed once."""
    return sql(body, *names, **GRAPHS, **more).replace("with ", "with recursive ", 1).replace(" ga as (", " ga as materialized (")


METRIC = {
    "pa": 'select profile, "left", weight / degree as part from w join deg using ("left")',
    "gx": 'select chain, draw, profile, "right", sum(part) * any_value(idf) as x from (select * from gr union all select -1, -1, "left", "right" from edges) join pa using ("left") join rs using ("right") group by chain, draw, profile, "right"',
    "gp": 'select *, x / sum(x) over (partition by chain, draw, profile) as p from gx',
    "gm": 'select chain, draw, profile, module, sum(p) as p from gp join mem on feature = "right" group by all',
    "ga": "select chain, draw, 'feature' as layer, round(sum(h - case when s > 0 then s * log2(s / 5) else 0 end) / 5, 10) as gjsd from (select chain, draw, \"right\", sum(p) as s, sum(case when p > 0 then p * log2(p) else 0 end) as h from gp group by all) group by all union all select chain, draw, 'module', round(sum(h - case when s > 0 then s * log2(s / 5) else 0 end) / 5, 10) from (select chain, draw, module, sum(p) as s, sum(case when p > 0 then p * log2(p) else 0 end) as h from gm group by all) group by all",
}


def with_metrics(spark, d):
    """The draws' layers (chain, draw, layer, gjsd), and a function for those of the observed graph, which have chain -1."""
    e, w, scratch = S.edges(spark, d), S.weights(spark, d), Scratch(spark)
    members = S.members(spark, d).withColumnRenamed("feature", "right")
    layered = rewire.layered(w, e, members)
    metric = lambda layers: layers.select("chain", "draw", "layer", F.round("gjsd", 10).alias("gjsd"))
    observed = rewire.as_rows(e).select(F.lit(-1).alias("chain"), F.lit(-1).alias("draw"), "left", "rights")
    return metric(rewire.summarised(e, CHAINS, DRAWS, BURN, THIN, SEED, layered)), lambda: scratch.write(metric(layered(observed, scratch)))


GAP = 'select chain, draw, max(abs(d - e)) as {side}_gap from (select chain, draw, "{side}", count(*) as d from gr group by all) join (select "{side}", count(*) as e from edges group by all) using ("{side}") group by all'


@query(
    replayed(
        'select chain, draw, n_edges, left_gap, right_gap, changed from (select chain, draw, count(*) as n_edges, round(avg(case when x is null then 1 else 0 end), 8) as changed from gr left join (select "left", "right", 1 as x from edges) using ("left", "right") group by all) join lg using (chain, draw) join rg using (chain, draw)',
        "edges", lg=GAP.format(side="left"), rg=GAP.format(side="right"),
    ).replace(" gr as (", " gr as materialized (")
)
def rewired_degrees(spark, d):
    """NM1, NM2, GR14: every kept graph has the observed degrees, and other edges."""
    e = S.edges(spark, d)
    out = rewire.summarised(e, CHAINS, DRAWS, BURN, THIN, SEED, rewire.kept_figures(e))
    return out.withColumnRenamed("share", "changed").withColumn("changed", r("changed"))


TOPOLOGY = """select n.layer, count(*) as n_null, any_value(o.gjsd) as observed, round(avg(n.gjsd), 9) as null_mean, round(stddev_samp(n.gjsd), 9) as null_sd, round((any_value(o.gjsd) - avg(n.gjsd)) / stddev_samp(n.gjsd), 4) as z,
    (sum((n.gjsd >= o.gjsd)::int) + 1)::double / (count(*) + 1) as p_upper, (sum((n.gjsd <= o.gjsd)::int) + 1)::double / (count(*) + 1) as p_lower from ga n join ga o on o.chain = -1 and o.layer = n.layer where n.chain >= 0 group by n.layer"""


@query(replayed(TOPOLOGY, "w", "deg", "rs", "mem", **METRIC))
def topology_null(spark, d):
    """GR13, NM2, ST13, ST1, MD12: the divergence of profiles recomputed from rewired graphs, at two layers, against the observed graph's."""
    draws, own = with_metrics(spark, d)
    rows = draws.withColumnRenamed("gjsd", "null").join(own().select("layer", F.col("gjsd").alias("observed")), "layer")
    out = ranks.empirical(rows, "observed", "null", ["layer"])
    return out.select("layer", "n_null", "observed", r("null_mean", 9).alias("null_mean"), r("null_sd", 9).alias("null_sd"), r("z", 4).alias("z"), "p_upper", "p_lower")


LAGS = "select chain, {} from (select chain, gjsd, {} from ga where chain >= 0 and layer = 'feature' window w as (partition by chain order by draw)) group by chain".format(
    ", ".join(f"round(corr(gjsd, y{k}), 6) as lag{k}" for k in (1, 5, 10)), ", ".join(f"lag(gjsd, {k}) over w as y{k}" for k in (1, 5, 10))
)


@query(
    replayed(
        """select chain, lag1, lag5, lag10, r_hat, abs(lag1) <= 0.10 and r_hat <= 1.01 as mixed, case when abs(lag1) <= 0.10 and r_hat <= 1.01 then 'MIXED' when r_hat <= 1.01 then 'SLOW' else 'STUCK' end as verdict from lags
        cross join (select round(sqrt((n - 1) / n + between_ / within_), 6) as r_hat from (select avg(v) as within_, var_samp(m) as between_, avg(n) as n from (select chain, avg(gjsd) as m, var_samp(gjsd) as v, count(*) as n from ga where chain >= 0 and layer = 'feature' group by all)))""",
        "w", "deg", "rs", "mem", **METRIC, lags=LAGS,
    )
)
def chain_mixing(spark, d):
    """ST20, ST21, WN6, ST25: of the null divergences, over the chains, by the limits 0.10 and 1.01."""
    out = rewire.mixing(with_metrics(spark, d)[0].where("layer = 'feature'"), "gjsd")
    rules = [("MIXED", F.col("mixed")), ("SLOW", F.col("r_hat") <= 1.01)]
    return rewire.verdict(out, rules, "STUCK").select("chain", *[r(c, 6).alias(c) for c in ("lag1", "lag5", "lag10", "r_hat")], "mixed", "verdict")


@query(sql("select count(*) as n, 0::bigint as n_one_sided, 0::bigint as n_masks, 0.0::double as max_gap, true as agree from nul where rep < 99", "feat", "z", "uni", **{k: v for k, v in DRAW.items() if k != "obs"}))
def null_replay(spark, d):
    """NM11: a null drawn anew over rows, from other partitions of its inputs, reproduces the one of blocks within 1e-10."""
    w, z, u = S.features(spark, d), S.scores(spark, d), S.universe(spark, d)
    blocks = nulls.alignment_blocks(u.repartition(3), w.repartition(3), z, 99, SEED).select("rep", "profile", "alignment")
    rows = nulls.alignment_null(w.repartition(5), z, nulls.permutations(u.repartition(5), 99, SEED)).select("rep", "profile", "alignment")
    return mapping.compared(Scratch(spark).write(blocks), rows, ["rep", "profile"], "alignment", 1e-10).withColumn("max_gap", r("max_gap", 10))


@query("select user_id, lag, round(corr(value, y), 7) as autocorrelation from (select user_id, k as lag, value, case k when 1 then lag(value, 1) over w when 5 then lag(value, 5) over w else lag(value, 10) over w end as y from events cross join (select unnest([1, 5, 10]) as k) window w as (partition by user_id, k order by event_id)) where y is not null group by all")
def lag_correlation(spark, d):
    """WN6."""
    out = ranks.lag_correlation(S.table(spark, d, "events"), "value", ["user_id"], "event_id")
    return out.withColumn("autocorrelation", r("autocorrelation", 7))
