"""Queries of evidence, projection, similarity and divergence."""

from __future__ import annotations

from pyspark.sql import functions as F

from kalibra.functions.ranks import average_rank, min_rank, spearman, spearman_p, to_sum_one, top
from kalibra.functions.special import student_p_sql
from kalibra.operators import divergence, evidence, mapping, projection
from kalibra.plans import stand_ins as S
from kalibra.plans.stand_ins import r, sql
from kalibra.storage import Scratch

QUERIES, ORACLES = {}, {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLES[f.__name__] = text
        return f

    return add


def named(df):
    return df.withColumnsRenamed({"left": "left_node", "right": "right_node"})


def profiles(spark, d, weights=None):
    return projection.project(weights or S.weights(spark, d), S.edges(spark, d))


@query(
    sql(
        'select profile, "right" as right_node, binary_union, round(weighted_raw, 8) as weighted_raw, round(degree_normalised, 10) as degree_normalised, round(ubiquity_corrected, 10) as ubiquity_corrected, contributing, round(sum1, 10) as sum1 from prof',
        "prof",
    )
)
def projection_(spark, d):
    """PR1, AG2, SC8, PR7-PR11, JN1-JN4, WN4."""
    out = named(profiles(spark, d))
    return out.withColumns({"weighted_raw": r("weighted_raw"), **{c: r(c, 10) for c in ("degree_normalised", "ubiquity_corrected", "sum1")}})


QUERIES["projection"] = QUERIES.pop("projection_")
ORACLES["projection"] = ORACLES.pop("projection_")


@query(sql('select profile, "left" as left_node, support, articles, round(weight, 10) as weight from w', "w"))
def support_weights(spark, d):
    """PR1, AG3."""
    return named(S.weights(spark, d)).withColumn("weight", r("weight", 10))


@query(
    sql(
        'select profile, "left" as left_node, m as support, big_m as articles, round((m + 0.5::double) / (big_m + 0.5::double), 10) as weight from (select profile, "left", count(distinct article) as m from ev group by all) join (select profile, count(distinct article) as big_m from ev group by all) using (profile)',
        "ev",
    )
)
def support_weights_early(spark, d):
    """PR3: the other smoothing."""
    return named(evidence.support_weights(S.evidence(spark, d), 0.5)).withColumn("weight", r("weight", 10))


LEAVE_OUT = """select profile, "left", m as support, big_m as articles, (m + 0.5::double) / (big_m + 1) as weight from (select profile, "left", count(distinct article) as m from ev2 group by all) join (select profile, count(distinct article) as big_m from ev2 group by all) using (profile)"""


CLASSES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")


def left_out(spark, d):
    """Of parts as left nodes, the weights by all articles and by those of no class of CLASSES."""
    own = Scratch(spark).write(S.evidence(spark, d, "l_partkey"))
    kept = evidence.without_articles(own, own.where(F.col("priority").isin(*CLASSES)).select("article"))
    return evidence.support_weights(own), evidence.support_weights(kept)


EV2 = {"ev2": f"select * from evp where priority not in {CLASSES}"}


@query(sql('select profile, "left" as left_node, support, articles, round(weight, 10) as weight from w2', "evp", **EV2, w2=LEAVE_OUT))
def leave_class_out(spark, d):
    """PR4, JN6."""
    return named(left_out(spark, d)[1]).withColumn("weight", r("weight", 10))


@query(
    sql(
        'select f.profile, f."left" as left_node, f.m as full_support, a.articles, round(0.5::double / (a.articles + 1), 10) as weight from (select profile, "left", count(distinct article) as m from evp group by all) f join (select distinct profile, articles from w2) a using (profile) where not exists (select 1 from w2 where w2.profile = f.profile and w2."left" = f."left")',
        "evp",
        **EV2,
        w2=LEAVE_OUT,
    )
)
def losing_support(spark, d):
    """PR5."""
    return named(evidence.losing_support(*left_out(spark, d))).withColumn("weight", r("weight", 10))


@query(
    sql(
        'select f.profile, count(*) as n_full, count(w2.weight) as n_kept, count(*) - count(w2.weight) as n_lost from (select distinct profile, "left" from evp) f left join w2 on w2.profile = f.profile and w2."left" = f."left" group by all',
        "evp",
        **EV2,
        w2=LEAVE_OUT,
    )
)
def representation_stability(spark, d):
    """ST23."""
    return evidence.stability(*left_out(spark, d))


@query(sql('select "left" as left_node, degree from deg', "deg"))
def left_degree(spark, d):
    """AG2."""
    return named(projection.left_degrees(S.edges(spark, d)))


@query(sql('select "right" as right_node, n, round(idf, 10) as idf from rs', "rs"))
def right_ubiquity(spark, d):
    """AG2, SC8."""
    return named(projection.right_stats(S.edges(spark, d)).select("right", "n", r("idf", 10).alias("idf")))


@query(
    sql(
        'select profile, "left" as left_node, round(weight, 8) as weight, round(sum(weight / degree), 8) as projected, round(abs(weight - sum(weight / degree)), 8) as gap from w join deg using ("left") join edges using ("left") group by profile, "left", weight',
        "w", "deg", "edges",
    )
)
def mass_check(spark, d):
    """PR12."""
    out = projection.mass_check(S.weights(spark, d), S.edges(spark, d))
    return named(out).withColumns({c: r(c) for c in ("weight", "projected", "gap")})


@query(
    sql(
        'select profile, count(*) as n, count(k) as n_mapped, round(sum(weight), 8) as mass, round(coalesce(sum(weight) filter (k is not null), 0), 8) as mass_mapped, round(count(k)::double / count(*), 8) as share, round(coalesce(sum(weight) filter (k is not null), 0) / sum(weight), 8) as mass_share, count(k) >= 5 and coalesce(sum(weight) filter (k is not null), 0) / sum(weight) >= 0.7 as eligible from w left join (select distinct "left", 1 as k from rich) using ("left") group by profile',
        "w", "rich",
    )
)
def mapping_coverage(spark, d):
    """AG13, PR6, PR21."""
    out = projection.prior_eligible(projection.coverage(S.weights(spark, d), S.rich(spark, d)))
    return out.withColumns({c: r(c) for c in ("mass", "mass_mapped", "share", "mass_share")})


@query(sql('select profile, "left" as left_node, round(weight, 8) as weight from w where "left" not in (select "left" from rich)', "w", "rich"))
def unmapped_nodes(spark, d):
    """JN6, SO1."""
    return named(projection.unmapped(S.weights(spark, d), S.rich(spark, d))).withColumn("weight", r("weight"))


SPLIT = """select 'shared' as component, "left", min(low) as weight from low group by "left" union all select 'specific:' || profile, "left", weight - low from low"""
LOW = 'select profile, "left", weight, case when count(*) over (partition by "left") = (select count(distinct profile) from w) then min(weight) over (partition by "left") else 0 end as low from w'


@query(sql('select component, "left" as left_node, round(weight, 10) as weight from s', "w", low=LOW, s=SPLIT))
def shared_specific(spark, d):
    """PR13, AG6, AG12."""
    return named(projection.shared_and_specific(S.weights(spark, d))).withColumn("weight", r("weight", 10))


@query(
    sql(
        'select component, "right" as right_node, round(sum(s.weight / degree) * any_value(idf), 10) as score from s join deg using ("left") join edges using ("left") join rs using ("right") group by component, "right"',
        "w", "deg", "rs", low=LOW, s=SPLIT,
    )
)
def component_projection(spark, d):
    """PR14."""
    parts = projection.shared_and_specific(S.weights(spark, d)).withColumnRenamed("component", "profile")
    out = projection.project(parts, S.edges(spark, d)).where("contributing > 0")
    return out.select(F.col("profile").alias("component"), F.col("right").alias("right_node"), r("ubiquity_corrected", 10).alias("score"))


@query(sql("select distinct profile, 0.0::double as max_gap, true as holds from w", "w"))
def linear_identity(spark, d):
    """PR15, JN14: the parts add up to the whole."""
    out = projection.linear_identity(S.weights(spark, d), S.edges(spark, d))
    return out.select("profile", r("max_gap", 10).alias("max_gap"), (F.col("max_gap") <= 1e-10).alias("holds"))


PAIR = {
    "rk": 'select profile, "right", sum1, rank() over (partition by profile order by sum1) + (count(*) over (partition by profile, sum1) - 1) / 2.0::double as ar, row_number() over (partition by profile order by sum1 desc, "right") as rn from (select profile, "right", round(sum1, 12) as sum1 from prof)',
    "pr": 'select a.profile as first, b.profile as second, a."right", a.sum1 as a, b.sum1 as b, a.ar as ra, b.ar as rb, a.rn as na, b.rn as nb from rk a join rk b using ("right") where a.profile < b.profile',
}


def rounded(spark, d):
    return profiles(spark, d).withColumn("sum1", F.round("sum1", 12))


@query(
    sql(
        "select first, second, round(corr(ra, rb), 6) as spearman, round(corr(a, b), 6) as pearson, round(sum((a > 0 and b > 0)::int)::double / sum((a > 0 or b > 0)::int), 8) as jaccard from pr group by all",
        "prof", **PAIR,
    )
)
def profile_similarity(spark, d):
    """PR17, ST6, ST7, SE2, WN3."""
    out = projection.similarity(rounded(spark, d), "sum1")
    return out.withColumns({"spearman": r("spearman", 6), "pearson": r("pearson", 6), "jaccard": r("jaccard")})


@query(
    sql(
        "select first, second, k, sum((greatest(na, nb) <= k)::int)::bigint as overlap, round(sum((greatest(na, nb) <= k)::int)::double / (2 * k - sum((greatest(na, nb) <= k)::int)), 8) as jaccard from pr cross join (select unnest([20, 50, 100, 200]) as k) group by first, second, k",
        "prof", **PAIR,
    )
)
def top_overlap(spark, d):
    """SE3, SO2."""
    return projection.top_overlap(rounded(spark, d), "sum1").withColumn("jaccard", r("jaccard"))


@query(sql('select profile, "right" as right_node, rn as rank, rank() over (partition by profile order by sum1 desc) as tied_rank from rk qualify rn <= 100', "prof", **PAIR))
def top_features(spark, d):
    """PR22, WN1, WN2, WN7."""
    out = top(rounded(spark, d), "sum1", ["profile"], "right", 100)  # all that are larger than one of them are among them
    out = out.withColumn("tied_rank", min_rank("sum1", ["profile"]).cast("long"))
    return out.select("profile", F.col("right").alias("right_node"), F.col("rank").cast("long").alias("rank"), "tied_rank")


@query(sql("select profile, count(*) as n, sum((sum1 > 0)::int)::bigint as n_positive, round(sum(sum1), 8) as total, round(max(sum1), 10) as largest from prof group by all", "prof"))
def profile_summary(spark, d):
    """AG19, AG1."""
    return projection.summary(profiles(spark, d), "sum1").withColumns({"total": r("total"), "largest": r("largest", 10)})


@query(
    sql(
        'select profile, "right" as right_node, round(raw / sum(raw) over (partition by profile), 10) as weight from (select profile, "right", sum(weight) as raw from w join edges using ("left") group by all)',
        "w", "edges",
    )
)
def plain_prior(spark, d):
    """PR19."""
    return named(projection.prior(S.weights(spark, d), S.edges(spark, d))).withColumn("weight", r("weight", 10))


@query(
    sql(
        "select round((select sum(case when sum1 > 0 then sum1 * log2(sum1 / m) else 0 end) / 5 from (select *, avg(sum1) over (partition by \"right\") as m from prof)), 8) as gjsd, round((select sum(lo) from (select min(sum1) as lo from prof group by \"right\")), 8) as common_mass",
        "prof",
    )
)
def divergence_of_profiles(spark, d):
    """ST13, ST18, ST19."""
    return divergence.gjsd(profiles(spark, d), "sum1").select(r("gjsd").alias("gjsd"), r("common_mass").alias("common_mass"))


@query(
    sql(
        "select first, second, round(sum(case when a > 0 then a * log2(2 * a / (a + b)) else 0 end + case when b > 0 then b * log2(2 * b / (a + b)) else 0 end) / 2, 8) as jsd, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 8) as cosine from pr group by all",
        "prof", **PAIR,
    )
)
def pairwise_divergence(spark, d):
    """ST14, ST15, JN10."""
    return divergence.pairwise(rounded(spark, d), "sum1").withColumns({"jsd": r("jsd"), "cosine": r("cosine")})


@query(
    sql(
        "select first, second, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 8) as cosine, count(*) as n_common from pr where a > 0 and b > 0 group by all",
        "prof", **PAIR,
    )
)
def common_cosine(spark, d):
    """ST16."""
    return divergence.common_key_cosine(rounded(spark, d), "sum1").withColumn("cosine", r("cosine"))


@query(sql("select profile, round(-sum(case when sum1 > 0 then sum1 * log2(sum1) else 0 end), 8) as entropy from prof group by all", "prof"))
def profile_entropy(spark, d):
    """ST17."""
    return divergence.entropy(profiles(spark, d), "sum1").withColumn("entropy", r("entropy"))


LAYERS = """select 'left' as layer, round(sum(case when p > 0 then p * log2(p / m) else 0 end) / 5, 8) as gjsd from (select profile, "left", weight / sum(weight) over (partition by profile) as p, sum(weight / t) over (partition by "left") / 5 as m from (select *, sum(weight) over (partition by profile) as t from w))
        union all select 'feature', round(sum(case when sum1 > 0 then sum1 * log2(sum1 / m) else 0 end) / 5, 8) from (select *, avg(sum1) over (partition by "right") as m from prof)
        union all select 'module', round(sum(case when q > 0 then q * log2(q / m) else 0 end) / 5, 8) from (select *, avg(q) over (partition by module) as m from (select profile, module, sum(sum1) as q from prof join mem on feature = "right" group by all))"""


@query(sql(LAYERS, "prof", "mem"))
def cross_layer(spark, d):
    """MD12's layers, ST13, MD1, WN4."""
    own = S.weights(spark, d)
    left = to_sum_one(own.select("profile", F.col("left").alias("right"), "weight"), "weight", ["profile"], "p")
    feature = Scratch(spark).write(profiles(spark, d, own).select("profile", "right", F.col("sum1").alias("p")))
    module = feature.join(S.members(spark, d).withColumnRenamed("feature", "right"), "right").groupBy("profile", "module").agg(F.sum("p").alias("p")).withColumnRenamed("module", "right")
    out = None
    for name, rows in (("left", left), ("feature", feature), ("module", module)):
        one = divergence.gjsd(rows, "p").select(F.lit(name).alias("layer"), r("gjsd").alias("gjsd"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""with k as (select c_mktsegment as profile, rank() over (partition by c_mktsegment order by c_acctbal) + (count(*) over (partition by c_mktsegment, c_acctbal) - 1) / 2.0::double as ra, rank() over (partition by c_mktsegment order by c_nationkey) + (count(*) over (partition by c_mktsegment, c_nationkey) - 1) / 2.0::double as rb from customer),
    c as (select profile, count(*) as n, round(corr(ra, rb), 8) as rho from k group by profile), s as (select profile, n, rho, rho * sqrt((n - 2) / (1 - rho * rho)) as t, (n - 2)::double as df from c)
    select profile, n, rho, round({student_p_sql('t', 'df', 'duckdb')}, 9) as p from s"""
)
def grouped_spearman(spark, d):
    """ST6, ST9, WN3: rho and its P by Student's t."""
    out = spearman(S.table(spark, d, "customer"), "c_acctbal", "c_nationkey", ["c_mktsegment"], wide=True)
    return spearman_p(out.withColumn("rho", r("rho"))).select(F.col("c_mktsegment").alias("profile"), "n", "rho", r("p", 9).alias("p"))


@query(
    "select p_partkey as part, rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2.0::double as average, rank() over (partition by p_brand order by p_size desc) as least from part"
)
def ranks_within(spark, d):
    """WN1, WN3."""
    part = S.table(spark, d, "part")
    return part.select(F.col("p_partkey").alias("part"), average_rank("p_size", ["p_brand"]).alias("average"), min_rank("p_size", ["p_brand"]).cast("long").alias("least"))


@query(
    "select p_name as name, coalesce(x.k, b.k) as mapped, case when x.k is not null then 'exact' when b.k is not null then 'first_word' else 'unresolved' end as method from (select distinct p_name from part) left join (select p_name as n, min(p_partkey) as k from part where p_size < 3 group by all) x on x.n = p_name left join (select split_part(p_name, ' ', 1) as n, min(p_partkey) as k from part where p_size = 9 and p_retailprice < 1000 group by all) b on b.n = split_part(p_name, ' ', 1)"
)
def priority_lookup(spark, d):
    """JN7, JN11, SC2, SC6."""
    part = S.table(spark, d, "part")
    names = part.select(F.col("p_name").alias("name")).distinct()
    exact = part.where("p_size < 3").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("mapped"))
    first = part.where("p_size = 9 and p_retailprice < 1000").groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w")).agg(F.min("p_partkey").alias("mapped"))
    by_word = names.join(first, F.split_part("name", F.lit(" "), F.lit(1)) == F.col("w")).select("name", "mapped")
    return mapping.resolve(names, "name", [("exact", exact), ("first_word", by_word)])


@query(
    "select p_name || ' ' || p_size as name, min(p_brand) as brand from part group by all having count(distinct p_brand) = 1"
)
def unique_names(spark, d):
    """JN12, JN13."""
    part = S.table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_size").alias("name"), F.col("p_brand").alias("brand"))
    return mapping.unique_mapping(part, "name", "brand")


@query(
    "select p_name || ' ' || p_size as name, count(distinct p_brand) as n, string_agg(distinct p_brand, '|' order by p_brand) as candidates from part group by all having count(distinct p_brand) > 1"
)
def ambiguous_names(spark, d):
    """JN12, SC7."""
    part = S.table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_size").alias("name"), F.col("p_brand").alias("brand"))
    return mapping.ambiguous(part, "name", "brand")


@query("select p_brand as brand, p_partkey as part, p_retailprice as price from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) = 1")
def best_per_key(spark, d):
    """SO4, SO5."""
    part = S.table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("price"))
    return mapping.keep_best(part, ["brand"], F.desc("price"), "part")


@query(
    "select count(*) as n, count(*) filter (a is null or b is null) as n_one_sided, 0::bigint as n_masks, 0.0::double as max_gap, count(*) filter (a is null or b is null) = 0 as agree from (select distinct l_partkey as a from lineitem where l_linestatus = 'O') full join (select distinct l_partkey as b from lineitem where l_linestatus = 'F') on a = b"
)
def cross_check(spark, d):
    """JN14, SE4."""
    items = S.table(spark, d, "lineitem")
    part = lambda s: items.where(F.col("l_linestatus") == s).select(F.col("l_partkey").alias("k"), F.lit(1.0).alias("x")).distinct()
    return mapping.compared(part("O"), part("F"), ["k"], "x", 1e-10)


@query(
    sql(
        "select n as name, count(distinct \"right\") as n_edges, min(\"right\") as first_right from (select distinct p_name as n, m from part join (select l_partkey, min(l_suppkey) as m from lineitem group by all) on l_partkey = p_partkey) join edges on \"left\" = m group by n",
        "edges",
    )
)
def inherited_edges(spark, d):
    """PR18: names take over the edges of the nodes that they are mapped to, their parts' first suppliers."""
    first = S.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("mapped"))
    names = S.table(spark, d, "part").join(first, "p_partkey").select(F.col("p_name").alias("name"), "mapped").distinct()
    out = projection.inherited_edges(names, S.edges(spark, d)).groupBy(F.col("left").alias("name"))
    return out.agg(F.count("*").alias("n_edges"), F.min("right").alias("first_right"))


@query(
    sql(
        "select count(*) as n, 0::bigint as n_one_sided, 0::bigint as n_masks, 0.0::double as max_gap, true as agree from prof where contributing > 0",
        "prof",
    )
)
def replay_check(spark, d):
    """PR16, MD11, SC13: profiles rebuilt edge by edge agree with the projection."""
    w, e = S.weights(spark, d), S.edges(spark, d)
    again = projection.contributions(w, e).groupBy("profile", "right").agg(F.sum("corrected").alias("x"))
    again = to_sum_one(Scratch(spark).write(again), "x", ["profile"], "y").select("profile", "right", F.col("y").alias("x"))
    own = projection.project(w, e).where("contributing > 0").select("profile", "right", F.col("sum1").alias("x"))
    own = own.repartition(S.tasks(e), "profile", "right")
    return mapping.compared(own, again, ["profile", "right"], "x", 1e-12).withColumn("max_gap", r("max_gap", 10))


@query(
    sql(
        """select "left", feature, module, round(feature / "left", 6) as feature_over_left, round(module / feature, 6) as module_over_feature, round(module / "left", 6) as module_over_left
        from (select max(gjsd) filter (layer = 'left') as "left", max(gjsd) filter (layer = 'feature') as feature, max(gjsd) filter (layer = 'module') as module from la)""",
        "prof", "mem", la=LAYERS,
    )
)
def layer_retention(spark, d):
    """MD12: what of the divergence between profiles is left from layer to layer."""
    out = divergence.retention(QUERIES["cross_layer"](spark, d))
    return out.withColumns({c: r(c, 6) for c in out.columns if "over" in c})


@query(
    sql(
        """select (select gjsd from la where layer = 'feature') as gjsd, round(sum(common), 8) as common_mass, any_value(jsd) as mean_jsd, any_value(cosine) as mean_cosine, any_value(pearson) as mean_pearson, any_value(spearman) as mean_spearman, any_value(jaccard) as mean_jaccard
        from (select min(sum1) as common from prof group by "right") cross join (select round(avg(jsd), 7) as jsd, round(avg(cosine), 7) as cosine, round(avg(pearson), 6) as pearson, round(avg(spearman), 6) as spearman, round(avg(jaccard), 7) as jaccard from
        (select sum(case when a > 0 then a * log2(2 * a / (a + b)) else 0 end + case when b > 0 then b * log2(2 * b / (a + b)) else 0 end) / 2 as jsd, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) as cosine, corr(a, b) as pearson, corr(ra, rb) as spearman, sum((a > 0 and b > 0)::int)::double / sum((a > 0 or b > 0)::int) as jaccard from pr group by first, second))""",
        "prof", "mem", la=LAYERS, **PAIR,
    )
)
def convergence_record(spark, d):
    """ST19: all measures of the profiles' convergence as one record."""
    return divergence.convergence(Scratch(spark).write(rounded(spark, d).select("profile", "right", "sum1")), "sum1").select(
        r("gjsd").alias("gjsd"), r("common_mass").alias("common_mass"), r("mean_jsd", 7).alias("mean_jsd"), r("mean_cosine", 7).alias("mean_cosine"),
        r("mean_pearson", 6).alias("mean_pearson"), r("mean_spearman", 6).alias("mean_spearman"), r("mean_jaccard", 7).alias("mean_jaccard"),
    )


@query(
    """with f as (select c_mktsegment as profile, l_partkey as left_node, p_type as formula from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
    g as (select profile, p_brand as left_node, formula from f join part on p_partkey = left_node)
    select profile, left_node, m as formulas, big_m as all_formulas, round((m + 0.5::double) / (big_m + 1), 10) as weight from (select profile, left_node, count(distinct formula) as m from g group by all) join (select profile, count(distinct formula) as big_m from g group by all) using (profile)"""
)
def formula_weights(spark, d):
    """PR2: brands as items of the formulas, part types, that a profile's orders hold."""
    part = S.table(spark, d, "part").select(F.col("p_partkey").alias("left"), F.col("p_brand").alias("brand"), F.col("p_type").alias("article"))
    rows = S.evidence(spark, d, "l_partkey").select("profile", "left").join(part, "left").select("profile", F.col("brand").alias("left"), "article")
    out = evidence.support_weights(rows)
    return out.select("profile", F.col("left").alias("left_node"), F.col("support").alias("formulas"), F.col("articles").alias("all_formulas"), r("weight", 10).alias("weight"))


METHODS = ("binary_union", "weighted_raw", "degree_normalised", "ubiquity_corrected")


@query(
    sql(
        "select profile, step, method, round(sum(x / t * coalesce(z, 0)) / sum(case when z is not null then x / t else 0 end), 8) as alignment from (select *, sum(x) over (partition by profile, method) as t from m) join z on feature = \"right\" group by all",
        "prof", "z",
        m=" union all ".join(f"select profile, \"right\", {i + 1} as step, '{m}' as method, {m}::double as x from prof" for i, m in enumerate(METHODS)),
    )
)
def method_trajectory(spark, d):
    """ST27, MD14, AG12: the alignment under each projection method, in their order."""
    wide = profiles(spark, d).withColumn("binary_union", F.col("binary_union").cast("double"))
    long = wide.unpivot(["profile", "right"], list(METHODS), "method", "x")
    steps = F.create_map(*[F.lit(v) for i, m in enumerate(METHODS) for v in (m, i + 1)])
    rows = long.join(S.scores(spark, d).withColumnRenamed("feature", "right"), "right")
    # both sums share the method's total, which cancels
    out = rows.groupBy("profile", "method").agg(
        F.sum(F.col("x") * F.coalesce("z", F.lit(0.0))).alias("a"), F.sum(F.when(F.col("z").isNotNull(), F.col("x")).otherwise(0.0)).alias("b")
    )
    return out.select("profile", steps[F.col("method")].alias("step"), "method", r(F.col("a") / F.col("b")).alias("alignment"))
