"""The engine's relations over the star schema: suppliers are left nodes, parts right nodes and features, market segments profiles, orders articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kalibra import storage
from kalibra.functions.ranks import to_sum_one
from kalibra.operators.evidence import support_weights
from kalibra.operators.nulls import matched_strata
from kalibra.storage import Scratch

SEED = 1729


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Rows of a task where they are dealt out for joins and distinct rows.
ROWS = storage.ROWS


def tasks(df: DataFrame) -> int:
    """Tasks of about ROWS rows of a table, whose count is read from its footers."""
    return storage.tasks(df, ROWS)


def of_profiles(spark: SparkSession, d: str, items: DataFrame) -> DataFrame:
    """items, rows of lineitem with their order as article, with profile and priority, dealt out by article."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("article"), "o_custkey", F.col("o_orderpriority").alias("priority"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("profile"))
    n = tasks(table(spark, d, "lineitem"))
    if (m := tasks(orders)) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        orders, people = orders.repartition(m, "o_custkey"), people.repartition(m, "o_custkey")
    own = orders.join(people, "o_custkey").repartition(n, "article")
    return items.repartition(n, "article").join(own, "article")


def evidence(spark: SparkSession, d: str, left: str = "l_suppkey") -> DataFrame:
    """(profile, article, left, priority), dealt out by article, which serves for distinct rows, too."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article"), F.col(left).alias("left"))
    return of_profiles(spark, d, items).select("profile", "article", "left", "priority")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Each once, and written: projections read them several times."""
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("left"), F.col("l_partkey").alias("right"))
    return Scratch(spark).write(items.repartition(tasks(table(spark, d, "lineitem")), "left", "right").distinct())


def rich(spark: SparkSession, d: str) -> DataFrame:
    """The edges of suppliers with a balance from 2000 up, a graph that lacks some left nodes."""
    firms = table(spark, d, "supplier").where("s_acctbal >= 2000").select(F.col("s_suppkey").alias("left"))
    return edges(spark, d).join(firms, "left", "left_semi")


def weights(spark: SparkSession, d: str) -> DataFrame:
    return Scratch(spark).write(support_weights(evidence(spark, d)))


def features(spark: SparkSession, d: str) -> DataFrame:
    """(profile, feature, weight): quantities of parts by segment, scaled to 1."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article"), F.col("l_partkey").alias("feature"), "l_quantity")
    rows = of_profiles(spark, d, items).select("profile", "feature", "l_quantity").repartition(tasks(table(spark, d, "lineitem")), "profile", "feature")
    return to_sum_one(Scratch(spark).write(rows.groupBy("profile", "feature").agg(F.sum("l_quantity").alias("q"))), "q", ["profile"], "weight").drop("q")


def universe(spark: SparkSession, d: str) -> DataFrame:
    """(feature, network, ubiquity, stratum): parts with the degree of orders, null under 10 of them, and of suppliers."""
    items = table(spark, d, "lineitem").select(F.col("l_partkey").alias("feature"), "l_orderkey", "l_suppkey")
    n = tasks(table(spark, d, "lineitem"))
    some = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 8)
    # each degree's rows are made distinct by themselves: for both at once Spark sorts or holds every row twice
    degree = lambda c, name: items.select("feature", c).repartition(n, "feature", c).distinct().repartition(some, "feature").groupBy("feature").agg(F.count(c).alias(name))
    rows = degree("l_orderkey", "n").join(degree("l_suppkey", "ubiquity"), "feature")
    rows = Scratch(spark).write(rows.select("feature", F.when(F.col("n") >= 10, F.col("n").cast("double")).alias("network"), F.col("ubiquity").cast("double").alias("ubiquity")))
    return matched_strata(rows, "network", "ubiquity")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(feature, z): retail prices, null for sizes over 45."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("feature"), F.when(F.col("p_size") <= 45, F.col("p_retailprice") / 1000.0 - 1.0).alias("z"))


def members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("feature"), F.col("p_brand").alias("module"))


def prices(spark: SparkSession, d: str) -> DataFrame:
    """(feature, sample, value, status, big): line prices of parts."""
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("feature"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_linestatus").alias("status"),
        (F.col("l_quantity") > 25).alias("big"),
    )


def network(spark: SparkSession, d: str) -> DataFrame:
    """(u, v, score) of nations that trade: customers' and suppliers', by quantity over the largest."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("u"))
    firms = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("v"))
    rows = items.join(orders, "l_orderkey").join(people, "o_custkey").join(firms, "l_suppkey")
    return Scratch(spark).write(rows.groupBy("u", "v").agg(F.sum("l_quantity").alias("score")))


def discounts(spark: SparkSession, d: str) -> DataFrame:
    """(feature, sample, value, status, big): line discounts of parts."""
    rows = table(spark, d, "lineitem")
    return rows.select(F.col("l_partkey").alias("feature"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("sample"), F.col("l_discount").alias("value"), F.col("l_linestatus").alias("status"), (F.col("l_quantity") > 25).alias("big"))


def r(x: Column | str, digits: int = 8) -> Column:
    """Rounded, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)


#: The same relations in SQL.
SQL = {
    "ev": 'select c_mktsegment as profile, l_orderkey as article, l_suppkey as "left", o_orderpriority as priority from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey',
    "evp": 'select c_mktsegment as profile, l_orderkey as article, l_partkey as "left", o_orderpriority as priority from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey',
    "rich": 'select * from edges where "left" in (select s_suppkey from supplier where s_acctbal >= 2000)',
    "pd": "select l_partkey as feature, l_discount as value, l_linestatus as status, l_quantity > 25 as big from lineitem",
    "edges": 'select distinct l_suppkey as "left", l_partkey as "right" from lineitem',
    "w": 'select profile, "left", m as support, big_m as articles, (m + 0.5::double) / (big_m + 1) as weight from (select profile, "left", count(distinct article) as m from ev group by all) join (select profile, count(distinct article) as big_m from ev group by all) using (profile)',
    "deg": 'select "left", count(*) as degree from edges group by all',
    "rs": 'select "right", count(*) as n, ln(((select count(distinct "left") from edges) + 1)::double / (count(*) + 1)) + 1 as idf from edges group by all',
    "proj": """select p.profile, rs."right", case when coalesce(c.k, 0) > 0 then 1 else 0 end as binary_union, coalesce(c.raw, 0) as weighted_raw, coalesce(c.dn, 0) as degree_normalised, coalesce(c.dn, 0) * idf as ubiquity_corrected, coalesce(c.k, 0) as contributing
        from (select distinct profile from w) p cross join rs left join (select profile, "right", sum(weight) as raw, sum(weight / degree) as dn, count(*) as k from w join deg using ("left") join edges using ("left") group by all) c on c.profile = p.profile and c."right" = rs."right" """,
    "prof": 'select *, ubiquity_corrected / sum(ubiquity_corrected) over (partition by profile) as sum1 from proj',
    "feat": "select profile, feature, q / sum(q) over (partition by profile) as weight from (select c_mktsegment as profile, l_partkey as feature, sum(l_quantity) as q from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all)",
    "uni0": "select l_partkey as feature, case when count(distinct l_orderkey) >= 10 then count(distinct l_orderkey)::double end as network, count(distinct l_suppkey)::double as ubiquity from lineitem group by all",
    "cuts0": "select quantile_cont(network, [0.25, 0.5, 0.75]) as qn, min(network) as mn, quantile_cont(ubiquity, [0.25, 0.5, 0.75]) as qu, min(ubiquity) as mu from uni0",
    "cuts": "select list_distinct(list_filter(qn, lambda e: e > mn)) as dn, list_distinct(list_filter(qu, lambda e: e > mu)) as du from cuts0",
    "uni": "select feature, network, ubiquity, case when network is null then 'NO_NET' else 'D' || (1 + len(list_filter(dn, lambda e: network > e)))::varchar end || '|U' || (1 + len(list_filter(du, lambda e: ubiquity > e)))::varchar as stratum from uni0 cross join cuts",
    "z": "select p_partkey as feature, case when p_size <= 45 then p_retailprice / 1000.0::double - 1 end as z from part",
    "mem": "select p_partkey as feature, p_brand as module from part",
    "px": "select l_partkey as feature, l_orderkey || '-' || l_linenumber as sample, l_extendedprice as value, l_linestatus as status, l_quantity > 25 as big from lineitem",
    "net0": "select c_nationkey as u, s_nationkey as v, sum(l_quantity) as score from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by all",
}
NEEDS = {"rich": ["edges"], "w": ["ev"], "deg": ["edges"], "rs": ["edges"], "proj": ["w", "deg", "rs"], "prof": ["proj"], "cuts0": ["uni0"], "cuts": ["cuts0"], "uni": ["uni0", "cuts"]}


def sql(body: str, *names: str, **more: str) -> str:
    """A query over the named relations and what they need, and over more of its own."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in NEEDS.get(name, []):
            need(x)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} as ({SQL[n]})" for n in order] + [f"{n} as ({x})" for n, x in more.items()]
    return f"with {', '.join(parts)} {body}"
