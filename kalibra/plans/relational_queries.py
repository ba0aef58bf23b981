"""Queries of filters, joins, aggregates, scalar functions, sets and page scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from kalibra.functions import ranks, text
from kalibra.operators import evidence, mapping
from kalibra.plans import stand_ins as S
from kalibra.plans.stand_ins import r
from kalibra.sources import readers, tables

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("select event_id, try_cast(regexp_extract(props, '\"k\": *(\\d+)', 1) as double) as k from events where event_type in ('click', 'view') and props <> '' and value > 0 and value is not null")
def coerced_filter(spark, d):
    """FIL1, FIL2, FIL6, SC17."""
    e = S.table(spark, d, "events").where(F.col("event_type").isin("click", "view") & (F.col("props") != "") & (F.col("value") > 0) & F.col("value").isNotNull())
    return e.select("event_id", text.number(F.regexp_extract("props", r'"k": *(\d+)', 1)).alias("k"))


@query("select l_orderkey as orderkey, l_linenumber as line from lineitem where l_discount between 0.02 and 0.05 and not isnan(l_tax) and not regexp_matches(l_returnflag, '[R;/|]')")
def range_filter(spark, d):
    """FIL3, FIL4."""
    items = S.table(spark, d, "lineitem")
    return items.where(F.col("l_discount").between(0.02, 0.05) & ~F.isnan("l_tax") & ~F.col("l_returnflag").rlike("[R;/|]")).select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"))


@query("select p_partkey as part from part where not regexp_matches(p_name, 'widget|ring|bolt') and not list_contains(string_split(p_type, ' '), 'ECONOMY')")
def variant_exclusion(spark, d):
    """FIL5, FIL8."""
    p = S.table(spark, d, "part")
    return p.where(~F.col("p_name").rlike("widget|ring|bolt") & ~F.array_contains(F.split("p_type", " "), "ECONOMY")).select(F.col("p_partkey").alias("part"))


@query('with e as (select distinct l_suppkey as l, l_partkey as r from lineitem) select l as left_node, count(*) as degree from e group by l having count(*) between 100 and 580')
def degree_bounds(spark, d):
    """FIL7."""
    from kalibra.operators.projection import degree_between

    kept = degree_between(S.edges(spark, d), 100, 580)
    return kept.groupBy(F.col("left").alias("left_node")).agg(F.count("*").alias("degree"))


@query(
    "select c_custkey as customer, concat_ws(';', case when c_acctbal < 0 then 'NEGATIVE' end, case when c_mktsegment = 'BUILDING' then 'SEGMENT' end, case when c_nationkey > 20 then 'NATION' end) as issues, c_acctbal >= 0 and c_nationkey <= 20 as passes from customer"
)
def completeness_audit(spark, d):
    """FIL16, FIL17."""
    c = S.table(spark, d, "customer")
    issues = ranks.flagged({"NEGATIVE": F.col("c_acctbal") < 0, "SEGMENT": F.col("c_mktsegment") == "BUILDING", "NATION": F.col("c_nationkey") > 20})
    return c.select(F.col("c_custkey").alias("customer"), issues.alias("issues"), ((F.col("c_acctbal") >= 0) & (F.col("c_nationkey") <= 20)).alias("passes"))


@query(
    "select page_id, case when regexp_matches(url, '^https') then 'SECURE' when regexp_matches(url, 'page=') then 'LISTING' when regexp_matches(url, '#') then 'ANCHOR' else 'OTHER' end as class from pages"
)
def rule_classes(spark, d):
    """FIL19."""
    pages = S.table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return readers.classified(pages, [("^https", "SECURE"), ("page=", "LISTING"), ("#", "ANCHOR")]).select("page_id", "class")


@query("select c_mktsegment as segment, c_nationkey as nation, count(*) as n from customer group by all having count(*) > 1")
def duplicate_keys(spark, d):
    """FIL20, AG10."""
    c = S.table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return mapping.duplicates(c, ["segment", "nation"])


@query("select p_name as name, p_name = (select min(q.p_name) from part q where q.p_brand = p.p_brand) as own from (select distinct p_name, p_brand from part) p")
def protected_identity(spark, d):
    """FIL18: whether a raw name is its group's canonical one."""
    p = S.table(spark, d, "part").select("p_name", "p_brand").distinct()
    low = p.groupBy("p_brand").agg(F.min("p_name").alias("low"))
    return p.join(low, "p_brand").select(F.col("p_name").alias("name"), (F.col("p_name") == F.col("low")).alias("own"))


@query("select s_suppkey as supplier, n_name as nation, coalesce(k, 0) as orders from supplier join nation on s_nationkey = n_nationkey left join (select l_suppkey as s, count(distinct l_orderkey) as k from lineitem where l_returnflag = 'R' group by all) on s = s_suppkey")
def lookup_join(spark, d):
    """JN1, JN2, JN7, FIL13: lookups, and a left join with zeros."""
    s = S.table(spark, d, "supplier").join(S.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = S.table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("k"))
    out = s.join(k, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return out.select(F.col("s_suppkey").alias("supplier"), F.col("n_name").alias("nation"), F.coalesce("k", F.lit(0)).alias("orders"))


@query("select n_nationkey as nation, r_name as region, count(c_custkey) as n from nation join region on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by all")
def checked_join(spark, d):
    """JN3: the join's keys must be unique on the many-to-one side."""
    n = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("regionkey"))
    g = S.table(spark, d, "region").select(F.col("r_regionkey").alias("regionkey"), F.col("r_name").alias("region"))
    c = S.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return mapping.checked_join(mapping.checked_join(n, g, ["regionkey"], "many_to_one"), c, ["nation"], "one_to_one", "left").select("nation", "region", F.coalesce("n", F.lit(0)).alias("n"))


@query("select m.p as segment, t.t as type, coalesce(k, 0) as n, k is not null as measured from (select distinct c_mktsegment as p from customer) m cross join (select distinct p_type as t from part) t left join (select c_mktsegment as p, p_type as t, count(*) as k from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey where l_returnflag = 'R' and l_linestatus = 'F' group by all) using (p, t)")
def completed_grid(spark, d):
    """JN4, JN8."""
    seg = S.table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"))
    typ = S.table(spark, d, "part").select(F.col("p_type").alias("type"))
    items = S.table(spark, d, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F'").join(S.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = items.join(S.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(S.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = rows.groupBy(F.col("c_mktsegment").alias("segment"), F.col("p_type").alias("type")).agg(F.count("*").alias("n"))
    out = mapping.on_universe(mapping.grid(seg, typ), n, ["segment", "type"], "n", None)
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


@query("select c_custkey as customer from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT') and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def semi_and_anti(spark, d):
    """JN5, JN6."""
    o = S.table(spark, d, "orders")
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("customer"))
    urgent, pending = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("customer")), o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("customer"))
    return c.join(urgent, "customer", "left_semi").join(pending, "customer", "left_anti")


@query("select s_nationkey as nation, coalesce(max(case when s_acctbal > 9000 then s_acctbal end), max(c)) as balance from supplier left join (select c_nationkey as k, max(c_acctbal) as c from customer group by all) on k = s_nationkey group by all")
def coalesced_join(spark, d):
    """JN9, JN15."""
    a = S.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.max(F.when(F.col("s_acctbal") > 9000, F.col("s_acctbal"))).alias("balance"))
    b = S.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.max("c_acctbal").alias("balance"))
    return mapping.coalesced_join(a, b, ["nation"])


@query("select p_brand as brand, count(distinct p_type) as formulas, sum(p_size)::bigint as total, max(p_size) as largest from part group by all")
def named_aggregates(spark, d):
    """AG1, AG3."""
    p = S.table(spark, d, "part").select(F.col("p_brand").alias("brand"), "p_type", "p_size")
    counts = evidence.formula_counts(p.withColumn("group", F.lit(1)), ["group"], "brand", "p_type").drop("group")
    return counts.join(p.groupBy("brand").agg(F.sum("p_size").alias("total"), F.max("p_size").alias("largest")), "brand")


@query("select l_returnflag as flag, round(stddev_samp(l_extendedprice), 4) as sd, round(avg(l_extendedprice), 4) as mean, stddev_pop(l_extendedprice) = 0 as flat, quantile_cont(l_quantity, 0.025) as q025, quantile_cont(l_quantity, 0.5) as q500, quantile_cont(l_quantity, 0.975) as q975, bool_and(l_quantity > 0) as every, bool_or(l_quantity > 49) as some_ from lineitem group by all")
def moments_and_quantiles(spark, d):
    """AG5, AG7, AG8, AG9, AG18."""
    items = S.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"))
    out = items.agg(
        r(F.stddev_samp("l_extendedprice"), 4).alias("sd"), r(F.avg("l_extendedprice"), 4).alias("mean"), (F.stddev_pop("l_extendedprice") == 0).alias("flat"),
        F.percentile("l_quantity", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"),
        ranks.all_of(F.col("l_quantity") > 0).alias("every"), ranks.any_of(F.col("l_quantity") > 49).alias("some_"),
    )
    return out.select("flag", "sd", "mean", "flat", *[F.col("q")[i].alias(n) for i, n in enumerate(("q025", "q500", "q975"))], "every", "some_")


@query("select c_nationkey as nation, count(*) filter (c_mktsegment = 'BUILDING') as building, count(*) filter (c_mktsegment = 'MACHINERY') as machinery, least(count(*) filter (c_mktsegment = 'BUILDING'), count(*) filter (c_mktsegment = 'MACHINERY')) as shared from customer group by all")
def pivoted(spark, d):
    """AG6, AG11, AG13."""
    wide = S.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).count()
    wide = wide.select("nation", F.coalesce("BUILDING", F.lit(0)).alias("building"), F.coalesce("MACHINERY", F.lit(0)).alias("machinery"))
    return wide.withColumn("shared", ranks.least_of(["building", "machinery"]))


@query("select p_partkey as part, k as measure, v as value from (select p_partkey, unnest([{'k': 'size', 'v': p_size::double}, {'k': 'price', 'v': p_retailprice}], recursive := true) from part)")
def unpivoted(spark, d):
    """AG12."""
    p = S.table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("part", ["size", "price"], "measure", "value")


@query("select p_partkey as part, rank() over (partition by p_brand order by p_retailprice desc) - rank() over (partition by p_brand order by p_size desc) as shift from part")
def rank_shift(spark, d):
    """WN9."""
    p = S.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("part"), (ranks.min_rank("p_retailprice", ["p_brand"]) - ranks.min_rank("p_size", ["p_brand"])).cast("long").alias("shift"))


@query("(select 'top' as label, p_partkey as part, p_retailprice as price from part order by p_retailprice desc, p_partkey limit 25) union all (select 'bottom', p_partkey, p_retailprice from part order by p_retailprice, p_partkey limit 25)")
def both_ends(spark, d):
    """SO3, SE1: a top-k report."""
    p = S.table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("price"))
    ends = [p.orderBy(o, "part").limit(25).select(F.lit(n).alias("label"), "part", "price") for n, o in (("top", F.desc("price")), ("bottom", F.asc("price")))]
    return ends[0].unionByName(ends[1])


@query("select b as brand, n, row_number() over (order by n desc, m desc, b) as priority from (select p_brand as b, count(*) as n, greatest(max(p_size), 20) as m from part group by all)")
def priority_order(spark, d):
    """SO1, SO6: brands are few."""
    from pyspark.sql import Window

    p = S.table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.greatest(F.max("p_size"), F.lit(20)).alias("m"))
    return p.select("brand", "n", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("m"), "brand")).cast("long").alias("priority"))


@query("select (select count(*) from (select distinct l_partkey from lineitem where l_returnflag = 'A' and l_discount > 0.09 intersect select distinct l_partkey from lineitem where l_returnflag = 'N' and l_discount > 0.09)) as both_, round(100.0::double * (select count(*) from (select distinct l_partkey from lineitem where l_returnflag = 'A' and l_discount > 0.09 intersect select distinct l_partkey from lineitem where l_returnflag = 'N' and l_discount > 0.09)) / least((select count(distinct l_partkey) from lineitem where l_returnflag = 'A' and l_discount > 0.09), (select count(distinct l_partkey) from lineitem where l_returnflag = 'N' and l_discount > 0.09)), 6) as share")
def overlap_of_smaller(spark, d):
    """SE2, SE5."""
    items = S.table(spark, d, "lineitem").where("l_discount > 0.09")
    flags = items.groupBy("l_partkey").agg(F.max((F.col("l_returnflag") == "A").cast("long")).alias("a"), F.max((F.col("l_returnflag") == "N").cast("long")).alias("n"))
    out = flags.agg(F.sum(F.col("a") * F.col("n")).alias("both_"), F.sum("a").alias("na"), F.sum("n").alias("nn"))
    return out.select("both_", r(F.lit(100.0) * F.col("both_") / F.least("na", "nn"), 6).alias("share"))


@query("(select l_suppkey as node, 'first' as only_in from lineitem where l_quantity > 49 and l_discount > 0.08 except select l_suppkey, 'first' from lineitem where l_quantity < 2 and l_discount > 0.08) union all (select l_suppkey, 'second' from lineitem where l_quantity < 2 and l_discount > 0.08 except select l_suppkey, 'second' from lineitem where l_quantity > 49 and l_discount > 0.08)")
def universe_difference(spark, d):
    """SE4."""
    items = S.table(spark, d, "lineitem").where("l_discount > 0.08").select(F.col("l_suppkey").alias("node"), "l_quantity")
    return mapping.same_universe(items.where("l_quantity > 49"), items.where("l_quantity < 2"), "node")


@query(
    "select n_nationkey as nation, upper(regexp_replace(trim(coalesce(n_name, '')), '\\s+', '', 'g')) as squeezed, split_part(n_name, '_', 1) as token, regexp_replace(n_name || '.' || n_regionkey, '\\.\\d+$', '') as bare, sha256(n_name) as digest, case when starts_with(n_name, 'NATION_1') then 'ONE' when starts_with(n_name, 'NATION_2') then 'TWO' else 'OTHER' end as decoded, case n_name when 'NATION_3' then 'third' else n_name end as aliased, trim(regexp_replace(replace(lower(n_name), 'nation', ''), '[^a-z0-9]+', ' ', 'g')) as formula from nation"
)
def scalar_text(spark, d):
    """SC1-SC6, SC15, SC16."""
    n = S.table(spark, d, "nation")
    x = F.col("n_name")
    return n.select(
        F.col("n_nationkey").alias("nation"),
        text.squeezed(x, True).alias("squeezed"),
        text.first_token(x).alias("token"),
        text.without_version(F.concat_ws(".", x, "n_regionkey")).alias("bare"),
        text.digest(x).alias("digest"),
        text.decoded(x, {"NATION_1": "ONE", "NATION_2": "TWO"}).alias("decoded"),
        text.aliased(x, {"NATION_3": "third"}).alias("aliased"),
        text.formula_name(x, ["nation"]).alias("formula"),
    )


@query("select page_id, nullif(trim(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '&amp;', '&')), '') as title, nullif(trim(replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&amp;', '&')), '') as heading from pages")
def page_identity(spark, d):
    """SRC20."""
    return readers.page_identity(S.table(spark, d, "pages")).select("page_id", "title", "heading")


@query("select page_id, len(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1)) as items, sha256(html) as digest, strlen(html)::bigint as length from pages")
def page_inventory(spark, d):
    """The counts of list items, and SC16 of pages."""
    p = S.table(spark, d, "pages")
    return p.select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1))).cast("long").alias("items"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").cast("long").alias("length"))


LINKS = r"(?is)<li[^>]*><a href=\"([^\"]*)\"[^>]*>(.*?)</a></li>"


@query(
    f"with li as (select page_id, generate_subscripts(x, 1) as row, unnest(x) as x from (select page_id, regexp_extract_all(html, '{LINKS}') as x from pages)) "
    f"select page_id, row::int as row, trim(replace(regexp_extract(x, '{LINKS}', 1), '&amp;', '&')) as target, trim(replace(regexp_extract(x, '{LINKS}', 2), '&amp;', '&')) as name, 'nav' as place from li"
)
def page_records(spark, d):
    """SRC21: the links of each page, laid out as a table with a spanned column and no ends of cells, found by header and read back."""
    pages = S.table(spark, d, "pages")
    rows = F.regexp_replace("html", LINKS, "<tr><td>$1<td>$2</tr>")
    first = "<table><tr><th>Other</th></tr></table><table><tr><th>Place<th>Link Target<th>Name</tr>"
    spanned = F.regexp_replace(rows, "(?is)<ul>(<tr>)(.*?)</ul>", f"{first}<tr><td rowspan=0>nav</td>$2</table>")
    found = tables.page_records(pages.withColumn("html", spanned), {"target": "link", "name": "name", "place": "place"}, ["target", "name"])
    return found.select("page_id", "row", "target", "name", "place")
