"""Joins that resolve names, and joins that check what they assume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve(names: DataFrame, name: str, tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """names with mapped and method: the first table (name, mapped) that knows the name wins, else unresolved."""
    out, found = names, []
    for i, (_, table) in enumerate(tables):
        out = out.join(table.select(F.col("name").alias(name), F.col("mapped").alias(f"_m{i}")), name, "left")
        found.append(F.col(f"_m{i}"))
    method = F.lit("unresolved")
    for (label, _), column in reversed(list(zip(tables, found))):
        method = F.when(column.isNotNull(), F.lit(label)).otherwise(method)
    return out.withColumns({"mapped": F.coalesce(*found), "method": method}).drop(*[f"_m{i}" for i in range(len(tables))])


def unique_mapping(table: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys that stand for one value only."""
    rows = table.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    one = rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_hi"))
    return one.where(F.col(value) == F.col("_hi")).drop("_hi")


def ambiguous(table: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, candidates) of the keys that stand for several values, withheld from matching."""
    rows = table.groupBy(key).agg(F.countDistinct(value).alias("n"), F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), "|").alias("candidates"))
    return rows.where("n > 1")


def keep_best(df: DataFrame, by: list[str], *order) -> DataFrame:
    """One row per key, the first in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require(df: DataFrame, columns: list[str], name: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    if found := duplicates(df, keys).limit(5).collect():
        raise ValueError(f"{name} repeats {[tuple(r) for r in found]}")
    return df


def checked_join(a: DataFrame, b: DataFrame, keys: list[str], cardinality: str, how: str = "inner") -> DataFrame:
    """A join that first checks the side, or both, that must have unique keys: one_to_one, one_to_many, many_to_one or many_to_many."""
    left, _, right = cardinality.partition("_to_")
    if left == "one":
        require_unique(a, keys, "the left side")
    if right == "one":
        require_unique(b, keys, "the right side")
    return a.join(b, keys, how)


#: Values that with_each() unfolds, at most.
FEW = 10_000


def with_each(df: DataFrame, values: DataFrame) -> DataFrame:
    """Every row of df with every distinct row of values, which must be FEW at most: they become one array, and are unfolded in place."""
    values = values.distinct()
    if values.limit(FEW + 1).count() > FEW:
        raise ValueError(f"over {FEW} values to unfold")
    one = values.agg(F.collect_set(F.struct(*values.columns)).alias("_all"))
    return df.crossJoin(one).select(*df.columns, F.explode("_all").alias("_one")).select(*df.columns, "_one.*")  # one row


def grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every pair of two distinct sets, the second a small one."""
    return with_each(a.distinct(), b)


def on_universe(universe: DataFrame, values: DataFrame, keys: list[str], x: str, fill: float | None = 0.0) -> DataFrame:
    """The values on all of a universe, those missing filled; measured tells which weren't."""
    rows = values.select(*keys, F.col(x), F.lit(True).alias("measured"))
    out = universe.select(*keys).join(rows, keys, "left").withColumn("measured", F.coalesce("measured", F.lit(False)))
    return out if fill is None else out.withColumn(x, F.coalesce(x, F.lit(fill)))


def coalesced_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """A left join where columns of both sides become one, the left side's unless null."""
    both = [c for c in a.columns if c in b.columns and c not in keys]
    out = a.join(b.withColumnsRenamed({c: f"{c}_right" for c in both}), keys, "left")
    return out.withColumns({c: F.coalesce(c, f"{c}_right") for c in both}).drop(*[f"{c}_right" for c in both])


def compared(a: DataFrame, b: DataFrame, keys: list[str], x: str, tolerance: float) -> DataFrame:
    """One row: keys of both, keys of one, masks that differ, the largest gap, and whether the two agree."""
    left = a.select(*keys, F.col(x).alias("_a"), F.lit(1).alias("_ia"))
    right = b.select(*keys, F.col(x).alias("_b"), F.lit(1).alias("_ib"))
    both = left.join(right, keys, "full_outer")
    gap = F.coalesce(F.max(F.abs(F.col("_a") - F.col("_b"))), F.lit(0.0))
    one = F.sum((F.col("_ia").isNull() | F.col("_ib").isNull()).cast("long"))
    masks = F.sum((F.col("_ia").isNotNull() & F.col("_ib").isNotNull() & (F.col("_a").isNull() != F.col("_b").isNull())).cast("long"))
    out = both.agg(F.count("*").alias("n"), F.coalesce(one, F.lit(0)).alias("n_one_sided"), F.coalesce(masks, F.lit(0)).alias("n_masks"), gap.alias("max_gap"))
    return out.withColumn("agree", (F.col("n_one_sided") == 0) & (F.col("n_masks") == 0) & (F.col("max_gap") <= tolerance))


def same_universe(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys of only one side, with that side's name; none if the universes are equal."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).withColumn("only_in", F.lit("first")).unionByName(y.exceptAll(x).withColumn("only_in", F.lit("second")))


def detect_column(columns: list[str], candidates: list[str], explicit: str | None = None) -> str:
    """SRC22: the column of a table that a candidate names: exactly, else but for case, else as a part."""
    if explicit:
        if explicit not in columns:
            raise ValueError(f"no column {explicit}")
        return explicit
    for c in candidates:
        if c in columns:
            return c
    lowered = {c.lower(): c for c in reversed(columns)}
    for c in candidates:
        if c.lower() in lowered:
            return lowered[c.lower()]
    for c in candidates:
        for own in columns:
            if c.lower() in own.lower():
                return own
    raise ValueError(f"none of {candidates} among {columns}")
