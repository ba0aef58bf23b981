"""Divergence, similarity and entropy of profiles (by, key, p) that each sum to 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalibra.functions.ranks import safe_divide
from kalibra.operators.projection import pairs, similarity


def _term(p, m):
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))


def gjsd(profiles: DataFrame, p: str, by: str = "profile", key: str = "right", within: tuple[str, ...] = ()) -> DataFrame:
    """(within, gjsd, common_mass): the mean divergence in bits of the profiles from their mean, and the mass that all share.

    A profile that lacks a key has 0 there.  With q the profiles' mean, the sum
    over profiles needs only each key's own rows, so no grid is filled.
    """
    k = profiles.groupBy(*within).agg(F.countDistinct(by).alias("k"))
    rows = profiles.groupBy(*within, key).agg(
        F.sum(p).alias("s"),
        F.sum(F.when(F.col(p) > 0, F.col(p) * F.log2(p)).otherwise(0.0)).alias("h"),
        F.min(p).alias("low"),
        F.count("*").alias("n"),
    )
    rows = rows.join(k, list(within)) if within else rows.crossJoin(k)  # one row
    part = F.col("h") - F.when(F.col("s") > 0, F.col("s") * F.log2(F.col("s") / F.col("k"))).otherwise(0.0)
    common = F.when(F.col("n") == F.col("k"), F.col("low")).otherwise(0.0)
    return rows.groupBy(*within).agg((F.sum(part) / F.first("k")).alias("gjsd"), F.sum(common).alias("common_mass"))


def pairwise(profiles: DataFrame, p: str, by: str = "profile", key: str = "right") -> DataFrame:
    """(first, second, jsd, cosine) on a common universe."""
    both = pairs(profiles, p, key, by).withColumn("m", (F.col("a") + F.col("b")) / 2)
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    return both.groupBy("first", "second").agg(
        (F.sum(_term(a, m) + _term(b, m)) / 2).alias("jsd"),
        safe_divide(F.sum(a * b), F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("cosine"),
    )


def common_key_cosine(profiles: DataFrame, p: str, by: str = "profile", key: str = "right") -> DataFrame:
    """(first, second, cosine, n_common): over keys where both have a positive value."""
    both = pairs(profiles.where(F.col(p) > 0), p, key, by)
    a, b = F.col("a"), F.col("b")
    return both.groupBy("first", "second").agg(safe_divide(F.sum(a * b), F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("cosine"), F.count("*").alias("n_common"))


def entropy(profiles: DataFrame, p: str, by: str = "profile") -> DataFrame:
    """(by, entropy) in bits."""
    x = F.col(p)
    return profiles.groupBy(by).agg((-F.sum(F.when(x > 0, x * F.log2(x)).otherwise(0.0))).alias("entropy"))


def retention(layers: DataFrame) -> DataFrame:
    """One row of the ratios of divergence between layers (layer, gjsd): feature over left, module over feature, module over left."""
    wide = layers.groupBy().pivot("layer", ["left", "feature", "module"]).agg(F.first("gjsd"))
    return wide.select(
        "left",
        "feature",
        "module",
        safe_divide(F.col("feature"), F.col("left")).alias("feature_over_left"),
        safe_divide(F.col("module"), F.col("feature")).alias("module_over_feature"),
        safe_divide(F.col("module"), F.col("left")).alias("module_over_left"),
    )


def convergence(profiles: DataFrame, x: str) -> DataFrame:
    """One record of how close all profiles (profile, right, x) are: gjsd, common_mass, and the means over pairs of jsd, cosine, pearson, spearman and jaccard."""
    one = gjsd(profiles, x)
    two = pairwise(profiles, x).agg(F.avg("jsd").alias("mean_jsd"), F.avg("cosine").alias("mean_cosine"))
    three = similarity(profiles, x).agg(*[F.avg(c).alias(f"mean_{c}") for c in ("pearson", "spearman", "jaccard")])
    return one.crossJoin(two).crossJoin(three)  # one row each
