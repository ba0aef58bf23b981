"""Smoothed support weights from literature-like evidence (profile, article, left)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kalibra.storage import Scratch


def support_weights(evidence: DataFrame, offset: float = 1.0) -> DataFrame:
    """(profile, left, support, articles, weight): weight = (support + 0.5) / (articles + offset).

    support counts the profile's articles with the left node, articles all of
    the profile, by the first row of each, so they are not made distinct anew.  An offset of 1 is the Jeffreys weight (PR1, and PR2 with formulas for
    articles), one of 0.5 the early variant (PR3).
    """
    first = F.row_number().over(Window.partitionBy("profile", "article").orderBy("left")) == 1  # evidence dealt out by article stays so
    rows = Scratch(evidence.sparkSession).write(evidence.select("profile", "left", "article").distinct().select("profile", "left", first.alias("first")))
    articles = rows.groupBy("profile").agg(F.sum(F.col("first").cast("long")).alias("articles"))
    support = rows.groupBy("profile", "left").agg(F.count("*").alias("support"))
    out = support.join(articles, "profile")
    return out.select("profile", "left", "support", "articles", ((F.col("support") + 0.5) / (F.col("articles") + F.lit(offset))).alias("weight"))


def without_articles(evidence: DataFrame, excluded: DataFrame) -> DataFrame:
    """The evidence of all other articles, to be counted anew."""
    return evidence.join(excluded.select("article").distinct(), "article", "left_anti")


def losing_support(full: DataFrame, reduced: DataFrame) -> DataFrame:
    """The weights of a full representation's relations that the reduced one lacks: 0.5 / (articles + 1)."""
    articles = reduced.select("profile", "articles").distinct()
    lost = full.select("profile", "left", F.col("support").alias("full_support")).join(reduced.select("profile", "left"), ["profile", "left"], "left_anti")
    return lost.join(articles, "profile").withColumn("weight", F.lit(0.5) / (F.col("articles") + 1))


def formula_counts(composition: DataFrame, groups: list[str], item: str, formula: str) -> DataFrame:
    """How many formulas of a group hold an item."""
    return composition.groupBy(*groups, item).agg(F.countDistinct(formula).alias("formulas"))


def stability(full: DataFrame, reduced: DataFrame) -> DataFrame:
    """Relations by profile that stay and go, between two representations."""
    both = full.select("profile", "left", F.col("weight").alias("a")).join(reduced.select("profile", "left", F.col("weight").alias("b")), ["profile", "left"], "left")
    return both.groupBy("profile").agg(F.count("*").alias("n_full"), F.count("b").alias("n_kept"), F.sum(F.col("b").isNull().cast("long")).alias("n_lost"))
