"""Robust local regression of very many points at a bounded number of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalibra.functions.ranks import exact_quantiles, numbered
from kalibra.storage import Scratch

#: Fits are made at so many places, evenly spaced, and interpolated between them.
PLACES = 201


def places(points: DataFrame, n: int = PLACES) -> list[float]:
    """Evenly spaced places from the least x to the largest; one where all are alike, none without points."""
    low, high = points.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return []
    return [low + (high - low) * i / (n - 1) for i in range(n)] if high > low else [low]


def interpolated(x: Column, at: list[float], values: list[float]) -> Column:
    """The line through (at, values), at ascending; constant beyond its ends."""
    if not at:
        return F.lit(None).cast("double")
    a, v, n = F.lit([float(p) for p in at]), F.lit([float(p) for p in values]), len(at)
    halves = F.lit([1 << b for b in reversed(range(n.bit_length()))])
    below = F.aggregate(halves, F.lit(0), lambda i, s: F.when((i + s <= n) & (F.get(a, i + s - 1) <= x), i + s).otherwise(i))
    line = F.transform(
        F.array(below),
        lambda i: F.when(i == 0, v[0])
        .when(i == n, v[n - 1])
        .otherwise(F.get(v, i - 1) + (x - F.get(a, i - 1)) / (F.get(a, i) - F.get(a, i - 1)) * (F.get(v, i) - F.get(v, i - 1))),
    )
    return line[0]


def half_widths(points: DataFrame, at: list[float], k: int, scratch: Scratch) -> list[float]:
    """Of each place, how far its k-th nearest x is.

    The k nearest are neighbours in order, so it is the least, over stretches of k
    of them, of the distance to the farther end: a join of two ranks, and a minimum.
    """
    ranked = scratch.write(numbered(points.select("x"), [], ["x"], "i", scratch))
    ends = ranked.join(ranked.select(F.col("x").alias("_end"), (F.col("i") - (k - 1)).alias("i")), "i")
    rows = ends.select("x", "_end", F.posexplode(F.lit(at)).alias("pos", "a"))
    found = rows.groupBy("pos").agg(F.min(F.greatest(F.col("a") - F.col("x"), F.col("_end") - F.col("a"))).alias("h"))
    return [h for _, h in sorted(map(tuple, found.collect()))]  # a row for each place


def fitted(points: DataFrame, at: list[float], widths: list[float], weight: Column, extent: float) -> list[float | None]:
    """Weighted lines by the points around each place, as sums that are combined before they are shuffled."""
    rows = points.select("x", "y", weight.alias("_w"), F.posexplode(F.lit(at)).alias("pos", "a"))
    h, u = F.get(F.lit(widths), F.col("pos")), F.col("x") - F.col("a")
    near = F.abs(u) <= 0.999 * h
    d = F.abs(u) / h
    w = F.col("_w") * F.when(F.abs(u) <= 0.001 * h, F.lit(1.0)).otherwise(F.pow(1 - d * d * d, F.lit(3.0)))
    rows = rows.where(near & (F.col("_w") > 0)).select("pos", w.alias("w"), u.alias("u"), "y")
    of = {"w": F.col("w"), "u": F.col("w") * F.col("u"), "uu": F.col("w") * F.col("u") * F.col("u"), "y": F.col("w") * F.col("y"), "uy": F.col("w") * F.col("u") * F.col("y")}
    out: list[float | None] = [None] * len(at)
    for r in rows.groupBy("pos").agg(*[F.sum(v).alias(f"s{n}") for n, v in of.items()]).collect():  # a row for each place
        u, y = r.su / r.sw, r.sy / r.sw
        spread = r.suu / r.sw - u * u
        out[r.pos] = y - (u * (r.suy / r.sw - u * y) / spread if spread > 0 and spread**0.5 > 0.001 * extent else 0.0)
    return out


def lowess(points: DataFrame, at: list[float] | None = None, span: float = 0.5, steps: int = 3) -> tuple[list[float], list[float]]:
    """(places, fits) of points (x, y): tricube weights over the span's share of the points, bisquare ones of residuals in each step.

    With the points' own x as places this is the classic smoother; by default the
    fits are made at PLACES of them.  Rows with a null or not a number have no
    part; a place whose neighbours have all lost their weight keeps its last fit;
    without points there is no place.  The driver gets a row for each place.
    """
    scratch = Scratch(points.sparkSession)
    points = scratch.write(points.select(F.col("x").cast("double"), F.col("y").cast("double")).where("x is not null and y is not null and not isnan(x) and not isnan(y)"))
    n, low, high = points.agg(F.count("*"), F.min("x"), F.max("x")).first()
    at = places(points) if at is None else sorted(set(map(float, at)))
    if not n or not at:
        return [], []
    widths = half_widths(points, at, min(max(int(span * n + 1e-7), 2), n), scratch)
    fits = fitted(points, at, widths, F.lit(1.0), high - low)
    for _ in range(steps):
        off = points.withColumn("_r", F.abs(F.col("y") - interpolated(F.col("x"), at, fits)))
        mean = off.agg(F.avg("_r")).first()[0]
        scale = 6 * exact_quantiles(off.select("_r"), "_r", [], {"m": 0.5}).first().m
        if scale < 1e-7 * mean or not scale:
            break
        q = F.col("_r") / scale
        weight = F.when(q <= 0.001, F.lit(1.0)).when(q <= 0.999, F.pow(1 - q * q, F.lit(2.0))).otherwise(F.lit(0.0))
        fits = [new if new is not None else old for new, old in zip(fitted(off, at, widths, weight, high - low), fits)]
    return at, fits
