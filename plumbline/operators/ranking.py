"""Ranks, bins, quantiles and interpolation inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.runtime import rank_score


def ranked_bins(df: DataFrame, group: str | list[str], score: str = "score", idx: str = "idx", bins: int = 4) -> DataFrame:
    """Adds ``rank01`` = (rank - 1) / n in [0, 1), ascending, and ``bin`` = min(floor(bins * rank01), bins - 1).

    These bins are not those of ``ntile``, which puts the remainder in the first ones.
    """
    keys = [group] if isinstance(group, str) else group
    w = Window.partitionBy(*keys)
    rn = F.row_number().over(w.orderBy(rank_score(F.col(score)).asc_nulls_first(), F.col(idx)))
    df = df.withColumn("_r", rn - 1).withColumn("_n", F.count("*").over(w))
    bin_ = F.least(F.floor(F.lit(bins) * F.col("_r") / F.col("_n")), F.lit(bins - 1))
    return df.withColumn("rank01", F.col("_r") / F.col("_n")).withColumn("bin", bin_.cast("int")).drop("_r", "_n")


def unit_rank(df: DataFrame, group: str | list[str], score: str = "score", idx: str = "idx") -> DataFrame:
    """Adds ``rank01`` = (rank - 1) / max(n - 1, 1) in [0, 1]."""
    keys = [group] if isinstance(group, str) else group
    w = Window.partitionBy(*keys)
    rn = F.row_number().over(w.orderBy(rank_score(F.col(score)).asc_nulls_first(), F.col(idx)))
    return df.withColumn("rank01", (rn - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1)))


def median_split(df: DataFrame, group: list[str], value: str, outcome: str) -> DataFrame:
    """``(group, hi_minus_lo)``: mean outcome of the rows at or above a group's median less that of the rows below; groups in which
    a side is empty give none."""
    med = df.groupBy(*group).agg(F.percentile(value, 0.5).alias("med"), F.count("*").alias("n")).where("n >= 2")
    y = F.col(outcome).cast("double")
    j = df.join(med, group)
    out = j.groupBy(*group).agg(
        F.avg(F.when(F.col(value) >= F.col("med"), y)).alias("hi"), F.avg(F.when(F.col(value) < F.col("med"), y)).alias("lo")
    )
    return out.select(*group, (F.col("hi") - F.col("lo")).alias("hi_minus_lo")).where("hi_minus_lo IS NOT NULL")


def holm(df: DataFrame, p: str, order: str, family: list[str]) -> DataFrame:
    """Adds ``holm_p``, the step-down adjusted p-value within a family; a null or NaN p counts as 1. A family is one
    bounded set of hypotheses and takes one task."""
    w = Window.partitionBy(*family)
    clean = F.coalesce(rank_score(F.col(p)), F.lit(1.0))
    df = df.withColumn("_p", clean).withColumn("_n", F.count("*").over(w))
    df = df.withColumn("_r", F.row_number().over(w.orderBy("_p", order)))
    step = F.least(F.lit(1.0), (F.col("_n") - F.col("_r") + 1) * F.col("_p"))
    running = F.max(step).over(w.orderBy("_p", order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("holm_p", running).drop("_p", "_n", "_r")


def average_rank(value: str, group: list[str]) -> Column:
    """The rank with ties averaged, as a window expression."""
    w = Window.partitionBy(*group)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*group, value)) - 1) / 2


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    ranked = df.where(f"`{x}` IS NOT NULL AND `{y}` IS NOT NULL").withColumn("_x", average_rank(x, group)).withColumn("_y", average_rank(y, group))
    return ranked.groupBy(*group).agg(F.corr("_x", "_y").alias("spearman"))


def pearson_interval(df: DataFrame, group: list[str], x: str, y: str, z: float = 1.959963984540054) -> DataFrame:
    """``(group, n, r, lo, hi)`` with the Fisher interval; null for fewer than four pairs."""
    g = df.where(f"`{x}` IS NOT NULL AND `{y}` IS NOT NULL").groupBy(*group).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    ok = F.col("n") >= 4
    mid, half = F.atanh("r"), z / F.sqrt(F.col("n") - 3)
    return g.select(*group, "n", F.when(ok, F.col("r")).alias("r"), F.when(ok, F.tanh(mid - half)).alias("lo"), F.when(ok, F.tanh(mid + half)).alias("hi"))


def interpolate_best(curve: DataFrame, targets: DataFrame, group: str, x: str = "x", y: str = "y", at: str = "at") -> DataFrame:
    """``(group, at, value)``: the greatest value at ``at`` among the segments between neighbouring points of a curve, in the curve's own
    order; none outside."""
    w = Window.partitionBy(group).orderBy("pos")
    seg = curve.select(group, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1")).where("x1 IS NOT NULL")
    lo, hi = F.least("x0", "x1"), F.greatest("x0", "x1")
    j = seg.join(targets, group).where((F.col(at) >= lo) & (F.col(at) <= hi))
    t = F.when(F.col("x1") == F.col("x0"), F.greatest("y0", "y1")).otherwise(
        F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col(at) - F.col("x0")) / (F.col("x1") - F.col("x0"))
    )
    return j.groupBy(group, at).agg(F.max(t).alias("value"))
