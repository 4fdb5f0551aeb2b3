"""Contrasts of selections against matched nulls, their moments over a fixed design, and decisions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import f_upper, t_cdf, t_ppf
from plumbline.operators.diversity import label_entropy
from plumbline.operators.draws import kept_parts, null_entropy
from plumbline.operators.selection import random_k, top_k

#: Margins of the equivalence test on the log scale, and the greatest share of null draws that may lack items.
LOW_MARGIN, HIGH_MARGIN, MAX_LACKING = math.log(0.9), math.log(1.1), 0.02


def pool_contrast(
    items: DataFrame, k: int, draws: int, keys: list[str] = ["country", "template"], salt: str = "null", null: Callable[[DataFrame, int, int, str], DataFrame] = random_k  # noqa: B006
) -> DataFrame:
    """``(pool_id, keys, delta, selected, null_mean, null_sd, z)`` of each pool: log Vendi of the top k's labels less the mean over matched random k's.

    Both sides hold k labelled items, so no rarefaction is needed: pools of fewer than k items, and pools with an item without a label, have
    no contrast (``delta`` and what it comes from are null); for those with labels missing use ``endpoint``. ``null`` gives the selections to
    compare with, as rows with a ``draw``, from (items, k, draws, salt).
    """
    whole = items.groupBy("pool_id", *keys).agg(((F.count("*") >= k) & (F.count("*") == F.count("label"))).alias("whole"))
    sel = label_entropy(top_k(items, k), ["pool_id", *keys]).select("pool_id", *keys, F.col("entropy").alias("selected"))
    if null is random_k:
        drawn = null_entropy(items, k, draws, salt)
    else:
        drawn = label_entropy(null(items, k, draws, salt), ["pool_id", "draw"])
        drawn = drawn.groupBy("pool_id").agg(F.avg("entropy").alias("null_mean"), F.stddev_samp("entropy").alias("null_sd"))
    either = whole.join(sel, ["pool_id", *keys], "left").join(drawn, "pool_id", "left")
    ok = [F.when(F.col("whole"), F.col(c)).alias(c) for c in ("selected", "null_mean", "null_sd")]
    delta = F.col("selected") - F.col("null_mean")
    return either.select("pool_id", *keys, *ok).select(
        "pool_id", *keys, delta.alias("delta"), "selected", "null_mean", "null_sd", F.when(F.col("null_sd") > 0, delta / F.col("null_sd")).alias("z")
    )


def endpoint(items: DataFrame, k: int, m: int, draws: int, keep: str = "keep", salt: str = "null") -> DataFrame:
    """The contrast on kept items only: select among all, then keep, then rarefy to ``m``.

    ``(pool_id, n_pool, delta, lo, hi, n_kept, kept_selected, selected_deficit, lacking, kept_shift, non_estimable, reason)``. The filter
    never comes before the selection. Reasons, in order: the pool is smaller than k; the selection keeps fewer than m; the chance that a
    null draw does is more than ``MAX_LACKING``; the bracket from that chance is wider than the upper margin. ``lacking`` is this chance,
    exact, and not the share of the draws made. ``selected_deficit`` is the share of the k that the filter took, ``kept_shift`` how much
    larger the kept share of the selection is than that of the null draws.
    """
    return endpoints(items, [k], m, draws, keep, salt).drop("k")


def endpoints(items: DataFrame, ks: list[int], m: int, draws: int, keep: str = "keep", salt: str = "null") -> DataFrame:
    """``(k, endpoint)``: a row a pool and k; the items are ranked, counted and drawn from for all k in one pass, which shuffles them once."""
    j = kept_parts(items.where("pool_id IS NOT NULL"), ks, m, draws, keep, salt)
    lo = F.col("log_selected") - (1 - F.col("lacking")) * F.col("log_null")
    hi = lo - F.col("lacking") * F.lit(-math.log(m))
    small = F.col("n_pool") < F.col("k")
    reason = (
        F.when(small, F.lit("pool smaller than k"))
        .when(F.col("kept_selected") < m, F.concat(F.lit("selection keeps too few ("), "kept_selected", F.lit(")")))
        .when(F.col("lacking") > MAX_LACKING, F.lit("null draws keep too few"))
        .when(hi - lo > HIGH_MARGIN, F.lit("bracket too wide"))
    )
    return j.select(
        "k",
        "pool_id",
        "n_pool",
        F.when(reason.isNull(), F.col("log_selected") - F.col("log_null")).alias("delta"),
        F.when(reason.isNull(), F.least(lo, hi)).alias("lo"),
        F.when(reason.isNull(), F.greatest(lo, hi)).alias("hi"),
        "n_kept",
        F.when(~small, F.col("kept_selected")).alias("kept_selected"),
        F.when(~small, 1 - F.col("kept_selected") / F.col("k")).alias("selected_deficit"),
        "lacking",
        F.when(~small, (F.col("kept_selected") - F.col("mean_kept_null")) / F.col("k")).alias("kept_shift"),
        reason.isNotNull().alias("non_estimable"),
        reason.alias("reason"),
    )


def dose_response(items: DataFrame, ks: list[int], draws: int, primary: int) -> DataFrame:
    """``(k, pools, mean_delta, minus_primary)``: contrasts by k, and their paired difference from the primary k. Pools smaller than a k have none for it."""
    parts = None
    for k in ks:
        one = pool_contrast(items, k, draws).where("delta IS NOT NULL").select("pool_id", F.lit(k).alias("k"), "delta")
        parts = one if parts is None else parts.unionByName(one)
    base = parts.where(F.col("k") == primary).select("pool_id", F.col("delta").alias("base"))
    return parts.join(base, "pool_id").groupBy("k").agg(
        F.count("delta").alias("pools"), F.avg("delta").alias("mean_delta"), F.avg(F.col("delta") - F.col("base")).alias("minus_primary")
    )


def cell_moments(df: DataFrame, value: str = "delta", by: list[str] = []) -> DataFrame:  # noqa: B006
    """``(by, country, template, pools, mean, var_of_mean)``."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, "country", "template").agg(
        F.count("*").alias("pools"), F.avg(value).alias("mean"), (F.var_samp(value) / F.count("*")).alias("var_of_mean")
    )


def country_moments(cells: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``(by, country, mean, var, df, thin)``: templates averaged with equal weight; Satterthwaite degrees of freedom; thin if a cell has
    fewer than two pools."""
    w = F.col("var_of_mean")
    n = F.count("*")
    return cells.groupBy(*by, "country").agg(
        F.avg("mean").alias("mean"),
        (F.sum(w) / (n * n)).alias("var"),
        F.when(F.sum(w) > 0, F.sum(w) * F.sum(w) / F.sum(w * w / (F.col("pools") - 1))).alias("df"),
        (F.min("pools") < 2).alias("thin"),
    )


def marginal_moments(cells: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``(by, countries, theta, se, df, thin)`` of the equal-weight mean over countries, themselves means of their templates."""
    counts = cells.groupBy(*by, "country").agg(F.count("*").alias("t"))
    c = F.count_distinct
    n_countries = counts.groupBy(*by).agg(c("country").alias("countries")) if by else counts.agg(c("country").alias("countries"))
    j = cells.join(counts, [*by, "country"])
    j = j.join(n_countries, by) if by else j.crossJoin(F.broadcast(n_countries))
    weight = 1 / (F.col("t") * F.col("countries"))
    part = weight * weight * F.col("var_of_mean")
    return j.groupBy(*by).agg(
        F.first("countries").alias("countries"),
        F.sum(weight * F.col("mean")).alias("theta"),
        F.sqrt(F.sum(part)).alias("se"),
        F.when(F.sum(part) > 0, F.sum(part) * F.sum(part) / F.sum(part * part / (F.col("pools") - 1))).alias("df"),
        (F.min("pools") < 2).alias("thin"),
    )


@dataclass
class Decision:
    verdict: str
    reason: str | None = None
    estimate: float | None = None
    lo: float | None = None
    hi: float | None = None
    p_low: float | None = None
    p_high: float | None = None


#: Estimable pools without which nothing is called equivalent or harmful.
MIN_POOLS = 4


def equivalence(
    theta: float | None, se: float | None, df: float | None, thin: bool = False, expected: int | None = None, found: int | None = None,
    pools: int | None = None, margin: float = 0.1,
) -> Decision:
    """Two one-sided t tests of theta at 5 % each against ln(1 - margin) and ln(1 + margin): harmful, equivalent, inconclusive or non_estimable.

    ``lo`` and ``hi`` are the one-sided bounds, a 90 % interval; harmful if ``hi`` lies below the margin of loss, equivalent if both lie within.
    """
    low, high = math.log1p(-margin), math.log1p(margin)
    if theta is None:
        return Decision("non_estimable", "no finite contrasts")
    if expected is not None and found != expected:
        return Decision("non_estimable", "a country of the design is missing", theta)
    if thin:
        return Decision("non_estimable", "a cell has fewer than two pools", theta)
    if pools is not None and pools < MIN_POOLS:
        return Decision("non_estimable", f"fewer than {MIN_POOLS} estimable pools", theta)
    if not se or not df or df <= 0:
        return Decision("non_estimable", "no variance between pools", theta)
    half = t_ppf(0.95, df) * se
    p_low, p_high = 1 - t_cdf((theta - low) / se, df), t_cdf((theta - high) / se, df)
    d = Decision("inconclusive", None, theta, theta - half, theta + half, p_low, p_high)
    if d.hi < low:
        d.verdict = "harmful"
    elif d.lo > low and d.hi < high:
        d.verdict = "equivalent"
    return d


def equivalence_iid(deltas: DataFrame, value: str = "delta", margin: float = 0.1) -> Decision:
    """The test on pools as exchangeable replicates: their moments in Spark, one row to the driver."""
    x = F.when(~F.isnan(value), F.col(value))
    r = deltas.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("sd")).first()
    if r["n"] < MIN_POOLS:
        return Decision("non_estimable", f"fewer than {MIN_POOLS} estimable pools", r["m"])
    return equivalence(r["m"], (r["sd"] or 0.0) / math.sqrt(r["n"]), r["n"] - 1, margin=margin)


def country_marginal(deltas: DataFrame, expected: int | None = None, value: str = "delta", margin: float = 0.1) -> dict:
    """The whole chain for one relation of (country, template, delta): moments in Spark, one row to the driver, then the test."""
    cells = cell_moments(deltas, value)
    rows = marginal_moments(cells).collect()
    r = rows[0].asDict() if rows else {}
    pools = cells.agg(F.sum("pools")).first()[0] or 0
    return asdict(equivalence(r.get("theta"), r.get("se"), r.get("df"), bool(r.get("thin", True)), expected, r.get("countries"), pools, margin))


def welch(means: list[float], variances: list[float], dfs: list[float]) -> tuple[float, float, float, float]:
    """Welch's F for group means with their variances: F, both degrees of freedom, upper tail."""
    g = len(means)
    w = [1 / v for v in variances]
    total = sum(w)
    mid = sum(a * m for a, m in zip(w, means)) / total
    between = sum(a * (m - mid) ** 2 for a, m in zip(w, means)) / (g - 1)
    lam = sum((1 - a / total) ** 2 / d for a, d in zip(w, dfs))
    f = between / (1 + 2 * (g - 2) / (g * g - 1) * lam)
    d2 = (g * g - 1) / (3 * lam)
    return f, g - 1.0, d2, f_upper(f, g - 1, d2)


def heterogeneity(countries: DataFrame) -> dict:
    """Welch's test of equal country means, from ``country_moments``: at most one row a country reaches the driver."""
    rows = [r for r in countries.collect() if not r["thin"] and r["var"] and r["var"] > 0]
    if len(rows) < 2:
        return {"verdict": "non_estimable", "f": None, "p": None}
    f, d1, d2, p = welch([r["mean"] for r in rows], [r["var"] for r in rows], [r["df"] for r in rows])
    return {"verdict": "heterogeneous" if p < 0.05 else "not_shown", "f": f, "df1": d1, "df2": d2, "p": p}


def disjoint_pairs(intervals: DataFrame, group: str = "country") -> DataFrame:
    """``(a, b, gap)`` of groups whose intervals do not meet."""
    a = intervals.select(F.col(group).alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    b = intervals.select(F.col(group).alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    gap = F.greatest(F.col("alo") - F.col("bhi"), F.col("blo") - F.col("ahi"))
    return a.join(b, F.col("a") < F.col("b")).where(gap > 0).select("a", "b", gap.alias("gap"))


def robust_over_readers(df: DataFrame, cell: list[str], readers: list[str]) -> DataFrame:
    """``(cell, verdict)``: yes if the interval of every required reader lies below 0, pending if one is missing, else no."""
    mine = df.where(F.col("reader").isin(readers)).groupBy(*cell)
    g = mine.agg(F.countDistinct(F.when(F.col("hi").isNotNull(), F.col("reader"))).alias("n"), F.bool_and(F.col("hi") < 0).alias("below"))
    verdict = F.when(F.col("n") < len(readers), "pending").when(F.col("below"), "yes").otherwise("no")
    return g.select(*cell, verdict.alias("verdict"))


def dominance(lo_gain: Column, hi_gain: Column, lo_div: Column, hi_div: Column) -> Column:
    """Of two configurations by the intervals of their differences: better, worse, mixed or unclear."""
    up, down = (lo_gain > 0) | (lo_div > 0), (hi_gain < 0) | (hi_div < 0)
    return F.when(up & down, "mixed").when(up, "better").when(down, "worse").otherwise("unclear")
