"""Diversity of labels and embeddings, agreement with truth, and how groups differ."""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.selection import MAX_POOL, _unit, cosine, log_vendi


def label_entropy(df: DataFrame, group: list[str], label: str = "label") -> DataFrame:
    """``(group, n, labels, entropy, vendi, vendi_norm, simpson)`` of labels; the exact-match Vendi score is the perplexity.

    Two sums: by (group, label), then by group; no kernel is built. Null labels are left out.
    """
    c = df.where(F.col(label).isNotNull()).groupBy(*group, label).agg(F.count("*").alias("c"))
    g = c.groupBy(*group).agg(
        F.sum("c").alias("n"),
        F.count("*").alias("labels"),
        F.sum(F.col("c") * F.ln("c")).alias("clnc"),
        F.sum(F.col("c") * F.col("c")).alias("cc"),
    )
    entropy = F.ln("n") - F.col("clnc") / F.col("n")
    return g.select(
        *group,
        "n",
        "labels",
        entropy.alias("entropy"),
        F.exp(entropy).alias("vendi"),
        (F.exp(entropy) / F.col("n")).alias("vendi_norm"),
        (1 - F.col("cc") / (F.col("n") * F.col("n"))).alias("simpson"),
    )


def batched_vendi(df: DataFrame, group: list[str], label: str = "label", idx: str = "idx", batch: int = 8, strict: bool = True) -> DataFrame:
    """``(group, diversity)``: mean normalized Vendi score over batches of consecutive items.

    Strict: the batch is no larger than the group, a short last batch is dropped where there are several, and a score is divided
    by its batch's length. Otherwise groups of fewer than 32 items are cut to 24 and every score is divided by ``batch``. An item without a
    label counts in its batch's length, but has no label to differ.
    """
    w = Window.partitionBy(*group)
    rows = df.withColumn("at", F.row_number().over(w.orderBy(idx)) - 1).withColumn("n", F.count("*").over(w))
    if not strict:
        rows = rows.where((F.col("n") >= 32) | (F.col("at") < 24))
    rows = rows.withColumn("chunk", F.floor(F.col("at") / batch))
    if strict:
        length = F.least(F.lit(batch), F.col("n") - F.col("chunk") * batch)
        e = label_entropy(rows.withColumn("size", F.col("n")).withColumn("length", length), [*group, "size", "length", "chunk"], label)
        e = e.where((F.col("length") == batch) | (F.col("size") < batch))
        return e.groupBy(*group).agg(F.avg(F.col("vendi") / F.col("length")).alias("diversity"))
    e = label_entropy(rows.withColumn("size", F.col("n")), [*group, "size", "chunk"], label)
    return e.groupBy(*group).agg(F.avg(F.col("vendi") / batch).alias("diversity"))


def coverage(df: DataFrame, group: list[str], reference: DataFrame, label: str = "label") -> DataFrame:
    """``(group, coverage)``: the share of the reference's labels that a group holds."""
    ref = reference.select(label).where(F.col(label).isNotNull()).distinct()
    hit = df.join(ref, label, "left_semi").select(*group, label).distinct().groupBy(*group).agg(F.count("*").alias("hit"))
    total = ref.agg(F.count("*").alias("all"))
    groups = df.select(*group).distinct()
    return groups.join(hit, group, "left").crossJoin(F.broadcast(total)).select(*group, (F.coalesce("hit", F.lit(0)) / F.col("all")).alias("coverage"))


# ---- rarefaction, exactly


@lru_cache(maxsize=65536)
def _exact(counts: tuple[int, ...], m: int) -> float:
    """The mean of exp(entropy) / m over all m-subsets of labels with these counts.

    A subset's entropy depends only on its label counts as a multiset; the number of subsets with each multiset is
    summed label by label.
    """
    states: dict[tuple[int, ...], int] = {(): 1}
    for n in counts:
        new: dict[tuple[int, ...], int] = {}
        for parts, ways in states.items():
            room = m - sum(parts)
            for c in range(0, min(n, room) + 1):
                key = tuple(sorted((*parts, c))) if c else parts
                new[key] = new.get(key, 0) + ways * math.comb(n, c)
        states = new
    total = math.comb(sum(counts), m)
    value = 0.0
    for parts, ways in states.items():
        if sum(parts) == m:
            h = -sum(c / m * math.log(c / m) for c in parts)
            value += ways / total * math.exp(h) / m
    return value


def rarefied(counts: list[int], m: int) -> float:
    """Expected normalized diversity of a random ``m``-subset; NaN if there are fewer than ``m`` items or none."""
    if m < 1 or sum(counts) < m:
        return math.nan
    return _exact(tuple(sorted(c for c in counts if c)), m)


def rarefaction(df: DataFrame, group: list[str], m: int, label: str = "label") -> DataFrame:
    """``(group, n, rarefied, non_estimable, reason)``: exact rarefaction to ``m`` items from label counts.

    Only counts a label reach Python, one array a group.
    """
    c = df.where(F.col(label).isNotNull()).groupBy(*group, label).agg(F.count("*").alias("c"))
    g = c.groupBy(*group).agg(F.sort_array(F.collect_list("c")).alias("counts"), F.sum("c").alias("n"))

    @F.pandas_udf("double")
    def score(counts: pd.Series) -> pd.Series:
        return counts.map(lambda x: rarefied([int(v) for v in x], m))

    few = F.col("n") < m
    return g.select(
        *group,
        "n",
        F.when(~few, score("counts")).alias("rarefied"),
        few.alias("non_estimable"),
        F.when(few, F.lit(f"fewer than {m} items")).alias("reason"),
    )


def diversity_at(df: DataFrame, group: list[str], m: int, label: str = "label") -> DataFrame:
    """``(group, n, at, diversity)``: the expected normalized diversity of ``m`` of a group's labels, of all of them where there are fewer, and null for
    fewer than two: the normalized score falls with the size of a set, so sets are compared at one size."""
    c = df.where(F.col(label).isNotNull()).groupBy(*group, label).agg(F.count("*").alias("c"))
    g = c.groupBy(*group).agg(F.sort_array(F.collect_list("c")).alias("counts"), F.sum("c").alias("n"))
    g = g.withColumn("at", F.least(F.lit(m).cast("long"), F.col("n")))

    @F.pandas_udf("double")
    def score(counts: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([rarefied([int(v) for v in x], int(k)) if k >= 2 else None for x, k in zip(counts, at)], dtype=float)

    return g.select(*group, "n", "at", F.nullif(score("counts", "at"), F.lit(float("nan"))).alias("diversity"))


# ---- embeddings


#: A group of at most so many vectors is measured in one task from its own kernel.
SMALL_GROUP = 1_000


def _kernel_entropy(gram: np.ndarray, n: int) -> float:
    w = np.linalg.eigvalsh(gram) / n
    w = w[w > 1e-12]
    return float(-(w * np.log(w)).sum())


def _row(group: list[str], key: tuple, values: dict) -> pd.DataFrame:
    """One row of plain objects: a null key stays null in a column of any type."""
    return pd.DataFrame({k: pd.Series([None if v is None or v != v else v], dtype=object) for k, v in zip(group, key)} | {k: pd.Series([v]) for k, v in values.items()})


def vendi(df: DataFrame, group: list[str], vector: str = "embedding", order: str = "idx") -> DataFrame:
    """``(group, n, log_vendi)`` of unit vectors; null vectors are left out.

    The eigenvalues of the similarity kernel are those of the vectors' second moment, so the smaller of the two matrices will do. Groups of at
    most ``SMALL_GROUP`` vectors are measured whole. Of larger ones, whose second moment has a size that does not depend on the group's, moments are
    summed in Spark from each batch, so a group of any size stays distributed.
    """
    kinds = dict(df.dtypes)
    keys = ", ".join(f"`{g}` {kinds[g]}" for g in group)
    rows = df.select(*group, F.col(vector).cast("array<double>").alias(vector)).where(F.col(vector).isNotNull())
    sizes = rows.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg((F.count("*") > SMALL_GROUP).alias("_large"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group])
    sized = rows.join(sizes, same).select(*group, vector, "_large")

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        u = _unit(np.stack(pdf[vector]).astype(float))
        gram = u @ u.T if len(u) <= u.shape[1] else u.T @ u
        return _row(group, key, {"n": len(u), "log_vendi": _kernel_entropy(gram, len(u))})

    def moments(batches):
        for pdf in batches:
            for key, part in pdf.groupby(group, dropna=False):
                u = _unit(np.stack(part[vector]).astype(float))
                yield _row(group, key, {"n": len(u), "m": (u.T @ u).ravel()})

    @F.pandas_udf("double")
    def entropy(n: pd.Series, m: pd.Series) -> pd.Series:
        side = [int(round(math.sqrt(len(x)))) for x in m]
        return pd.Series([_kernel_entropy(np.asarray(x, float).reshape(d, d), count) for count, x, d in zip(n, m, side)], dtype=float)

    small = sized.where("NOT _large").drop("_large").groupBy(*group).applyInPandas(whole, f"{keys}, n long, log_vendi double")
    parts = sized.where("_large").drop("_large").mapInPandas(moments, f"{keys}, n long, m array<double>")
    cells = parts.select(*group, "n", F.posexplode("m").alias("at", "x"))
    sums = cells.groupBy(*group, "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    large = sums.groupBy(*group).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "x"))).alias("m"))
    return small.unionByName(large.select(*group, "n", entropy("n", F.transform("m", lambda s: s["x"])).alias("log_vendi")))


def kernel_vendi(similarity):
    """A grouped aggregate of any similarity callback: the effective number of distinct values of a column."""

    @F.pandas_udf("double")
    def score(values: pd.Series) -> float:
        v = list(values)
        if not v:
            return 0.0
        if len(v) > MAX_POOL:
            raise ValueError(f"a kernel over {len(v)} values; at most {MAX_POOL}")
        k = np.array([[similarity(a, b) for b in v] for a in v], float) / len(v)
        w = np.linalg.eigvalsh(k)
        w = w[w > 1e-12]
        return float(np.exp(-(w * np.log(w)).sum()))

    return score


def cosine_gaps(df: DataFrame, pool: str, label: str, idx: str = "idx", vector: str = "embedding") -> DataFrame:
    """``(pool, same_label, other_label, gap)``: per pool the means over its items of an item's mean cosine with the others of
    its label and of other labels.

    Sums of unit vectors by label give every item's mean cosine without pairing items: within a group it is the
    item's product with the group's sum, less itself.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = df.where(F.col(vector).isNotNull()).select(pool, idx, label, F.transform(v, lambda x: x / norm).alias("u"))
    cells = rows.select(pool, label, F.posexplode("u").alias("at", "x"))
    by_label = cells.groupBy(pool, label, "at").agg(F.sum("x").alias("x"))
    sums = by_label.groupBy(pool, label).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("mine"))
    whole = by_label.groupBy(pool, "at").agg(F.sum("x").alias("x")).groupBy(pool)
    whole = whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("every"))
    n_label = rows.groupBy(pool, label).agg(F.count("*").alias("n_mine"))
    n_pool = rows.groupBy(pool).agg(F.count("*").alias("n"))
    dots = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    joined = rows.join(sums, [pool, label]).join(whole, pool).join(n_label, [pool, label]).join(n_pool, pool)
    own = dots(F.col("u"), F.col("mine"))
    same = F.when(F.col("n_mine") > 1, (own - 1) / (F.col("n_mine") - 1))
    other = F.when(F.col("n") > F.col("n_mine"), (dots(F.col("u"), F.col("every")) - own) / (F.col("n") - F.col("n_mine")))
    means = joined.groupBy(pool).agg(F.avg(same).alias("same_label"), F.avg(other).alias("other_label"))
    return means.withColumn("gap", F.col("same_label") - F.col("other_label"))


# ---- sets of labels


def set_jaccard(df: DataFrame, stratum: str, pool: str, label: str = "label") -> DataFrame:
    """``(stratum, pool_a, pool_b, jaccard)`` of the label sets of each stratum's pools; pools without labels take no part."""
    sets = df.where(F.col(label).isNotNull()).groupBy(stratum, pool).agg(F.collect_set(label).alias("labels"))
    a = sets.select(stratum, F.col(pool).alias("pool_a"), F.col("labels").alias("la"))
    b = sets.select(stratum, F.col(pool).alias("pool_b"), F.col("labels").alias("lb"))
    pairs = a.join(b, stratum).where("pool_a < pool_b")
    return pairs.select(stratum, "pool_a", "pool_b", (F.size(F.array_intersect("la", "lb")) / F.size(F.array_union("la", "lb"))).alias("jaccard"))


def modal_label(df: DataFrame, group: list[str], label: str = "label") -> DataFrame:
    """``(group, modal, share)``: the most frequent label, the least of several, and its share."""
    c = df.where(F.col(label).isNotNull()).groupBy(*group, label).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*group).orderBy(F.desc("c"), F.asc(label))
    c = c.withColumn("r", F.row_number().over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(*group)))
    return c.where("r = 1").select(*group, F.col(label).alias("modal"), (F.col("c") / F.col("n")).alias("share"))


def country_cosines(df: DataFrame, country: str, vector: str) -> DataFrame:
    """``(country, own, other)``: the mean cosine of a country's items with its other items, and with the items of all other countries.

    The mean of inner products is the inner product of sums, so sums by country and dimension suffice; null and zero vectors are left out.
    """
    x = F.posexplode(vector).alias("at", "x")
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda a: a * a), F.lit(0.0), lambda s, a: s + a))
    units = df.where(F.col(vector).isNotNull()).withColumn("_norm", norm).where("_norm > 0")
    n = units.groupBy(country).agg(F.count("*").cast("double").alias("n"))
    total = n.agg(F.sum("n").alias("all"))
    s = units.select(country, "_norm", x).select(country, "at", (F.col("x") / F.col("_norm")).alias("x"))
    s = s.groupBy(country, "at").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    s = s.withColumn("t", F.sum("s").over(Window.partitionBy("at")))
    sums = s.groupBy(country).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("q"), F.sum(F.col("s") * (F.col("t") - F.col("s"))).alias("st"))
    j = sums.join(n, country).crossJoin(F.broadcast(total))
    own = F.when(F.col("n") > 1, (F.col("ss") - F.col("q")) / (F.col("n") * (F.col("n") - 1)))
    return j.select(country, own.alias("own"), F.when(F.col("all") > F.col("n"), F.col("st") / (F.col("n") * (F.col("all") - F.col("n")))).alias("other"))


# ---- differences between groups


def between_share(df: DataFrame, stratum: str, group: str, value: str) -> DataFrame:
    """``(stratum, eta2)``: the share of a value's variance within a stratum that lies between its groups, from sums alone."""
    g = df.where(F.col(value).isNotNull()).groupBy(stratum, group)
    g = g.agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    t = g.groupBy(stratum).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between")
    )
    base = F.col("s") * F.col("s") / F.col("n")
    total = F.col("q") - base
    return t.select(stratum, F.when(total > 1e-12, (F.col("between") - base) / total).alias("eta2"))


def mix_decomposition(df: DataFrame, group: list[str], kind: str, part: str, outcome: str, low, high) -> DataFrame:
    """``(group, total, composition, within)``: the change of a rate from part ``low`` to part ``high``, split into the change of the
    mix of kinds (at each kind's mean rate) and the rest."""
    y = F.col(outcome).cast("double")
    cells = df.where(F.col(outcome).isNotNull()).groupBy(*group, kind).agg(
        F.count_if(F.col(part) == low).alias("n_lo"),
        F.count_if(F.col(part) == high).alias("n_hi"),
        F.sum(F.when(F.col(part) == low, y)).alias("y_lo"),
        F.sum(F.when(F.col(part) == high, y)).alias("y_hi"),
        F.avg(y).alias("rate"),
    )
    w = Window.partitionBy(*group)
    cells = cells.withColumn("w_lo", F.col("n_lo") / F.sum("n_lo").over(w)).withColumn("w_hi", F.col("n_hi") / F.sum("n_hi").over(w))
    out = cells.groupBy(*group).agg(
        (F.sum("y_hi") / F.sum("n_hi") - F.sum("y_lo") / F.sum("n_lo")).alias("total"),
        F.sum((F.col("w_hi") - F.col("w_lo")) * F.col("rate")).alias("composition"),
    )
    return out.withColumn("within", F.col("total") - F.col("composition"))


def rank_auc(df: DataFrame, group: list[str], score: Column, positive: Column) -> DataFrame:
    """``(group, auc)``: the chance that a positive outscores a negative, ties counting half, from sums of average ranks.

    Ranks come from counts by distinct score, so equal scores cost one row.
    """
    c = df.select(*group, score.alias("s"), positive.alias("pos")).where("s IS NOT NULL AND pos IS NOT NULL")
    c = c.groupBy(*group, "s").agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("wins", F.col("p") * (below + F.col("n") / 2))
    total = F.sum("p") * F.sum("n")
    return c.groupBy(*group).agg(F.when(total > 0, F.sum("wins") / total).alias("auc"))


__all__ = [
    "batched_vendi", "between_share", "cosine", "cosine_gaps", "coverage", "kernel_vendi", "label_entropy", "log_vendi", "mix_decomposition",
    "modal_label", "rank_auc", "rarefaction", "rarefied", "set_jaccard", "vendi",
]
