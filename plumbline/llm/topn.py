"""Top N items within every group, by a hot-cold split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.runtime import bounded_broadcast, materialize, rank_score

#: No more than this many groups are treated as hot, so their keys are a broadcast of proven size.
MAX_HOT_GROUPS = 10_000
#: A group of fewer rows is never hot.
HOT_ROWS = 5_000
#: Score ranges, and least number of hash slices of each range, into which a hot group is cut; more slices for a group of more rows than so many a slice.
RANGES, SLICES, SLICE_ROWS = 15, 4, 500_000


def top_n_per_group(
    df: DataFrame,
    group: str,
    item: str,
    score: str,
    tie: str,
    n: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The ``n`` best rows of every group: ``(group, item, score, tie, rank)``.

    Order within a group: score descending, then ``tie`` ascending, then ``item`` ascending, so the order is total
    over distinct items. Method: exact group sizes part the rows. Light groups go through an ordinary window. A hot
    group (at least ``hot_rows`` rows and at least a ``MAX_HOT_GROUPS``-th of all rows) is cut by score ranges, and
    each range by a hash of the item, so that even one value held by all rows is spread; each salt keeps its own
    best ``n`` and one window over those bounded survivors merges them. Both results are united. Salting never drops
    a row that belongs to the result: a row among the best n of its group is among the best n of its salt.

    Defined cases: rows with a null or NaN score, or a null item, do not rank; a null group is a group of its own;
    null ties come last; the same row given twice counts twice (dedupe first if an item must count once); groups
    with fewer than ``n`` ranking rows give all; an empty table gives no rows; columns other than the four named are
    ignored, so clashing names do no harm.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(
        F.col(group).alias("g"), F.col(item).alias("i"), rank_score(F.col(score)).alias("s"), F.col(tie).alias("t")
    ).where("s IS NOT NULL AND i IS NOT NULL")
    rows = materialize(rows, "topn")
    order = [F.desc("s"), F.asc_nulls_last("t"), F.asc("i")]

    sizes = rows.groupBy("g").agg(F.count("*").alias("n_rows"))
    total = rows.count()
    least = max(hot_rows, -(-total // MAX_HOT_GROUPS))
    hot_keys = sizes.where(F.col("n_rows") >= least).select("g", F.lit(True).alias("hot"))
    # Of N rows at most N / least groups have `least` rows, and least >= N / MAX_HOT_GROUPS.
    keys = bounded_broadcast(hot_keys, MAX_HOT_GROUPS, 64)

    light = rows.join(keys, rows["g"].eqNullSafe(keys["g"]), "left_anti")
    light = light.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("r") <= n)

    hot = rows.join(keys, rows["g"].eqNullSafe(keys["g"]), "left_semi")
    # Bounds of equal shares of each hot group, nearly exact; they only steer the balance, not the result.
    shares = F.array(*[F.lit(k / (RANGES + 1)) for k in range(1, RANGES + 1)])
    cuts = hot.groupBy(F.col("g").alias("cg")).agg(F.percentile_approx("s", shares, F.lit(1000)).alias("cuts"), F.count("*").alias("n_hot"))
    slices = F.greatest(F.lit(SLICES), F.ceil(F.col("n_hot") / (RANGES * SLICE_ROWS)))
    cuts = cuts.select("cg", "cuts", slices.alias("slices"))
    cuts = bounded_broadcast(cuts, MAX_HOT_GROUPS, 64 + 8 * RANGES)
    salted = hot.join(cuts, F.col("g").eqNullSafe(F.col("cg"))).select(
        "g",
        "i",
        "s",
        "t",
        F.size(F.filter("cuts", lambda c: c > F.col("s"))).alias("range"),
        F.pmod(F.xxhash64("i", "t"), F.col("slices")).alias("slice"),
    )
    by_salt = Window.partitionBy("g", "range", "slice").orderBy(*order)
    merged = Window.partitionBy("g").orderBy(*order)
    hot = (
        salted.withColumn("r", F.row_number().over(by_salt))
        .where(F.col("r") <= n)
        .select("g", "i", "s", "t", F.row_number().over(merged).alias("r"))
        .where(F.col("r") <= n)
    )
    both = light.select("g", "i", "s", "t", "r").unionByName(hot)
    return both.select(
        F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("t").alias(tie), F.col("r").alias("rank")
    )
