"""Bootstrap, permutation and subsampling with md5 priorities, which any engine can reproduce."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from plumbline.operators.draws import leading
from plumbline.operators.selection import priority, with_draws
from plumbline.runtime import materialize


def hashed_index(n: Column, salt: str, *keys: str) -> Column:
    """A number from 1 to n for the keys: the first 32 bits of their md5, modulo n."""
    return F.conv(F.substring(priority(salt, *keys), 1, 8), 16, 10).cast("long") % n + 1


def with_index(df: DataFrame, cell: list[str], unit: str) -> DataFrame:
    """Adds ``_i``, the unit's place in its cell, and ``_m``, the cell's size."""
    w = Window.partitionBy(*cell)
    return df.withColumn("_i", F.row_number().over(w.orderBy(unit))).withColumn("_m", F.count("*").over(w))


#: A cell of up to so many units is held in one task; the draws of such a cell are dealt over so many tasks, which give so many rows at once.
PACKED_UNITS, DRAW_BLOCKS, RESAMPLED = 1_000_000, 8, 100_000


def resample(df: DataFrame, cell: list[str], unit: str, draws: int, salt: str = "boot") -> DataFrame:
    """``draws`` resamples with replacement of every cell's units, of the cell's size: the rows of ``df`` with ``draw`` and ``place``.

    Each place of each draw points at an index of its cell by hash, so nothing depends on partitioning. The numbered units are written once;
    a unit with a null in its cell's keys has no cell. Every block of draws gets a copy of a cell and looks its places up in it, in md5 of whole arrays, so no row of a resample is shuffled;
    the places of cells above ``PACKED_UNITS`` find their units by an equi-join on (cell, index).
    """
    known = df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in cell]))
    indexed = materialize(with_index(known, cell, unit), "units")
    most = indexed.agg(F.max("_m")).first()[0] or 0
    parts = [_packed(indexed.where(F.col("_m") <= PACKED_UNITS), df.columns, cell, draws, salt)]
    if most > PACKED_UNITS:
        large = indexed.where(F.col("_m") > PACKED_UNITS)
        places = with_draws(large.select(*cell, F.col("_i").alias("place"), "_m"), draws)
        wanted = places.withColumn("_i", hashed_index(F.col("_m"), salt, "draw", *cell, "place")).drop("_m")
        parts.append(wanted.join(large.drop("_m"), [*cell, "_i"]).select(parts[0].columns))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _packed(indexed: DataFrame, columns: list[str], cell: list[str], draws: int, salt: str) -> DataFrame:
    """The resamples of cells that each fit in a task: every block of draws gets a cell's units, in their order, as rows that stream."""
    others, blocks = [c for c in columns if c not in cell], min(draws, DRAW_BLOCKS)
    tasks = 2 * indexed.sparkSession.sparkContext.defaultParallelism
    name = F.concat_ws("#", *[F.col(c).cast("string") for c in cell]).alias("_cell")
    dealt = indexed.select(*cell, *others, "_i", "_m", name, F.explode(F.sequence(F.lit(1), F.lit(blocks))).alias("_block"))
    dealt = dealt.repartition(tasks, *cell, "_block").sortWithinPartitions(*cell, "_block", "_i")
    kinds = {f.name: f for f in indexed.schema}
    schema = StructType([*[kinds[c] for c in cell], StructField("draw", IntegerType()), StructField("place", IntegerType()), *[kinds[c] for c in others]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        missing = 0

        def drawn() -> Iterator[pa.RecordBatch]:
            units = pa.concat_tables(parts).combine_chunks()
            n, key, block = units.num_rows, units.column("_cell")[0].as_py(), units.column("_block")[0].as_py()
            own, rest, tails = units.select(cell), units.select(others), [str(x) for x in range(1, n + 1)]
            mine = list(range(block, draws + 1, blocks))
            step = max(1, RESAMPLED // n)
            for lo in range(0, len(mine), step):
                some = mine[lo : lo + step]
                at = (leading([f"{salt}#{d}#{key}#" for d in some], tails) % np.uint64(n)).astype(np.int64).ravel()
                places = {"draw": np.repeat(np.array(some, np.int32), n), "place": np.tile(np.arange(1, n + 1, dtype=np.int32), len(some))}
                same, picked = own.take(pa.array(np.zeros(len(at), np.int64))), rest.take(pa.array(at))
                made = {c: same.column(c) for c in cell} | {c: pa.array(x) for c, x in places.items()} | {c: picked.column(c) for c in others}
                yield from pa.table({f.name: made[f.name] for f in schema}).combine_chunks().to_batches(max_chunksize=RESAMPLED)

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                missing = missing or batch.column("_m")[lo].as_py()
                part = batch.slice(lo, min(missing, batch.num_rows - lo))
                parts.append(pa.Table.from_batches([part]))
                lo, missing = lo + part.num_rows, missing - part.num_rows
                if not missing:
                    yield from drawn()
                    parts.clear()

    return dealt.mapInArrow(run, schema)


def bootstrap_mean(df: DataFrame, cell: list[str], unit: str, value: str, draws: int, salt: str = "boot", outer: list[str] | None = None) -> DataFrame:
    """``(outer, estimate, lo, hi, draws)``: percentile interval of the mean over cells of the cells' means.

    Each level of ``cell`` beyond ``outer`` is averaged with equal weight, from the innermost outwards.
    """
    outer = outer or []

    def nested(rows: DataFrame, keys: list[str]) -> DataFrame:
        level = rows.groupBy(*keys, *cell).agg(F.avg(value).alias("m"))
        for depth in range(len(cell) - 1, len(outer) - 1, -1):
            level = level.groupBy(*keys, *cell[:depth]).agg(F.avg("m").alias("m"))
        return level

    point = nested(df, []).withColumnRenamed("m", "estimate")
    reps = nested(resample(df, cell, unit, draws, salt), ["draw"])
    ci = reps.groupBy(*outer).agg(
        F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"), F.count("m").alias("draws")
    )
    return point.join(ci, outer) if outer else point.crossJoin(ci)


def bootstrap_ratio(df: DataFrame, cell: list[str], cluster: str, num: str, den: str, draws: int, salt: str = "ratio") -> DataFrame:
    """``(estimate, lo, hi)`` of sum(num) / sum(den) when whole clusters are resampled within cells; clusters are summed first."""
    sums = df.groupBy(*cell, cluster).agg(F.sum(num).alias("num"), F.sum(den).alias("den"))
    ratio = F.when(F.sum("den") != 0, F.sum("num") / F.sum("den"))
    point = sums.agg(ratio.alias("estimate"))
    reps = resample(sums, cell, cluster, draws, salt).groupBy("draw").agg(ratio.alias("r"))
    return point.crossJoin(reps.agg(F.percentile("r", 0.025).alias("lo"), F.percentile("r", 0.975).alias("hi")))


def bootstrap_any(df: DataFrame, cell: list[str], unit: str, value: str, statistic: Callable[[pd.Series], float], draws: int, salt: str = "any") -> DataFrame:
    """``(estimate, lo, hi)`` of any statistic of a column of values, given as a function of a pandas Series; a resample's values meet in one task, so
    the units should be pools or other aggregates."""

    @F.pandas_udf("double")
    def stat(v: pd.Series) -> float:
        return float(statistic(v))

    point = df.agg(stat(F.col(value).cast("double")).alias("estimate"))
    reps = resample(df, cell, unit, draws, salt).groupBy("draw").agg(stat(F.col(value).cast("double")).alias("s"))
    return point.crossJoin(reps.agg(F.percentile("s", 0.025).alias("lo"), F.percentile("s", 0.975).alias("hi")))


def hashed_subset(df: DataFrame, group: list[str], item: str, size: int, salt: str = "subset") -> DataFrame:
    """A random ``size`` of each group's items, by hash."""
    w = Window.partitionBy(*group).orderBy(priority(salt, *group, item), item)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_r")


def half_samples(df: DataFrame, cell: list[str], unit: str, draws: int, salt: str = "half") -> DataFrame:
    """The units of each cell's random half, rounded up, without replacement, in each draw."""
    d = with_draws(df.withColumn("_m", F.count("*").over(Window.partitionBy(*cell))), draws)
    d = d.withColumn("_p", priority(salt, "draw", *cell, unit))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("draw", *cell).orderBy("_p", unit)))
    return d.where(F.col("_r") <= F.ceil(F.col("_m") / 2)).drop("_m", "_p", "_r")


def permuted(df: DataFrame, stratum: list[str], unit: str, label: str, draws: int, salt: str = "shuffle") -> DataFrame:
    """The rows with their labels permuted within strata in each draw."""
    w = Window.partitionBy("draw", *stratum)
    d = with_draws(df, draws).withColumn("_p", priority(salt, "draw", *stratum, unit))
    d = d.withColumn("_from", F.row_number().over(w.orderBy(unit))).withColumn("_to", F.row_number().over(w.orderBy("_p", unit)))
    keys = ["draw", *stratum]
    labels = d.select(*keys, F.col("_to").alias("_from"), F.col(label).alias("_label"))
    return d.drop(label, "_to", "_p").join(labels, [*keys, "_from"]).withColumnRenamed("_label", label).drop("_from")


#: Parts of the unit interval in which draws find their step of the ladder of cumulative weights.
LADDER_PARTS = 1_000


def weighted_draws(df: DataFrame, weight: str, value: str, n: int, salt: str = "zipf", group: str | None = None) -> DataFrame:
    """``n`` draws with replacement of a value with chances in proportion to its weight, by the cumulative weights."""
    keys = [group] if group else []
    w = Window.partitionBy(*keys).orderBy(value)
    upto = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(Window.partitionBy(*keys))
    ladder = df.select(*keys, value, (upto / total).alias("hi"), ((upto - F.col(weight)) / total).alias("lo"))
    groups = df.select(*keys).distinct() if group else df.sparkSession.range(1).select()
    draws = with_draws(groups, n)
    u = (F.conv(F.substring(priority(salt, *keys, "draw"), 1, 8), 16, 10).cast("double")) / F.lit(4294967296.0)
    # Numbers and steps of the ladder meet in parts of the unit interval, so each is compared with few.
    part = lambda x: F.floor(F.col(x) * LADDER_PARTS)
    draws = draws.withColumn("u", u).withColumn("_part", part("u"))
    ladder = ladder.withColumn("_part", F.explode(F.sequence(part("lo"), part("hi"))))
    joined = draws.join(ladder, [*keys, "_part"])
    return joined.where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select(*keys, "draw", value)


def max_modulus(reps: DataFrame, points: DataFrame, group: str) -> DataFrame:
    """Simultaneous intervals: (group, estimate, lo, hi) from (draw, group, m, se) and (group, estimate, se), by the 95 % quantile over draws of the
    greatest studentized deviation; draws with a zero spread are discarded, and more than 1 % of them make it null."""
    j = reps.join(points.select(group, F.col("estimate").alias("e0")), group)
    t = j.groupBy("draw").agg(F.max(F.abs(F.col("m") - F.col("e0")) / F.when(F.col("se") > 0, F.col("se"))).alias("t"), F.count_if(~(F.col("se") > 0)).alias("bad"))
    q = t.agg(F.percentile(F.when(F.col("bad") == 0, F.col("t")), 0.95).alias("q"), F.avg((F.col("bad") > 0).cast("double")).alias("bad"))
    q = q.select(F.when(F.col("bad") <= 0.01, F.col("q")).alias("q"))
    return points.crossJoin(F.broadcast(q)).select(
        group, "estimate", (F.col("estimate") - F.col("q") * F.col("se")).alias("lo"), (F.col("estimate") + F.col("q") * F.col("se")).alias("hi")
    )
