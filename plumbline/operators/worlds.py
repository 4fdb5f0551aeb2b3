"""Planted worlds: pools whose true effect is known, to test selection, contrast and verdict from end to end."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(salt: str, *keys: Column) -> Column:
    """A number above 0 and at most 1 for the keys, from the first 32 bits of their md5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(salt), *[k.cast("string") for k in keys])), 1, 8), 16, 10)
    return (bits.cast("double") + 1.0) / 4294967296.0


def normal(salt: str, *keys: Column) -> Column:
    return F.sqrt(-2.0 * F.ln(uniform(f"{salt}-r", *keys))) * F.cos(2 * math.pi * uniform(f"{salt}-a", *keys))


def planted_world(
    spark: SparkSession, taste: float, noise: float | dict[int, float], merge: float = 0.0, error: float = 0.0, countries: int = 8,
    pools: int = 4, n: int = 96, labels: int = 24, exponent: float = 1.1, seed: int = 0,
) -> DataFrame:
    """``(pool_id, country, template, idx, label, machine, score)``: labels by Zipf's law in each country, and a score that prefers the most common one.

    The score is ``taste`` for an item of the first label, and ``noise`` (which may differ by country) times a normal number. ``label`` is true; ``machine``
    is what a reader says that calls the best-scored share ``merge`` of a pool by the first label, and with chance ``error`` says nothing. Taste makes a loss
    of diversity that both show; merging one that only the machine shows.
    """
    weights = [1 / (k + 1) ** exponent for k in range(labels)]
    upto = [sum(weights[: k + 1]) / sum(weights) for k in range(labels)]
    rows = spark.range(countries * 2 * pools * n).select(
        F.expr(f"id DIV {n}").alias("pool_id"), (F.col("id") % n).cast("int").alias("idx"), F.expr(f"id DIV {n * pools * 2}").cast("int").alias("country"),
        (F.expr(f"id DIV {n * pools}") % 2).cast("int").alias("template"),
    )
    keys = (F.lit(seed), F.col("pool_id"), F.col("idx"))
    u = uniform("label", *keys)
    which = F.size(F.filter(F.array(*map(F.lit, upto[:-1])), lambda c: c < u))
    name = F.when(which < 4, F.concat(F.lit("shared-"), which)).otherwise(F.concat_ws("-", F.lit("local"), "country", which))
    if isinstance(noise, dict):
        spread = F.try_element_at(F.create_map(*[F.lit(x) for kv in noise.items() for x in kv]), F.col("country"))
    else:
        spread = F.lit(float(noise))
    rows = rows.withColumn("label", name).withColumn("score", F.when(which == 0, float(taste)).otherwise(0.0) + spread * normal("noise", *keys))
    from pyspark.sql import Window

    w = Window.partitionBy("pool_id").orderBy(F.desc("score"), "idx")
    merged = F.when(F.row_number().over(w) <= round(merge * n), "shared-0").otherwise(F.col("label"))
    return rows.withColumn("machine", F.when(uniform("error", *keys) > error, merged))
