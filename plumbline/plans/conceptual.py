"""Queries of concept subspaces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.operators import concepts as M
from plumbline.operators.selection import dot, top_k
from plumbline.plans.base import ITEMS_SQL, items, rounded, vectors

BASIS = np.eye(64)[:, :2]


@query(
    "m10_norms",
    "SELECT vec_id AS idx, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])), 6) AS norm FROM embeddings",
)
def m10(spark, sf):
    return rounded(vectors(spark, sf).select("idx", F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("norm")))


@query(
    "m12_neutralized",
    "SELECT vec_id AS idx, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding[3:]])), 6) AS norm FROM embeddings",
)
def m12(spark, sf):
    """Embeddings without their first two coordinates' directions."""
    v = vectors(spark, sf).select("idx", M.neutralized(F.col("embedding"), BASIS).alias("e"))
    return rounded(v.select("idx", F.sqrt(dot(F.col("e"), F.col("e"))).alias("norm")))


@query("m13_global_subspace")
def m13(spark, sf):
    """How much of each label's mean direction lies in the leading four principal directions."""
    v = vectors(spark, sf)
    cells = v.select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(F.avg("x").alias("x"))
    mean = cells.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("direction"))
    return rounded(M.predicted_loss(mean, M.global_subspace(v, 4), "label"))


@query("m14_differential_subspace")
def m14(spark, sf):
    v = vectors(spark, sf)
    basis = M.differential_subspace(v, 3, "pool_id", "score")
    along = [F.round(F.abs(dot(F.col("embedding"), b)), 6).alias(f"along{k}") for k, b in enumerate(M._literal(basis))]
    return v.select("idx", *along)


@query(
    "m16_stereotype_shift",
    f"""WITH {ITEMS_SQL}, p AS (SELECT label, count(*)::DOUBLE AS proto FROM items GROUP BY label), j AS (SELECT i.*, proto, row_number() OVER (PARTITION BY pool_id ORDER BY score DESC NULLS LAST, idx) <= 16 AS top FROM items i JOIN p USING (label))
    SELECT pool_id, round((avg(proto) FILTER (WHERE top) - avg(proto)) / stddev_samp(proto), 6) AS shift FROM j GROUP BY pool_id""",
)
def m16(spark, sf):
    i = items(spark, sf)
    proto = i.groupBy("label").agg(F.count("*").cast("double").alias("proto"))
    return rounded(M.stereotype_shift(i, top_k(i, 16), proto))


@query("m15_country_loss")
def m15(spark, sf):
    """How much of a direction lies within the span of each label's vectors, at a fixed rank, and at that which explains nine tenths."""
    v = vectors(spark, sf)
    w = [((7 * i + 3) % 11 - 5) / 5.0 for i in range(64)]
    fixed = M.country_loss(v, "label", w, 8).select("label", F.col("loss").alias("fixed"))
    free = M.country_loss(v, "label", w, variance=0.9).select("label", "rank", F.col("loss").alias("free"))
    return rounded(fixed.join(free, "label"))
