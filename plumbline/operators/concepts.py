"""Concept subspaces of embeddings: their directions, removal, and the loss they predict."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.selection import _unit


def orthonormal(vectors: np.ndarray, tolerance: float = 1e-8) -> np.ndarray:
    """An orthonormal basis (columns) of the span of the rows, null directions dropped."""
    if len(vectors) == 0:
        return np.zeros((vectors.shape[1], 0))
    _, s, v = np.linalg.svd(np.asarray(vectors, float), full_matrices=False)
    return v[s > tolerance * max(s[0], 1e-300)].T


def moments(df: DataFrame, vector: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sum and second moment of unit vectors; each task sends one d x d sum, whatever the number of rows."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, m = 0, None, None
        for pdf in batches:
            rows = pdf[vector].dropna()
            if len(rows):
                u = _unit(np.stack(rows).astype(float))
                n += len(u)
                s = u.sum(0) if s is None else s + u.sum(0)
                m = u.T @ u if m is None else m + u.T @ u
        if n:
            yield pd.DataFrame([(n, s, m.ravel())], columns=["n", "s", "m"])

    parts = df.select(F.col(vector).cast("array<double>").alias(vector)).mapInPandas(sums, "n long, s array<double>, m array<double>")
    cells = parts.select("n", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("s").alias("x")), F.struct(F.lit(1).alias("kind"), F.col("m").alias("x")))).alias("c"))
    cells = cells.select("n", "c.kind", F.posexplode("c.x").alias("at", "x"))
    out = cells.groupBy("kind", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("kind", "at").collect()
    if not out:
        return 0, np.zeros(0), np.zeros((0, 0))
    s = np.array([r["x"] for r in out if r["kind"] == 0])
    return out[0]["n"], s, np.array([r["x"] for r in out if r["kind"] == 1]).reshape(len(s), len(s))


def global_subspace(df: DataFrame, rank: int, vector: str = "embedding") -> np.ndarray:
    """The leading principal directions of the centred unit vectors."""
    n, s, m = moments(df, vector)
    if n == 0:
        return np.zeros((0, 0))
    w, v = np.linalg.eigh(m / n - np.outer(s, s) / n**2)
    return v[:, ::-1][:, :rank]


def differential_subspace(df: DataFrame, rank: int, group: str, value: str, q: float = 0.75, vector: str = "embedding") -> np.ndarray:
    """Directions from each group's rows at or below the ``q`` quantile of a value to those above it, stacked over groups, uncentred."""
    cut = df.where(F.col(value).isNotNull() & F.col(vector).isNotNull())
    cut = cut.join(cut.groupBy(group).agg(F.percentile(value, q).alias("cut")), group)
    cells = cut.select(group, (F.col(value) > F.col("cut")).alias("hi"), F.posexplode(vector).alias("at", "x"))
    means = cells.groupBy(group, "at").agg((F.avg(F.when(F.col("hi"), F.col("x"))) - F.avg(F.when(~F.col("hi"), F.col("x")))).alias("d"))
    rows = means.where("d IS NOT NULL").groupBy(group).agg(F.sort_array(F.collect_list(F.struct("at", "d"))).alias("d")).collect()
    if not rows:
        return np.zeros((0, 0))
    d = np.array([[x["d"] for x in r["d"]] for r in rows])
    return orthonormal(_unit(d))[:, :rank]


def _literal(basis: np.ndarray) -> list[Column]:
    return [F.array(*[F.lit(float(x)) for x in column]) for column in basis.T]


def _less(v: Column, b: Column, times: Column) -> Column:
    return F.zip_with(v, b, lambda x, y: x - y * times)


def neutralized(vector: Column, basis: np.ndarray, strength: float = 1.0) -> Column:
    """The vector less ``strength`` times its projection on an orthonormal basis, as a Column."""
    v = F.transform(vector, lambda x: x.cast("double"))
    for b in _literal(basis):
        along = F.aggregate(F.zip_with(v, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        v = _less(v, b, along * strength)
    return v


def predicted_loss(directions: DataFrame, concept: np.ndarray, group: str, vector: str = "direction") -> DataFrame:
    """``(group, loss)``: the share of each group's preference direction that lies within a concept subspace."""
    squares = F.lit(0.0)
    for b in _literal(concept):
        along = F.aggregate(F.zip_with(vector, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        squares = squares + along * along
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return directions.select(group, F.when(norm > 0, F.sqrt(squares) / norm).alias("loss"))


def country_loss(
    df: DataFrame, group: str, direction: list[float], rank: int = 16, variance: float | None = None, vector: str = "embedding"
) -> DataFrame:
    """``(group, rank, loss)``: the share of a scorer's direction within the span of a group's centred vectors, cut to the ``rank`` leading directions, the same
    for all groups so that a large vocabulary does not span everything; or, as a variant, to as many as explain the share ``variance``. Directions
    without variance never count. Counts, sums and second moments are added up in Spark from each batch, so groups may have any size."""
    kind = dict(df.dtypes)[group]
    w = np.asarray(direction, float)

    def moments_by_group(batches):
        for pdf in batches:
            for key, part in pdf.groupby(group, dropna=False):
                x = np.stack(part[vector]).astype(float)
                flat = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                yield pd.DataFrame({group: pd.Series([None if key != key else key], dtype=object), "m": [flat]})

    rows = df.select(group, F.col(vector).cast("array<double>").alias(vector)).where(F.col(vector).isNotNull())
    parts = rows.mapInPandas(moments_by_group, f"`{group}` {kind}, m array<double>").select(group, F.posexplode("m").alias("at", "x"))
    sums = parts.groupBy(group, "at").agg(F.sum("x").alias("x")).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("m"))

    @F.pandas_udf("struct<rank: int, loss: double>")
    def within(m: pd.Series) -> pd.DataFrame:
        out = []
        for flat in m:
            flat = np.asarray(flat, float)
            d = len(w)
            n, s, q = flat[0], flat[1 : d + 1], flat[d + 1 :].reshape(d, d)
            values, vectors = np.linalg.eigh(q - np.outer(s, s) / n)
            values, vectors = values[::-1], vectors[:, ::-1]
            real = int((values > 1e-16 * max(values[0], 1e-300)).sum()) if values[0] > 1e-12 * max(np.trace(q), 1e-300) else 0
            keep = rank if variance is None else int(np.searchsorted(np.cumsum(values[:real]) / values[:real].sum(), variance) + 1) if real else 0
            keep = min(keep, real)
            out.append((keep, float(np.linalg.norm(vectors[:, :keep].T @ w) / (np.linalg.norm(w) + 1e-12))))
        return pd.DataFrame(out, columns=["rank", "loss"])

    return sums.select(group, within(F.transform("m", lambda x: x["x"])).alias("r")).select(group, "r.*")


def stereotype_shift(items: DataFrame, selected: DataFrame, prototype: DataFrame, pool: str = "pool_id", label: str = "label") -> DataFrame:
    """``(pool, shift)``: mean prototypicality of the selection less that of the pool, in the pool's sample standard deviations."""
    p = prototype.select(label, F.col("proto"))
    whole = items.join(p, label).groupBy(pool).agg(F.avg("proto").alias("m"), F.stddev_samp("proto").alias("sd"))
    mine = selected.join(p, label).groupBy(pool).agg(F.avg("proto").alias("s"))
    return whole.join(mine, pool).select(pool, F.when(F.col("sd") > 0, (F.col("s") - F.col("m")) / F.col("sd")).alias("shift"))
