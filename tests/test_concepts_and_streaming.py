import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import concepts as M
from plumbline.streaming import incremental as N


def vectors(spark, e, **extra):
    rows = [(k, [float(x) for x in v], *[c[k] for c in extra.values()]) for k, v in enumerate(e)]
    kinds = ", ".join(f"{n} {'string' if isinstance(c[0], str) else 'double'}" for n, c in extra.items())
    return spark.createDataFrame(rows, "idx long, embedding array<double>" + (", " + kinds if kinds else ""))


def test_orthonormal_drops_null_directions():
    b = M.orthonormal(np.array([[1.0, 0, 0], [2.0, 0, 0], [0, 3.0, 0]]))
    assert b.shape == (3, 2) and b.T @ b == pytest.approx(np.eye(2))


def test_global_subspace_is_that_of_the_covariance(spark):
    e = np.random.default_rng(0).normal(size=(50, 4)) * [5, 1, 1, 1] + [9, 0, 0, 0]
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    got = M.global_subspace(vectors(spark, e).repartition(3), 1)[:, 0]
    assert abs(got @ np.linalg.eigh(np.cov(u.T, bias=True))[1][:, -1]) == pytest.approx(1, abs=1e-9)


def test_neutralized_vectors_are_orthogonal_to_the_basis(spark):
    e = np.random.default_rng(1).normal(size=(5, 4))
    b = M.orthonormal(np.random.default_rng(2).normal(size=(2, 4)))
    got = np.array([r[0] for r in vectors(spark, e).orderBy("idx").select(M.neutralized(F.col("embedding"), b)).collect()])
    assert got == pytest.approx(e - e @ b @ b.T)


def test_differential_direction_is_what_the_value_follows(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=(400, 3)) * 0.1
    value = rng.normal(size=400)
    e[:, 1] += value
    df = vectors(spark, e, g=["a" if k % 2 else "b" for k in range(400)], value=[float(x) for x in value])
    assert abs(M.differential_subspace(df, 1, "g", "value")[1, 0]) > 0.95


def test_predicted_loss(spark):
    df = spark.createDataFrame([("in", [1.0, 0.0]), ("out", [0.0, 2.0]), ("zero", [0.0, 0.0])], "g string, direction array<double>")
    got = {r["g"]: r["loss"] for r in M.predicted_loss(df, np.array([[1.0], [0.0]]), "g").collect()}
    assert got == {"in": 1.0, "out": 0.0, "zero": None}


def test_items_are_scored_once(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    write = lambda name, ids: (src / name).write_text("".join(json.dumps({"image_id": i}) + "\n" for i in ids))
    score = lambda df: df.withColumn("score", F.length("image_id"))
    write("1.json", ["a", "b", "b"])
    N.score_once(N.new_items(spark, str(src), "image_id string"), score, out, cp).awaitTermination(120)
    write("2.json", ["b", "ccc"])
    N.score_once(N.new_items(spark, str(src), "image_id string"), score, out, cp).awaitTermination(120)
    assert sorted((r["image_id"], r["score"]) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 1), ("ccc", 3)]
    assert spark.read.parquet(out).select("batch").distinct().count() == 2
