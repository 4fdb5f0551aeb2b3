import math
from itertools import combinations

import numpy as np
import pytest

from plumbline.operators import diversity as D
from plumbline.operators import ranking as R


def labels(spark, values, pool=1):
    return spark.createDataFrame([(pool, i, v) for i, v in enumerate(values)], "pool_id long, idx long, label string")


@pytest.mark.parametrize("values, vendi", [("abcd", 4.0), ("aaaa", 1.0), ("aabb", 2.0)])
def test_vendi_of_labels(spark, values, vendi):
    assert D.label_entropy(labels(spark, values), ["pool_id"]).first()["vendi"] == pytest.approx(vendi)


@pytest.mark.parametrize("values, want", [("a" * 8 + "b" * 8, 0.125), ("ab" * 8, 0.25)])
def test_batches_depend_on_order(spark, values, want):
    assert D.batched_vendi(labels(spark, values), ["pool_id"]).first()["diversity"] == pytest.approx(want)


@pytest.mark.parametrize("counts, want", [([2, 2], 5 / 6), ([3, 1], 3 / 4), ([4], 1 / 2)])
def test_exact_rarefaction(counts, want):
    assert D.rarefied(counts, 2) == pytest.approx(want)


def test_rarefaction_equals_enumeration():
    values = "aabbbcdd"
    mean = np.mean([math.exp(-sum(s.count(x) / 3 * math.log(s.count(x) / 3) for x in set(s))) / 3 for s in combinations(values, 3)])
    assert D.rarefied([2, 3, 1, 2], 3) == pytest.approx(float(mean))


def test_rarefaction_of_too_few_is_not_estimable(spark):
    r = D.rarefaction(labels(spark, "ab"), ["pool_id"], 3).first()
    assert r["non_estimable"] and r["rarefied"] is None


def test_vendi_of_vectors_from_moments(spark):
    rng = np.random.default_rng(0)
    e = rng.normal(size=(30, 4))
    df = spark.createDataFrame([(1, i, [float(x) for x in v]) for i, v in enumerate(e)], "pool_id long, idx long, embedding array<double>")
    got = D.vendi(df.repartition(3), ["pool_id"]).first()
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    w = np.linalg.eigvalsh(u @ u.T / 30)
    w = w[w > 1e-12]
    assert got["n"] == 30 and got["log_vendi"] == pytest.approx(float(-(w * np.log(w)).sum()))


def test_jaccard_mode_and_auc(spark):
    df = spark.createDataFrame([("x", 1, "a"), ("x", 1, "b"), ("x", 2, "b"), ("x", 2, "c"), ("x", 3, None)], "country string, pool_id long, label string")
    assert D.set_jaccard(df, "country", "pool_id").first()["jaccard"] == pytest.approx(1 / 3)
    assert D.modal_label(df, ["pool_id"]).where("pool_id = 1").first()["modal"] == "a"
    s = spark.createDataFrame([(1, 1.0, True), (1, 1.0, False), (1, 2.0, True), (1, 0.0, False), (1, None, True)], "g int, s double, pos boolean")
    assert D.rank_auc(s, ["g"], s["s"], s["pos"]).first()["auc"] == pytest.approx(3.5 / 4)


def test_quartiles_are_not_ntiles(spark):
    b = R.ranked_bins(spark.range(78).selectExpr("1 AS pool_id", "id AS idx", "CAST(id AS double) AS score"), "pool_id")
    assert [r["count"] for r in b.groupBy("bin").count().orderBy("bin").collect()] == [20, 19, 20, 19]


def test_holm(spark):
    df = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, 0.03)], "fam string, pos int, p double")
    assert [r["holm_p"] for r in R.holm(df, "p", "pos", ["fam"]).orderBy("pos").collect()] == pytest.approx([0.03, 0.06, 0.06])


def test_pearson_interval(spark):
    df = spark.createDataFrame(list(zip(range(1, 9), [1, 3, 2, 5, 4, 7, 6, 8])), "x int, y int").selectExpr("1 AS g", "x", "y")
    r = R.pearson_interval(df, ["g"], "x", "y").first()
    assert (r["r"], r["lo"], r["hi"]) == pytest.approx((0.92857142857, 0.64774040, 0.98724881), abs=1e-7)
