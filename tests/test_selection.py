import numpy as np
import pytest

from plumbline.operators import selection as S

TIED = [0, 1, 2, 1, 2, 1, 0, 0, 2, 1, 2, 0]


def pool(spark, scores, pool_id=1):
    return spark.createDataFrame([(pool_id, i, None if s is None else float(s)) for i, s in enumerate(scores)], "pool_id long, idx long, score double")


def picked(df):
    return [r["idx"] for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("k, want", [(5, [2, 4, 8, 10, 1]), (8, [2, 4, 8, 10, 1, 3, 5, 9])])
def test_top_k_ties_go_to_the_lower_position(spark, k, want):
    assert picked(S.top_k(pool(spark, TIED), k)) == want


def test_top_k_puts_nan_and_null_last(spark):
    assert picked(S.top_k(pool(spark, [float("nan"), 1, None, 2]), 4))[:2] == [3, 1]


def test_random_k_is_matched_and_reproducible(spark):
    df = pool(spark, range(20))
    a = S.random_k(df, 6, 3).orderBy("draw", "idx").collect()
    assert len(a) == 18 and a == S.random_k(df.repartition(3), 6, 3).orderBy("draw", "idx").collect()


def test_allocation_by_largest_remainder(spark):
    rows = [(1, i, "a" if i < 5 else "b" if i < 8 else "c") for i in range(10)]
    q = S.allocate(spark.createDataFrame(rows, "pool_id long, idx long, stratum string"), 4)
    assert {r["stratum"]: r["quota"] for r in q.collect()} == {"a": 2, "b": 1, "c": 1}


def test_allocation_of_more_than_there_is(spark):
    q = S.allocate(spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "pool_id long, idx long, stratum string"), 16)
    assert {r["quota"] for r in q.collect()} == {1}


def test_greedy_selectors():
    rng = np.random.default_rng(0)
    e, s = rng.normal(size=(20, 5)), rng.normal(size=20)
    top = [int(i) for i in np.argsort(-s, kind="stable")[:6]]
    assert S.mmr(s, e, 6, 1.0) == top
    for f, p in ((S.mmr, 0.5), (S.dpp, 1.0), (S.facility_location, 1.0), (S.greedy_vendi, 0.1), (S.k_center, 1.0), (S.strata_by_look, 3)):
        out = f(s, e, 6, p)
        assert len(out) == len(set(out)) == 6
    assert S.mmr(s, e, 6, 0.5) == S.k_center(s, e, 6, 1.0)


def test_dpp_greedy_equals_determinants():
    rng = np.random.default_rng(1)
    e, s = rng.normal(size=(9, 6)), rng.normal(size=9)
    q, u = np.exp(S._z(s) / 2), S._unit(e)
    kernel = q[:, None] * (u @ u.T) * q[None]
    out: list[int] = []
    for _ in range(4):
        best = max((i for i in range(9) if i not in out), key=lambda i: np.linalg.det(kernel[np.ix_([*out, i], [*out, i])]))
        out.append(best)
    assert S.dpp(s, e, 4, 1.0) == out


def test_run_selectors_leaves_out_rows_without_vectors(spark):
    rows = [(1, i, float(i), [1.0, float(i)] if i else None) for i in range(5)]
    df = spark.createDataFrame(rows, "pool_id long, idx long, score double, embedding array<double>")
    out = S.run_selectors(df, 3, [("topk", 0), ("mmr", 0.5)]).collect()
    assert {r["idx"] for r in out if r["family"] == "topk"} == {4, 3, 2} and all(r["idx"] for r in out)


def test_empty_pools(spark):
    assert S.top_k(pool(spark, []), 3).count() == 0
    assert S.allocate(spark.createDataFrame([], "pool_id long, stratum string"), 3).count() == 0


def test_choose_on_tuning_prefers_the_margin_then_gain(spark):
    rows = [("a", 0, c, -0.2, 9.0) for c in (1, 2)] + [("b", 1, c, -0.05, 1.0) for c in (1, 2)] + [("c", 2, c, -0.01, 1.0) for c in (1, 2)] + [("d", 3, 1, 0.0, 99.0)]
    df = spark.createDataFrame(rows, "config string, grid_pos int, country int, delta double, gain double")
    assert S.choose_on_tuning(df, -0.10536).first()["config"] == "b"
    assert S.choose_on_tuning(df.where("config = 'a'"), -0.10536).first()["within_margin"] is False
