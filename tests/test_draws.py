"""Random k's that stream against those of ``random_k``."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.functions import stats as T
from plumbline.operators import deciding as J
from plumbline.operators import diversity as D
from plumbline.operators import draws as W
from plumbline.operators import inference as I
from plumbline.operators import reporting as P
from plumbline.operators import resampling as B
from plumbline.operators import selection as S

KINDS = "pool_id long, idx long, label string, score double, keep boolean, country int, template int"


def world(spark, sizes, seed=3):
    r = random.Random(seed)
    rows = [(p if p else None, 7 * i * i, r.choice([None, "a", "b", "c", "d"]), r.random(), r.choice([True, True, False, None]), p % 3, p % 2) for p, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, KINDS)


@pytest.fixture(params=[4_000_000, 60])
def held(request, monkeypatch):
    """With few priorities held at once, pools span many batches."""
    monkeypatch.setattr(W, "HELD", request.param)


def test_priorities_are_md5():
    heads, tails = ["null#1", "null#10", "x" * 20, "y" * 60], ["", "#1#2", "#é", "#" + "z" * 33, "#" + "z" * 70]
    first = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:16], 16)
    for some in (tails, tails[:4], tails[:2]):
        assert W.priorities(heads, some).tolist() == [[first(h + t) for t in some] for h in heads]


def test_null_entropy_is_that_of_random_k(spark, held):
    df = world(spark, [20, 5, 40, 1, 16, 90])
    got = {r[0]: r[1:] for r in W.null_entropy(df, 6, 12).collect()}
    e = D.label_entropy(S.random_k(df, 6, 12), ["pool_id", "draw"]).groupBy("pool_id").agg(F.avg("entropy"), F.stddev_samp("entropy"))
    expected = {r[0]: r[1:] for r in e.collect()}
    assert got.keys() == expected.keys()
    for p, x in expected.items():
        assert got[p] == pytest.approx(x, abs=1e-9)


def test_null_rarefied_is_that_of_random_k(spark, held):
    df = world(spark, [20, 5, 40, 1, 16, 90])
    got = {r[0]: r[1:] for r in W.null_rarefied(df, 8, 4, 12).collect()}
    null = S.random_k(df, 8, 12)
    n = null.groupBy("pool_id", "draw").agg(F.count_if("keep").alias("n"))
    d = D.rarefaction(null.where("keep"), ["pool_id", "draw"], 4).select(F.col("pool_id").alias("p"), F.col("draw").alias("at"), "rarefied")
    j = n.join(d, F.col("pool_id").eqNullSafe(F.col("p")) & (F.col("draw") == F.col("at")), "left").groupBy("pool_id").agg(F.avg("n"), F.avg(F.ln("rarefied")))
    expected = {r[0]: r[1:] for r in j.collect()}
    assert got.keys() == expected.keys()
    for p, (kept, log) in expected.items():
        assert got[p][0] == pytest.approx(kept) and (got[p][1] is None if log is None else math.isclose(got[p][1], log, abs_tol=1e-9))


def test_drawn_labels_are_those_of_random_k(spark, held):
    df = world(spark, [20, 5, 40, 1, 16, 90])
    got = {(r["pool_id"], r["country"], r["draw"]): r["labels"] for r in W.drawn_labels(df, 6, 5, "country").collect()}
    s = S.random_k(df, 6, 5).where("label IS NOT NULL").groupBy("pool_id", "country", "draw").agg(F.sort_array(F.collect_set("label")))
    assert got == {tuple(r[:3]): r[3] for r in s.collect()}


def test_what_draws_of_labels_hash_is_not_shuffled(spark):
    plan = W.drawn_labels(world(spark, [20, 30]), 6, 5, "country")._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange", 1)
    assert "concat_ws" in above and "concat_ws" not in below


def test_what_draws_of_contrasts_hash_is_not_shuffled(spark):
    plan = I.pool_contrast(world(spark, [20, 30]), 8, 16)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    drawn = next(i for i, x in enumerate(lines) if "MapInArrow" in x)
    shuffle = next(i for i, x in enumerate(lines) if i > drawn and "Exchange" in x)
    assert any("concat_ws" in x for x in lines[drawn:shuffle]) and not any("concat_ws" in x for x in lines[shuffle:])


@pytest.mark.parametrize("of", ["contrast", "endpoint"])
def test_draws_are_not_shuffled(spark, of):
    df = world(spark, [20, 30])
    made = I.pool_contrast(df, 8, 16) if of == "contrast" else I.endpoint(df, 8, 4, 200)
    assert "sequence" not in made._jdf.queryExecution().executedPlan().toString()  # no row is repeated for its draws


def test_dose_rows_shuffle_no_draw(spark):
    rows = J.dose_rows(world(spark, [20, 30]), [4, 8], 50)
    assert "sequence" not in rows._jdf.queryExecution().executedPlan().toString()


def test_dose_rows_are_endpoints_of_each_k_drawn_at_once(spark, held):
    df, ks = world(spark, [20, 30, 5, 90, 24, 9]).withColumn("label", F.coalesce("label", F.lit("e"))), [4, 8, 24]
    rows = J.dose_rows(df, ks, 12)
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # one pass over the items draws for every k
    got = {(r["k"], r["pool_id"]): r for r in rows.collect()}
    expected = {(k, r["pool_id"]): r for k in ks for r in I.endpoint(df, k, 4, 12).where(f"n_pool >= {k}").collect()}
    assert got.keys() == expected.keys() and {k for k, _ in got} == set(ks)
    for key, r in expected.items():
        for c in r.asDict():
            assert got[key][c] == (pytest.approx(r[c], abs=1e-9) if isinstance(r[c], float) else r[c]), (key, c)


def test_endpoints_shuffle_the_items_once(spark):
    plan = J.dose_rows(world(spark, [20, 30]), [4, 8], 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_reason_histogram_shuffles_the_items_once(spark, held):
    df = world(spark, [20, 30, 5, 90, 24, 9, 40])
    h = P.reason_histogram(J.dose_rows(df, [4, 8], 12), ["k"])
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan  # the items, and the counts of reasons
    pools, expected = {}, Counter()
    for r in df.where("pool_id IS NOT NULL").collect():
        pools.setdefault(r["pool_id"], []).append((-r["score"], r["keep"] is True))
    for k in (4, 8):
        for rows in pools.values():
            rows.sort()
            if len(rows) >= k:
                few, lacking = sum(x for _, x in rows[:k]) < 4, T.hypergeom_below(len(rows), sum(x for _, x in rows), k, 4) > I.MAX_LACKING
                if few or lacking:
                    expected[k, "selection keeps too few" if few else "null draws keep too few"] += 1
    assert {(r["k"], r["reason"]): r["pools"] for r in h.collect()} == expected and len(expected) > 2


def test_best_of_pools_that_span_batches_are_those_of_top_k(spark, held):
    odd = F.when(F.col("idx") % 3 == 0, F.lit(None)).when(F.col("idx") % 5 == 0, F.lit(math.nan)).otherwise(F.round("score", 1))  # nulls, NaN and ties
    df = world(spark, [20, 5, 40, 1, 16, 90]).withColumn("score", odd)
    got = {(r["pool_id"], r["k"]): r for r in W.kept_parts(df, [4, 8], 4, 12).collect()}
    n = {r[0]: r[1:] for r in df.groupBy("pool_id").agg(F.count("*"), F.count_if("keep")).collect()}
    assert got.keys() == {(p, k) for p in n for k in (4, 8)}
    for k in (4, 8):
        top = S.top_k(df, k)
        kept = {r[0]: r[1] for r in top.groupBy("pool_id").agg(F.count_if("keep")).collect()}
        d = {r["pool_id"]: r["rarefied"] for r in D.rarefaction(top.where("keep"), ["pool_id"], 4).collect()}
        for p, (items, good) in n.items():
            r, x = got[p, k], d.get(p)
            assert (r["n_pool"], r["n_kept"], r["kept_selected"]) == (items, good, kept[p])
            assert r["log_selected"] is None if x is None else math.isclose(r["log_selected"], math.log(x), abs_tol=1e-9)


def test_places_of_a_resample_are_hashed_as_whole_arrays(spark, monkeypatch):
    n = 700  # more than FEW_TAILS
    df = spark.range(n).selectExpr("1.5D AS cell", "id AS unit", "if(id % 7 = 0, NULL, id) AS v").unionByName(spark.sql("SELECT 2.0D AS cell, 5000L AS unit, 3L AS v"))
    made = B.resample(df, ["cell"], "unit", 9)
    assert made.columns == ["cell", "draw", "place", "unit", "v"] and "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    at = lambda d, p: int(hashlib.md5(f"boot#{d}#1.5#{p}".encode()).hexdigest()[:8], 16) % n
    expected = [(1.5, d, p, at(d, p), at(d, p) if at(d, p) % 7 else None) for d in range(1, 10) for p in range(1, n + 1)] + [(2.0, d, 1, 5000, 3) for d in range(1, 10)]
    assert sorted(map(tuple, made.collect()), key=lambda r: r[:3]) == sorted(expected, key=lambda r: r[:3])
    monkeypatch.setattr(W, "ARRAY", 64)
    tails = [str(i) for i in range(n)]
    assert W.leading(["a#", "bc#"], tails).tolist() == [[int(hashlib.md5((h + t).encode()).hexdigest()[:8], 16) for t in tails] for h in ("a#", "bc#")]
