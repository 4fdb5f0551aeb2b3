import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import runtime
from plumbline.operators import concepts
from plumbline.operators import deciding as J
from plumbline.operators import diversity as D
from plumbline.operators import inference as I
from plumbline.operators import integrity as C
from plumbline.operators import selection as S
from plumbline.operators import worlds as W
from plumbline.sources import stores

ITEMS = "pool_id long, idx long, label string, score double, country int, template int"

# ---- planted worlds, from items to verdicts


def deltas(world, label="label"):
    return I.pool_contrast(world.withColumn("label", F.col(label)), 16, 20)


@pytest.mark.parametrize("taste,noise,verdicts", [(1, 0.1, {"harmful"}), (1, 3.0, {"harmful", "inconclusive"}), (1, 20.0, {"equivalent"}), (0, 1.0, {"equivalent"})])
def test_worlds_get_their_verdict(spark, taste, noise, verdicts):
    d = I.country_marginal(deltas(W.planted_world(spark, taste, noise)), 8)
    assert d["verdict"] in verdicts and (noise > 0.1 or d["estimate"] < -0.5)


def test_a_reader_that_merges_labels_is_told_from_a_loss(spark):
    world = W.planted_world(spark, 0, 1.0, merge=0.1)
    machine, truth = deltas(world, "machine"), deltas(world)
    assert I.country_marginal(machine, 8)["estimate"] < -0.1 and abs(I.country_marginal(truth, 8)["estimate"]) < 0.06
    gaps = machine.select("pool_id", "country", "template", F.col("delta").alias("m")).join(truth.select("pool_id", "delta"), "pool_id").withColumn("gap", F.col("m") - F.col("delta"))
    assert J.gap_test(gaps, "gap", 8)["verdict"] == "harmful"
    same = gaps.withColumn("gap", F.lit(0.0))
    d = J.gap_test(same, "gap", 8)
    assert d["verdict"] == "non_estimable" and d["exact_agreement"] and not J.gap_test(same.where("country > 0"), "gap", 8)["exact_agreement"]


def test_planted_heterogeneity_is_found_and_needs_disjoint_intervals(spark):
    d = deltas(W.planted_world(spark, 1, {c: 0.1 if c < 4 else 20.0 for c in range(8)}))
    countries = I.country_moments(I.cell_moments(d))
    wide = countries.select("country", (F.col("mean") - 3 * F.sqrt("var")).alias("lo"), (F.col("mean") + 3 * F.sqrt("var")).alias("hi"))
    verdict = J.heterogeneity_verdict(countries, wide)
    assert verdict["verdict"] == "heterogeneous"
    assert J.heterogeneity_verdict(countries, wide.withColumn("lo", F.lit(-9.0)))["verdict"] == "not_shown"
    assert J.heterogeneity_verdict(countries, wide.withColumn("lo", F.lit(None).cast("double")))["verdict"] == "non_estimable"
    p = J.recentred_p(d, 30).first()["p"]
    assert p < 0.05
    rule = J.spread_rule(countries, wide, verdict, p, True)
    assert rule["claim"] and rule["status"] == "heterogeneous_spread_established" and rule["holm_p"] == max(p, verdict["p"])
    assert J.spread_rule(countries, wide, verdict, p, False)["status"] == "non_estimable_incomplete_design"
    rows = {r["country"]: r for r in wide.collect()}
    assert rule["lcb"] == pytest.approx(max(rows[a]["lo"] - rows[b]["hi"] for a in rows for b in rows if a != b))


def test_errors_of_the_reader_leave_labels_out(spark):
    world = W.planted_world(spark, 0, 1.0, error=0.2, countries=2, pools=1)
    assert 0.1 < world.where("machine IS NULL").count() / world.count() < 0.3
    assert deltas(world, "machine").where("delta IS NOT NULL").count() == 0  # labels are missing: that is the endpoint's work


# ---- contrasts


def test_small_pools_and_missing_labels_have_no_contrast(spark):
    rows = [(1, i, f"l{i % 3}", float(i), 0, 0) for i in range(9)] + [(2, i, None if i == 3 else "a", float(i), 0, 0) for i in range(20)] + [(3, i, f"l{i % 4}", float(i), 0, 0) for i in range(20)]
    got = {r["pool_id"]: r["delta"] for r in I.pool_contrast(spark.createDataFrame(rows, ITEMS), 16, 4).collect()}
    assert got[1] is None and got[2] is None and got[3] is not None


def test_endpoint_ladder_and_shares(spark):
    rows = [(1, i, "a", float(i), True, 0, 0) for i in range(9)] + [(2, i, f"l{i % 4}", float(-i), i % 2 == 0 or i < 16, 0, 0) for i in range(64)]
    got = {r["pool_id"]: r for r in I.endpoint(spark.createDataFrame(rows, "pool_id long, idx long, label string, score double, keep boolean, country int, template int"), 16, 8, 30).collect()}
    assert got[1]["reason"] == "pool smaller than k" and got[1]["delta"] is None and got[1]["lacking"] is None
    assert got[2]["selected_deficit"] == 0 and 0.2 < got[2]["kept_shift"] < 0.6


def test_a_batch_with_a_missing_label_counts(spark):
    rows = [(1, i, None if i in (3, 12) else f"l{i % 4}", 0.0, 0, 0) for i in range(16)]
    assert D.batched_vendi(spark.createDataFrame(rows, ITEMS), ["pool_id"]).count() == 1


def test_best_of_n_takes_the_whole_pool_once(spark):
    rows = [(p, i, "a", float(i), 0, 0) for p, n in ((1, 8), (2, 5)) for i in range(n)]
    got = S.best_of_n(spark.createDataFrame(rows, ITEMS), [4, 8], 2, 3).groupBy("pool_id", "size").agg(F.countDistinct("draw").alias("d")).collect()
    assert {(r["pool_id"], r["size"]): r["d"] for r in got} == {(1, 4): 3, (1, 8): 1, (2, 4): 3}


def test_greedy_vendi_equals_trying_every_item():
    rng = np.random.default_rng(0)
    for gamma in (0.0, 0.5):
        e, s = rng.normal(size=(14, 5)), rng.normal(size=14)
        u, z = e / np.linalg.norm(e, axis=1, keepdims=True), (s - s.mean()) / (s.std() + 1e-12)
        want = [int(z.argmax())]
        while len(want) < 5:
            value = {i: S.log_vendi(u[[*want, i]]) + gamma * z[[*want, i]].mean() for i in range(14) if i not in want}
            want.append(max(value, key=lambda i: (round(value[i], 10), -i)))
        assert S.greedy_vendi(s, e, 5, gamma) == want


def test_frontier_rows_have_a_random_baseline(spark):
    rng = np.random.default_rng(1)
    rows = [(p, i, int(rng.integers(4)), float(rng.normal()), [float(x) for x in rng.normal(size=4)], float(rng.normal())) for p in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "pool_id int, idx int, label int, score double, embedding array<double>, judge double")
    got = S.frontier_rows(df, S.run_selectors(df, 4, [("topk", 0.0), ("mmr", 0.5)]), ["family", "param"], 4, 6).collect()
    assert len(got) == 9 and all(r["delta"] == r["emb_delta"] == r["raw_gain"] == 0 for r in got if r["family"] == "random")
    S.register_selector("first", lambda s, e, k, _: list(range(k)))
    try:
        assert {r["idx"] for r in S.run_selectors(df, 2, [("first", 0.0)]).collect()} == {0, 1}
        with pytest.raises(ValueError):
            S.register_selector("first", None)
    finally:
        del S.SELECTORS["first"]
    assert {r["idx"] for r in S.random_direction(df.where("pool_id = 0"), 20, [1.0, 0, 0, 0]).collect()} == set(range(20))


# ---- designs, resampling and rules


def design(spark, rng, thin=False):
    rows = [(c, t, f"{c}{t}{p}", float(1 + 0.1 * rng.normal()), float(0.95 + 0.1 * rng.normal())) for c in "xyz" for t in "AB" for p in range(1 if thin and c == "x" else 6)]
    return spark.createDataFrame(rows, "country string, template string, pool_id string, top_g double, kept double").withColumn("g", F.col("kept") - F.col("top_g"))


def test_fixed_design_intervals_and_thin_cells(spark):
    df = design(spark, np.random.default_rng(0))
    r = J.fixed_design(df, ["top_g"], [], 60).first()
    cells = {}
    for x in df.collect():
        cells.setdefault((x["country"], x["template"]), []).append(x["top_g"])
    want = np.mean([np.mean([np.mean(cells[c, t]) for t in "AB"]) for c in "xyz"])
    assert r["mean"] == pytest.approx(want) and r["lo"] < r["boot_lo"] + 0.05 and r["lo"] < want < r["hi"] and r["p_le_0"] < 1e-6 and not r["non_estimable"]
    thin = J.fixed_design(design(spark, np.random.default_rng(0), True), ["top_g"], [], 10).first()
    assert thin["non_estimable"] and thin["mean"] is None and "fewer than two" in thin["reason"]
    kept = J.retention(df, "g", 60)
    assert kept["gate"] and kept["retained"] == pytest.approx(0.95, abs=0.08) and kept["lo"] < kept["retained"] < kept["hi"]
    assert J.retention(df.withColumn("top_g", -F.col("top_g")), "g", 20)["retained"] is None


def test_intervals_are_withheld_if_the_statistic_is_often_missing(spark):
    df = design(spark, np.random.default_rng(2))
    r = J.paired_bootstrap(df, ["top_g", "g"], F.when(F.col("top_g") > 5, F.col("g")), 20).first()
    assert r["value"] is None and r["lo"] is None and r["finite"] == 0
    stat = F.col("s") / F.col("n")
    c = J.cluster_bootstrap(df, ["country"], "pool_id", {"s": F.sum("g"), "n": F.count("*")}, stat, 40, by=["country"]).collect()
    assert len(c) == 3 and all(r["lo"] <= r["value"] <= r["hi"] for r in c)


def test_welch_difference_and_statistic(spark):
    x, y = [1.0, 2.0, 4.0, 3.5], [0.5, 0.7, 0.1]
    df = spark.createDataFrame([("a", v) for v in x] + [("b", v) for v in y] + [("b", float("nan"))], "g string, v double")
    d = J.welch_difference(df, "g", "a", "b", "v")
    vx, vy = np.var(x, ddof=1) / 4, np.var(y, ddof=1) / 3
    assert d["difference"] == pytest.approx(np.mean(x) - np.mean(y)) and d["df"] == pytest.approx((vx + vy) ** 2 / (vx**2 / 3 + vy**2 / 2))
    assert J.welch_difference(df.where("g = 'a'"), "g", "a", "b", "v")["difference"] is None
    countries = spark.createDataFrame([(1, "x", 0.1, 0.01, 5.0), (1, "y", 0.5, 0.02, 6.0), (1, "z", 0.2, 0.005, 7.0)], "k int, country string, mean double, var double, df double")
    assert J.welch_statistic(countries, ["k"]).first()["f"] == pytest.approx(I.welch([0.1, 0.5, 0.2], [0.01, 0.02, 0.005], [5, 6, 7])[0])


def test_equivalence_of_exchangeable_pools(spark):
    few = spark.createDataFrame([(0.0,), (0.01,), (float("nan"),)], "delta double")
    assert I.equivalence_iid(few).verdict == "non_estimable"
    many = spark.createDataFrame([(-0.2 + 0.01 * k,) for k in range(6)], "delta double")
    assert I.equivalence_iid(many).verdict == "harmful" and I.equivalence_iid(many.withColumn("delta", F.lit(0.0))).verdict == "non_estimable"
    assert I.equivalence(-0.13, 0.01, 10).hi == pytest.approx(-0.13 + 1.812461 * 0.01, abs=1e-6)


def test_holm_and_claims():
    assert J.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06]) and J.holm([None, 0.01, math.nan]) == pytest.approx([1.0, 0.03, 1.0])
    loss, moments = {"verdict": "harmful"}, {"theta": -0.5, "se": 0.05, "df": 20.0}
    spread = {"status": "heterogeneous_spread_established", "claim": True, "holm_p": 0.001}
    front = {"p": 0.001, "lo": 0.02, "top_lo": 0.3, "retained": 0.95}
    got = J.claims(loss, moments, {"verdict": "equivalent", "reason": None}, spread, front)
    assert all(c["claimed"] for c in got)
    a1 = J.claims(loss, moments, {"verdict": "harmful", "reason": None}, spread, front)[0]
    assert a1["status"] == "stop_rule" and not a1["claimed"]
    assert J.claims(loss, moments, {"verdict": "inconclusive", "reason": None}, spread, None)[0]["status"] == "unvalidated"
    assert J.claims(loss, moments, None, spread, None)[0]["withheld"][0].startswith("the reader's gap is missing")
    a3 = J.claims(loss, moments, None, spread, {**front, "retained": 0.8})[2]
    assert not a3["claimed"] and len(a3["withheld"]) == 1


def test_verdicts_of_intervals(spark):
    v = ["better", "worse", "tie", "n/e"]
    df = spark.createDataFrame([(a, b) for a in v for b in v], "g string, d string").withColumn("x", J.dominance_of(F.col("g"), F.col("d")))
    got = {(r["g"], r["d"]): r["x"] for r in df.collect()}
    assert got["better", "tie"] == "dominates" and got["tie", "worse"] == "dominated" and got["tie", "tie"] == "tie" and got["better", "worse"] == "trade-off" and got["n/e", "better"] == "n/e"
    one = spark.createDataFrame([(0.5, 0.0, 1.0, 2.0, 10.0, 20.0, 5.0)], "g double, a double, b double, c double, x double, y double, z double")
    cols = [F.col(c) for c in "abcxyz"]
    assert one.select(J.matched_gain(F.col("g"), cols[:3], cols[3:])).first()[0] == 15.0
    assert one.select(J.matched_gain(F.lit(3.0), cols[:3], cols[3:])).first()[0] is None


def test_photo_sets_are_spread_and_whole(spark):
    photos = spark.createDataFrame([("x", f"d{k % 9}", f"i{k}") for k in range(90)] + [("y", "only", "j1")], "country string, dish_id string, image_id string")
    sets = J.spread_sets(photos, 6, 30).collect()
    by = {}
    for r in sets:
        by.setdefault(r["set"], []).append(r)
    assert all(r["country"] == "x" for r in sets) and len({v[0]["dishes"] for v in by.values()}) > 3
    assert all(len(v) == len({r["image_id"] for r in v}) == 6 and len({r["dish_id"] for r in v}) == v[0]["dishes"] for v in by.values())
    t = J.tracking(spark.createDataFrame([(f"s{k}", 0.2 + 0.01 * k, 0.2 + 0.01 * k) for k in range(40)], "set string, truth double, read double"), 500).first()
    assert t["slope"] == pytest.approx(1) and t["sign_agree"] == t["sign_agree_large"] == 1


def test_country_cosines_equal_all_pairs(spark):
    rng = np.random.default_rng(0)
    e, c = rng.normal(size=(30, 4)), rng.integers(3, size=30)
    df = spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in zip(c, e)] + [(0, None)], "c int, e array<double>")
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    g = u @ u.T
    for r in D.country_cosines(df, "c", "e").collect():
        mine = c == r["c"]
        n = mine.sum()
        assert r["own"] == pytest.approx((g[np.ix_(mine, mine)].sum() - n) / (n * (n - 1))) and r["other"] == pytest.approx(g[np.ix_(mine, ~mine)].mean())


def test_vendi_of_small_and_large_groups_agree(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(g, k, [float(x) for x in rng.normal(size=4)]) for g, n in (("a", 3), ("b", 30), (None, 5)) for k in range(n)] + [("a", 9, None)]
    df = spark.createDataFrame(rows, "g string, idx int, embedding array<double>").repartition(3)
    small = {r["g"]: (r["n"], r["log_vendi"]) for r in D.vendi(df, ["g"]).collect()}
    monkeypatch.setattr(D, "SMALL_GROUP", 4)
    mixed = {r["g"]: (r["n"], r["log_vendi"]) for r in D.vendi(df, ["g"]).collect()}
    assert small == {k: (n, pytest.approx(v)) for k, (n, v) in mixed.items()} and small["a"][0] == 3 and small[None][0] == 5
    u = np.stack([r[2] for r in rows if r[0] == "b"])
    assert small["b"][1] == pytest.approx(S.log_vendi(u / np.linalg.norm(u, axis=1, keepdims=True)))


def test_diversity_at_a_size_and_its_edges(spark):
    rows = [("a", "x")] * 3 + [("a", "y")] * 3 + [("b", "x"), ("b", "y"), ("c", "x"), ("d", None)]
    got = {r["g"]: (r["at"], r["diversity"]) for r in D.diversity_at(spark.createDataFrame(rows, "g string, label string"), ["g"], 4).collect()}
    assert got["a"] == (4, pytest.approx(D.rarefied([3, 3], 4))) and got["b"] == (2, pytest.approx(1.0)) and got["c"] == (1, None) and "d" not in got


def test_country_loss_at_a_fixed_rank(spark):
    rng = np.random.default_rng(5)
    x = {"a": rng.normal(size=(30, 6)) * [5, 3, 1, 0, 0, 0], "b": rng.normal(size=(4, 6)), None: np.ones((3, 6))}
    rows = [(g, [float(v) for v in r]) for g, e in x.items() for r in e]
    df = spark.createDataFrame([*rows, ("a", None)], "g string, embedding array<double>").repartition(4)
    w = rng.normal(size=6)
    for rank, variance in ((2, None), (10, None), (1, 0.8)):
        for r in concepts.country_loss(df, "g", list(w), rank, variance).collect():
            e = x[r["g"]] - x[r["g"]].mean(0)
            _, s, v = np.linalg.svd(e, full_matrices=False)
            real = int((s > 1e-8 * s[0]).sum()) if s[0] > 1e-9 else 0
            keep = min(rank, real) if variance is None else min(int(np.searchsorted(np.cumsum(s[:real] ** 2) / (s[:real] ** 2).sum(), variance) + 1), real) if real else 0
            assert (r["rank"], r["loss"]) == (keep, pytest.approx(np.linalg.norm(v[:keep] @ w) / np.linalg.norm(w), abs=1e-6))


# ---- stores, checks and written tables


def test_stores_append_template_and_differences(spark, tmp_path):
    path = str(tmp_path / "rows")
    for k in (1, 2):
        stores.append_jsonl(spark.createDataFrame([(f"i{k}", 0.5, "t")], "image_id string, score double, text string"), path)
    assert stores.read_jsonl(spark, path, "image_id string, score double, text string").count() == 2
    sheet = str(tmp_path / "sheet")
    stores.write_annotation_template(spark.createDataFrame([("i1", "x", "p", "f", 0.9)], "image_id string, country string, prompt_id string, path string, score double"), sheet)
    assert "score" not in spark.read.option("header", True).csv(sheet).columns
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0), ("y", 2.5)], "k string, v double")
    assert {r["k"] for r in C.differing(a, b, ["k"], "v", 0.1).collect()} == {"y", "z"}
    versions = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("y", 1, None)], "k string, at int, v string")
    assert {(r["k"], r["v"]) for r in C.latest(versions, ["k"], "at").collect()} == {("x", "new"), ("y", None)}


def test_written_tables_are_shared_and_removed(spark, monkeypatch):
    monkeypatch.setattr(runtime, "_WRITTEN", [])
    monkeypatch.setattr(runtime, "_CACHED", {})
    made = []
    build = lambda: made.append(1) or spark.range(3)
    assert runtime.cached(spark, ("k", 1), build).count() == runtime.cached(spark, ("k", 1), build).count() == 3 and len(made) == 1
    assert runtime.clean(spark) == 1 and runtime.cached(spark, ("k", 1), build).count() == 3 and len(made) == 2
    assert runtime.clean(spark) == 1


def test_salted_joins_equal_broadcast_ones(spark, monkeypatch):
    left = spark.createDataFrame([(k % 3 if k % 7 else None, k) for k in range(60)], "k int, v int")
    right = spark.createDataFrame([(0, "a"), (2, "b")], "k int, w string")
    for how in ("inner", "left"):
        want = {tuple(r) for r in runtime.salted_join(left, right, ["k"], 2, 16, how).select("k", "v", "w").collect()}
        with monkeypatch.context() as m:
            m.setattr(runtime, "BROADCAST_LIMIT_BYTES", 0)
            assert {tuple(r) for r in runtime.salted_join(left, right, ["k"], 2, 16, how).select("k", "v", "w").collect()} == want


def test_spread_resamples_its_pools_once(spark, monkeypatch):
    from plumbline.plans import deciding as P

    seen, rule = [], J.spread_rule
    monkeypatch.setattr(J, "spread_rule", lambda countries, intervals, *rest: seen.extend([countries, intervals]) or rule(countries, intervals, *rest))
    d = W.planted_world(spark, 1, 1.0).groupBy("country", "template", "pool_id").agg(F.avg("score").alias("delta"))
    monkeypatch.setattr(P, "contrast", lambda *_: d)
    assert P._spread(spark, "")["status"].startswith(("het", "non"))
    for df in seen:  # read several times, so a written row a country
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 8 and "Aggregate" not in plan and "Generate" not in plan


def test_gains_are_written_once_and_shared(spark, monkeypatch):
    from plumbline.plans import deciding as P

    monkeypatch.setattr(P, "items", lambda *_: W.planted_world(spark, 1, 1.0))
    made = P.gains(spark, "planted")
    assert made is P.gains(spark, "planted") and "Window" not in made._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in made.collect()} == {tuple(r) for r in P._gains(spark, "planted").collect()}
