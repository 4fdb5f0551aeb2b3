import hashlib
import math

import pytest

from plumbline.functions import stats as T
from plumbline.operators import inference as I
from plumbline.operators import integrity as C
from plumbline.operators import resampling as B


def test_distributions():
    assert T.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert T.t_ppf(0.95, 3) == pytest.approx(2.353363435, abs=1e-8)
    assert T.f_upper(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-8)
    assert T.hypergeom_below(9, 7, 4, 3) == pytest.approx(21 / 126)


def test_equivalence_verdicts():
    assert I.equivalence(0.0, 0.01, 20).verdict == "equivalent"
    assert I.equivalence(-0.5, 0.05, 20).verdict == "harmful"
    assert I.equivalence(-0.09, 0.05, 20).verdict == "inconclusive"
    assert I.equivalence(-0.5, 0.05, 20, thin=True).verdict == "non_estimable"
    assert I.equivalence(0.0, 0.01, 20, expected=8, found=7).verdict == "non_estimable"
    assert (I.LOW_MARGIN, I.HIGH_MARGIN) == (math.log(0.9), math.log(1.1))


def test_moments_average_templates_then_countries(spark):
    rows = [("x", "A", v) for v in (0.0, 2.0)] + [("x", "B", v) for v in (4.0, 6.0, 8.0)] + [("y", "A", v) for v in (1.0, 1.0)]
    cells = I.cell_moments(spark.createDataFrame(rows, "country string, template string, delta double"))
    m = I.marginal_moments(cells).first()
    assert m["theta"] == pytest.approx(((1 + 6) / 2 + 1) / 2)
    assert m["se"] == pytest.approx(math.sqrt((1 + 4 / 3) / 16)) and not m["thin"]


def test_heterogeneity_of_countries(spark):
    rows = [(c, t, (5.0 if c == "x" else 0.0) + v) for c in "xyz" for t in "AB" for v in (0.1, 0.0, -0.1)]
    cells = I.cell_moments(spark.createDataFrame(rows, "country string, template string, delta double"))
    assert I.heterogeneity(I.country_moments(cells))["verdict"] == "heterogeneous"


def test_contrast_of_a_selection_that_follows_the_label(spark):
    rows = [(p, i, "top" if i < 20 else f"l{i % 7}", float(-i), p % 2, 0) for p in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "pool_id long, idx long, label string, score double, country int, template int")
    assert all(r["delta"] < -1 for r in I.pool_contrast(df, 16, 8).collect())


def test_endpoint_selects_before_it_filters(spark):
    rows = [(1, i, f"l{i % 4}", float(-i), i >= 10, 0, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "pool_id long, idx long, label string, score double, keep boolean, country int, template int")
    r = I.endpoint(df, 16, 8, 4).first()
    assert r["kept_selected"] == 6 and r["non_estimable"] and r["reason"].startswith("selection keeps too few")


def test_endpoint_takes_the_lacking_share_exactly(spark):
    rows = [(p, i, f"l{i % 5}", float(-i), i % 4 != 0, 0, 0) for p in range(40) for i in range(64)]
    df = spark.createDataFrame(rows, "pool_id long, idx long, label string, score double, keep boolean, country int, template int")
    got = I.endpoint(df, 16, 8, 16).collect()
    assert {r["lacking"] for r in got} == {T.hypergeom_below(64, 48, 16, 8)} and not any(r["non_estimable"] for r in got)


def test_resamples_keep_cell_sizes(spark):
    df = spark.range(30).selectExpr("id % 3 AS cell", "id AS unit", "CAST(id AS double) AS v")
    n = B.resample(df, ["cell"], "unit", 4).groupBy("draw", "cell").count().collect()
    assert len(n) == 12 and {r["count"] for r in n} == {10}
    r = B.bootstrap_mean(df, ["cell"], "unit", "v", 40).first()
    assert r["estimate"] == pytest.approx(14.5) and r["lo"] < 14.5 < r["hi"]


def test_resamples_look_units_up_in_packed_cells(spark, monkeypatch):
    rows = [(f"c{i % 3}" if i < 29 else None, i, float(i * i)) for i in range(31)]
    df = spark.createDataFrame(rows, "cell string, unit long, v double")
    cells = {c: [(u, v) for k, u, v in rows if k == c] for c in ("c0", "c1", "c2")}
    at = lambda c, d, p: int(hashlib.md5(f"boot#{d}#{c}#{p}".encode()).hexdigest()[:8], 16) % len(cells[c])
    expected = sorted((c, d, p, *cells[c][at(c, d, p)]) for c in cells for d in range(1, 13) for p in range(1, len(cells[c]) + 1))
    packed = B.resample(df, ["cell"], "unit", 12)
    assert sorted(map(tuple, packed.select("cell", "draw", "place", "unit", "v").collect())) == expected
    assert "Join" not in packed._jdf.queryExecution().executedPlan().toString()  # no row of a resample is shuffled
    monkeypatch.setattr(B, "PACKED_UNITS", 9)  # c2 is packed, the larger cells are joined
    mixed = B.resample(df, ["cell"], "unit", 12)
    assert sorted(map(tuple, mixed.select("cell", "draw", "place", "unit", "v").collect())) == expected


def test_half_samples_and_permutations(spark):
    df = spark.range(7).selectExpr("1 AS cell", "id AS unit", "CAST(id AS string) AS label")
    assert B.half_samples(df, ["cell"], "unit", 2).groupBy("draw").count().collect()[0]["count"] == 4
    p = B.permuted(df, ["cell"], "unit", "label", 2)
    assert sorted(r["label"] for r in p.where("draw = 1").collect()) == list("0123456")


def test_integrity(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "g int, k string")
    have = spark.createDataFrame([("a",), ("c",), ("c",)], "k string")
    rows = {r["g"]: r for r in C.completeness(left, have, "g", "k").collect()}
    assert rows[2]["complete"] and rows[1]["missing"] == ["b"]
    assert [r["k"] for r in C.resume(left, have, "k").collect()] == ["b"]
    with pytest.raises(Exception, match="repeats"):
        C.join_checked(left, have, ["k"]).collect()
    a = spark.createDataFrame([("a", 1)], "k string, v int")
    b = spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    assert sorted(tuple(r) for r in C.first_wins([a, b], ["k"]).collect()) == [("a", 1), ("b", 3)]


def test_weighted_draws_follow_the_weights_with_and_without_groups(spark):
    df = spark.createDataFrame([("g", "a", 6.0), ("g", "b", 3.0), ("g", "c", 1.0)], "g string, v string, w double")
    whole = [r["v"] for r in B.weighted_draws(df, "w", "v", 2000).collect()]
    assert len(whole) == 2000 and whole.count("a") / 2000 == pytest.approx(0.6, abs=0.05) and whole.count("c") / 2000 == pytest.approx(0.1, abs=0.04)
    assert B.weighted_draws(df, "w", "v", 50, group="g").count() == 50
