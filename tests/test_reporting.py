import io
import json
import tarfile
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import integrity as C
from plumbline.operators import producing as M
from plumbline.operators import reporting as P
from plumbline.operators import resampling as B
from plumbline.operators import selection as S
from plumbline.sources import stores as O


def test_mean_jaccard_equals_all_pairs(spark):
    sets = {0: {"a", "b"}, 1: {"b"}, 2: set(), 3: {"c"}, 4: set(), 5: {"a", "b", "c"}}
    rows = [("x", p, v) for p, s in sets.items() for v in s]
    pools = spark.createDataFrame([("x", p) for p in sets] + [("y", 1), ("y", 2)], "country string, pool_id int")
    got = {r["country"]: r["jaccard"] for r in P.mean_jaccard(spark.createDataFrame(rows, "country string, pool_id int, label string"), ["country"], pools).collect()}
    pairs = [len(a & b) / len(a | b) for a, b in combinations(sets.values(), 2) if a | b]
    assert got == {"x": pytest.approx(np.mean(pairs)), "y": None}


def test_equal_sets_are_counted_not_paired(spark):
    many = spark.range(30_000).selectExpr("'x' AS country", "CASE id % 3 WHEN 0 THEN array('a', 'b') WHEN 1 THEN array('b') ELSE array() END AS s", "array('z') AS one")
    n, empty = 30_000, 10_000  # 450 million pairs of pools, one of different sets with labels
    pairs = n * (n - 1) / 2 - empty * (empty - 1) / 2
    r = P.set_jaccard(many, ["country"], {"both": "s", "same": "one"}).first()
    assert r["both"] == pytest.approx((2 * 10_000 * 9_999 / 2 + 10_000 * 10_000 * 0.5) / pairs) and r["same"] == 1


def test_repetition_sees_what_scores_repeat(spark):
    rows = [("x", p, i, "top" if i < 8 else f"l{(i * 7 + p) % 9}", float(-i)) for p in range(5) for i in range(40)] + [("x", 0, 90, None, -99.0)]
    r = P.repetition(spark.createDataFrame(rows, "country string, pool_id int, idx int, label string, score double"), 8, 12).first()
    assert r["jaccard_top"] == 1 and r["excess"] > 0.3 and r["modal"] == "top" and r["modal_top"] == 1 and r["set_top"] == 1 and r["pools"] == 5
    assert abs(r["excess_matched"]) <= 1 and r["modal_pool"] < 0.25
    t = P.t_interval(spark.createDataFrame([(0.1,), (0.3,), (float("nan"),)], "v double"), "v")
    assert t["mean"] == pytest.approx(0.2) and t["lo"] < 0.2 < t["hi"] and t["positive"] == 2
    assert P.t_interval(spark.createDataFrame([(0.1,)], "v double"), "v")["lo"] is None


def test_formats_and_small_tables(spark):
    df = spark.createDataFrame([(0.5, "a_b"), (float("nan"), "x"), (None, None)], "v double, t string")
    got = df.select(P.shown(F.col("v"), 2).alias("s"), P.shown_p(F.col("v")).alias("p"), P.shown_interval(F.col("v"), F.col("v")).alias("i"), P.latex_escaped(F.col("t")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("+0.50", "0.500", "[+0.5, +0.5]", "a\\_b"), ("n/a", "n/a", "n/a", "x"), ("n/a", "n/a", "n/a", None)]
    assert P.markdown(df.limit(1), ["v", "t"]) == "| v | t |\n|---|---|\n| 0.5 | a_b |"
    reasons = spark.createDataFrame([("few (3)", True), ("few (4)", True), (None, True), ("few (1)", False)], "reason string, non_estimable boolean")
    assert {r["reason"]: r["pools"] for r in P.reason_histogram(reasons, []).collect()} == {"few": 2, "unspecified": 1}


def test_callbacks_and_subsets(spark):
    df = spark.createDataFrame([("x", k, float(k)) for k in range(20)], "c string, u int, v double")
    r = B.bootstrap_any(df, ["c"], "u", "v", lambda v: v.max(), 30).first()
    assert r["estimate"] == 19 and r["lo"] <= r["hi"] <= 19
    assert B.hashed_subset(df, ["c"], "u", 7).count() == 7 and P.capped(df, ["c"], "u", 3).count() == 3
    assert S.facility_location(*facility(), 6, 0.3) == plain_facility(*facility(), 6, 0.3) == S.facility_location(*facility(), 6, 0.3, block=3)


def facility():
    rng = np.random.default_rng(3)
    return rng.normal(size=25), rng.normal(size=(25, 4))


def plain_facility(scores, e, k, beta):
    z, u = (scores - scores.mean()) / (scores.std() + 1e-12), e / np.linalg.norm(e, axis=1, keepdims=True)
    sim, out = (u @ u.T + 1) / 2, []
    for _ in range(k):
        value = [-np.inf if i in out else sim[[*out, i]].max(0).mean() + beta * z[[*out, i]].sum() / k for i in range(len(z))]
        out.append(int(np.argmax(np.round(value, 12))))
    return out


# ---- joins that raise, checks


def test_joins_raise_on_lost_and_mixed_rows(spark):
    items = spark.createDataFrame([("i1", "t", "known"), ("i2", "t", "main")], "image_id string, select_text string, kind string")
    scores = spark.createDataFrame([("i1", 0.5, "t"), ("i2", 0.4, "t")], "image_id string, score double, text string")
    assert C.items_with_scores(items, scores, "image_id", "text", "select_text").count() == 2
    for bad in (scores.where("image_id = 'i1'"), scores.withColumn("text", F.lit("u"))):
        with pytest.raises(PySparkException, match="no score|another text"):
            C.items_with_scores(items, bad, "image_id", "text", "select_text").collect()
    with pytest.raises(PySparkException, match="no tag for i2"):
        C.items_with_tags(items, scores.where("image_id = 'i1'").select("image_id"), "image_id").collect()
    verify = spark.createDataFrame([("i1", None, 0.6)], "image_id string, kept boolean, p_yes double")
    known = F.col("kind") == "known"
    assert {r["image_id"]: r["keep"] for r in C.items_with_verification(items, verify, "image_id", known).collect()} == {"i1": True, "i2": True}
    assert not C.items_with_verification(items, verify, "image_id", known, 0.7).where("image_id = 'i1'").first()["keep"]
    with pytest.raises(PySparkException, match="no verification for i1"):
        C.items_with_verification(items, verify.limit(0), "image_id", known).collect()
    assert C.text_mismatches(items, scores.withColumn("text", F.lit("u")), "image_id", "text", "select_text").count() == 2
    assert C.holds_all(items, items.limit(1), "image_id") and not C.holds_all(items.limit(0), items, "image_id")
    ids = spark.createDataFrame([("g#p#1#0001",), ("g#p#1",), (" ",), (None,), ("g# #1#0001",)], "id string")
    assert C.blank_ids(ids, "id").count() == 4


# ---- stores


def test_knowledge_from_document_archive_and_folder(spark, tmp_path):
    records = [{"country": "x", "name": "pie"}, {"country": "y", "name": None}]
    (tmp_path / "kb").mkdir()
    (tmp_path / "one.json").write_text(json.dumps(records))
    raw = json.dumps(records).encode()
    with tarfile.open(tmp_path / "kb" / "kb.tar.gz", "w:gz") as t:
        for name in ("d/kb.json", "d/._kb.json"):
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
    for path in ("one.json", "kb/kb.tar.gz", "kb"):
        got = O.read_knowledge(spark, str(tmp_path / path), "country string, name string").collect()
        assert sorted((r["country"], r["name"]) for r in got) == [("x", "pie"), ("y", None)], path


def test_vectors_are_not_written_twice_and_results_are_listed(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "image_id string, embedding array<double>")
    out = str(tmp_path / "v")
    assert O.write_vectors(df.limit(1), out) and O.write_vectors(df, out) and not O.write_vectors(df, out)
    assert spark.read.parquet(out).count() == 2
    O.write_result({"generator": "g", "provenance": "p", "x": float("nan"), ("stk", 4): {1.5}}, str(tmp_path / "r.json"))
    (tmp_path / "other.json").write_text("{}")
    assert json.loads((tmp_path / "r.json").read_text()) == {"generator": "g", "provenance": "p", "x": None, "stk|4": [1.5]}
    assert [r["generator"] for r in O.read_results(spark, str(tmp_path)).collect()] == ["g"]
    with pytest.raises(ValueError):
        O.read_results(spark, out)
    (tmp_path / "prompts.json").write_text(json.dumps([{"prompt_id": "p", "text": "t"}, {"prompt_id": "q"}]))
    assert O.read_prompts(spark, str(tmp_path / "prompts.json")).count() == 1
    assert O.reader_path("r", "tags", "sdxl", "qwen") == "r/tags/sdxl.jsonl" and O.reader_path("r", "tags", "sdxl", "x") == "r/tags/sdxl__x.jsonl"


def test_configuration_is_checked_and_counted():
    good = {"domain": "d", "countries": list("abcd"), "templates": ["A", "B"], "n": 64, "n_pools": 4, "k": 16, "m_auth": 8, "secondary_k": 32, "other": 1}
    c = O.RunConfig.of(good)
    assert c.secondary_k == [32] and c.budget()["images"] == 4 * 2 * 4 * 64 and len(c.warnings) == 1
    for change in ({"k": 65}, {"m_auth": 17}, {"secondary_k": [65]}, {"countries": list("aabc")}, {"countries": []}, {"n": 0}, {"n": True}):
        with pytest.raises(ValueError):
            O.RunConfig.of(good | change)
    with pytest.raises(ValueError, match="missing keys: k"):
        O.RunConfig.of({k: v for k, v in good.items() if k != "k"})


# ---- producers


def test_producers_keep_ids_seeds_and_texts(spark):
    specs = spark.createDataFrame([("main", "p", "a pie", "x", "A", 7)], "kind string, prompt_id string, prompt_text string, country string, template string, pool_seed long")
    made = M.generate(specs, "gen@1", 3, lambda prompt, seed: f"{prompt}/{seed}").withColumn("select_text", F.col("prompt_text"))
    rows = made.orderBy("idx").collect()
    assert [r["image_id"] for r in rows] == [f"gen@1#p#7#000{k}" for k in range(3)] and len({r["image_seed"] for r in rows}) == 3
    assert all(r["path"] == f"a pie/{r['image_seed']}" for r in rows)
    scores = M.score(made, lambda paths, texts: paths.str.len() + texts.str.len())
    assert C.items_with_scores(made, scores, "image_id", "text", "select_text").count() == 3
    assert {r["reply"] for r in M.tag(made, lambda paths: pd.Series(["{}"] * len(paths))).collect()} == {"{}"}
    assert {tuple(r["embedding"]) for r in M.embed(made, lambda paths: pd.Series([[1.0, 2.0]] * len(paths))).collect()} == {(1.0, 2.0)}


def test_model_tags_and_options(spark):
    df = spark.createDataFrame([("org/Model-X", ""), ("stabilityai/stable-diffusion-xl-base-1.0", None), ("m", "mine")], "m string, t string")
    assert [r[0] for r in df.select(X.model_tag(F.col("m"), F.col("t"))).collect()] == ["model-x", "sdxl", "mine"]
    o = spark.createDataFrame([(f"i{k}", "pie", ["a", "b", "c"]) for k in range(12)], "i string, d string, x array<string>")
    rows = o.select(*X.choice_options(F.col("i"), F.col("d"), F.col("x"))).collect()
    assert all(len(r[0]) == 5 and r[0][r[1]] == "pie" and r[0][4] == "none of these" for r in rows) and len({r[1] for r in rows}) > 1
