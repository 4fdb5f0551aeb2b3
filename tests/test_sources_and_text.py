import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.sources import stores as O


def test_jsonl_tolerates_a_torn_tail_only(spark, tmp_path):
    p = tmp_path / "scores.jsonl"
    p.write_text('{"image_id": "a", "score": 1.5, "text": "t"}\n\n{"image_id": "b", "sc')
    assert [r["image_id"] for r in O.read_jsonl(spark, str(p), O.SCORES).collect()] == ["a"]
    p.write_text('{"image_id": "b", "sc\n{"image_id": "a", "score": 1.5, "text": "t"}\n')
    with pytest.raises(ValueError):
        O.read_jsonl(spark, str(p), O.SCORES)
    assert O.read_jsonl(spark, str(tmp_path / "none.jsonl"), O.SCORES).count() == 0


def test_vocabulary_and_annotations(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"vocab": {"x": ["b", "a"]}, "kb_prominence": {"x": {"a": 0.7}}}')
    assert [tuple(r) for r in O.read_vocabulary(spark, str(tmp_path / "v.json")).collect()] == [("x", "a", 0.7), ("x", "b", None)]
    assert O.read_vocabulary(spark, str(tmp_path / "v.json"), 0.5).count() == 1
    (tmp_path / "a.csv").write_text("image_id,country,artifact,adjudicated\ni1,x,soup,Yes\ni2,x,,1\ni3,x,pie,no\n")
    assert [tuple(r) for r in O.read_annotations(spark, str(tmp_path / "a.csv")).orderBy("image_id").collect()] == [("i1", "x", "soup"), ("i2", "x", "unresolved")]
    (tmp_path / "b.csv").write_text("image_id,country,artifact\ni1,x,soup\ni1,x,pie\n")
    with pytest.raises(ValueError):
        O.read_annotations(spark, str(tmp_path / "b.csv"))


def test_wide_photos_and_aliases(spark):
    df = spark.createDataFrame([("d", "p1", None)], "name string, image1 string, image2 string")
    assert [(r["slot"], r["image"]) for r in O.unpivot_photos(df, ["image1", "image2"]).collect()] == [("image1", "p1")]
    a = spark.createDataFrame([("['x', {'name': 'y'}]",), ("bad(",), (None,)], "a string").select(O.parse_aliases("a").alias("a"))
    assert [r["a"] for r in a.collect()] == [["x", "y"], [], []]
    c = spark.createDataFrame([('["x"]',), ('["x","y"]',), ("x",), ("z",)], "c string")
    assert c.where(O.only_country("c", ["x"])).count() == 2


def test_result_document_keeps_provenance(tmp_path):
    p = str(tmp_path / "r.json")
    O.write_result({"provenance": 1, "a": 2}, p)
    O.write_result({"provenance": 1, "b": 3}, p)
    with pytest.raises(ValueError):
        O.write_result({"provenance": 2}, p)


@pytest.mark.parametrize("text, want", [("The Feijão (stew)", "feijao"), ("Fish & Chips_hot-pot", "fish and chips hot pot"), ("そば", "そば"), (None, "")])
def test_normalize(text, want):
    assert X.normalize_text(text) == want


def test_text_columns(spark):
    df = spark.createDataFrame([("ab", "ba"), ("soup", "soap"), ("soup", "soups"), ("soup", "soup"), ("abcd", "badc")], "x string, y string")
    assert [r[0] for r in df.select(X.one_edit(F.col("x"), F.col("y"))).collect()] == [True, True, True, False, False]
    r = spark.createDataFrame([('so {"dish": "Pie", "country": 5} ok',), ("{bad",), (None,)], "r string")
    assert [tuple(x) for x in r.select(X.json_field(F.col("r"), "dish"), X.json_field(F.col("r"), "country")).collect()] == [("Pie", None), (None, None), (None, None)]
    known = {"japan": "Japan", "japanese": "Japan", "us": "United States"}
    c = spark.createDataFrame([("JAPAN",), ("Japanese cuisine",), ("n/a",), ("new land",), ("us food",)], "c string")
    assert [x[0] for x in c.select(X.normalize_country(F.col("c"), known)).collect()] == ["Japan", "Japan", "unknown", "New Land", "Us Food"]
    i = spark.createDataFrame([("g", "p", 7, 3), ("g#", "p", 7, 3), ("g", "p", 7, 12345)], "g string, p string, s long, i int")
    ids = [x[0] for x in i.select(X.image_id(F.col("g"), F.col("p"), F.col("s"), F.col("i"))).collect()]
    assert ids == ["g#p#7#0003", None, "g#p#7#12345"]
