import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import matching as K


def test_normalizing_keeps_other_scripts_and_drops_latin_accents():
    assert X.normalize_text("The  Pâté (pâtisserie) & Co_op-Stew!") == "pate and co op stew"
    assert X.normalize_text("そばガキ") == "そばガキ" and X.normalize_text("がき") == "がき"
    assert X.normalize_text("the") == "the" and X.normalize_text(None) == "" and X.normalize_text("(all)") == ""


def test_steps_take_one_head_at_a_time(spark):
    names = {
        "a bowl of fresh tomme": ["a bowl of fresh tomme", "fresh tomme", "tomme"],
        "two large plates of the traditional pie": ["two large plates of the traditional pie", "the traditional pie", "traditional pie", "pie"],
        "plate lunch": ["plate lunch"], "traditional": ["traditional"], "home made freshly made soup": ["home made freshly made soup", "freshly made soup", "soup"],
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["s"] for r in df.select("n", X.strip_steps(F.col("n")).alias("s")).collect()} == names


def test_spelling_variants_spare_short_words_and_words_of_the_vocabulary(spark):
    words = F.array(F.lit("broccoli"), F.lit("beet"))
    cases = [("borccoli soup", "broccoli soup", True), ("beet soup", "beef soup", False), ("broccoli", "brocccoli", False), ("brocoli pie", "broccoli pie", True),
             ("broccoli soup", "broccoli soup", False), ("brocoli", "broccoli soup", False), ("brcoli soup", "broccoli soup", False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", X.spelling_variant(F.col("a"), F.col("b"), words)).collect())


VOCAB = [("Japan", "Ramen"), ("Japan", "Soba noodles"), ("Brazil", "Sobá"), ("India", "Curry"), ("India", "Alu bhola machher jhol"), ("India", "Alu bhala machher jhol"), ("Italy", "Minestrone"), ("Italy", "Fresh tomme"), ("Italy", None)]


def test_the_five_rules_in_order(spark):
    vocabulary = spark.createDataFrame(VOCAB, "country string, name string")
    want = {
        "RAMEN!": ("ramen", 1), "soba": ("soba", 1), "a bowl of fresh tomme": ("fresh tomme", 2), "a dish of traditional minestrone": ("minestrone", 2),
        "japanese ramen": ("ramen", 3), "japanese curry": ("japanese curry", None), "noodle sobas": ("soba noodles", 4), "minestorne": ("minestrone", 5),
        "alu bhula machher jhol": ("alu bhula machher jhol", None), "a cup of nothing": ("nothing", None), "unknown": (None, None), "": (None, None),
    }
    labels = spark.createDataFrame([(v,) for v in [*want, *want, None]], "said string").withColumn("rule", F.lit("clash"))
    got = K.match_labels(labels, "said", vocabulary, "name", "country").collect()
    assert {r["said"]: (r["matched"], r["rule"]) for r in got} == want and len(got) == len(want)
    assert all(r["in_vocab"] == (r["rule"] is not None) for r in got)
    nothing = K.match_labels(labels, "said", vocabulary.limit(0), "name", "country").collect()
    assert not any(r["in_vocab"] for r in nothing) and K.match_labels(labels.limit(0), "said", vocabulary, "name").count() == 0


def test_the_country_comes_before_the_vocabulary_and_an_empty_one_lets_pass(spark):
    vocabulary = spark.createDataFrame(VOCAB, "country string, name string")
    rows = [("Ramen", "Japan", "Japan", "established"), ("Ramen", "India", "Japan", "off_country"), ("zzz", None, "Japan", "off_country"), ("zzz", "Japan", "Japan", "plausible_unlisted"),
            ("curry", "Japan", "Japan", "plausible_unlisted"), ("zzz", "Peru", "Peru", "established"), (None, "Japan", "Japan", "unresolved"), ("soba", "Brazil", "Brazil", "established")]
    tags = spark.createDataFrame(rows, "label string, country string, prompted string, want string")
    got = K.statuses(tags, "label", "country", "prompted", vocabulary, "name", "country").collect()
    assert len(got) == len(rows) and all(r["status"] == r["want"] for r in got)
    share = K.status_shares(spark.createDataFrame([(r["status"],) for r in got], "status string").withColumn("g", F.lit(1)), ["g"]).first()
    assert share["n"] == 8 and share["deficit"] == pytest.approx(1 - 3 / 8)


def test_a_reply_is_read_before_the_stored_label(spark):
    vocabulary = spark.createDataFrame(VOCAB, "country string, name string")
    tags = spark.createDataFrame([('{"dish": "ramen", "country": "Japan"}', "curry", "India"), ("", "curry", "India"), (None, "curry", None), ("no json", "curry", "India")], "reply string, label string, country string")
    said = spark.createDataFrame([("ramen",), ("curry",)], "said string")
    got = K.reader_records(tags, "reply", "label", "country", K.match_labels(said, "said", vocabulary, "name"), "said").collect()
    assert sorted((r["said"] or "-", r["said_country"] or "-", r["in_vocab"]) for r in got) == [("-", "-", False), ("curry", "-", True), ("curry", "India", True), ("ramen", "Japan", True)]


def test_prominence_prompts_and_plan(spark):
    records = spark.createDataFrame([("x", "pie", "a", "[]", "t"), ("x", "pie", "None", "nan", None), ("x", "soup", "a", "b", ""), ("x", "None", "a", "b", "t")], "c string, n string, p string, q string, title string")
    got = {r["n"]: r["prominence"] for r in K.kb_prominence(records, ["p", "q"], "title", "n", "c").collect()}
    assert got == {"pie": 0.75, "soup": 0.5}
    keys = K.rekeyed_prominence(spark.createDataFrame([("x", "The Pie", 1.0), ("x", "pie", 0.5)], "c string, n string, v double"), "n", "v", ["c"]).collect()
    assert [(r["key"], r["v"]) for r in keys] == [("pie", 0.75)]
    grid = K.prompt_grid(spark.createDataFrame([("New Land",), ("New Land",), (None,)], "c string"), "c", ["soup"], {"A": "a {domain}{country}"})
    assert {r["prompt_id"]: r["text"] for r in grid.collect()} == {"new_land-soup-A": "a soup from New Land", "global-soup-A": "a soup"}
    plan = K.pool_plan(grid, {"main": (0, 2), "tune": (500, 1)}, 64).collect()
    assert sorted(r["pool_seed"] for r in plan) == [0, 1, 500, 1000, 1001, 1500]
    with pytest.raises(ValueError, match="given twice"):
        K.pool_plan(grid, {"main": (0, 2), "tune": (1000, 1)}, 64)
