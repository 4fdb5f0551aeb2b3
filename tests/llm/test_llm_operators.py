import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import canonical, consensus, encode, frequency, leakage, topn, truncation, varied
from plumbline.llm.queries import tokenizer_path

# ---- top N per group


def brute_top(rows, n):
    out = set()
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g and r[1] is not None and r[2] is not None and r[2] == r[2]]
        mine.sort(key=lambda r: (-r[2], r[3] is None, r[3], r[1]))
        out |= {(g, r[1], k + 1) for k, r in enumerate(mine[:n])}
    return out


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_top_n_equals_brute_force_hot_and_cold(spark, hot_rows):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), f"i{k}", rng.choice([0.5, 1.0, 2.0, float("nan"), None]), rng.randrange(5)) for k in range(300)]
    rows += [(9, f"same{k}", 1.0, 0) for k in range(60)] + [(8, None, 1.0, 0)]
    df = spark.createDataFrame(rows, "g int, item string, score double, t int").withColumn("rank", F.lit("clash")).withColumn("hot", F.lit(1))
    got = topn.top_n_per_group(df, "g", "item", "score", "t", 5, hot_rows)
    assert {(r["g"], r["item"], r["rank"]) for r in got.collect()} == brute_top(rows, 5)


def test_top_n_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g int, item string, score double, t int")
    assert topn.top_n_per_group(df, "g", "item", "score", "t", 5).count() == 0


# ---- frequencies


def test_term_frequencies_count_occurrences_and_records(spark):
    values = ["Pie pie", "pie", "É́tude-1", None, "", "  ", "x" * 200_000] + ["soup"] * 40
    df = spark.createDataFrame([(v,) for v in values], "label string").withColumn("field", F.lit("clash")).repartition(3)
    got = {r["term"]: r for r in frequency.term_frequencies(df, {"label": frequency.letter_digit_terms}).collect()}
    assert (got["pie"]["occurrences"], got["pie"]["records"], got["pie"]["mark"]) == (3, 2, "rare")
    assert got["soup"]["mark"] == "common" and got["soup"]["field_records"] == len(values) - 1
    assert got["x" * 200_000]["records"] == 1 and "1" in got
    empty = spark.createDataFrame([], "label string")
    assert frequency.term_frequencies(empty, {"label": frequency.whole_value}).count() == 0


def test_whole_values():
    assert frequency.whole_value("  New   Land ") == ["new land"] and frequency.whole_value(" \t") == []


# ---- encoding


def test_encoding_equals_the_library_and_round_trips(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = ["", " ", "a   b\n\n c ", "<|endoftext|>", "don't it's WE'LL", "日本語　テスト 🙂", "aaaaaaaaa" * 50, "é\x1cx y", "1234 5.6%", "\ttab\r\nline", "word " * 20_000]
    df = spark.createDataFrame([(k, v) for k, v in enumerate([None, *texts])], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in encode.encode_corpus(df, "doc_id", "text", path).collect()}
    assert got[0] == [] and got[1] == []
    raw = open(path, "rb").read()
    for k, v in enumerate(texts):
        assert got[k + 1] == t.encode(v, add_special_tokens=False).ids
        assert encode.decode(got[k + 1], raw) == v
    assert encode.encode_corpus(df.limit(0), "doc_id", "text", path).count() == 0


def test_replay_equals_merging_word_by_word():
    replay = encode.MergeReplay(open(tokenizer_path("byte_bpe_50k.json"), "rb").read())
    rng = random.Random(0)
    words = [bytes(rng.choice(b"abcdetion s") for _ in range(rng.randrange(1, 14))) for _ in range(300)]

    def plain(w):
        ids = [int(replay.byte_ids[b]) for b in w]
        while True:
            due = [(replay.rank[k], p) for p in range(len(ids) - 1) if (k := (ids[p] << 32) | ids[p + 1]) in replay.rank]
            if not due:
                return ids
            r, p = min(due)
            ids[p : p + 2] = [replay.made[r]]

    assert replay.replay(words) == [plain(w) for w in words]


# ---- leakage

WORDS = [a + b for a in "bal cor dun fer gil hom jud kel lor mun".split() for b in "ack end ish ott ust ard".split()]


def passage(rng, n=45):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(n))


def test_leaks_whole_part_edited_and_set_in_lines(spark):
    rng = random.Random(3)
    item = passage(rng)
    w = item.split()
    fill = lambda n: passage(rng, n)
    lines = [" ".join(w[k : k + 5]) for k in range(0, 45, 5)]
    pages = {
        1: fill(80) + " " + item.upper() + " " + fill(80),
        2: fill(50) + " " + " ".join(w[10:30]) + " " + fill(50),
        3: "\n".join(x for line in lines for x in (line, fill(5))),
        4: fill(20) + " " + " ".join(x.replace("e", "c") if k % 9 == 0 else x for k, x in enumerate(w) if k % 13 != 5) + " " + fill(20),
        5: fill(60) + " " + " ".join(w[:11]) + " " + fill(60),
        6: " ".join(rng.sample(w, 45)),
        7: fill(150),
        8: "",
        9: None,
        10: "\n".join(f"{' '.join(w[k : k + 5])} {w[k + 5][:3]}-\n{w[k + 5][3:]}" if k + 5 < 45 else w[k] for k in range(0, 44, 6)),
    }
    docs = spark.createDataFrame(list(pages.items()), "doc_id long, text string").withColumn("item_id", F.lit("clash")).repartition(3)
    items = spark.createDataFrame([(70, item + " Question: who did it?"), (71, passage(rng)), (72, None), (73, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(k, 70) for k in (1, 2, 3, 4, 10)}
    assert leakage.find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leakage.find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_items_in_several_blocks_and_halves_far_apart(spark, monkeypatch):
    rng = random.Random(11)
    items = [(k, passage(rng)) for k in range(6)]
    texts = [passage(rng, 60) + " " + t + " " + passage(rng, 60) for _, t in items]
    first, second = items[0][1].split()[:22], items[0][1].split()[22:]
    texts += [" ".join(first) + " " + passage(rng, 600) + " " + " ".join(second)]  # each half is a run by itself
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    held = spark.createDataFrame(items, "i long, t string")
    want = {(k, k) for k in range(6)} | {(6, 0)}
    assert {(r[0], r[1]) for r in leakage.find_leaks(docs, "d", "t", held, "i", "t").collect()} == want
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 500)
    assert {(r[0], r[1]) for r in leakage.find_leaks(docs, "d", "t", held, "i", "t").collect()} == want


def test_edits_within_equals_the_table():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        for most in range(4):
            if a and b:
                assert leakage.edits_within(a, b, most) == (row[-1] <= most)


def test_an_item_in_most_texts_is_still_found(spark):
    rng = random.Random(5)
    item = passage(rng)
    docs = spark.createDataFrame([(k, passage(rng, 60) + " " + item) for k in range(60)] + [(k, passage(rng, 60)) for k in range(60, 90)], "d long, t string")
    items = spark.createDataFrame([(1, item)], "i long, t string")
    assert {r["doc_id"] for r in leakage.find_leaks(docs, "d", "t", items, "i", "t").collect()} == set(range(60))


def test_a_part_of_an_item_in_many_texts_is_found_without_its_rarest_seeds(spark):
    rng = random.Random(6)
    item, other = passage(rng, 50), passage(rng, 50)
    w, v = item.split(), other.split()
    part = w[30:48]
    part[3], part[9], part[14] = part[3][:-1] + "x", part[9][:-1] + "x", part[14][:-1] + "x"
    texts = [passage(rng, 40) + " " + " ".join(w[8:]) for _ in range(30)]  # the first words are left out: the rarest seeds
    texts += [passage(rng, 60) + " " + " ".join(part) + " " + passage(rng, 60) for _ in range(3)]
    texts += [passage(rng, 60) + " " + " ".join(v[20:39]) + " " + passage(rng, 60) for _ in range(30)]  # always the same part
    texts += [passage(rng, 150) for _ in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "d long, t string")
    items = spark.createDataFrame([(1, item), (2, other)], "i long, t string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs, "d", "t", items, "i", "t").collect()}
    assert got == {(k, 1) for k in range(33)} | {(k, 2) for k in range(33, 63)}


def test_alignment_equals_plain_dynamic_programming():
    rng = random.Random(2)
    lexicon = leakage.Lexicon(sorted(WORDS))
    for _ in range(20):
        item = np.array([rng.randrange(12) for _ in range(12)])
        text = np.array([rng.randrange(12) for _ in range(30)])
        h = np.zeros((13, 31))
        for i in range(1, 13):
            for j in range(1, 31):
                a, b = int(text[j - 1]), int(item[i - 1])
                s = leakage.SAME if a == b else leakage.MISREAD if lexicon.misread(a, b) else leakage.OTHER
                row = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + leakage.OTHER)
                h[i, j] = max(row, *(h[i, k] - leakage.GAP_START - leakage.GAP_WORD * (j - k) for k in range(j)))
        assert leakage.align(item, text, lexicon)[0] == pytest.approx(h.max())


# ---- truncation


def page(rng, n):
    text = ""
    while len(text) < n:
        text += passage(rng, 9).capitalize() + "." + rng.choice([" ", "\n"])
    return text.rstrip()


def test_truncation_by_limit_and_by_end(spark):
    rng = random.Random(4)
    rows = [(k, page(rng, rng.randrange(300, 3000)), "free", None) for k in range(60)]
    rows += [(100 + k, page(rng, rng.randrange(500, 1900))[:2000], "limited", None) for k in range(40)]
    cut = [(200 + k, page(rng, 2600)[:2000], "limited", None) for k in range(12)]
    rows += cut
    odd = {
        300: ("It ends in the mid", None), 301: ("It is cut. And then [...]", None), 302: ("Half a letter�", None), 303: ("All lines. Not here.", 9),
        304: ("Body. \nContinued on page 4", None), 305: ("Body.\n— A READER", None), 306: ("", None), 307: ("  \n", None), 308: (None, None), 309: ("Whole.", 1),
    }
    rows += [(k, t, None, n) for k, (t, n) in odd.items()]
    # How a pointer begins is learned, so other pages must end in one, too.
    rows += [(310 + k, f"{page(rng, 400)}\nContinued on page {k}", "free", None) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    df = df.withColumn("boxes", F.when(F.col("n").isNotNull(), F.array_repeat(F.lit(1), F.col("n")))).withColumn("cut", F.lit("clash"))
    got = {r["doc_id"] for r in truncation.find_truncated(df, "doc_id", "text", "source", "boxes").where("cut").collect()}
    assert got == {r[0] for r in cut} | {300, 301, 302, 303}
    share = {r["source"]: r for r in truncation.truncation_by_source(df, "doc_id", "text", "source", "boxes").collect()}
    assert share["limited"]["cut_texts"] == 12 and share["limited"]["texts"] == 52 and share["free"]["cut_share"] == 0 and share[None]["texts"] == 10
    assert truncation.find_truncated(df.limit(0), "doc_id", "text", "source").count() == 0


def test_openings_are_learned_and_all_spikes_of_a_source_are_found(spark):
    rng = random.Random(8)
    rows = [(k, f"{page(rng, rng.randrange(300, 1500))}\nWanted: {passage(rng, 3)}", "free") for k in range(30)]
    rows += [(50 + k, f"{page(rng, 900)} wanted {passage(rng, 9)}.", "free") for k in range(30)]  # not at the start of a line
    rows += [(100 + k, page(rng, rng.randrange(500, 3000)), None) for k in range(60)]
    cut = [(200 + k, page(rng, 2600)[:1500].rstrip(".")[:1499] + "e", None) for k in range(9)]  # a limit that was raised later
    cut += [(300 + k, page(rng, 2600)[:2200].rstrip(".")[:2199] + "e", None) for k in range(9)]
    df = spark.createDataFrame(rows + cut, "doc_id long, text string, source string")
    found = truncation.find_truncated(df, "doc_id", "text", "source").where("cut")
    assert {r["doc_id"]: r["reason"][:5] for r in found.collect()} == {r[0]: "limit" if len(r[1]) in (1500, 2200) else "unfin" for r in cut}
    features = truncation.ending_features(df, "doc_id", "text", "source", None)
    assert {tuple(r) for r in truncation.closing_openings(df, "text", features).collect()} >= {("wanted:", 0)}
    spikes = truncation.length_spikes(features.withColumn("closing", F.lit(False)))
    assert {(r["source"], r["measure"], r["length"]) for r in spikes.collect()} >= {(None, "chars", 1500), (None, "chars", 2200)}


# ---- typed values


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_search_equals_brute_force():
    rng = random.Random(0)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(3, 9))) for _ in range(80)})
    trie = canonical.ReferenceTrie([(k, n, None) for k, n in enumerate(names)])
    keys = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(100)] + ["a" * 70, ""]
    for most in range(3):
        for key, batch in zip(keys, trie.search_all(keys, most)):
            want = {(k, e) for k, n in enumerate(names) if (e := osa(key, n)) <= most}
            for found in (batch, trie.search(key, most)):
                assert {(i, e) for ends, e in found for i in ends.whole} == want


def test_values_are_mapped_or_reported(spark, monkeypatch):
    ref = [(1, "Marovia", "lerbrormash pie", ["そばきり"]), (2, "Marovia", "lerbrormash soup", None), (3, "Sevrana", "gråndhek stew", []), (4, "Sevrana", "tazon tazon rice", None), (5, None, None, None), (6, "Sevrana", "miro soup", None)]
    reference = spark.createDataFrame(ref, "vocab_id long, country string, name string, aliases array<string>")
    want = {
        "LERBRORMASH PIE": 1, "a bowl of lerbrormash_soup!!": 2, "soup lerbrormash": 2, "Marovian lerbromrash pie x2": 1, "grandhek": 3, "grÃ¥ndhek stew": 3,
        "gråndhek st.": 3, "そばきり": 1, "lerbrormash": -1, "tazon rice": 4, "lerbrormashpie": 1, "unknown": -1, "???": -1, "zzzzzz noodles": -1, "lerbrormash stew": -1, "x" * 5000: -1,
    }
    # Phrases around names are learned, so they must stand around several names.
    want |= {"a bowl of gråndhek stew": 3, "a bowl of miro soup": 6, "miro soup x2": 6, "gråndhek stew x2": 3, "lerbrormash soup x2": 2, "near miro soup": -1}
    df = spark.createDataFrame([(v,) for v in [*want, *want, None, " ", " "]], "entered string").withColumn("entry_id", F.lit("clash"))
    got = canonical.map_values(df, "entered", reference, "vocab_id", "name", "aliases", "country").collect()
    assert {r["entered"]: r["entry_id"] for r in got} == want and len(got) == len(want)
    near = {r["entered"]: [tuple(c) for c in r["candidates"]] for r in got}
    assert near["lerbrormash"] == [(0, 1), (0, 2)] and near["Marovian lerbromrash pie x2"] == [(1, 1)] and near["unknown"] == []
    monkeypatch.setattr(canonical, "BLOCK_BYTES", 40)
    parts = canonical.map_values(df, "entered", reference, "vocab_id", "name", "aliases", "country").collect()
    assert {r["entered"]: r["entry_id"] for r in parts} == want
    assert {r["entry_id"] for r in canonical.map_values(df, "entered", reference.limit(0), "vocab_id", "name").collect()} == {-1}
    assert canonical.map_values(df.limit(0), "entered", reference, "vocab_id", "name").count() == 0


# ---- consensus


def test_consensus_trusts_reliable_annotators_and_turns_liars_round(spark):
    rng = random.Random(0)
    truth = {f"i{k}": rng.choice(["a", "b"]) for k in range(200)}
    flip = {"a": "b", "b": "a"}
    rows = []
    for i, t in truth.items():
        for r in ("good1", "good2"):
            rows.append(("f", i, r, t if rng.random() < 0.95 else flip[t]))
        for r in ("liar1", "liar2", "liar3"):
            rows.append(("f", i, r, t if rng.random() < 0.2 else flip[t]))
    # Eight certain votes a few times settle which side is right.
    rows += [("f", i, f"crowd{c}", t) for i, t in list(truth.items())[:60] for c in range(5)]
    rows += [("f", None, "good1", "a"), ("f", "i0", None, "a"), ("f", "i0", "good1", None), ("g", "solo", "good1", "z")]
    fit = consensus.fit_consensus(spark.createDataFrame(rows, "field string, item string, annotator string, value string"), "field", "item", "annotator", "value")
    out = {(r["field"], r["item"]): r for r in fit.consensus().collect()}
    assert np.mean([out[("f", i)]["value"] == t for i, t in truth.items()]) > 0.93
    assert out[("g", "solo")]["probability"] == 1.0 and out[("g", "solo")]["agreement"] is None
    rel = {r["annotator"]: r for r in fit.reliability().where("field = 'f'").collect()}
    assert rel["good1"]["low"] > rel["liar1"]["high"]


def crowd(rng, items=300, seed_values="abc"):
    """Readings by annotators whose skill follows the prior, and the truth."""
    skill = {f"r{k}": rng.betavariate(consensus.RIGHT_PRIOR, consensus.WRONG_PRIOR) for k in range(8)}
    truth = {f"i{k}": rng.choice(seed_values) for k in range(items)}
    rows = []
    for i, t in truth.items():
        for a in rng.sample(sorted(skill), 5):
            rows.append(("f", i, a, t if rng.random() < skill[a] else rng.choice([v for v in seed_values if v != t])))
    return rows, truth, skill


def test_the_bound_rises_and_joined_logarithms_give_the_same(spark, monkeypatch):
    rows, truth, _ = crowd(random.Random(3), 120)
    df = spark.createDataFrame([*rows, *rows[:40]], "f string, i string, a string, v string").withColumn("n", F.lit("clash"))
    fit = consensus.fit_consensus(df, "f", "i", "a", "v", tolerance=1e-6)
    assert len(fit.bounds) > 3 and all(b >= a - 1e-6 for a, b in zip(fit.bounds, fit.bounds[1:]))
    got = {r["item"]: (r["value"], r["probability"]) for r in fit.consensus().collect()}
    assert np.mean([got[i][0] == t for i, t in truth.items()]) > 0.85
    monkeypatch.setattr(consensus, "MOST_PLACES", 0)
    other = consensus.fit_consensus(df, "f", "i", "a", "v", tolerance=1e-6)
    assert other.bounds == pytest.approx(fit.bounds, abs=1e-6)
    assert {r["item"]: (r["value"], pytest.approx(r["probability"], abs=1e-6)) for r in other.consensus().collect()} == got


def test_reliability_intervals_cover_the_skill(spark):
    # Thirty crowds at once, each a field: nominal 95 %, and somewhat less, since mean-field inference understates its doubt.
    rows, want = [], {}
    for k in range(30):
        mine, _, skill = crowd(random.Random(100 + k), 60)
        rows += [(f"f{k}", *r[1:]) for r in mine]
        want |= {(f"f{k}", a): s for a, s in skill.items()}
    fit = consensus.fit_consensus(spark.createDataFrame(rows, "f string, i string, a string, v string"), "f", "i", "a", "v")
    got = fit.reliability().collect()
    assert len(got) == len(want)
    assert np.mean([r["low"] <= want[(r["field"], r["annotator"])] <= r["high"] for r in got]) >= 0.85


def test_krippendorff_against_the_definition(spark):
    units = [["a", "a", "b"], ["b", "b"], ["a", "c", "c", "c"], ["a"]]
    rows = [("f", f"u{u}", f"r{k}", v) for u, vs in enumerate(units) for k, v in enumerate(vs)]
    rel = spark.createDataFrame(rows, "f string, i string, a string, v string")
    pair = [u for u in units if len(u) > 1]
    n = sum(map(len, pair))
    do = sum(sum(x != y for k, x in enumerate(u) for m, y in enumerate(u) if k != m) / (len(u) - 1) for u in pair) / n
    t = Counter(v for u in pair for v in u)
    de = sum(t[x] * t[y] for x in t for y in t if x != y) / (n * (n - 1))
    assert consensus.krippendorff_alpha(rel).first()["alpha"] == pytest.approx(1 - do / de, abs=1e-6)


def test_consensus_of_nothing(spark):
    fit = consensus.fit_consensus(spark.createDataFrame([], "f string, i string, a string, v string"), "f", "i", "a", "v")
    assert fit.consensus().count() == 0 and fit.reliability().count() == 0


def test_digamma_and_trigamma(spark):
    r = spark.range(1).select(consensus.digamma(F.lit(0.5)), consensus.digamma(F.lit(10.0)), consensus.trigamma(F.lit(1.0))).first()
    assert tuple(r) == pytest.approx((-1.9635100260214235, 2.251752589066721, 1.6449340668482264), abs=1e-8)


# ---- varied subset


def test_ward_groups_equal_plain_agglomeration():
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(25, 3)), rng.uniform(0.5, 2, 25)
    groups = {k: [k] for k in range(25)}
    c, m = x.copy(), w.copy()
    while len(groups) > 6:
        cost, a, b = min((m[a] * m[b] / (m[a] + m[b]) * ((c[a] - c[b]) ** 2).sum(), a, b) for a in groups for b in groups if a < b)
        c[a] = (m[a] * c[a] + m[b] * c[b]) / (m[a] + m[b])
        m[a] += m[b]
        groups[a] += groups.pop(b)
    got = varied.ward_groups(x, w, 6)
    assert {frozenset(v) for v in groups.values()} == {frozenset(np.flatnonzero(got == g).tolist()) for g in range(6)}


def test_tree_keeps_all_records_within_its_bound():
    rng = np.random.default_rng(1)
    tree = varied.ClusterFeatureTree(4, 50)
    x = rng.normal(size=(2000, 4))
    for row in x:
        tree.insert(1.0, row.copy(), float(row @ row))
    n, s, _ = tree.leaves()
    assert n.sum() == 2000 and len(n) <= 50 and s.sum(0) == pytest.approx(x.sum(0))
    together = varied.ClusterFeatureTree(4, 50)
    together.insert_all(np.ones(2000), x, (x * x).sum(1))
    n, s, q = together.leaves()
    assert n.sum() == 2000 and len(n) <= 50 and s.sum(0) == pytest.approx(x.sum(0)) and q.sum() == pytest.approx((x * x).sum())


def test_the_subset_depends_on_the_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(varied, "BUCKET_ROWS", 150)
    monkeypatch.setattr(varied, "CHUNK_ROWS", 64)
    monkeypatch.setattr(varied, "MIN_LEAVES", 40)
    rng = np.random.default_rng(4)
    rows = [(f"i{k}", [float(v) for v in rng.normal(size=3)], f"p{k % 37}") for k in range(1000)]
    df = spark.createDataFrame(rows, "id string, v array<double>, pool string")
    pick = lambda x: sorted(r["id"] for r in varied.varied_subset(x, "id", 10, "v", {"pool": 0.5}, vector_dims=3).collect())
    first = pick(df)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for parts, adaptive, batch in (("13", "false", "10000"), ("3", "true", "70")):
            for k, v in zip(before, (parts, adaptive, batch)):
                spark.conf.set(k, v)
            assert pick(df.orderBy(F.rand(7)).repartition(int(parts))) == first
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_subset_of_few_different_rows_and_of_too_many(spark):
    rows = [(f"i{k}", f"p{k % 3}") for k in range(50)]
    df = spark.createDataFrame(rows, "id string, pool string")
    got = [r["id"] for r in varied.varied_subset(df, "id", 20, None, {"pool": 0.5}).collect()]
    assert len(got) == len(set(got)) == 20 and {int(i[1:]) % 3 for i in got} == {0, 1, 2}
    with pytest.raises(ValueError):
        varied.varied_subset(df, "id", varied.MOST_CHOSEN + 1, None, {"pool": 0.5})


def test_a_huge_clump_does_not_dominate(spark):
    rng = np.random.default_rng(2)
    rows = [(f"clump{k}", [1.0, 0.0, float(1e-4 * rng.normal())], "p0") for k in range(2000)]
    rows += [(f"rare{k}", [float(v) for v in rng.normal(size=3)], f"p{k % 10}") for k in range(40)]
    rows += [rows[0], rows[5], (None, None, None), ("none", None, None), ("nan", [float("nan"), 0.0, 1.0], "p1")]
    df = spark.createDataFrame(rows, "id string, v array<double>, pool string").withColumn("group", F.lit("clash")).repartition(5)
    got = [r["id"] for r in varied.varied_subset(df, "id", 20, "v", {"pool": 0.5}, vector_dims=3).collect()]
    assert len(got) == len(set(got)) == 20 and sum(i.startswith("clump") for i in got) <= 4
    assert varied.varied_subset(df.limit(0), "id", 5, "v", {}, vector_dims=3).count() == 0
    few = varied.varied_subset(df.where("id LIKE 'rare%'"), "id", 100, "v", {}, vector_dims=3)
    assert few.count() == 40
