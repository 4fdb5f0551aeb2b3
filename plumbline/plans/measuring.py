"""Queries of diversity, agreement and ranks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.operators import diversity as D
from plumbline.operators import ranking as R
from plumbline.operators import selection as S
from plumbline.plans.base import CHECKS_SQL, IMAGES_SQL, ITEMS_SQL, PHOTOS_SQL, READINGS_SQL, SCORED_SQL, checks, images, items, pictures, readings, rounded, scored, vectors
from plumbline.runtime import read

ENTROPY = "ln(sum(c)) - sum(c * ln(c)) / sum(c)"


@query(
    "d3_label_vendi",
    f"""WITH {ITEMS_SQL}, c AS (SELECT pool_id, label, count(*)::DOUBLE AS c FROM items GROUP BY ALL)
    SELECT pool_id, sum(c)::BIGINT AS n, count(*) AS labels, round({ENTROPY}, 6) AS entropy, round(exp({ENTROPY}), 6) AS vendi,
        round(exp({ENTROPY}) / sum(c), 6) AS vendi_norm, round(1 - sum(c * c) / (sum(c) * sum(c)), 6) AS simpson FROM c GROUP BY pool_id""",
)
def d3(spark, sf):
    return rounded(D.label_entropy(items(spark, sf), ["pool_id"]))


@query("d1_vendi_embeddings")
def d1(spark, sf):
    return rounded(D.vendi(vectors(spark, sf), ["pool_id"]))


@query("d2_kernel_vendi")
def d2(spark, sf):
    """Any similarity callback: here labels at distance one are half alike."""
    score = D.kernel_vendi(lambda a, b: max(0.0, 1 - abs(a - b) / 2))
    return rounded(vectors(spark, sf, 40).groupBy("pool_id").agg(score("label").alias("vendi")))


def _batched(strict: bool) -> str:
    keep = "" if strict else "WHERE n >= 32 OR ord < 24"
    value = "avg(v / c_n) FILTER (WHERE c_n = 8 OR n < 8)" if strict else "avg(v / 8)"
    return f"""WITH {ITEMS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY idx) - 1 AS ord, count(*) OVER (PARTITION BY pool_id) AS n FROM items),
    c AS (SELECT pool_id, n, ord // 8 AS chunk, label, count(*)::DOUBLE AS c FROM a {keep} GROUP BY ALL),
    v AS (SELECT pool_id, n, chunk, sum(c) AS c_n, exp({ENTROPY}) AS v FROM c GROUP BY ALL)
    SELECT pool_id, round({value}, 6) AS diversity FROM v GROUP BY pool_id"""


@query("d6_batched_vendi", _batched(False))
def d6(spark, sf):
    return rounded(D.batched_vendi(items(spark, sf), ["pool_id"], strict=False))


@query("d7_batched_vendi_strict", _batched(True))
def d7(spark, sf):
    return rounded(D.batched_vendi(items(spark, sf), ["pool_id"]))


@query(
    "d9_coverage",
    f"""WITH {PHOTOS_SQL}, {READINGS_SQL}, r AS (SELECT reader, label FROM readings WHERE label IS NOT NULL), v AS (SELECT DISTINCT name FROM vocab WHERE name IS NOT NULL)
    SELECT reader, round(count(DISTINCT v.name) / (SELECT count(*) FROM v)::DOUBLE, 6) AS coverage FROM readings LEFT JOIN v ON v.name = readings.label GROUP BY reader""",
)
def d9(spark, sf):
    ref = read(spark, sf, "vocab").select(F.col("name").alias("label"))
    return rounded(D.coverage(readings(spark, sf), ["reader"], ref))


@query("d12_rarefaction")
def d12(spark, sf):
    """Exact expected diversity of 8 of each pool's items."""
    return rounded(D.rarefaction(items(spark, sf), ["pool_id"], 8))


@query(
    "d13_rarefaction_draws",
    f"""WITH {ITEMS_SQL}, d AS (SELECT i.*, d.draw, row_number() OVER (PARTITION BY pool_id, d.draw ORDER BY md5(concat_ws('#', 'rare', d.draw, pool_id, idx)), idx) AS r
        FROM items i CROSS JOIN (SELECT unnest(range(1, 17)) AS draw) d),
    c AS (SELECT pool_id, draw, label, count(*)::DOUBLE AS c FROM d WHERE r <= 8 GROUP BY ALL), e AS (SELECT pool_id, draw, exp({ENTROPY}) / 8 AS v FROM c GROUP BY ALL)
    SELECT pool_id, round(avg(v), 6) AS rarefied FROM e GROUP BY pool_id""",
)
def d13(spark, sf):
    e = D.label_entropy(S.random_k(items(spark, sf), 8, 16, "rare"), ["pool_id", "draw"])
    return rounded(e.groupBy("pool_id").agg(F.avg("vendi_norm").alias("rarefied")))


@query(
    "d14_pairwise_jaccard",
    f"""WITH {ITEMS_SQL}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY score DESC NULLS LAST, idx) AS r FROM items) WHERE r <= 3),
    s AS (SELECT country, pool_id, list(DISTINCT label) AS l FROM t GROUP BY ALL)
    SELECT a.country, round(avg(len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l)))::DOUBLE), 6) AS jaccard
    FROM s a JOIN s b ON a.country = b.country AND a.pool_id < b.pool_id GROUP BY a.country""",
)
def d14(spark, sf):
    """How alike the label sets of a country's selections are."""
    pairs = D.set_jaccard(S.top_k(items(spark, sf), 3), "country", "pool_id")
    return rounded(pairs.groupBy("country").agg(F.avg("jaccard").alias("jaccard")))


@query(
    "d15_modal_share",
    f"""WITH {ITEMS_SQL}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY score DESC NULLS LAST, idx) AS r FROM items) WHERE r <= 16),
    c AS (SELECT pool_id, label, count(*) AS c FROM t GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY c DESC, label) AS r, sum(c) OVER (PARTITION BY pool_id) AS n FROM c)
    SELECT pool_id, label AS modal, round(c / n, 6) AS share FROM o WHERE r = 1""",
)
def d15(spark, sf):
    return rounded(D.modal_label(S.top_k(items(spark, sf), 16), ["pool_id"]))


@query(
    "d16_between_share",
    f"""WITH {ITEMS_SQL}, g AS (SELECT country, label, count(*) AS n, sum(score) AS s, sum(score * score) AS q FROM items GROUP BY ALL)
    SELECT country, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)), 6) AS eta2 FROM g GROUP BY country""",
)
def d16(spark, sf):
    return rounded(D.between_share(items(spark, sf), "country", "label", "score"))


@query(
    "d17_cosine_gaps",
    """WITH v AS (SELECT vec_id % 10 AS p, vec_id AS i, label, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT a.p, a.i, avg(list_cosine_similarity(a.e, b.e)) FILTER (WHERE a.label = b.label) AS same, avg(list_cosine_similarity(a.e, b.e)) FILTER (WHERE a.label <> b.label) AS other
        FROM v a JOIN v b ON a.p = b.p AND a.i <> b.i GROUP BY ALL)
    SELECT p AS pool_id, round(avg(same), 6) AS same_label, round(avg(other), 6) AS other_label, round(avg(same) - avg(other), 6) AS gap FROM s GROUP BY p""",
)
def d17(spark, sf):
    """J11 and D17, without pairing items."""
    return rounded(D.cosine_gaps(vectors(spark, sf), "pool_id", "label"))


@query(
    "d18_reader_accuracy",
    f"""WITH {PHOTOS_SQL}, {READINGS_SQL}, j AS (SELECT r.reader, p.country AS pc, r.label, r.country, p.dish, p.gt_in_cspace FROM readings r JOIN pictures p USING (image_id)),
    s AS (SELECT *, 'all' AS scope FROM j UNION ALL SELECT *, 'gt' FROM j WHERE gt_in_cspace)
    SELECT reader, scope, pc AS country, count(*) AS n, round(avg((label IS NOT NULL)::INT), 6) AS resolved, round(avg(coalesce(lower(label) = lower(dish), false)::INT), 6) AS dish_ok,
        round(avg(coalesce(country = pc, false)::INT), 6) AS country_ok FROM s GROUP BY GROUPING SETS ((reader, scope), (reader, scope, pc))""",
)
def d18(spark, sf):
    p = pictures(spark, sf).select("image_id", F.col("country").alias("pc"), "dish", "gt_in_cspace")
    j = readings(spark, sf).join(p, "image_id")
    both = j.withColumn("scope", F.explode(F.when(F.col("gt_in_cspace"), F.array(F.lit("all"), F.lit("gt"))).otherwise(F.array(F.lit("all")))))
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6)
    sets = both.groupingSets([["reader", "scope"], ["reader", "scope", "pc"]], "reader", "scope", "pc")
    return sets.agg(
        F.count("*").alias("n"), share(F.col("label").isNotNull()).alias("resolved"), share(F.lower("label") == F.lower("dish")).alias("dish_ok"),
        share(F.col("country") == F.col("pc")).alias("country_ok"),
    ).withColumnRenamed("pc", "country")


@query(
    "d19_forced_choice",
    f"""WITH {CHECKS_SQL} SELECT reader, count(kept) AS n, round(avg(kept::INT), 6) AS accuracy, round(avg((chosen = 4)::INT), 6) AS none_rate FROM checks GROUP BY reader""",
)
def d19(spark, sf):
    g = checks(spark, sf).groupBy("reader")
    return rounded(g.agg(F.count("kept").alias("n"), F.avg(F.col("kept").cast("int")).alias("accuracy"), F.avg((F.col("chosen") == 4).cast("int")).alias("none_rate")))


@query(
    "d20_verifier_auc",
    f"""WITH {CHECKS_SQL}, s AS (SELECT reader, p_yes AS s, true AS pos FROM checks WHERE p_yes IS NOT NULL UNION ALL SELECT reader, p_yes_decoy, false FROM checks WHERE p_yes_decoy IS NOT NULL),
    k AS (SELECT *, rank() OVER (PARTITION BY reader ORDER BY s) + (count(*) OVER (PARTITION BY reader, s) - 1) / 2.0 AS rk FROM s)
    SELECT reader, round((sum(rk) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0)
        / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 6) AS auc FROM k GROUP BY reader""",
)
def d20(spark, sf):
    """J12 and D20."""
    c = checks(spark, sf)
    s = c.select("reader", F.col("p_yes").alias("s"), F.lit(True).alias("pos")).unionByName(c.select("reader", F.col("p_yes_decoy").alias("s"), F.lit(False).alias("pos")))
    return rounded(D.rank_auc(s, ["reader"], F.col("s"), F.col("pos")))


@query(
    "d21_tagger_diagnostics",
    f"""WITH {READINGS_SQL} SELECT reader, round(avg((label IS NOT NULL)::INT), 6) AS resolved, round(avg(in_vocab::INT), 6) AS in_vocab,
        round(avg(regexp_matches(coalesce(raw, ''), '[\\p{{Georgian}}\\p{{Cyrillic}}\\p{{Greek}}\\p{{Hiragana}}]')::INT), 6) AS native_script FROM readings GROUP BY reader""",
)
def d21(spark, sf):
    from plumbline.functions.text import is_native_script

    native = is_native_script(F.coalesce("raw", F.lit("")))
    return rounded(
        readings(spark, sf).groupBy("reader").agg(
            F.avg(F.col("label").isNotNull().cast("int")).alias("resolved"), F.avg(F.col("in_vocab").cast("int")).alias("in_vocab"), F.avg(native.cast("int")).alias("native_script")
        )
    )


@query(
    "d22_status_shift",
    f"""WITH {ITEMS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY score DESC NULLS LAST, idx) <= 16 AS top FROM items),
    p AS (SELECT country, pool_id, l.label, avg((t.label = l.label)::INT) FILTER (WHERE top) - avg((t.label = l.label)::INT) AS shift
        FROM t CROSS JOIN (SELECT DISTINCT label FROM items) l GROUP BY ALL)
    SELECT country, label, round(avg(shift), 6) AS shift FROM p GROUP BY ALL""",
)
def d22(spark, sf):
    t = R_top(items(spark, sf))
    c = t.groupBy("country", "pool_id", "label").agg(F.count_if("top").alias("k"), F.count("*").alias("c"))
    n = t.groupBy("pool_id").agg(F.count_if("top").alias("kk"), F.count("*").alias("n"))
    cell = c.join(n, "pool_id").select("country", "pool_id", "label", (F.col("k") / F.col("kk") - F.col("c") / F.col("n")).alias("shift"))
    # A label that a pool lacks has no shift there: its zero still counts in the mean over the country's pools.
    pools = n.join(t.select("pool_id", "country").distinct(), "pool_id").groupBy("country").agg(F.count("*").alias("pools"))
    out = cell.groupBy("country", "label").agg(F.sum("shift").alias("s")).join(pools, "country")
    return rounded(out.select("country", "label", (F.col("s") / F.col("pools")).alias("shift")))


def R_top(df):  # noqa: N802
    return df.withColumn("top", F.row_number().over(S.by_score("pool_id")) <= 16)


@query(
    "d23_mix_decomposition",
    f"""WITH {ITEMS_SQL}, b AS (SELECT *, least((4 * (row_number() OVER (PARTITION BY pool_id ORDER BY score, idx) - 1)) // count(*) OVER (PARTITION BY pool_id), 3) AS bin FROM items),
    y AS (SELECT *, (idx % 3 = 0)::DOUBLE AS y FROM b),
    c AS (SELECT country, label, count(*) FILTER (WHERE bin = 0) AS n0, count(*) FILTER (WHERE bin = 3) AS n3, sum(y) FILTER (WHERE bin = 0) AS y0, sum(y) FILTER (WHERE bin = 3) AS y3, avg(y) AS r FROM y GROUP BY ALL),
    w AS (SELECT *, n0 / sum(n0) OVER (PARTITION BY country) AS w0, n3 / sum(n3) OVER (PARTITION BY country) AS w3 FROM c),
    o AS (SELECT country, sum(y3) / sum(n3) - sum(y0) / sum(n0) AS total, sum((w3 - w0) * r) AS composition FROM w GROUP BY country)
    SELECT country, round(total, 6) AS total, round(composition, 6) AS composition, round(total - composition, 6) AS within FROM o""",
)
def d23(spark, sf):
    b = R.ranked_bins(items(spark, sf), "pool_id").withColumn("ok", F.col("idx") % 3 == 0)
    return rounded(D.mix_decomposition(b, ["country"], "label", "bin", "ok", 0, 3))


_LNC = "lgamma({a} + 1.0) - lgamma({b} + 1.0) - lgamma({a} - {b} + 1.0)"


@query(
    "d24_kept_insufficiency",
    f"""WITH {ITEMS_SQL}, p AS (SELECT n, kept, count(*) AS pools FROM (SELECT pool_id, count(*) AS n, count(*) FILTER (WHERE idx % 2 = 0) AS kept FROM items GROUP BY pool_id) GROUP BY ALL), k AS (SELECT *, least(16, n) AS k FROM p),
    t AS (SELECT k.*, CASE WHEN j <= kept AND k - j <= n - kept AND j <= k THEN exp({_LNC.format(a="kept", b="j")} + {_LNC.format(a="(n - kept)", b="(k - j)")} - ({_LNC.format(a="n", b="k")})) ELSE 0 END AS x FROM k CROSS JOIN (SELECT unnest(range(0, 8)) AS j))
    SELECT n, kept, pools, round(sum(x), 6) AS lacking FROM t GROUP BY ALL""",
)
def d24(spark, sf):
    """The exact chance that a random 16 of a pool keeps fewer than 8 of its even-numbered items."""
    from plumbline.functions.stats import hypergeom_below

    n = items(spark, sf).groupBy("pool_id").agg(F.count("*").alias("n"), F.count_if(F.col("idx") % 2 == 0).alias("kept"))
    chance = F.pandas_udf(lambda n, kept: pd.Series([hypergeom_below(int(a), int(b), min(16, int(a)), 8) for a, b in zip(n, kept)], dtype=float), "double")
    return rounded(n.groupBy("n", "kept").agg(F.count("*").alias("pools")).withColumn("lacking", chance("n", "kept")))


@query("d25_frequencies", "SELECT country, dish, count(*) AS rows FROM manifest WHERE dish IS NOT NULL GROUP BY ALL")
def d25(spark, sf):
    return read(spark, sf, "manifest").where("dish IS NOT NULL").groupBy("country", "dish").agg(F.count("*").alias("rows"))


@query(
    "w2_ranked_bins",
    f"""WITH {ITEMS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY score, idx) - 1 AS r, count(*) OVER (PARTITION BY pool_id) AS n FROM items)
    SELECT pool_id, idx, round(r / n, 6) AS rank01, least((4 * r) // n, 3)::INT AS bin FROM b""",
)
def w2(spark, sf):
    return rounded(R.ranked_bins(items(spark, sf), "pool_id").select("pool_id", "idx", "rank01", "bin"))


@query(
    "w3_unit_rank",
    f"""WITH {ITEMS_SQL} SELECT pool_id, idx, round((row_number() OVER (PARTITION BY pool_id ORDER BY score, idx) - 1) / greatest(count(*) OVER (PARTITION BY pool_id) - 1, 1), 6) AS rank01 FROM items""",
)
def w3(spark, sf):
    return rounded(R.unit_rank(items(spark, sf), "pool_id").select("pool_id", "idx", "rank01"))


@query(
    "w4_within_label_bins",
    f"""WITH {ITEMS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY pool_id, label ORDER BY score, idx) - 1 AS r, count(*) OVER (PARTITION BY pool_id, label) AS n FROM items)
    SELECT pool_id, label, least((4 * r) // n, 3)::INT AS bin, count(*) AS rows FROM b WHERE n >= 4 GROUP BY ALL""",
)
def w4(spark, sf):
    i = items(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("pool_id", "label"))).where("n >= 4")
    return R.ranked_bins(i, ["pool_id", "label"]).groupBy("pool_id", "label", "bin").agg(F.count("*").alias("rows"))


@query(
    "w5_median_split",
    f"""WITH {ITEMS_SQL}, m AS (SELECT pool_id, label, quantile_cont(score, 0.5) AS med FROM items GROUP BY ALL HAVING count(*) >= 2),
    h AS (SELECT i.pool_id, i.label, avg((idx % 3 = 0)::INT) FILTER (WHERE score >= med) - avg((idx % 3 = 0)::INT) FILTER (WHERE score < med) AS d
        FROM items i JOIN m ON m.pool_id = i.pool_id AND m.label = i.label GROUP BY ALL)
    SELECT pool_id, label, round(d, 6) AS hi_minus_lo FROM h WHERE d IS NOT NULL""",
)
def w5(spark, sf):
    i = items(spark, sf).withColumn("ok", (F.col("idx") % 3 == 0).cast("int"))
    return rounded(R.median_split(i, ["pool_id", "label"], "score", "ok"))


@query(
    "w6_holm",
    f"""WITH {ITEMS_SQL}, p AS (SELECT country, pool_id, least(1.0, round(avg(score) / 100, 9)) AS p FROM items GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY p, pool_id) AS r, count(*) OVER (PARTITION BY country) AS n FROM p)
    SELECT country, pool_id, round(max(least(1.0, (n - r + 1) * p)) OVER (PARTITION BY country ORDER BY r ROWS UNBOUNDED PRECEDING), 6) AS holm_p FROM r""",
)
def w6(spark, sf):
    p = items(spark, sf).groupBy("country", "pool_id").agg(F.least(F.lit(1.0), F.round(F.avg("score") / 100, 9)).alias("p"))
    return rounded(R.holm(p, "p", "pool_id", ["country"]).select("country", "pool_id", "holm_p"))


@query("w7_percentiles", f"WITH {ITEMS_SQL} SELECT label, round(quantile_cont(score, 0.025), 6) AS lo, round(quantile_cont(score, 0.975), 6) AS hi FROM items GROUP BY label")
def w7(spark, sf):
    return rounded(items(spark, sf).groupBy("label").agg(F.percentile("score", 0.025).alias("lo"), F.percentile("score", 0.975).alias("hi")))


@query(
    "w9_interpolation",
    f"""WITH {ITEMS_SQL}, c AS (SELECT country, label AS pos, round(avg(score), 6) AS x, count(*)::DOUBLE AS y FROM items GROUP BY ALL),
    g AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM c WINDOW w AS (PARTITION BY country ORDER BY pos)), t AS (SELECT country, round(avg(score), 6) AS at FROM items GROUP BY country)
    SELECT g.country, t.at, round(max(CASE WHEN x1 = x THEN greatest(y, y1) ELSE y + (y1 - y) * (t.at - x) / (x1 - x) END), 6) AS value FROM g JOIN t ON t.country = g.country
    WHERE x1 IS NOT NULL AND t.at BETWEEN least(x, x1) AND greatest(x, x1) GROUP BY ALL""",
)
def w9(spark, sf):
    c = items(spark, sf).groupBy("country", F.col("label").alias("pos")).agg(F.round(F.avg("score"), 6).alias("x"), F.count("*").cast("double").alias("y"))
    t = items(spark, sf).groupBy("country").agg(F.round(F.avg("score"), 6).alias("at"))
    return rounded(R.interpolate_best(c, t, "country"))


@query(
    "m5_pearson",
    f"""WITH {ITEMS_SQL}, r AS (SELECT label, count(*) AS n, corr(score, idx) AS r FROM items GROUP BY label)
    SELECT label, n, round(r, 6) AS r, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS lo, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS hi FROM r WHERE n >= 4""",
)
def m5(spark, sf):
    return rounded(R.pearson_interval(items(spark, sf), ["label"], "score", "idx"))


@query(
    "m6_spearman",
    f"""WITH {ITEMS_SQL}, k AS (SELECT pool_id, rank() OVER (PARTITION BY pool_id ORDER BY score) + (count(*) OVER (PARTITION BY pool_id, score) - 1) / 2.0 AS a,
        rank() OVER (PARTITION BY pool_id ORDER BY idx) + (count(*) OVER (PARTITION BY pool_id, idx) - 1) / 2.0 AS b FROM items)
    SELECT pool_id, round(corr(a, b), 6) AS spearman FROM k GROUP BY pool_id""",
)
def m6(spark, sf):
    return rounded(R.spearman(items(spark, sf), ["pool_id"], "score", "idx"))


@query(
    "m4_wilson",
    f"""WITH {CHECKS_SQL}, c AS (SELECT reader, count(*) FILTER (WHERE kept)::DOUBLE AS k, count(kept)::DOUBLE AS n FROM checks GROUP BY reader)
    SELECT reader, round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS lo,
        round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS hi FROM c""",
)
def m4(spark, sf):
    from plumbline.functions.stats import wilson

    c = checks(spark, sf).groupBy("reader").agg(F.count_if("kept").alias("k"), F.count("kept").alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return rounded(c.select("reader", lo.alias("lo"), hi.alias("hi")))


@query(
    "m8_sign_agreement",
    f"""WITH {READINGS_SQL}, {CHECKS_SQL}, a AS (SELECT image_id, avg((label IS NOT NULL)::INT) - 0.5 AS x FROM readings GROUP BY image_id),
    b AS (SELECT image_id, avg(p_yes) - 0.5 AS y FROM checks WHERE p_yes IS NOT NULL GROUP BY image_id)
    SELECT count(*) AS n, round(avg((sign(x) = sign(y))::INT), 6) AS agree, round(avg((sign(x) = sign(y))::INT) FILTER (WHERE abs(x) > 0.105361), 6) AS agree_large FROM a JOIN b USING (image_id)""",
)
def m8(spark, sf):
    a = readings(spark, sf).groupBy("image_id").agg((F.avg(F.col("label").isNotNull().cast("int")) - 0.5).alias("x"))
    b = checks(spark, sf).where("p_yes IS NOT NULL").groupBy("image_id").agg((F.avg("p_yes") - 0.5).alias("y"))
    same = (F.signum("x") == F.signum("y")).cast("int")
    return rounded(a.join(b, "image_id").agg(F.count("*").alias("n"), F.avg(same).alias("agree"), F.avg(F.when(F.abs("x") > 0.105361, same)).alias("agree_large")))


@query(
    "m11_zscore",
    f"WITH {IMAGES_SQL}, {SCORED_SQL} SELECT i.image_id, round((s.score - avg(s.score) OVER w) / (stddev_pop(s.score) OVER w + 1e-12), 6) AS z FROM images i JOIN scored s USING (image_id) "
    "WHERE s.score IS NOT NULL AND NOT isnan(s.score) WINDOW w AS (PARTITION BY i.prompt_id)",
)
def m11(spark, sf):
    """Scores standardized within prompts, by a join with the prompts' moments rather than a window over a prompt's rows."""
    j = images(spark, sf).select("image_id", "prompt_id").join(scored(spark, sf).where("score IS NOT NULL AND NOT isnan(score)"), "image_id")
    m = j.groupBy("prompt_id").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    z = (F.col("score") - F.col("mean")) / (F.col("sd") + 1e-12)
    return rounded(j.join(m, j["prompt_id"].eqNullSafe(m["prompt_id"])).select("image_id", z.alias("z")), 6)
