"""Queries of reports, variants, checks and small functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.functions import text as X
from plumbline.functions.stats import wilson
from plumbline.operators import deciding as J
from plumbline.operators import diversity as D
from plumbline.operators import inference as I
from plumbline.operators import integrity as C
from plumbline.operators import reporting as P
from plumbline.operators import resampling as B
from plumbline.operators import selection as S
from plumbline.plans.auditing import H, boot_sql, contrast, contrast_sql
from plumbline.plans.base import CHECKS_SQL, IMAGES_SQL, ITEMS_SQL, PHOTOS_SQL, READINGS_SQL, SCORED_SQL, checks, images, items, pictures, readings, rounded, scored, vectors
from plumbline.runtime import cached, read

RANK = "row_number() OVER (PARTITION BY pool_id ORDER BY score DESC NULLS LAST, idx)"

# ---- repetition

_JACCARD = """(SELECT {keys}, avg(j) AS jaccard FROM (SELECT {ak}, len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) AS j
    FROM {t} a JOIN {t} b ON {on} AND a.pool_id < b.pool_id WHERE len(a.s) + len(b.s) > 0) GROUP BY {keys})"""
_TOPS = f"""tops AS (SELECT * FROM (SELECT *, {RANK} AS r FROM items) WHERE r <= 16),
    rnd AS (SELECT * FROM (SELECT i.*, d.draw, row_number() OVER (PARTITION BY pool_id, d.draw ORDER BY md5(concat_ws('#', 'rep', d.draw, pool_id, idx)), idx) AS r FROM items i CROSS JOIN (SELECT unnest(range(1, 9)) AS draw) d) WHERE r <= 16),
    ts AS (SELECT country, pool_id, list(DISTINCT label) AS s FROM tops GROUP BY ALL), rs AS (SELECT country, draw, pool_id, list(DISTINCT label) AS s FROM rnd GROUP BY ALL)"""


@query(
    "d15_repetition",
    f"""WITH {ITEMS_SQL}, {_TOPS}, jt AS {_JACCARD.format(keys="country", ak="a.country", t="ts", on="a.country = b.country")},
    jr0 AS {_JACCARD.format(keys="country, draw", ak="a.country, a.draw", t="rs", on="a.country = b.country AND a.draw = b.draw")}, jr AS (SELECT country, avg(jaccard) AS jaccard FROM jr0 GROUP BY country),
    m AS (SELECT country, label AS modal FROM (SELECT country, label, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, label) AS r FROM items GROUP BY country, label) WHERE r = 1),
    mt AS (SELECT country, avg(s) AS s FROM (SELECT t.country, pool_id, avg((label = modal)::INT) AS s FROM tops t JOIN m ON m.country = t.country GROUP BY ALL) GROUP BY country),
    mp AS (SELECT country, avg(s) AS s FROM (SELECT t.country, pool_id, avg((label = modal)::INT) AS s FROM items t JOIN m ON m.country = t.country GROUP BY ALL) GROUP BY country),
    st AS (SELECT country, avg(len(s)) AS n, count(*) AS pools FROM ts GROUP BY country), sr AS (SELECT country, avg(len(s)) AS n FROM rs GROUP BY country)
    SELECT jt.country, st.pools, round(jt.jaccard, 6) AS jaccard_top, round(jr.jaccard, 6) AS jaccard_random, round(jt.jaccard - jr.jaccard, 6) AS excess, m.modal, round(mt.s, 6) AS modal_top, round(mp.s, 6) AS modal_pool,
        round(mt.s - mp.s, 6) AS modal_excess, round(st.n, 6) AS set_top, round(sr.n, 6) AS set_random
    FROM jt JOIN jr USING (country) JOIN m USING (country) JOIN mt USING (country) JOIN mp USING (country) JOIN st USING (country) JOIN sr USING (country)""",
)
def d15(spark, sf):
    """Whether the best sixteen of a country's pools repeat labels more than random ones; for the matched excess see ``d15_matched``."""
    return rounded(_repeated(spark, sf).drop("excess_matched"))


def _repeated(spark, sf):
    return cached(spark, ("repetition", sf), lambda: P.repetition(items(spark, sf), 16, 8))


@query("d15_matched")
def d15_matched(spark, sf):
    return rounded(_repeated(spark, sf).select("country", "excess", "excess_matched"))


# ---- rankings, reasons, variants


@query(
    "o2_country_ranking",
    f"""WITH {contrast_sql(16, 8)}, c AS (SELECT country, avg(delta) AS loss FROM pc GROUP BY country)
    SELECT country, round(loss, 6) AS loss, row_number() OVER (ORDER BY loss DESC, country) AS rank, round(max(loss) OVER () - min(loss) OVER (), 6) AS spread, round(stddev_samp(loss) OVER (), 6) AS sd FROM c""",
)
def o2(spark, sf):
    c = contrast(spark, sf, 16, 8).groupBy("country").agg(F.avg("delta").alias("loss"))
    return rounded(P.country_ranking(c, "country", "loss"))


@query("o3_worst_pools", f"WITH {contrast_sql(16, 8)} SELECT pool_id, country, round(delta, 6) AS delta FROM pc ORDER BY round(delta, 6), pool_id LIMIT 10")
def o3(spark, sf):
    """A limit after an order: the ten pools that lose most."""
    return rounded(contrast(spark, sf, 16, 8).select("pool_id", "country", "delta")).orderBy("delta", "pool_id").limit(10)


@query("reason_histogram")
def reasons(spark, sf):
    kept = items(spark, sf).withColumn("keep", F.col("idx") % 4 != 0)
    rows = cached(spark, ("dose", sf), lambda: J.dose_rows(kept, [8, 16, 24], 50))
    return P.reason_histogram(rows, ["k"])


@query("slim_pools", f"WITH {contrast_sql(16, 8)} SELECT pool_id, country, template, round(delta, 6) AS delta, delta IS NULL AS non_estimable FROM pc")
def slim(spark, sf):
    return rounded(contrast(spark, sf, 16, 8).select("pool_id", "country", "template", "delta", F.col("delta").isNull().alias("non_estimable")))


@query(
    "variant_leave_one_out",
    f"""WITH {ITEMS_SQL}, c AS (SELECT country, avg(score) AS v FROM items GROUP BY country), o AS (SELECT country AS left_out FROM c UNION ALL SELECT NULL)
    SELECT o.left_out, count(*) AS countries, round(avg(c.v), 6) AS estimate FROM o JOIN c ON o.left_out IS NULL OR c.country <> o.left_out GROUP BY o.left_out""",
)
def loco(spark, sf):
    c = items(spark, sf).groupBy("country").agg(F.avg("score").alias("v"))
    return rounded(P.leave_one_out(c, "country").groupBy("left_out").agg(F.count("*").alias("countries"), F.avg("v").alias("estimate")))


@query(
    "variant_capped",
    f"""WITH {PHOTOS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY dish_id ORDER BY md5(concat_ws('#', 'cap', dish_id, image_id)), image_id) AS r FROM pictures WHERE dish_id IS NOT NULL)
    SELECT dish_id, image_id FROM p WHERE r <= 2""",
)
def capped(spark, sf):
    return P.capped(pictures(spark, sf).where("dish_id IS NOT NULL"), ["dish_id"], "image_id", 2).select("dish_id", "image_id")


@query(
    "r7_variant_range",
    f"""WITH {ITEMS_SQL}, c AS (SELECT country, template, avg(score) AS v FROM items GROUP BY ALL), o AS (SELECT DISTINCT country AS left_out FROM c),
    e AS (SELECT o.left_out, c.template, avg(c.v) AS estimate, avg(c.v) - 100 AS hi FROM o JOIN c ON c.country <> o.left_out GROUP BY ALL)
    SELECT template, round(min(estimate), 6) AS least, round(max(estimate), 6) AS greatest, count(*) FILTER (WHERE hi < 0) AS below_zero, count(*) AS variants FROM e GROUP BY template""",
)
def r7(spark, sf):
    """The range of an estimate over the countries left out, and how often it lies a hundred below."""
    c = items(spark, sf).groupBy("country", "template").agg(F.avg("score").alias("v"))
    e = P.leave_one_out(c, "country").where("left_out IS NOT NULL").groupBy("left_out", "template").agg(F.avg("v").alias("estimate"))
    return rounded(P.variant_range(e.withColumn("hi", F.col("estimate") - 100), ["template"]))


@query(
    "b10_half_interval",
    f"""WITH {ITEMS_SQL}, p AS (SELECT country, pool_id, avg(score) AS v FROM items GROUP BY ALL), h AS (SELECT p.*, d.draw, count(*) OVER (PARTITION BY country, d.draw) AS m,
        row_number() OVER (PARTITION BY d.draw, country ORDER BY md5(concat_ws('#', 'half', d.draw, country, pool_id)), pool_id) AS r FROM p CROSS JOIN (SELECT unnest(range(1, 101)) AS draw) d),
    e AS (SELECT draw, country, avg(v) AS v FROM h WHERE r <= ceil(m / 2) GROUP BY ALL), q AS (SELECT country, avg(v) AS mid, quantile_cont(v, 0.025) AS a, quantile_cont(v, 0.975) AS b FROM e GROUP BY country),
    t AS (SELECT country, avg(v) AS estimate FROM p GROUP BY country)
    SELECT country, round(estimate, 6) AS estimate, round(estimate + a - mid, 6) AS lo, round(estimate + b - mid, 6) AS hi FROM t JOIN q USING (country)""",
)
def b10i(spark, sf):
    p = items(spark, sf).groupBy("country", "pool_id").agg(F.avg("score").alias("v"))
    reps = B.half_samples(p, ["country"], "pool_id", 100).groupBy("draw", "country").agg(F.avg("v").alias("v"))
    return rounded(P.half_sample_interval(reps, p.groupBy("country").agg(F.avg("v").alias("estimate")), ["country"], "v"))


@query(
    "b13_zipf_subset",
    """WITH s AS (SELECT * FROM (SELECT country, name, row_number() OVER (PARTITION BY country ORDER BY md5(concat_ws('#', 'subset', country, name)), name) AS r FROM vocab WHERE country IS NOT NULL AND name IS NOT NULL) WHERE r <= 32),
    w AS (SELECT country, name, 1.0 / power(r, 1.1) AS w FROM s), l AS (SELECT country, name, w, sum(w) OVER (PARTITION BY country ORDER BY name ROWS UNBOUNDED PRECEDING) AS u, sum(w) OVER (PARTITION BY country) AS t FROM w),
    d AS (SELECT DISTINCT country FROM w), r AS (SELECT country, draw, ('0x' || substr(md5(concat_ws('#', 'dishes', country, draw)), 1, 8))::BIGINT / 4294967296.0 AS u FROM d CROSS JOIN (SELECT unnest(range(1, 65)) AS draw))
    SELECT r.country, r.draw, l.name FROM r JOIN l ON l.country = r.country AND r.u >= (l.u - l.w) / l.t AND r.u < l.u / l.t""",
)
def b13s(spark, sf):
    """A pool's dishes: 64 draws by Zipf's law from 32 random names of each country."""
    v = read(spark, sf, "vocab").where("country IS NOT NULL AND name IS NOT NULL").select("country", "name")
    s = B.hashed_subset(v, ["country"], "name", 32)
    at = F.row_number().over(Window.partitionBy("country").orderBy(F.md5(F.concat_ws("#", F.lit("subset"), "country", "name")), "name"))
    w = s.withColumn("w", 1.0 / F.pow(at.cast("double"), F.lit(1.1)))
    return B.weighted_draws(w, "w", "name", 64, "dishes", "country").select("country", F.col("draw").cast("long").alias("draw"), "name")


@query(
    "u2_bootstrap_median",
    f"""WITH {ITEMS_SQL}, p AS (SELECT country, pool_id, avg(score) AS v FROM items GROUP BY ALL), {boot_sql("country", "pool_id", "p", 60, "any")}, r AS (SELECT draw, quantile_cont(v, 0.5) AS s FROM bs GROUP BY draw)
    SELECT round((SELECT quantile_cont(v, 0.5) FROM p), 6) AS estimate, round(quantile_cont(s, 0.025), 6) AS lo, round(quantile_cont(s, 0.975), 6) AS hi FROM r""",
)
def u2(spark, sf):
    """Any statistic as a callback: here the median."""
    p = items(spark, sf).groupBy("country", "pool_id").agg(F.avg("score").alias("v"))
    return rounded(B.bootstrap_any(p, ["country"], "pool_id", "v", lambda v: v.median(), 60))


@query("u3_permutation_contrast")
def u3(spark, sf):
    """Another null as a callback: the positions of the top k filled from permuted pools."""
    return rounded(I.pool_contrast(items(spark, sf), 16, 8, null=lambda d, k, n, salt: S.permutation_null(d, k, n)))


# ---- tables


@query(
    "r2_keep_by_reader",
    f"""WITH {PHOTOS_SQL}, {CHECKS_SQL}, k AS (SELECT p.country, c.reader, avg(c.kept::INT) AS keep FROM checks c JOIN pictures p USING (image_id) WHERE p.country IS NOT NULL AND c.kept IS NOT NULL GROUP BY ALL)
    SELECT country, coalesce(max(CASE WHEN reader = 'reader_amber' THEN printf('%.3f', keep) END), 'n/a') AS reader_amber, coalesce(max(CASE WHEN reader = 'reader_kelp' THEN printf('%.3f', keep) END), 'n/a') AS reader_kelp,
        coalesce(max(CASE WHEN reader = 'nobody' THEN printf('%.3f', keep) END), 'n/a') AS nobody FROM k GROUP BY country""",
)
def r2(spark, sf):
    c = checks(spark, sf).where("kept IS NOT NULL").join(pictures(spark, sf).where("country IS NOT NULL").select("image_id", "country"), "image_id")
    k = c.groupBy("country", "reader").agg(F.avg(F.col("kept").cast("int")).alias("keep"))
    return P.by_reader(k, ["country"], "keep", ["reader_amber", "reader_kelp", "nobody"])


@query(
    "r5_percent_table",
    f"""WITH {contrast_sql(16, 8)}, c AS (SELECT country, round(avg(delta), 6) AS d FROM pc GROUP BY country)
    SELECT country, round(100 * (exp(d) - 1), 6) AS percent, CASE WHEN d IS NULL THEN 'n/a' ELSE printf('%+.3f', d) END AS shown, CASE WHEN abs(d) < 0.001 THEN '<0.001' ELSE printf('%.3f', abs(d)) END AS p,
        '[' || printf('%+.2f', d - 1) || ', ' || printf('%+.2f', d + 1) || ']' AS interval FROM c""",
)
def r5(spark, sf):
    c = contrast(spark, sf, 16, 8).groupBy("country").agg(F.round(F.avg("delta"), 6).alias("d"))
    d = F.col("d")
    return c.select("country", F.round(P.percent(d), 6).alias("percent"), P.shown(d, 3).alias("shown"), P.shown_p(F.abs(d)).alias("p"), P.shown_interval(d - 1, d + 1, 2).alias("interval"))


@query(
    "i25_country_reliability",
    f"""WITH {PHOTOS_SQL}, {READINGS_SQL}, {CHECKS_SQL}, a AS (SELECT p.country, count(*)::DOUBLE AS n, avg((r.label IS NOT NULL)::INT) AS resolved, count(*) FILTER (WHERE lower(r.label) = lower(p.gt_label))::DOUBLE AS hits
        FROM readings r JOIN pictures p USING (image_id) WHERE p.country IS NOT NULL AND p.gt_label IS NOT NULL GROUP BY p.country), b AS (SELECT p.country, avg(c.kept::INT) AS keep FROM checks c JOIN pictures p USING (image_id) WHERE p.country IS NOT NULL GROUP BY p.country)
    SELECT a.country, n::BIGINT AS n, round(resolved, 6) AS resolved, round(hits / n, 6) AS accuracy, round(((hits / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n)) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 6) AS lo,
        round(((hits / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n)) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 6) AS hi, round(keep, 6) AS keep FROM a LEFT JOIN b USING (country)""",
)
def i25(spark, sf):
    """Per country how far readers and verifier can be trusted."""
    p = pictures(spark, sf).where("country IS NOT NULL").select("image_id", "country", "gt_label")
    r = readings(spark, sf).select("image_id", "label").join(p.where("gt_label IS NOT NULL"), "image_id").groupBy("country")
    a = r.agg(F.count("*").alias("n"), F.avg(F.col("label").isNotNull().cast("int")).alias("resolved"), F.count_if(F.lower("label") == F.lower("gt_label")).alias("hits"))
    b = checks(spark, sf).join(p, "image_id").groupBy("country").agg(F.avg(F.col("kept").cast("int")).alias("keep"))
    lo, hi = wilson(F.col("hits"), F.col("n"))
    return rounded(a.join(b, "country", "left").select("country", "n", "resolved", (F.col("hits") / F.col("n")).alias("accuracy"), lo.alias("lo"), hi.alias("hi"), "keep"))


@query(
    "i20_photo_selection",
    f"""WITH {PHOTOS_SQL}, {CHECKS_SQL}, s AS (SELECT p.country, p.image_id, p.dish_id, avg(c.p_yes) AS score FROM pictures p JOIN checks c USING (image_id) WHERE p.country IS NOT NULL AND p.dish_id IS NOT NULL AND c.p_yes IS NOT NULL GROUP BY ALL),
    d AS (SELECT s.*, d.draw, row_number() OVER (PARTITION BY country, d.draw ORDER BY md5(concat_ws('#', 'photo', d.draw, country, image_id)), image_id) AS r FROM s CROSS JOIN (SELECT unnest(range(1, 41)) AS draw) d),
    p AS (SELECT *, row_number() OVER (PARTITION BY country, draw ORDER BY score DESC, image_id) AS t FROM d WHERE r <= 24),
    e AS (SELECT country, draw, {H} AS h FROM (SELECT country, draw, dish_id, count(*)::DOUBLE AS c FROM p WHERE t <= 6 GROUP BY ALL) GROUP BY ALL), n AS (SELECT country, draw, {H} AS h FROM (SELECT country, draw, dish_id, count(*)::DOUBLE AS c FROM p WHERE r <= 6 GROUP BY ALL) GROUP BY ALL)
    SELECT e.country, count(*) AS draws, round(avg(e.h - n.h), 6) AS delta FROM e JOIN n ON n.country = e.country AND n.draw = e.draw GROUP BY e.country""",
)
def i20(spark, sf):
    """Does keeping the most recognised quarter of random pools of photos lower the diversity of dishes?"""
    s = checks(spark, sf).where("p_yes IS NOT NULL").join(pictures(spark, sf).where("country IS NOT NULL AND dish_id IS NOT NULL").select("image_id", "country", "dish_id"), "image_id")
    s = s.groupBy("country", "image_id", "dish_id").agg(F.avg("p_yes").alias("score"))
    pools = S.random_k(s, 24, 40, "photo", "country", "image_id")
    best = S.top_k(pools.drop("rank"), 6, ["country", "draw"], "score", "image_id")
    sel = D.label_entropy(best, ["country", "draw"], "dish_id").select("country", "draw", F.col("entropy").alias("own"))
    null = D.label_entropy(pools.where("rank <= 6"), ["country", "draw"], "dish_id").select("country", "draw", F.col("entropy").alias("other"))
    return rounded(sel.join(null, ["country", "draw"]).groupBy("country").agg(F.count("*").alias("draws"), F.avg(F.col("own") - F.col("other")).alias("delta")))


@query("i22_second_space")
def i22(spark, sf):
    """The choices made in one space of looks, measured in another: here the first 32 dimensions."""
    from plumbline.plans.selecting import GRID

    v = vectors(spark, sf).withColumn("judge", F.col("score"))
    chosen = S.run_selectors(v, 8, GRID)
    other = v.withColumn("embedding", F.slice("embedding", 1, 32))
    rows = S.frontier_rows(other, chosen, ["family", "param"], 8, 8)
    return rounded(rows.groupBy("family", "param").agg(F.avg("emb_delta").alias("emb_delta"), F.count("*").alias("pools")))


@query(
    "i23_paired_generators",
    f"""WITH {IMAGES_SQL}, {SCORED_SQL}, p AS (SELECT i.generator_id, i.kind, i.country, i.pool_seed, avg(s.score) AS v FROM images i JOIN scored s USING (image_id) WHERE s.score IS NOT NULL AND NOT isnan(s.score) AND i.country IS NOT NULL GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY generator_id, kind, country ORDER BY pool_seed) AS j FROM p), g AS (SELECT min(generator_id) AS a, max(generator_id) AS b FROM p)
    SELECT x.kind, x.country, count(*) AS pairs, round(avg(x.v - y.v), 6) AS difference FROM n x JOIN n y ON x.kind = y.kind AND x.country = y.country AND x.j = y.j, g WHERE x.generator_id = g.a AND y.generator_id = g.b GROUP BY ALL""",
)
def i23(spark, sf):
    """Two generators paired by the place of the pool in its cell."""
    s = scored(spark, sf).where("score IS NOT NULL AND NOT isnan(score)").select("image_id", "score")
    p = images(spark, sf).where("country IS NOT NULL").join(s, "image_id").groupBy("generator_id", "kind", "country", "pool_seed").agg(F.avg("score").alias("v"))
    n = p.withColumn("j", F.row_number().over(Window.partitionBy("generator_id", "kind", "country").orderBy("pool_seed")))
    ends = F.broadcast(p.agg(F.min("generator_id").alias("a"), F.max("generator_id").alias("b")))  # one row
    side = n.crossJoin(ends).groupBy("kind", "country", "j")
    both = side.agg(F.max(F.when(F.col("generator_id") == F.col("a"), F.col("v"))).alias("x"), F.max(F.when(F.col("generator_id") == F.col("b"), F.col("v"))).alias("y"))
    both = both.where("x IS NOT NULL AND y IS NOT NULL").groupBy("kind", "country")
    return rounded(both.agg(F.count("*").alias("pairs"), F.avg(F.col("x") - F.col("y")).alias("difference")))


@query(
    "k20_illustration",
    f"""WITH {ITEMS_SQL}, p AS (SELECT * FROM items WHERE pool_id = (SELECT min(pool_id) FROM items)), t AS (SELECT idx, 'topk' AS family, {RANK} AS r FROM p),
    n AS (SELECT idx, 'random' AS family, row_number() OVER (ORDER BY md5(concat_ws('#', 'null', 1, pool_id, idx)), idx) AS r FROM p) SELECT family, r AS rank, idx FROM (SELECT * FROM t UNION ALL SELECT * FROM n) WHERE r <= 8""",
)
def k20(spark, sf):
    """One pool, and what two selectors take from it."""
    i = items(spark, sf)
    one = i.join(F.broadcast(i.agg(F.min("pool_id").alias("pool_id"))), "pool_id")
    top = S.top_k(one, 8).select(F.lit("topk").alias("family"), "rank", "idx")
    return top.unionByName(S.random_k(one, 8, 1).select(F.lit("random").alias("family"), "rank", "idx"))


# ---- checks


@query(
    "v4_text_mismatches",
    f"WITH {IMAGES_SQL}, {SCORED_SQL}, m AS (SELECT image_id, CASE WHEN kind = 'tune' THEN select_text || '!' ELSE select_text END AS select_text FROM images) SELECT m.image_id, m.select_text, s.text AS scored_text FROM m JOIN scored s USING (image_id) WHERE s.text IS DISTINCT FROM m.select_text",
)
def v4t(spark, sf):
    """Images scored on another text than theirs: the table has hardly any, so tuning images get another."""
    i = images(spark, sf).withColumn("select_text", F.when(F.col("kind") == "tune", F.concat("select_text", F.lit("!"))).otherwise(F.col("select_text")))
    return C.text_mismatches(i, scored(spark, sf), "image_id", "text", "select_text")


@query(
    "j1_checked_scores",
    f"""WITH {IMAGES_SQL}, {SCORED_SQL} SELECT i.kind, count(*) AS items, round(avg(s.score), 6) AS score FROM images i JOIN scored s USING (image_id) WHERE s.text IS NOT DISTINCT FROM i.select_text AND NOT isnan(s.score) AND s.score IS NOT NULL GROUP BY i.kind""",
)
def j1c(spark, sf):
    """The join that raises on a lost or differently scored item, on those that are neither."""
    s = scored(spark, sf).where("score IS NOT NULL AND NOT isnan(score)")
    i = images(spark, sf).select("image_id", "kind", "select_text")
    good = i.join(s.select("image_id", F.col("text").alias("select_text")), ["image_id", "select_text"], "left_semi")
    null_text = i.where("select_text IS NULL").join(s.where("text IS NULL").select("image_id"), "image_id", "left_semi")
    j = C.items_with_scores(good.unionByName(null_text), s, "image_id", "text", "select_text")
    return rounded(j.groupBy("kind").agg(F.count("*").alias("items"), F.avg("score").alias("score")))


@query("v8_mixed_sources", f"WITH {READINGS_SQL} SELECT image_id, count(DISTINCT reader) AS sources FROM readings GROUP BY image_id HAVING count(DISTINCT reader) > 1")
def v8(spark, sf):
    return C.mixed_sources(readings(spark, sf), "image_id", "reader")


@query(
    "v10_grid_differences",
    "SELECT * FROM (VALUES ('topk', NULL::DOUBLE, 'found'), ('mmr', 0.5, 'planned')) t(family, param, side)",
)
def v10(spark, sf):
    """A grid that lacks a configuration and has another; a parameter that both lack is no difference."""
    planned = spark.createDataFrame([("stk", None), ("stk", 4.0), ("mmr", 0.5)], "family string, param double")
    found = spark.createDataFrame([("stk", None), ("stk", 4.0), ("topk", None)], "family string, param double")
    return C.grid_differences(planned, found, ["family", "param"])


# ---- wording


@query("t9_known_prompts", "SELECT vocab_id, 'An image of ' || name || ', a traditional dish from ' || country AS prompt FROM vocab")
def t9(spark, sf):
    return read(spark, sf, "vocab").select("vocab_id", X.known_label_prompt(F.col("name"), F.col("country")).alias("prompt"))


@query(
    "t10_model_tags",
    "SELECT DISTINCT generator_id, CASE WHEN kind = 'tune' THEN 'tuned' WHEN generator_id = 'black-forest-labs/FLUX.1-schnell' THEN 'flux-schnell' ELSE lower(string_split(generator_id, '/')[-1]) END AS tag FROM manifest UNION SELECT 'black-forest-labs/FLUX.1-schnell', 'flux-schnell'",
)
def t10(spark, sf):
    m = read(spark, sf, "manifest").select("generator_id", F.when(F.col("kind") == "tune", "tuned").alias("own"))
    m = m.unionByName(spark.createDataFrame([("black-forest-labs/FLUX.1-schnell", "")], "generator_id string, own string"))
    return m.select("generator_id", X.model_tag(F.col("generator_id"), F.col("own")).alias("tag")).distinct()


@query(
    "b16_item_seeds",
    "SELECT image_id, min(('0x' || substr(md5(concat_ws('#', 'item', pool_seed, idx)), 1, 15))::BIGINT) AS seed FROM manifest GROUP BY image_id",
)
def b16(spark, sf):
    m = read(spark, sf, "manifest").select("image_id", X.item_seed(F.col("pool_seed"), F.col("idx")).alias("seed"))
    return m.groupBy("image_id").agg(F.min("seed").alias("seed"))


@query(
    "t14_choice_options",
    """WITH d AS (SELECT v.country, v.name, o.name AS decoy, row_number() OVER (PARTITION BY v.country, v.name ORDER BY md5(concat_ws('#', 'decoy', v.name, o.name)), o.name) AS r FROM vocab v JOIN vocab o ON v.country = o.country AND v.name <> o.name),
    l AS (SELECT name, list(decoy ORDER BY r) AS decoys FROM d WHERE r <= 3 GROUP BY name), p AS (SELECT v.vocab_id, v.name, decoys, ('0x' || substr(md5(concat_ws('#', 'place', v.vocab_id::VARCHAR)), 1, 8))::BIGINT % 4 AS place FROM vocab v JOIN l ON l.name = v.name)
    SELECT vocab_id, place::INT AS true_pos, list_concat(list_concat(decoys[1:place], [name]), list_concat(decoys[place + 1:3], ['none of these'])) AS option_list FROM p""",
)
def t14o(spark, sf):
    v = read(spark, sf, "vocab").select("vocab_id", "country", "name")
    o = v.select("country", F.col("name").alias("decoy"))
    j = v.join(o, "country").where("name <> decoy").withColumn("p", F.md5(F.concat_ws("#", F.lit("decoy"), "name", "decoy")))
    j = j.withColumn("r", F.row_number().over(Window.partitionBy("vocab_id").orderBy("p", "decoy"))).where("r <= 3")
    l = j.groupBy("vocab_id", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "decoy"))), lambda x: x["decoy"]).alias("decoys"))
    options, place = X.choice_options(F.col("vocab_id").cast("string"), F.col("name"), F.col("decoys"))
    return l.select("vocab_id", place.alias("true_pos"), options.alias("option_list"))


@query("d11_diversity_at")
def d11(spark, sf):
    """Each pool's label diversity at eight items."""
    return rounded(D.diversity_at(items(spark, sf), ["pool_id"], 8))
