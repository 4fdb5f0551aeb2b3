"""Queries of contrasts, resampling and decisions over the design."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.functions.stats import log_contrast, null_bias_bounds
from plumbline.operators import inference as I
from plumbline.operators import resampling as B
from plumbline.operators import selection as S
from plumbline.operators.diversity import label_entropy
from plumbline.plans.base import ITEMS_SQL, items, rounded
from plumbline.runtime import cached

def contrast(spark, sf: str, k: int, draws: int):
    """The contrasts of all pools against ``draws`` random k's: the null is drawn once a session and shared by the queries."""
    return cached(spark, ("contrast", sf, k, draws), lambda: I.pool_contrast(items(spark, sf), k, draws))


H = "ln(sum(c)) - sum(c * ln(c)) / sum(c)"


def contrast_sql(k: int = 16, draws: int = 32, salt: str = "null") -> str:
    """CTEs up to ``pc``: the contrast of each pool."""
    return f"""{ITEMS_SQL},
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY score DESC NULLS LAST, idx) AS r FROM items) WHERE r <= {k}),
    st AS (SELECT pool_id, country, template, {H} AS selected FROM (SELECT pool_id, country, template, label, count(*)::DOUBLE AS c FROM t GROUP BY ALL) GROUP BY ALL),
    d AS (SELECT i.*, d.draw, row_number() OVER (PARTITION BY pool_id, d.draw ORDER BY md5(concat_ws('#', '{salt}', d.draw, pool_id, idx)), idx) AS r
        FROM items i CROSS JOIN (SELECT unnest(range(1, {draws + 1})) AS draw) d),
    n AS (SELECT pool_id, draw, {H} AS h FROM (SELECT pool_id, draw, label, count(*)::DOUBLE AS c FROM d WHERE r <= {k} GROUP BY ALL) GROUP BY ALL),
    nn AS (SELECT pool_id, avg(h) AS null_mean, stddev_samp(h) AS null_sd FROM n GROUP BY pool_id),
    pc AS (SELECT st.*, null_mean, null_sd, selected - null_mean AS delta FROM st JOIN nn USING (pool_id))"""


@query(
    "i1_pool_contrast",
    f"""WITH {contrast_sql()} SELECT pool_id, country, template, round(delta, 6) AS delta, round(selected, 6) AS selected, round(null_mean, 6) AS null_mean,
        round(null_sd, 6) AS null_sd, CASE WHEN null_sd > 0 THEN round(delta / null_sd, 6) END AS z FROM pc""",
)
def i1(spark, sf):
    """Does keeping each pool's best 16 by score reduce label diversity against random 16?"""
    return rounded(contrast(spark, sf, 16, 32))


@query("i1_endpoint_kept")
def i1_endpoint(spark, sf):
    """The same on kept items only, rarefied exactly, with the reason ladder."""
    kept = items(spark, sf).withColumn("keep", F.col("idx") % 4 != 0)
    return rounded(I.endpoint(kept, 16, 8, 200))


@query(
    "i3_dose_response",
    f"""WITH a AS (WITH {contrast_sql(8, 8)} SELECT pool_id, 8 AS k, delta FROM pc), b AS (WITH {contrast_sql(16, 8)} SELECT pool_id, 16 AS k, delta FROM pc),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
    SELECT u.k, count(*) AS pools, round(avg(u.delta), 6) AS mean_delta, round(avg(u.delta - b.delta), 6) AS minus_primary FROM u JOIN b ON b.pool_id = u.pool_id GROUP BY u.k""",
)
def i3(spark, sf):
    return rounded(I.dose_response(items(spark, sf), [8, 16], 8, 16))


CELLS = "cm AS (SELECT country, template, count(*) AS pools, avg(delta) AS mean, var_samp(delta) / count(*) AS v FROM pc GROUP BY ALL)"


@query("i5_cells", f"WITH {contrast_sql()}, {CELLS} SELECT country, template, pools, round(mean, 6) AS mean, round(v, 6) AS var_of_mean FROM cm")
def i5(spark, sf):
    return rounded(I.cell_moments(contrast(spark, sf, 16, 32)))


@query(
    "i5_countries",
    f"""WITH {contrast_sql()}, {CELLS} SELECT country, round(avg(mean), 6) AS mean, round(sum(v) / (count(*) * count(*)), 6) AS var,
    CASE WHEN sum(v) > 0 THEN round(sum(v) * sum(v) / sum(v * v / (pools - 1)), 5) END AS df, min(pools) < 2 AS thin FROM cm GROUP BY country""",
)
def i5c(spark, sf):
    c = I.country_moments(I.cell_moments(contrast(spark, sf, 16, 32)))
    return rounded(c.withColumn("df", F.round("df", 5)))


@query(
    "i6_marginal",
    f"""WITH {contrast_sql()}, {CELLS}, ct AS (SELECT country, count(*) AS t FROM cm GROUP BY country), w AS (SELECT cm.*, 1.0 / (ct.t * (SELECT count(*) FROM ct)) AS w FROM cm JOIN ct USING (country))
    SELECT (SELECT count(*) FROM ct) AS countries, round(sum(w * mean), 6) AS theta, round(sqrt(sum(w * w * v)), 6) AS se,
        round(sum(w * w * v) * sum(w * w * v) / sum(w * w * v * w * w * v / (pools - 1)), 4) AS df, min(pools) < 2 AS thin FROM w""",
)
def i6(spark, sf):
    m = I.marginal_moments(I.cell_moments(contrast(spark, sf, 16, 32)))
    return rounded(m.withColumn("df", F.round("df", 4)))


@query("i9_country_marginal")
def i9(spark, sf):
    """Equivalence test of the equal-weight mean over countries."""
    d = I.country_marginal(contrast(spark, sf, 16, 32), expected=8)
    schema = "verdict string, reason string, estimate double, lo double, hi double, p_low double, p_high double"
    return rounded(spark.createDataFrame([tuple(d.values())], schema))


@query("i10_heterogeneity")
def i10(spark, sf):
    h = I.heterogeneity(I.country_moments(I.cell_moments(contrast(spark, sf, 16, 32))))
    return rounded(spark.createDataFrame([(h["verdict"], h["f"], h["p"])], "verdict string, f double, p double"))


@query(
    "i11_disjoint_pairs",
    f"""WITH {contrast_sql()}, {CELLS}, c AS (SELECT country, avg(mean) AS m, sqrt(sum(v)) / count(*) AS se FROM cm GROUP BY country),
    i AS (SELECT country, round(m - se, 6) AS lo, round(m + se, 6) AS hi FROM c)
    SELECT a.country AS a, b.country AS b, round(greatest(a.lo - b.hi, b.lo - a.hi), 5) AS gap FROM i a JOIN i b ON a.country < b.country WHERE greatest(a.lo - b.hi, b.lo - a.hi) > 0""",
)
def i11(spark, sf):
    """Pairs of countries whose one-standard-error intervals do not meet."""
    c = I.country_moments(I.cell_moments(contrast(spark, sf, 16, 32)))
    iv = c.select("country", F.round(F.col("mean") - F.sqrt("var"), 6).alias("lo"), F.round(F.col("mean") + F.sqrt("var"), 6).alias("hi"))
    return rounded(I.disjoint_pairs(iv), 5)


@query(
    "m1_log_contrast",
    f"""WITH {contrast_sql(16, 8)}, e AS (SELECT pool_id, exp(selected) AS vendi, null_mean FROM pc) SELECT pool_id, round(CASE WHEN vendi > 0 THEN ln(vendi) - null_mean END, 6) AS delta,
        round(exp(ln(vendi) - null_mean) - 1, 6) AS change FROM e""",
)
def m1(spark, sf):
    c = contrast(spark, sf, 16, 8)
    d = log_contrast(F.exp("selected"), F.col("null_mean"))
    return rounded(c.select("pool_id", d.alias("delta"), F.expm1(d).alias("change")))


@query(
    "m3_null_bias",
    f"""WITH {contrast_sql(16, 8)}, f AS (SELECT *, (pool_id % 5) / 50.0 AS f FROM pc)
    SELECT pool_id, round(selected - (1 - f) * null_mean - f * ln(8), 6) AS lo, round(selected - (1 - f) * null_mean, 6) AS hi FROM f""",
)
def m3(spark, sf):
    lo, hi = null_bias_bounds(F.col("selected"), F.col("null_mean"), (F.col("pool_id") % 5) / 50.0, 8)
    return rounded(contrast(spark, sf, 16, 8).select("pool_id", lo.alias("lo"), hi.alias("hi")))


# ---- resampling


def boot_sql(cell: str, unit: str, source: str, draws: int, salt: str) -> str:
    """CTEs up to ``bs``: resampled rows of ``source`` with their draw."""
    return f"""bi AS (SELECT *, row_number() OVER (PARTITION BY {cell} ORDER BY {unit}) AS i, count(*) OVER (PARTITION BY {cell}) AS m FROM {source}),
    bp AS (SELECT {cell}, i AS place, m, d.draw, ('0x' || substr(md5(concat_ws('#', '{salt}', d.draw, {cell}, i)), 1, 8))::BIGINT % m + 1 AS want FROM bi CROSS JOIN (SELECT unnest(range(1, {draws + 1})) AS draw) d),
    bs AS (SELECT bp.draw, bp.place, bi.* FROM bp JOIN bi ON bi.i = bp.want AND {" AND ".join(f"bi.{c.strip()} = bp.{c.strip()}" for c in cell.split(","))})"""


@query(
    "b1_bootstrap",
    f"""WITH {ITEMS_SQL}, p AS (SELECT country, pool_id, avg(score) AS v FROM items GROUP BY ALL), {boot_sql("country", "pool_id", "p", 50, "boot")},
    rp AS (SELECT draw, country, avg(v) AS m FROM bs GROUP BY ALL), pt AS (SELECT country, avg(v) AS estimate FROM p GROUP BY country)
    SELECT rp.country, round(any_value(estimate), 6) AS estimate, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, count(*) AS draws FROM rp JOIN pt USING (country) GROUP BY rp.country""",
)
def b1(spark, sf):
    p = items(spark, sf).groupBy("country", "pool_id").agg(F.avg("score").alias("v"))
    return rounded(B.bootstrap_mean(p, ["country"], "pool_id", "v", 50, outer=["country"]))


@query(
    "b2_stratified_bootstrap",
    f"""WITH {contrast_sql(16, 8)}, {boot_sql("country, template", "pool_id", "pc", 50, "boot")}, c AS (SELECT draw, country, template, avg(delta) AS m FROM bs GROUP BY ALL),
    k AS (SELECT draw, country, avg(m) AS m FROM c GROUP BY ALL), r AS (SELECT draw, avg(m) AS m FROM k GROUP BY draw),
    e AS (SELECT avg(m) AS estimate FROM (SELECT country, avg(m) AS m FROM (SELECT country, template, avg(delta) AS m FROM pc GROUP BY ALL) GROUP BY country))
    SELECT round((SELECT estimate FROM e), 6) AS estimate, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, count(*) AS draws FROM r""",
)
def b2(spark, sf):
    return rounded(B.bootstrap_mean(contrast(spark, sf, 16, 8), ["country", "template"], "pool_id", "delta", 50))


_B4_SQL = f"""WITH {contrast_sql(16, 8)}, {CELLS}, pt AS (SELECT country, avg(mean) AS e0, sqrt(sum(v) / (count(*) * count(*))) AS se0 FROM cm GROUP BY country),
    {boot_sql("country, template", "pool_id", "pc", 200, "boot")}, bc AS (SELECT draw, country, template, avg(delta) AS m, var_samp(delta) / count(*) AS v FROM bs GROUP BY ALL),
    bk AS (SELECT draw, country, avg(m) AS m, sqrt(sum(v) / (count(*) * count(*))) AS se FROM bc GROUP BY ALL),
    bt AS (SELECT draw, max(abs(m - e0) / CASE WHEN se > 0 THEN se END) AS t, count(*) FILTER (WHERE NOT (se > 0)) AS bad FROM bk JOIN pt ON pt.country = bk.country GROUP BY draw),
    q AS (SELECT CASE WHEN avg((bad > 0)::INT) <= 0.01 THEN quantile_cont(t, 0.95) FILTER (WHERE bad = 0) END AS q FROM bt)
    SELECT country, round(e0, 6) AS estimate, round(e0 - q * se0, 6) AS lo, round(e0 + q * se0, 6) AS hi FROM pt, q"""


@query("b4_simultaneous_intervals", _B4_SQL)
def b4(spark, sf):
    """Bootstrap-t intervals that hold for all countries at once."""
    d = contrast(spark, sf, 16, 8)
    points = I.country_moments(I.cell_moments(d)).select("country", F.col("mean").alias("estimate"), F.sqrt("var").alias("se"))
    cells = I.cell_moments(B.resample(d, ["country", "template"], "pool_id", 200), by=["draw"])
    reps = I.country_moments(cells, by=["draw"]).select("draw", "country", F.col("mean").alias("m"), F.sqrt("var").alias("se"))
    return rounded(B.max_modulus(reps, points, "country"))


@query(
    "b6_cluster_ratio",
    f"""WITH {ITEMS_SQL}, p AS (SELECT country, pool_id, sum((idx % 3 = 0)::INT)::DOUBLE AS num, count(*)::DOUBLE AS den FROM items GROUP BY ALL), {boot_sql("country", "pool_id", "p", 50, "ratio")},
    r AS (SELECT draw, sum(num) / sum(den) AS r FROM bs GROUP BY draw)
    SELECT round((SELECT sum(num) / sum(den) FROM p), 6) AS estimate, round(quantile_cont(r, 0.025), 6) AS lo, round(quantile_cont(r, 0.975), 6) AS hi FROM r""",
)
def b6(spark, sf):
    i = items(spark, sf).withColumn("num", (F.col("idx") % 3 == 0).cast("int")).withColumn("den", F.lit(1))
    return rounded(B.bootstrap_ratio(i, ["country"], "pool_id", "num", "den", 50))


@query(
    "b10_half_samples",
    f"""WITH {ITEMS_SQL}, p AS (SELECT DISTINCT country, pool_id FROM items), h AS (SELECT p.*, d.draw, count(*) OVER (PARTITION BY country, d.draw) AS m,
        row_number() OVER (PARTITION BY d.draw, country ORDER BY md5(concat_ws('#', 'half', d.draw, country, pool_id)), pool_id) AS r FROM p CROSS JOIN (SELECT unnest(range(1, 6)) AS draw) d)
    SELECT draw, country, pool_id FROM h WHERE r <= ceil(m / 2)""",
)
def b10(spark, sf):
    h = B.half_samples(items(spark, sf).select("country", "pool_id").distinct(), ["country"], "pool_id", 5)
    return h.select(F.col("draw").cast("long").alias("draw"), "country", "pool_id")


@query(
    "b11_permutation_null",
    f"""WITH {ITEMS_SQL}, d AS (SELECT country, idx, label, score, d.draw, row_number() OVER (PARTITION BY d.draw, country ORDER BY idx) AS f,
        row_number() OVER (PARTITION BY d.draw, country ORDER BY md5(concat_ws('#', 'shuffle', d.draw, country, idx)), idx) AS t FROM items CROSS JOIN (SELECT unnest(range(1, 6)) AS draw) d),
    p AS (SELECT a.draw, a.country, a.score, b.label FROM d a JOIN d b ON a.draw = b.draw AND a.country = b.country AND a.f = b.t),
    g AS (SELECT draw, country, label, count(*) AS n, sum(score) AS s, sum(score * score) AS q FROM p GROUP BY ALL),
    e AS (SELECT draw, country, (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)) AS eta2 FROM g GROUP BY ALL)
    SELECT country, round(avg(eta2), 6) AS null_eta2 FROM e GROUP BY country""",
)
def b11(spark, sf):
    p = B.permuted(items(spark, sf).select("country", "idx", "label", "score"), ["country"], "idx", "label", 5)
    g = p.groupBy("draw", "country", "label").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("q"))
    t = g.groupBy("draw", "country").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    base = F.col("s") * F.col("s") / F.col("n")
    return rounded(t.groupBy("country").agg(F.avg((F.col("b") - base) / (F.col("q") - base)).alias("null_eta2")))


@query(
    "b12_shared_null",
    f"WITH {contrast_sql(16, 16)} SELECT pool_id, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd FROM nn",
)
def b12(spark, sf):
    """The null distribution of each pool, which all selectors share."""
    n = label_entropy(S.random_k(items(spark, sf), 16, 16), ["pool_id", "draw"]).groupBy("pool_id")
    return rounded(n.agg(F.avg("entropy").alias("null_mean"), F.stddev_samp("entropy").alias("null_sd")))


@query(
    "b13_zipf_draws",
    """WITH w AS (SELECT country, name, 1.0 / power(row_number() OVER (PARTITION BY country ORDER BY name), 1.3) AS w FROM vocab WHERE country IS NOT NULL AND name IS NOT NULL),
    l AS (SELECT country, name, w, sum(w) OVER (PARTITION BY country ORDER BY name ROWS UNBOUNDED PRECEDING) AS u, sum(w) OVER (PARTITION BY country) AS t FROM w),
    d AS (SELECT DISTINCT country FROM w), r AS (SELECT country, draw, ('0x' || substr(md5(concat_ws('#', 'zipf', country, draw)), 1, 8))::BIGINT / 4294967296.0 AS u FROM d CROSS JOIN (SELECT unnest(range(1, 17)) AS draw))
    SELECT r.country, r.draw, l.name FROM r JOIN l ON l.country = r.country AND r.u >= (l.u - l.w) / l.t AND r.u < l.u / l.t""",
)
def b13(spark, sf):
    from pyspark.sql import Window

    from plumbline.runtime import read

    v = read(spark, sf, "vocab").where("country IS NOT NULL AND name IS NOT NULL")
    w = v.withColumn("w", 1.0 / F.pow(F.row_number().over(Window.partitionBy("country").orderBy("name")).cast("double"), F.lit(1.3)))
    return B.weighted_draws(w, "w", "name", 16, group="country").select("country", F.col("draw").cast("long").alias("draw"), "name")
