"""Queries of fixed designs, paired and clustered resampling, decisions, frontiers and the photo study."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.operators import deciding as J
from plumbline.operators import diversity as D
from plumbline.operators import inference as I
from plumbline.operators import ranking as R
from plumbline.operators import resampling as B
from plumbline.operators import selection as S
from plumbline.plans.auditing import CELLS, boot_sql, contrast, contrast_sql
from plumbline.plans.base import CHECKS_SQL, ITEMS_SQL, PHOTOS_SQL, READINGS_SQL, checks, items, pictures, readings, rounded
from plumbline.runtime import cached, materialize, read

RANK = "row_number() OVER (PARTITION BY pool_id ORDER BY score DESC NULLS LAST, idx)"
#: Of each pool the mean score of its best 16, and of its second best 16, over the pool's mean.
GAINS_SQL = f"""{ITEMS_SQL}, rk AS (SELECT *, {RANK} AS r FROM items),
    gains AS (SELECT pool_id, country, template, avg(score) FILTER (WHERE r <= 16) - avg(score) AS top_gain, avg(score) FILTER (WHERE r BETWEEN 17 AND 32) - avg(score) FILTER (WHERE r <= 16) AS gain FROM rk GROUP BY ALL)"""


def gains(spark, sf):
    """The gains of all pools: made once a session and shared by the queries, which read them several times."""
    return cached(spark, ("gains", sf), lambda: _gains(spark, sf))


def _gains(spark, sf):
    ranked = items(spark, sf).withColumn("r", F.row_number().over(S.by_score("pool_id")))
    top = F.avg(F.when(F.col("r") <= 16, F.col("score")))
    second = F.avg(F.when(F.col("r").between(17, 32), F.col("score")))
    g = ranked.groupBy("pool_id", "country", "template").agg((top - F.avg("score")).alias("top_gain"), (second - top).alias("gain"))
    return g


def one_row(spark, d: dict):
    """A dictionary as a relation of one row; its values' types are those of the annotations below."""
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    fields = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'double'}" for k, v in d.items())
    return spark.createDataFrame([tuple(d.values())], fields)


# ---- fixed design and bootstraps

_LONG = """lx AS (SELECT 'gain' AS metric, country, template, pool_id, gain AS x FROM gains UNION ALL SELECT 'top_gain', country, template, pool_id, top_gain FROM gains), lv AS (SELECT * FROM lx WHERE x IS NOT NULL)"""


@query(
    "i16_fixed_design",
    f"""WITH {GAINS_SQL}, {_LONG}, c AS (SELECT metric, country, template, count(*) AS n, avg(x) AS m, var_samp(x) / count(*) AS v FROM lv GROUP BY ALL),
    k AS (SELECT metric, country, count(*) AS t, avg(m) AS m FROM c GROUP BY ALL), s AS (SELECT metric, count(*) AS cs FROM k GROUP BY metric),
    w AS (SELECT c.*, 1.0 / (k.t * s.cs) AS w FROM c JOIN k ON k.metric = c.metric AND k.country = c.country JOIN s ON s.metric = c.metric),
    f AS (SELECT metric, sum(w * m) AS mean, sqrt(sum(w * w * v)) AS se, sum(w * w * v) * sum(w * w * v) / sum(w * w * v * w * w * v / (n - 1)) AS df, sum(n)::BIGINT AS pools FROM w GROUP BY metric),
    {boot_sql("metric, country, template", "pool_id", "lv", 200, "fixed")},
    bc AS (SELECT metric, draw, country, template, avg(x) AS m FROM bs GROUP BY ALL), bk AS (SELECT metric, draw, country, avg(m) AS m FROM bc GROUP BY ALL), br AS (SELECT metric, draw, avg(m) AS m FROM bk GROUP BY ALL),
    bq AS (SELECT metric, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM br GROUP BY metric)
    SELECT f.metric, round(mean, 6) AS mean, round(se, 6) AS se, round(df, 4) AS df, round(lo, 6) AS boot_lo, round(hi, 6) AS boot_hi, pools FROM f JOIN bq USING (metric)""",
)
def i16(spark, sf):
    """Two metrics of each pool over the design; their t intervals are in ``fixed_design``, which SQL has no quantiles for."""
    d = J.fixed_design(gains(spark, sf), ["gain", "top_gain"], [], 200)
    return rounded(d.select("metric", "mean", "se", F.round("df", 4).alias("df"), "boot_lo", "boot_hi", "pools"))


@query("i16_tests")
def i16_tests(spark, sf):
    return rounded(J.fixed_design(gains(spark, sf), ["gain", "top_gain"], [], 200))


_PAIR = boot_sql("country, template", "pool_id", "gw", 200, "pair")
_GW = "gw AS (SELECT * FROM gains WHERE gain IS NOT NULL AND top_gain IS NOT NULL)"


def _nested(source: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""(SELECT {k}avg(a) AS a, avg(b) AS b FROM (SELECT {k}country, avg(a) AS a, avg(b) AS b FROM
        (SELECT {k}country, template, avg(top_gain) AS a, avg(gain) AS b FROM {source} GROUP BY ALL) GROUP BY ALL) {group})"""


@query(
    "b3_paired_bootstrap",
    f"""WITH {GAINS_SQL}, {_GW}, {_PAIR}, p AS (SELECT (a + b) / a AS value FROM {_nested("gw", "")}), r AS (SELECT CASE WHEN a > 0 THEN (a + b) / a END AS s FROM {_nested("bs", "draw")})
    SELECT round((SELECT value FROM p), 6) AS value, round(quantile_cont(s, 0.025), 6) AS lo, round(quantile_cont(s, 0.975), 6) AS hi, round(count(s) / 200.0, 6) AS finite FROM r""",
)
def b3(spark, sf):
    """The share of top k's gain that the second best sixteen keep, a pool's two gains resampled together."""
    share = F.when(F.col("top_gain") > 0, (F.col("top_gain") + F.col("gain")) / F.col("top_gain"))
    return rounded(J.paired_bootstrap(gains(spark, sf), ["top_gain", "gain"], share, 200))


@query("m18_retention")
def m18(spark, sf):
    """The share kept, in raw units, behind the gate on top k's own interval."""
    return rounded(one_row(spark, J.retention(gains(spark, sf), "gain", 200)))


def _welch_sql(source: str, keys: str) -> str:
    """F by ``keys`` from (keys, country, mean, var, df)."""
    return f"""(SELECT {keys}, ((sum(mean * mean / var) - sum(mean / var) * sum(mean / var) / sum(1 / var)) / (count(*) - 1))
        / (1 + 2 * (count(*) - 2.0) / (count(*) * count(*) - 1) * (sum(1 / df) - 2 * sum(1 / var / df) / sum(1 / var) + sum(1 / var / var / df) / (sum(1 / var) * sum(1 / var)))) AS f FROM {source} GROUP BY {keys})"""


@query(
    "b5_recentred_null",
    f"""WITH {contrast_sql(16, 8)}, {CELLS}, own AS (SELECT 1 AS one, country, avg(mean) AS mean, sum(v) / (count(*) * count(*)) AS var, sum(v) * sum(v) / sum(v * v / (pools - 1)) AS df FROM cm GROUP BY country),
    ctr AS (SELECT country, template, pool_id, delta - avg(delta) OVER (PARTITION BY country, template) AS delta FROM pc), {boot_sql("country, template", "pool_id", "ctr", 200, "centre")},
    bc AS (SELECT draw, country, template, avg(delta) AS m, var_samp(delta) / count(*) AS v FROM bs GROUP BY ALL),
    bk AS (SELECT bc.draw, bc.country, avg(m) AS mean, greatest(sum(v) / (count(*) * count(*)), 1e-300) AS var, any_value(own.df) AS df FROM bc JOIN own ON own.country = bc.country GROUP BY ALL),
    o AS (SELECT f FROM {_welch_sql("own", "one")}), nf AS {_welch_sql("bk", "draw")}
    SELECT round((SELECT f FROM o), 5) AS f, count(*) AS draws, round((1 + count(*) FILTER (WHERE nf.f >= (SELECT f FROM o))) / 201.0, 6) AS p FROM nf""",
)
def b5(spark, sf):
    r = J.recentred_p(contrast(spark, sf, 16, 8), 200)
    return rounded(r.withColumn("f", F.round("f", 5)))


@query(
    "i10_welch_statistic",
    f"""WITH {contrast_sql(16, 32)}, {CELLS}, own AS (SELECT 1 AS one, country, avg(mean) AS mean, sum(v) / (count(*) * count(*)) AS var, sum(v) * sum(v) / sum(v * v / (pools - 1)) AS df FROM cm GROUP BY country)
    SELECT round(f, 5) AS f FROM {_welch_sql("own", "one")}""",
)
def i10f(spark, sf):
    """The statistic of the test of heterogeneity; its tail is in ``i10_heterogeneity``."""
    own = I.country_moments(I.cell_moments(contrast(spark, sf, 16, 32)))
    return J.welch_statistic(own.withColumn("one", F.lit(1)), ["one"]).select(F.round("f", 5).alias("f"))


#: Photos checked by a reader, with the quartile of the yes-probability within the country.
_KEEP_SQL = f"""{PHOTOS_SQL}, {CHECKS_SQL}, k AS (SELECT p.country, p.dish_id, c.image_id, c.reader, c.kept::INT AS kept,
        least(4 * (row_number() OVER (PARTITION BY p.country ORDER BY c.p_yes, c.image_id, c.reader) - 1) // greatest(count(*) OVER (PARTITION BY p.country) - 1, 1), 3) AS q
        FROM checks c JOIN pictures p USING (image_id) WHERE c.kept IS NOT NULL AND c.p_yes IS NOT NULL AND p.country IS NOT NULL AND p.dish_id IS NOT NULL)"""


def _kept(spark, sf):
    c = checks(spark, sf).where("kept IS NOT NULL AND p_yes IS NOT NULL").select("image_id", "reader", F.col("kept").cast("int").alias("kept"), "p_yes")
    k = c.join(pictures(spark, sf).select("image_id", "country", "dish_id"), "image_id").where("country IS NOT NULL AND dish_id IS NOT NULL")
    w = Window.partitionBy("country")
    at = F.row_number().over(w.orderBy("p_yes", "image_id", "reader")) - 1
    n = F.greatest(F.count("*").over(w) - 1, F.lit(1))
    return k.withColumn("q", F.least(F.floor(4 * at / n), F.lit(3)))


@query("i19_keep_by_quartile", f"WITH {_KEEP_SQL} SELECT q::BIGINT AS q, count(*) AS rows, round(avg(kept), 6) AS keep_rate FROM k GROUP BY q")
def i19(spark, sf):
    k = _kept(spark, sf).groupBy(F.col("q").cast("long").alias("q"))
    return rounded(k.agg(F.count("*").alias("rows"), F.avg("kept").alias("keep_rate")))


@query(
    "b7_dish_clusters",
    f"""WITH {_KEEP_SQL}, d AS (SELECT country, dish_id, coalesce(sum(kept) FILTER (WHERE q = 3), 0)::DOUBLE AS kt, count(*) FILTER (WHERE q = 3)::DOUBLE AS nt, coalesce(sum(kept) FILTER (WHERE q = 0), 0)::DOUBLE AS kb, count(*) FILTER (WHERE q = 0)::DOUBLE AS nb FROM k GROUP BY ALL),
    {boot_sql("country", "dish_id", "d", 200, "dishes")}, r AS (SELECT draw, CASE WHEN sum(nt) > 0 AND sum(nb) > 0 THEN sum(kt) / sum(nt) - sum(kb) / sum(nb) END AS s FROM bs GROUP BY draw)
    SELECT round((SELECT sum(kt) / sum(nt) - sum(kb) / sum(nb) FROM d), 6) AS value, round(quantile_cont(s, 0.025), 6) AS lo, round(quantile_cont(s, 0.975), 6) AS hi, round(count(s) / 200.0, 6) AS finite FROM r""",
)
def b7(spark, sf):
    """The keep rate of the top quartile less that of the bottom one, dishes resampled within countries."""
    top, low = F.col("q") == 3, F.col("q") == 0
    sums = {"kt": F.sum(F.when(top, F.col("kept")).otherwise(0)), "nt": F.count_if(top), "kb": F.sum(F.when(low, F.col("kept")).otherwise(0)), "nb": F.count_if(low)}
    stat = F.when((F.col("nt") > 0) & (F.col("nb") > 0), F.col("kt") / F.col("nt") - F.col("kb") / F.col("nb"))
    return rounded(J.cluster_bootstrap(_kept(spark, sf), ["country"], "dish_id", sums, stat, 200, "dishes"))


@query(
    "b8_decomposition_clusters",
    f"""WITH {ITEMS_SQL}, b AS (SELECT *, least((4 * (row_number() OVER (PARTITION BY pool_id ORDER BY score, idx) - 1)) // count(*) OVER (PARTITION BY pool_id), 3) AS bin FROM items),
    y AS (SELECT *, (idx % 3 = 0)::DOUBLE AS y FROM b), u AS (SELECT DISTINCT country, pool_id FROM y), {boot_sql("country", "pool_id", "u", 50, "mix")},
    yy AS (SELECT bs.draw, y.country, y.label, y.bin, y.y FROM bs JOIN y ON y.pool_id = bs.pool_id AND y.country = bs.country),
    c AS (SELECT draw, country, label, count(*) FILTER (WHERE bin = 0) AS n0, count(*) FILTER (WHERE bin = 3) AS n3, sum(y) FILTER (WHERE bin = 0) AS y0, sum(y) FILTER (WHERE bin = 3) AS y3, avg(y) AS r FROM yy GROUP BY ALL),
    w AS (SELECT *, n0 / sum(n0) OVER (PARTITION BY draw, country) AS w0, n3 / sum(n3) OVER (PARTITION BY draw, country) AS w3 FROM c),
    o AS (SELECT draw, country, sum(y3) / sum(n3) - sum(y0) / sum(n0) AS total, sum((w3 - w0) * r) AS composition FROM w GROUP BY ALL)
    SELECT country, round(quantile_cont(composition, 0.025), 6) AS comp_lo, round(quantile_cont(composition, 0.975), 6) AS comp_hi, round(quantile_cont(total - composition, 0.025), 6) AS within_lo,
        round(quantile_cont(total - composition, 0.975), 6) AS within_hi FROM o GROUP BY country""",
)
def b8(spark, sf):
    """The terms of the mix decomposition with whole pools resampled within countries."""
    b = R.ranked_bins(items(spark, sf), "pool_id").withColumn("ok", F.col("idx") % 3 == 0)
    draws = B.resample(b.select("country", "pool_id").distinct(), ["country"], "pool_id", 50, "mix").drop("place")
    rows = draws.join(b.select("pool_id", "country", "label", "bin", "ok"), ["country", "pool_id"])
    t = D.mix_decomposition(rows, ["draw", "country"], "label", "bin", "ok", 0, 3).groupBy("country")
    return rounded(t.agg(*[F.percentile(c, p).alias(f"{n}_{e}") for c, n in (("composition", "comp"), ("within", "within")) for p, e in ((0.025, "lo"), (0.975, "hi"))]))


_POOLS = "p AS (SELECT country, pool_id, avg(score) AS v FROM items GROUP BY ALL)"


@query(
    "b9_pool_bootstrap",
    f"""WITH {ITEMS_SQL}, {_POOLS}, {boot_sql("country", "pool_id", "p", 200, "pools")}, r AS (SELECT draw, avg(v) AS s FROM bs GROUP BY draw)
    SELECT round((SELECT avg(v) FROM p), 6) AS value, round(quantile_cont(s, 0.025), 6) AS lo, round(quantile_cont(s, 0.975), 6) AS hi, 1.0::DOUBLE AS finite FROM r""",
)
def b9(spark, sf):
    """All pools with equal weight, resampled within countries."""
    p = items(spark, sf).groupBy("country", "pool_id").agg(F.avg("score").alias("v"))
    return rounded(J.cluster_bootstrap(p, ["country"], "pool_id", {"s": F.sum("v"), "n": F.count("v")}, F.col("s") / F.col("n"), 200, "pools"))


@query(
    "m17_welch_difference",
    f"""WITH {ITEMS_SQL}, {_POOLS}, g AS (SELECT pool_id % 2 AS half, count(*) AS n, avg(v) AS m, var_samp(v) / count(*) AS v FROM p GROUP BY half), a AS (SELECT * FROM g WHERE half = 0), b AS (SELECT * FROM g WHERE half = 1)
    SELECT round(a.m - b.m, 6) AS difference, round(sqrt(a.v + b.v), 6) AS se, round((a.v + b.v) * (a.v + b.v) / (a.v * a.v / (a.n - 1) + b.v * b.v / (b.n - 1)), 4) AS df FROM a, b""",
)
def m17(spark, sf):
    p = items(spark, sf).groupBy("country", "pool_id").agg(F.avg("score").alias("v")).withColumn("half", (F.col("pool_id") % 2).cast("string"))
    d = J.welch_difference(p, "half", "0", "1", "v")
    return rounded(one_row(spark, d).select("difference", "se", F.round("df", 4).alias("df")))


@query(
    "m19_dominance",
    f"""WITH {ITEMS_SQL}, p AS (SELECT country, pool_id, template, avg(score) AS v, count(DISTINCT label)::DOUBLE AS d FROM items GROUP BY ALL),
    {boot_sql("country, template", "pool_id", "p", 200, "dom")}, t AS (SELECT draw, country, avg(v) FILTER (WHERE template = 0) - avg(v) FILTER (WHERE template = 1) AS v, avg(d) FILTER (WHERE template = 0) - avg(d) FILTER (WHERE template = 1) AS d FROM bs GROUP BY ALL),
    q AS (SELECT country, quantile_cont(v, 0.025) AS vl, quantile_cont(v, 0.975) AS vh, quantile_cont(d, 0.025) AS dl, quantile_cont(d, 0.975) AS dh FROM t GROUP BY country),
    w AS (SELECT country, CASE WHEN vl IS NULL THEN 'n/e' WHEN vl > 0 THEN 'better' WHEN vh < 0 THEN 'worse' ELSE 'tie' END AS g, CASE WHEN dl IS NULL THEN 'n/e' WHEN dl > 0 THEN 'better' WHEN dh < 0 THEN 'worse' ELSE 'tie' END AS d FROM q)
    SELECT country, g AS gain, d AS diversity, CASE WHEN g = 'n/e' OR d = 'n/e' THEN 'n/e' WHEN (g = 'better' OR d = 'better') AND g <> 'worse' AND d <> 'worse' THEN 'dominates'
        WHEN (g = 'worse' OR d = 'worse') AND g <> 'better' AND d <> 'better' THEN 'dominated' WHEN g = 'tie' AND d = 'tie' THEN 'tie' ELSE 'trade-off' END AS verdict FROM w""",
)
def m19(spark, sf):
    """One template against the other in each country, by intervals of score and number of labels."""
    p = items(spark, sf).groupBy("country", "pool_id", "template").agg(F.avg("score").alias("v"), F.countDistinct("label").cast("double").alias("d"))
    s = B.resample(p, ["country", "template"], "pool_id", 200, "dom").groupBy("draw", "country")
    diff = lambda c: F.avg(F.when(F.col("template") == 0, F.col(c))) - F.avg(F.when(F.col("template") == 1, F.col(c)))
    q = s.agg(diff("v").alias("v"), diff("d").alias("d")).groupBy("country")
    q = q.agg(*[F.percentile(c, x).alias(f"{c}{e}") for c in "vd" for x, e in ((0.025, "l"), (0.975, "h"))])
    w = q.select("country", J.interval_verdict(F.col("vl"), F.col("vh")).alias("gain"), J.interval_verdict(F.col("dl"), F.col("dh")).alias("diversity"))
    return w.withColumn("verdict", J.dominance_of(F.col("gain"), F.col("diversity")))


@query(
    "i21_robust_over_readers",
    f"""WITH {PHOTOS_SQL}, {CHECKS_SQL}, d AS (SELECT p.country, c.reader, p.dish_id, sum(c.p_yes_decoy - c.p_yes) AS s, count(*)::DOUBLE AS n FROM checks c JOIN pictures p USING (image_id)
        WHERE p.country IS NOT NULL AND p.dish_id IS NOT NULL AND c.p_yes IS NOT NULL AND c.p_yes_decoy IS NOT NULL GROUP BY ALL), {boot_sql("country, reader", "dish_id", "d", 100, "readers")},
    r AS (SELECT country, reader, draw, sum(s) / sum(n) AS x FROM bs GROUP BY ALL), h AS (SELECT country, reader, quantile_cont(x, 0.975) AS hi FROM r GROUP BY ALL),
    want AS (SELECT DISTINCT reader FROM checks WHERE reader IS NOT NULL)
    SELECT country, CASE WHEN count(DISTINCT reader) < (SELECT count(*) FROM want) THEN 'pending' WHEN bool_and(hi < 0) THEN 'yes' ELSE 'no' END AS verdict FROM h GROUP BY country""",
)
def i21(spark, sf):
    """Whether every reader finds the decoy less likely than the dish, by the upper end of an interval over dishes."""
    c = checks(spark, sf).where("p_yes IS NOT NULL AND p_yes_decoy IS NOT NULL")
    j = c.join(pictures(spark, sf).select("image_id", "country", "dish_id"), "image_id").where("country IS NOT NULL AND dish_id IS NOT NULL")
    sums = {"s": F.sum(F.col("p_yes_decoy") - F.col("p_yes")), "n": F.count("*")}
    hi = J.cluster_bootstrap(j, ["country", "reader"], "dish_id", sums, F.col("s") / F.col("n"), 100, "readers", by=["country", "reader"])
    required = [r[0] for r in checks(spark, sf).where("reader IS NOT NULL").select("reader").distinct().collect()]  # readers are a design
    return I.robust_over_readers(hi, ["country"], required)


# ---- dose, gap, spread, claims


@query("i2_dose_rows")
def i2(spark, sf):
    """Kept contrasts at three k, all rarefied to the smallest."""
    kept = items(spark, sf).withColumn("keep", F.col("idx") % 4 != 0)
    return rounded(cached(spark, ("dose", sf), lambda: J.dose_rows(kept, [8, 16, 24], 50)))


@query("i3_dose_summary")
def i3s(spark, sf):
    kept = items(spark, sf).withColumn("keep", F.col("idx") % 4 != 0)
    rows = cached(spark, ("dose", sf), lambda: J.dose_rows(kept, [8, 16, 24], 50))
    return rounded(J.dose_summary(rows, 16, 200))


def _gaps(spark, sf):
    """A machine reader that takes two labels for one, less the audit's, per pool."""
    merged = F.when(F.col("label") == F.lit("view"), F.lit("click")).otherwise(F.col("label"))
    other = cached(spark, ("merged", sf), lambda: I.pool_contrast(items(spark, sf).withColumn("label", merged), 16, 8)).select("pool_id", F.col("delta").alias("machine"))
    return contrast(spark, sf, 16, 8).join(other, "pool_id").withColumn("gap", F.col("machine") - F.col("delta"))


@query("i12_gap_test")
def i12(spark, sf):
    return rounded(one_row(spark, J.gap_test(_gaps(spark, sf), "gap", 8)))


def _spread(spark, sf):
    """The rule reads the country means and their intervals several times: both, a row a country, are written once, so the pools are resampled once."""
    d = contrast(spark, sf, 16, 8).select("country", "template", "pool_id", "delta")
    countries = materialize(I.country_moments(I.cell_moments(d)), "countries")
    points = countries.select("country", F.col("mean").alias("estimate"), F.sqrt("var").alias("se"))
    reps = I.country_moments(I.cell_moments(B.resample(d, ["country", "template"], "pool_id", 200), by=["draw"]), by=["draw"])
    intervals = materialize(B.max_modulus(reps.select("draw", "country", F.col("mean").alias("m"), F.sqrt("var").alias("se")), points, "country"), "intervals")
    verdict = J.heterogeneity_verdict(countries, intervals)
    p = J.recentred_p(d, 200).first()["p"]
    return J.spread_rule(countries, intervals, verdict, p, countries.count() == 8)


@query("i13_spread_rule")
def i13(spark, sf):
    return rounded(one_row(spark, _spread(spark, sf)))


@query("i15_claims")
def i15(spark, sf):
    """The three claims with Holm's correction, each with the reasons for which it is withheld."""
    d = contrast(spark, sf, 16, 8)
    loss = I.country_marginal(d, 8)
    moments = I.marginal_moments(I.cell_moments(d)).first().asDict()
    kept = J.retention(gains(spark, sf), "gain", 200)
    test = J.fixed_design(gains(spark, sf), ["gain"], [], 50).first()
    front = {"p": test["p_le_0"], "lo": test["lo"], "top_lo": kept["top_lo"], "retained": kept["retained"]}
    rows = J.claims(loss, moments, J.gap_test(_gaps(spark, sf), "gap", 8), _spread(spark, sf), front)
    out = [(c["name"], c["p"], c["p_holm"], c["claimed"], c["status"], c["withheld"]) for c in rows]
    return rounded(spark.createDataFrame(out, "name string, p double, p_holm double, claimed boolean, status string, withheld array<string>"))


@query("i17_against_top")
def i17(spark, sf):
    """Every configuration against top k: gain and both diversities over the design, and its dominance."""
    from plumbline.plans.selecting import _frontier

    rows = cached(spark, ("frontier", sf), lambda: _frontier(spark, sf)).where("family <> 'random'")
    rows = rows.withColumn("country", F.concat(F.lit("c"), (F.col("pool_id") % 2).cast("string"))).withColumn("template", F.lit("A"))
    diff = J.against_top(rows, ["std_gain", "emb_delta", "delta"], ["family", "param"], F.col("family") == "topk")
    tests = J.fixed_design(diff, ["std_gain", "emb_delta", "delta"], ["family", "param"], 100)
    v = J.interval_verdict(F.col("lo"), F.col("hi"))
    wide = tests.withColumn("v", v).groupBy("family", "param").pivot("metric", ["std_gain", "emb_delta", "delta"]).agg(F.first("mean").alias("mean"), F.first("v").alias("verdict"))
    return rounded(wide.withColumn("dominance", J.dominance_of(F.col("std_gain_verdict"), F.col("emb_delta_verdict"))))


@query(
    "i17_matched_gain",
    f"""WITH {ITEMS_SQL}, rk AS (SELECT *, {RANK} AS r FROM items), c AS (SELECT pool_id, z.s, avg(score) FILTER (WHERE r > z.s AND r <= z.s + 8) AS g, count(DISTINCT label) FILTER (WHERE r > z.s AND r <= z.s + 8)::DOUBLE AS d
        FROM rk CROSS JOIN (SELECT unnest([0, 4, 8]) AS s) z GROUP BY ALL), w AS (SELECT pool_id, max(g) FILTER (WHERE s = 0) AS g0, max(g) FILTER (WHERE s = 4) AS g1, max(g) FILTER (WHERE s = 8) AS g2,
        max(d) FILTER (WHERE s = 0) AS d0, max(d) FILTER (WHERE s = 4) AS d1, max(d) FILTER (WHERE s = 8) AS d2 FROM c GROUP BY pool_id), x AS (SELECT *, (g0 + g2) / 2 AS g FROM w)
    SELECT pool_id, round(greatest(CASE WHEN g BETWEEN least(g0, g1) AND greatest(g0, g1) THEN CASE WHEN g0 = g1 THEN d0 ELSE d0 + (d1 - d0) * (g - g0) / (g1 - g0) END END,
        CASE WHEN g BETWEEN least(g1, g2) AND greatest(g1, g2) THEN CASE WHEN g1 = g2 THEN d1 ELSE d1 + (d2 - d1) * (g - g1) / (g2 - g1) END END), 6) AS labels FROM x""",
)
def i17m(spark, sf):
    """The labels that a curve of ever lower slices of a pool holds at the gain half way along it."""
    r = items(spark, sf).withColumn("r", F.row_number().over(S.by_score("pool_id"))).groupBy("pool_id")
    inside = lambda s: (F.col("r") > s) & (F.col("r") <= s + 8)
    w = r.agg(*[F.avg(F.when(inside(s), F.col("score"))).alias(f"g{n}") for n, s in enumerate((0, 4, 8))], *[F.countDistinct(F.when(inside(s), F.col("label"))).cast("double").alias(f"d{n}") for n, s in enumerate((0, 4, 8))])
    g, d = [F.col(f"g{n}") for n in range(3)], [F.col(f"d{n}") for n in range(3)]
    return rounded(w.select("pool_id", J.matched_gain((F.col("g0") + F.col("g2")) / 2, g, d).alias("labels")))


# ---- photo study

_SETS_SQL = """ph AS (SELECT DISTINCT country, dish_id, image_id FROM pictures WHERE gt_in_cspace AND country IS NOT NULL AND dish_id IS NOT NULL), pd AS (SELECT DISTINCT country, dish_id FROM ph),
    dr AS (SELECT DISTINCT country, s.set, ('0x' || substr(md5(concat_ws('#', 'set', country, s.set)), 1, 8))::BIGINT % 8 + 1 AS dishes FROM pd CROSS JOIN (SELECT unnest(range(1, 51)) AS set) s),
    pk AS (SELECT * FROM (SELECT dr.*, pd.dish_id, row_number() OVER (PARTITION BY dr.country, dr.set ORDER BY md5(concat_ws('#', 'set', dr.country, dr.set, pd.dish_id)), pd.dish_id) AS r FROM dr JOIN pd ON pd.country = dr.country) WHERE r <= dishes),
    ow AS (SELECT pk.country, pk.set, pk.dishes, pk.dish_id, ph.image_id, row_number() OVER (PARTITION BY pk.country, pk.set, pk.dish_id ORDER BY md5(concat_ws('#', 'set', pk.set, ph.image_id)), ph.image_id) = 1 AS fst FROM pk JOIN ph ON ph.country = pk.country AND ph.dish_id = pk.dish_id),
    pl AS (SELECT *, row_number() OVER (PARTITION BY country, set ORDER BY fst DESC, md5(concat_ws('#', 'set', set, image_id)), image_id) AS place, count(*) OVER (PARTITION BY country, set) AS have, count(*) FILTER (WHERE fst) OVER (PARTITION BY country, set) AS found FROM ow),
    sets AS (SELECT country, set, dishes, dish_id, image_id FROM pl WHERE found = dishes AND have >= 8 AND place <= 8)"""


def _sets(spark, sf):
    p = pictures(spark, sf).where("gt_in_cspace AND country IS NOT NULL AND dish_id IS NOT NULL").select("country", "dish_id", "image_id")
    return J.spread_sets(p, 8, 50)


@query("j13_photo_sets", f"WITH {PHOTOS_SQL}, {_SETS_SQL} SELECT country, set, dishes, dish_id, image_id FROM sets")
def j13(spark, sf):
    """Sets of eight photos whose number of dishes is spread."""
    return _sets(spark, sf).select("country", F.col("set").cast("long").alias("set"), "dishes", "dish_id", "image_id")


_VENDI = "exp(ln(sum(c)) - sum(c * ln(c)) / sum(c)) / sum(c)"


@query(
    "i18_set_diversity",
    f"""WITH {PHOTOS_SQL}, {READINGS_SQL}, {_SETS_SQL}, t AS (SELECT country, set, {_VENDI} AS truth FROM (SELECT country, set, dish_id, count(*)::DOUBLE AS c FROM sets GROUP BY ALL) GROUP BY ALL),
    l AS (SELECT s.country, s.set, r.reader, r.label, count(*)::DOUBLE AS c FROM sets s JOIN readings r USING (image_id) WHERE r.label IS NOT NULL GROUP BY ALL),
    d AS (SELECT country, set, reader, {_VENDI} AS read, sum(c)::BIGINT AS labels FROM l GROUP BY ALL)
    SELECT d.country, d.set, reader, labels, round(truth, 6) AS truth, round(read, 6) AS read FROM d JOIN t ON t.country = d.country AND t.set = d.set WHERE labels >= 2""",
)
def i18(spark, sf):
    """What each reader's labels say of the diversity of the sets, beside the truth."""
    return rounded(_set_diversity(spark, sf).select("country", F.col("set").cast("long").alias("set"), "reader", "labels", "truth", "read"))


def _set_diversity(spark, sf):
    sets = _sets(spark, sf)
    truth = D.label_entropy(sets, ["country", "set"], "dish_id").select("country", "set", F.col("vendi_norm").alias("truth"))
    read_as = D.label_entropy(sets.join(readings(spark, sf).select("image_id", "reader", "label"), "image_id"), ["country", "set", "reader"])
    return read_as.where("n >= 2").select("country", "set", "reader", F.col("n").alias("labels"), F.col("vendi_norm").alias("read")).join(truth, ["country", "set"])


@query("i18_tracking")
def i18t(spark, sf):
    """Of all readers together, whether contrasts between sets have the sign and size of the true ones."""
    d = _set_diversity(spark, sf).select(F.concat_ws("#", "country", "set", "reader").alias("set"), "truth", "read")
    return rounded(J.tracking(d, 4000))


@query(
    "j11_other_countries",
    """WITH v AS (SELECT vec_id, label % 5 AS country, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, country, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v),
    x AS (SELECT vec_id, country, unnest(range(0, len(u))) AS pos, unnest(u) AS x FROM u), s AS (SELECT country, pos, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY ALL), t AS (SELECT pos, sum(s) AS t FROM s GROUP BY pos), n AS (SELECT country, count(*)::DOUBLE AS n FROM u GROUP BY country)
    SELECT s.country, round((sum(s.s * s.s) - sum(s.q)) / any_value(n.n * (n.n - 1)), 6) AS own, round(sum(s.s * (t.t - s.s)) / any_value(n.n * ((SELECT sum(n) FROM n) - n.n)), 6) AS other FROM s JOIN t ON t.pos = s.pos JOIN n ON n.country = s.country GROUP BY s.country""",
)
def j11(spark, sf):
    """Mean cosine of an item with the others of its country and with those of other countries, from sums a dimension: no pairs are made."""
    v = read(spark, sf, "embeddings").select((F.col("label") % 5).alias("country"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rounded(D.country_cosines(v, "country", "embedding"))
