"""Selection queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plumbline.catalog import query
from plumbline.operators import selection as S
from plumbline.plans.base import ITEMS_SQL, items, rounded, vectors
from plumbline.runtime import cached

RANK = "row_number() OVER (PARTITION BY pool_id ORDER BY score DESC NULLS LAST, idx)"


def drawn(salt: str, draws: int, source: str = "items") -> str:
    return f"""(SELECT i.*, d.draw, row_number() OVER (PARTITION BY pool_id, d.draw ORDER BY md5(concat_ws('#', '{salt}', d.draw, pool_id, idx)), idx) AS r
        FROM {source} i CROSS JOIN (SELECT unnest(range(1, {draws + 1})) AS draw) d)"""


@query("k1_topk", f"WITH {ITEMS_SQL} SELECT pool_id, idx, r AS rank FROM (SELECT *, {RANK} AS r FROM items) WHERE r <= 16")
def k1(spark, sf):
    return S.top_k(items(spark, sf), 16).select("pool_id", "idx", "rank")


@query("k2_random_k", f"WITH {ITEMS_SQL} SELECT pool_id, draw, idx FROM {drawn('null', 4)} WHERE r <= 16")
def k2(spark, sf):
    return S.random_k(items(spark, sf), 16, 4).select("pool_id", F.col("draw").cast("long").alias("draw"), "idx")


@query(
    "k3_permutation_null",
    f"""WITH {ITEMS_SQL}, places AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY idx) AS place, {RANK} AS rk FROM items)
    SELECT d.pool_id, d.draw, d.idx FROM {drawn('perm', 2)} d JOIN places p ON p.pool_id = d.pool_id AND p.place = d.r WHERE p.rk <= 16""",
)
def k3(spark, sf):
    return S.permutation_null(items(spark, sf), 16, 2).select("pool_id", F.col("draw").cast("long").alias("draw"), "idx")


@query(
    "k4_size_topk",
    f"""WITH {ITEMS_SQL}, sized AS (SELECT user_id AS pool_id, event_id AS idx, length(props) AS size FROM events)
    SELECT pool_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY size DESC, idx) AS r FROM sized) WHERE r <= 16""",
)
def k4(spark, sf):
    from plumbline.runtime import read

    sized = read(spark, sf, "events").select(F.col("user_id").alias("pool_id"), F.col("event_id").alias("idx"), F.length("props").cast("double").alias("size"))
    return S.top_k(sized, 16, score="size").select("pool_id", "idx")


DIRECTION = [((7 * i + 3) % 11 - 5) / 5.0 for i in range(64)]
_UNIT = [x / sum(y * y for y in DIRECTION) ** 0.5 for x in DIRECTION]


@query(
    "k5_random_direction",
    f"""WITH v AS (SELECT vec_id % 10 AS pool_id, vec_id AS idx, round(list_sum(list_transform(list_zip(embedding, {_UNIT}), lambda x: x[1]::DOUBLE * x[2])), 9) AS score FROM embeddings)
    SELECT pool_id, idx FROM (SELECT *, {RANK} AS r FROM v) WHERE r <= 8""",
)
def k5(spark, sf):
    return S.random_direction(vectors(spark, sf), 8, _UNIT).select("pool_id", "idx")


@query(
    "k9_allocation",
    f"""WITH {ITEMS_SQL}, s AS (SELECT pool_id, label, count(*) AS size FROM items GROUP BY ALL), n AS (SELECT *, sum(size) OVER (PARTITION BY pool_id)::BIGINT AS n FROM s),
    b AS (SELECT *, (least(16, n) * size) // n AS base, (least(16, n) * size) % n AS rest FROM n)
    SELECT pool_id, label, size, base + CASE WHEN row_number() OVER (PARTITION BY pool_id ORDER BY rest DESC, size DESC, label)
        <= least(16, n) - sum(base) OVER (PARTITION BY pool_id) THEN 1 ELSE 0 END AS quota FROM b""",
)
def k9a(spark, sf):
    return S.allocate(items(spark, sf), 16, stratum="label")


@query(
    "k9_stratified_topk",
    f"""WITH {ITEMS_SQL}, s AS (SELECT pool_id, label, count(*) AS size FROM items GROUP BY ALL), n AS (SELECT *, sum(size) OVER (PARTITION BY pool_id)::BIGINT AS n FROM s),
    b AS (SELECT *, (least(16, n) * size) // n AS base, (least(16, n) * size) % n AS rest FROM n),
    q AS (SELECT pool_id, label, base + CASE WHEN row_number() OVER (PARTITION BY pool_id ORDER BY rest DESC, size DESC, label)
        <= least(16, n) - sum(base) OVER (PARTITION BY pool_id) THEN 1 ELSE 0 END AS quota FROM b)
    SELECT i.pool_id, i.label, i.idx FROM (SELECT *, row_number() OVER (PARTITION BY pool_id, label ORDER BY score DESC NULLS LAST, idx) AS r FROM items) i
    JOIN q ON q.pool_id = i.pool_id AND q.label = i.label WHERE i.r <= q.quota""",
)
def k9(spark, sf):
    return S.stratified_top_k(items(spark, sf), 16, stratum="label").select("pool_id", "label", "idx")


@query(
    "k10_threshold_random",
    f"""WITH {ITEMS_SQL}, b AS (SELECT * FROM (SELECT *, {RANK} AS rk, count(*) OVER (PARTITION BY pool_id) AS n FROM items)
        WHERE rk <= greatest(16, round_even(n * 0.5, 0)))
    SELECT pool_id, idx FROM {drawn('thr', 1, 'b')} WHERE r <= 16""",
)
def k10(spark, sf):
    return S.threshold_random(items(spark, sf), 16, 0.5).select("pool_id", "idx")


@query(
    "k18_best_of_n",
    f"""WITH {ITEMS_SQL}, d AS {drawn('bon', 3)},
    n AS (SELECT pool_id, count(*) AS n FROM items GROUP BY pool_id),
    s AS (SELECT d.*, z.size FROM d JOIN n ON n.pool_id = d.pool_id CROSS JOIN (SELECT unnest([20, 32, 48]) AS size) z WHERE r <= z.size AND (z.size < n OR (z.size = n AND d.draw = 1))),
    t AS (SELECT *, row_number() OVER (PARTITION BY pool_id, size, draw ORDER BY score DESC NULLS LAST, idx) AS k FROM s)
    SELECT pool_id, size, round(avg(score), 6) AS mean_score FROM t WHERE k <= 16 GROUP BY pool_id, size""",
)
def k18(spark, sf):
    b = S.best_of_n(items(spark, sf), [20, 32, 48], 16, 3)
    return rounded(b.groupBy("pool_id", "size").agg(F.avg("score").alias("mean_score")))


@query(
    "k18_slope",
    f"""WITH {ITEMS_SQL}, d AS {drawn('bon', 3)},
    n AS (SELECT pool_id, count(*) AS n FROM items GROUP BY pool_id),
    s AS (SELECT d.*, z.size FROM d JOIN n ON n.pool_id = d.pool_id CROSS JOIN (SELECT unnest([20, 32, 48]) AS size) z WHERE r <= z.size AND (z.size < n OR (z.size = n AND d.draw = 1))),
    t AS (SELECT *, row_number() OVER (PARTITION BY pool_id, size, draw ORDER BY score DESC NULLS LAST, idx) AS k FROM s),
    m AS (SELECT pool_id, country, size, avg(score) AS y FROM t WHERE k <= 16 GROUP BY ALL)
    SELECT country, round(regr_slope(y, log2(size / 16.0)), 6) AS slope FROM m GROUP BY country""",
)
def k18s(spark, sf):
    b = S.best_of_n(items(spark, sf), [20, 32, 48], 16, 3).groupBy("pool_id", "country", "size").agg(F.avg("score").alias("y"))
    return rounded(b.groupBy("country").agg(F.regr_slope("y", F.log2(F.col("size") / 16.0)).alias("slope")))


@query(
    "k19_top_fraction",
    f"""WITH {ITEMS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY score DESC NULLS LAST, md5(concat_ws('#', 'tie', pool_id, idx)), idx) AS r,
        count(*) OVER (PARTITION BY pool_id) AS n FROM items) SELECT pool_id, idx FROM t WHERE r <= greatest(4, round_even(n * 0.25, 0))""",
)
def k19(spark, sf):
    return S.top_fraction(items(spark, sf), 0.25).select("pool_id", "idx")


@query(
    "k15_evaluate",
    f"""WITH {ITEMS_SQL}, j AS (SELECT *, ('0x' || substr(md5(concat_ws('#', 'judge', idx)), 1, 8))::BIGINT / 4294967296.0 + score / 100 AS judge, {RANK} AS r FROM items),
    p AS (SELECT pool_id, avg(judge) AS mean, stddev_pop(judge) AS sd, avg(judge) FILTER (WHERE r <= 16) AS picked FROM j GROUP BY pool_id)
    SELECT pool_id, 'topk' AS family, round(picked - mean, 6) AS raw_gain, round(CASE WHEN sd > 0 THEN (picked - mean) / sd ELSE 0 END, 6) AS std_gain FROM p""",
)
def k15(spark, sf):
    judge = F.conv(F.substring(F.md5(F.concat_ws("#", F.lit("judge"), "idx")), 1, 8), 16, 10).cast("double") / 4294967296.0 + F.col("score") / 100
    i = items(spark, sf).withColumn("judge", judge)
    picked = S.top_k(i, 16).select("pool_id", "idx", F.lit("topk").alias("family"))
    return rounded(S.evaluate(i, picked, ["family"]))


#: The configurations compared: top k, then strata, marginal relevance and determinantal grids, and the other greedy families.
GRID = [("topk", 0.0), *(("stk", c) for c in (2, 4, 8)), *(("mmr", x) for x in (0.4, 0.7, 0.9)), *(("dpp", a) for a in (1, 4)), ("facility", 1.0), ("kcenter", 1.0)]


@query("k16_selectors")
def k16(spark, sf):
    """Every selector on every pool of vectors."""
    return S.run_selectors(vectors(spark, sf), 8, GRID)


@query("k12_greedy_vendi")
def k12(spark, sf):
    return S.run_selectors(vectors(spark, sf, 40), 4, [("vendi", 0.5)])


@query(
    "k6_mmr_first_steps",
    f"""WITH v AS (SELECT vec_id % 10 AS pool_id, vec_id AS idx, embedding::DOUBLE[] AS e,
        ('0x' || substr(md5(concat_ws('#', 'score', vec_id)), 1, 8))::BIGINT / 4294967296.0 AS score FROM embeddings),
    z AS (SELECT *, (score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-12) AS z FROM v WINDOW w AS (PARTITION BY pool_id)),
    a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY z DESC, idx) AS r FROM z) WHERE r = 1),
    s AS (SELECT z.pool_id, z.idx, 0.7 * z.z - 0.3 * list_cosine_similarity(z.e, a.e) AS m FROM z JOIN a ON a.pool_id = z.pool_id WHERE z.idx <> a.idx),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY m DESC, idx) AS r FROM s) WHERE r = 1)
    SELECT pool_id, 1 AS rank, idx FROM a UNION ALL SELECT pool_id, 2, idx FROM b""",
)
def k6(spark, sf):
    return S.run_selectors(vectors(spark, sf), 2, [("mmr", 0.7)]).select("pool_id", "rank", "idx")


def _frontier(spark, sf):
    """Every configuration's contrasts and gains on the pools of vectors, labels in twenty bands, with the random baseline."""
    v = vectors(spark, sf).withColumn("judge", F.col("score") + F.col("label") / 20.0)
    return S.frontier_rows(v, S.run_selectors(v, 8, GRID), ["family", "param"], 8, 8)


@query("k15_frontier_rows")
def k15f(spark, sf):
    """Delta, emb_delta and both gains of all selectors, and a random one."""
    return rounded(cached(spark, ("frontier", sf), lambda: _frontier(spark, sf)))


@query("k17_choose_on_tuning")
def k17(spark, sf):
    """The configuration that keeps the most judge gain within the diversity margin; ties keep the order of the grid."""
    places = spark.createDataFrame([(f, float(p), n) for n, (f, p) in enumerate(GRID)], "family string, param double, grid_pos int")
    rows = cached(spark, ("frontier", sf), lambda: _frontier(spark, sf)).join(F.broadcast(places), ["family", "param"])
    rows = rows.select(F.concat_ws("|", "family", "param").alias("config"), "grid_pos", (F.col("pool_id") % 2).alias("country"), F.col("emb_delta").alias("delta"), F.col("std_gain").alias("gain"))
    return rounded(S.choose_on_tuning(rows, math.log(0.9)))
