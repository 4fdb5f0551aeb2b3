"""Selection of k items from every pool: by score, at random, by strata, and by greedy diversity criteria.

All operators work on long rows (pool, position, score, ...). Ties go to the lower position. Null and NaN scores rank last.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.runtime import materialize, rank_score

#: A greedy selector holds one pool in one task. Larger pools are refused rather than cut: use ``stratified_top_k``, which has no such limit.
MAX_POOL = 20_000


def by_score(pool: str | list[str], score: str = "score", idx: str = "idx"):
    keys = [pool] if isinstance(pool, str) else pool
    return Window.partitionBy(*keys).orderBy(rank_score(F.col(score)).desc_nulls_last(), F.col(idx).asc())


def top_k(df: DataFrame, k: int, pool: str | list[str] = "pool_id", score: str = "score", idx: str = "idx") -> DataFrame:
    """The best ``k`` of each pool, with ``rank``; the plan keeps k rows a pool on the map side."""
    return df.withColumn("rank", F.row_number().over(by_score(pool, score, idx))).where(F.col("rank") <= k)


def priority(salt: str, *keys: str) -> Column:
    """A pseudo-random order that any engine can reproduce: the md5 of salt and keys."""
    return F.md5(F.concat_ws("#", F.lit(salt), *[F.col(k).cast("string") for k in keys]))


def with_draws(df: DataFrame, draws: int) -> DataFrame:
    return df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))


def random_k(df: DataFrame, k: int, draws: int, salt: str = "null", pool: str = "pool_id", idx: str = "idx") -> DataFrame:
    """``draws`` matched random selections of ``k`` of each pool, without replacement."""
    w = Window.partitionBy(pool, "draw").orderBy("priority", idx)
    d = with_draws(df, draws).withColumn("priority", priority(salt, "draw", pool, idx))
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("priority")


def permutation_null(df: DataFrame, k: int, draws: int, salt: str = "perm", pool: str = "pool_id", idx: str = "idx") -> DataFrame:
    """The positions of the top k, filled with the items of a random order of the pool."""
    places = df.withColumn("place", F.row_number().over(Window.partitionBy(pool).orderBy(idx)))
    picked = top_k(places, k, pool).select(F.col(pool).alias("p"), F.col("place").alias("wanted"))
    d = with_draws(df, draws).withColumn("priority", priority(salt, "draw", pool, idx))
    d = d.withColumn("place", F.row_number().over(Window.partitionBy(pool, "draw").orderBy("priority", idx)))
    return d.join(picked, (F.col(pool) == F.col("p")) & (F.col("place") == F.col("wanted"))).drop("p", "wanted", "priority")


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def random_direction(df: DataFrame, k: int, direction: list[float], vector: str = "embedding", pool: str = "pool_id") -> DataFrame:
    """The top k along a fixed direction."""
    unit = np.asarray(direction, float) / np.linalg.norm(direction)
    return top_k(df.withColumn("along", dot(F.col(vector), F.array(*[F.lit(float(x)) for x in unit]))), k, pool, "along")


def allocate(df: DataFrame, k: int, pool: str = "pool_id", stratum: str = "stratum") -> DataFrame:
    """``(pool, stratum, size, quota)``: k shared among a pool's strata by largest remainder; ties to the larger, then lesser stratum."""
    sizes = df.groupBy(pool, stratum).agg(F.count("*").alias("size"))
    n = F.sum("size").over(Window.partitionBy(pool))
    share = F.least(F.lit(k), F.col("n")) * F.col("size")
    sizes = sizes.withColumn("n", n).withColumn("base", F.floor(share / F.col("n")))
    sizes = sizes.withColumn("rest", share % F.col("n"))
    w = Window.partitionBy(pool).orderBy(F.desc("rest"), F.desc("size"), F.asc(stratum))
    left = F.least(F.lit(k), F.col("n")) - F.sum("base").over(Window.partitionBy(pool))
    return sizes.select(pool, stratum, "size", (F.col("base") + (F.row_number().over(w) <= left).cast("long")).alias("quota"))


def stratified_top_k(df: DataFrame, k: int, pool: str = "pool_id", stratum: str = "stratum", score: str = "score", idx: str = "idx") -> DataFrame:
    """The best of each stratum up to its quota."""
    quotas = allocate(df, k, pool, stratum).drop("size")
    ranked = df.withColumn("rank", F.row_number().over(by_score([pool, stratum], score, idx))).where(F.col("rank") <= k)
    return ranked.join(quotas, [pool, stratum]).where(F.col("rank") <= F.col("quota"))


def threshold_random(df: DataFrame, k: int, q: float, salt: str = "thr", pool: str = "pool_id", idx: str = "idx") -> DataFrame:
    """A random ``k`` of the best ``max(k, round(q n))`` of each pool, halves rounded to even."""
    ranked = df.withColumn("rank", F.row_number().over(by_score(pool, "score", idx))).withColumn("n", F.count("*").over(Window.partitionBy(pool)))
    best = ranked.where(F.col("rank") <= F.greatest(F.lit(k), F.bround(F.col("n") * q))).drop("rank", "n")
    return random_k(best, k, 1, salt, pool, idx).drop("draw", "rank")


def top_fraction(df: DataFrame, fraction: float, least: int = 4, salt: str = "tie", pool: str = "pool_id", idx: str = "idx") -> DataFrame:
    """The best ``max(least, round(n fraction))`` of each pool, equal scores in random order."""
    w = Window.partitionBy(pool).orderBy(rank_score(F.col("score")).desc_nulls_last(), priority(salt, pool, idx), F.col(idx))
    ranked = df.withColumn("rank", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(pool)))
    return ranked.where(F.col("rank") <= F.greatest(F.lit(least), F.bround(F.col("n") * fraction)))


def best_of_n(df: DataFrame, sizes: list[int], k: int, reps: int, salt: str = "bon", pool: str = "pool_id", idx: str = "idx") -> DataFrame:
    """The top k of random n-subsets of each pool, for each n of ``sizes`` and each repetition; the whole pool once where n is its size, and
    none where it is smaller."""
    counts = df.groupBy(pool).agg(F.count("*").alias("n_pool"))
    d = with_draws(df.join(counts, pool).withColumn("size", F.explode(F.array(*map(F.lit, sizes)))), reps)
    d = d.where((F.col("size") < F.col("n_pool")) | ((F.col("size") == F.col("n_pool")) & (F.col("draw") == 1))).drop("n_pool")
    d = d.withColumn("priority", priority(salt, "draw", pool, idx))
    w = Window.partitionBy(pool, "size", "draw").orderBy("priority", idx)
    subset = d.withColumn("at", F.row_number().over(w)).where(F.col("at") <= F.col("size"))
    return top_k(subset, k, [pool, "size", "draw"], "score", idx).drop("at", "priority")


# ---- greedy selectors, one pool at a time


def _unit(e: np.ndarray) -> np.ndarray:
    return e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)


def _z(s: np.ndarray) -> np.ndarray:
    return (s - s.mean()) / (s.std() + 1e-12)


def mmr(scores: np.ndarray, e: np.ndarray, k: int, lam: float) -> list[int]:
    """Maximal marginal relevance: score against the greatest cosine with what was taken."""
    z, u = _z(scores), _unit(e)
    free, worst, out = np.ones(len(z), bool), np.full(len(z), -np.inf), []
    for _ in range(min(k, len(z))):
        value = np.where(free, z if not out else lam * z - (1 - lam) * worst, -np.inf)
        i = int(value.argmax())
        out.append(i)
        free[i] = False
        worst = np.maximum(worst, u @ u[i])
    return out


def k_center(scores: np.ndarray, e: np.ndarray, k: int, eta: float) -> list[int]:
    """Greedy k-center with a bonus for the score: the marginal-relevance order with lambda = eta / (1 + eta)."""
    return mmr(scores, e, k, eta / (1 + eta))


def dpp(scores: np.ndarray, e: np.ndarray, k: int, alpha: float) -> list[int]:
    """Greedy MAP of a determinantal process whose kernel weighs similarity by quality exp(alpha z / 2)."""
    q, u = np.exp(alpha * _z(scores) / 2), _unit(e)
    gain, rows, out = q * q, np.zeros((0, len(q))), []
    gain = gain.copy()
    for _ in range(min(k, len(q))):
        i = int(gain.argmax())
        if not gain[i] > 1e-12:
            break
        out.append(i)
        new = (q * (u @ u[i]) * q[i] - rows.T @ rows[:, i]) / np.sqrt(gain[i])
        rows = np.vstack([rows, new])
        gain = gain - new * new
        gain[i] = -np.inf
    rest = [int(i) for i in np.argsort(-scores, kind="stable") if i not in set(out)]
    return out + rest[: max(0, min(k, len(q)) - len(out))]


def facility_location(scores: np.ndarray, e: np.ndarray, k: int, beta: float, block: int = 256) -> list[int]:
    """Greedy mean coverage of the pool, with a bonus for the score.

    A gain only falls as the choice grows, so an item's last gain bounds it: only items whose bound leads are measured again. Similarities are
    computed in blocks, so memory follows the pool's size, not its square.
    """
    z, u = _z(scores), _unit(e)
    n, out, cover = len(z), [], np.zeros(len(z))

    def gains(at: np.ndarray) -> np.ndarray:
        return np.maximum((u[at] @ u.T + 1) / 2 - cover, 0).mean(1) + beta * z[at] / k

    bound = np.concatenate([gains(np.arange(lo, min(lo + block, n))) for lo in range(0, n, block)]) if n else np.zeros(0)
    for _ in range(min(k, n)):
        fresh: set[int] = set()
        while (i := int(bound.argmax())) not in fresh:
            bound[i] = gains(np.array([i]))[0]
            fresh.add(i)
        out.append(i)
        bound[i] = -np.inf
        cover = np.maximum(cover, (u[i] @ u.T + 1) / 2)
    return out


def log_vendi(u: np.ndarray) -> float:
    """The log of the effective number of distinct unit vectors: entropy of the kernel's eigenvalues."""
    if len(u) == 0:
        return float("-inf")
    w = np.linalg.eigvalsh(u @ u.T if len(u) <= u.shape[1] else u.T @ u) / len(u)
    w = w[w > 1e-12]
    return float(-(w * np.log(w)).sum())


def greedy_vendi(scores: np.ndarray, e: np.ndarray, k: int, gamma: float) -> list[int]:
    """From the best score on, always the item that gives the chosen set the greatest log Vendi plus gamma times its mean score.

    The kernels of the set with each candidate differ in one border, so all are stacked and solved at once, in parts of bounded size.
    """
    z, u = _z(scores), _unit(e)
    out, free = [int(z.argmax())], np.ones(len(z), bool)
    free[out] = False
    while len(out) < min(k, len(z)):
        n, rest = len(out) + 1, np.flatnonzero(free)
        value = np.empty(len(rest))
        step = max(1, 2_000_000 // (n * n))
        for lo in range(0, len(rest), step):
            part = rest[lo : lo + step]
            kernel = np.empty((len(part), n, n))
            kernel[:, :-1, :-1] = u[out] @ u[out].T
            kernel[:, -1, :-1] = kernel[:, :-1, -1] = u[part] @ u[out].T
            kernel[:, -1, -1] = 1.0
            w = np.clip(np.linalg.eigvalsh(kernel) / n, 1e-300, None)
            value[lo : lo + step] = -(w * np.log(w) * (w > 1e-12)).sum(1)
        value += gamma * (z[out].sum() + z[rest]) / n
        best = int(rest[np.flatnonzero(value >= value.max() - 1e-12)[0]])
        out.append(best)
        free[best] = False
    return out


def spherical_kmeans(e: np.ndarray, c: int, seed: int, rounds: int = 50) -> np.ndarray:
    """Clusters by cosine with spread-out seeds; an empty cluster keeps its centre."""
    u, rng = _unit(e), np.random.default_rng(seed)
    centres = [u[rng.integers(len(u))]]
    while len(centres) < min(c, len(u)):
        far = np.maximum(1 - np.max(u @ np.array(centres).T, axis=1), 0)
        total = far.sum()
        centres.append(u[rng.choice(len(u), p=far / total) if total > 1e-12 else rng.integers(len(u))])
    m, label = np.array(centres), None
    for _ in range(rounds):
        new = (u @ m.T).argmax(1)
        if label is not None and (new == label).all():
            break
        label = new
        for j in range(len(m)):
            if (label == j).any():
                v = u[label == j].sum(0)
                m[j] = v / max(np.linalg.norm(v), 1e-12)
    return label


def strata_by_look(scores: np.ndarray, e: np.ndarray, k: int, c: float) -> list[int]:
    """The best of each of c look clusters, shared by largest remainder."""
    label = spherical_kmeans(e, int(c), seed=len(scores))
    sizes = np.bincount(label)
    share = min(k, len(scores)) * sizes
    base = share // len(scores)
    order = sorted(range(len(sizes)), key=lambda j: (-(share[j] % len(scores)), -sizes[j], j))
    for j in order[: min(k, len(scores)) - base.sum()]:
        base[j] += 1
    ranked = np.argsort(-scores, kind="stable")
    return [int(i) for j in range(len(sizes)) for i in [i for i in ranked if label[i] == j][: base[j]]]


SELECTORS: dict[str, Callable[[np.ndarray, np.ndarray, int, float], list[int]]] = {
    "topk": lambda s, e, k, _: [int(i) for i in np.argsort(-s, kind="stable")[:k]],
    "mmr": mmr,
    "dpp": dpp,
    "facility": facility_location,
    "vendi": greedy_vendi,
    "kcenter": k_center,
    "stk": strata_by_look,
}


def register_selector(name: str, f: Callable[[np.ndarray, np.ndarray, int, float], list[int]]) -> None:
    """Adds a selector ``(scores, embeddings, k, parameter) -> positions`` for ``run_selectors``."""
    if name in SELECTORS:
        raise ValueError(f"selector {name} exists")
    SELECTORS[name] = f


def run_selectors(df: DataFrame, k: int, grid: list[tuple[str, float]], pool: str = "pool_id", idx: str = "idx") -> DataFrame:
    """``(pool, family, param, rank, idx)`` of each configuration of the grid, from (pool, idx, score, embedding).

    A pool's rows go to one task, once for all configurations. Rows without embedding or score take no part.
    """
    rows = df.select(pool, idx, rank_score(F.col("score")).alias("score"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("score IS NOT NULL AND embedding IS NOT NULL")
    chosen = [(name, float(p), SELECTORS[name]) for name, p in grid]

    def select(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_POOL:
            raise ValueError(f"pool {key[0]} has {len(pdf)} items; greedy selection holds at most {MAX_POOL}")
        pdf = pdf.sort_values(idx)
        s, e, at = pdf["score"].to_numpy(), np.stack(pdf["embedding"]), pdf[idx].to_numpy()
        out = [(key[0], name, p, r + 1, at[i]) for name, p, f in chosen for r, i in enumerate(f(s, e, k, p))]
        return pd.DataFrame(out, columns=[pool, "family", "param", "rank", idx])

    kind = dict(df.dtypes)
    return rows.groupBy(pool).applyInPandas(select, f"`{pool}` {kind[pool]}, family string, param double, rank int, `{idx}` {kind[idx]}")


def evaluate(items: DataFrame, selected: DataFrame, config: list[str], pool: str = "pool_id", idx: str = "idx", judge: str = "judge") -> DataFrame:
    """``(pool, config, raw_gain, std_gain)``: how much the selected items' judge score exceeds the pool's, raw and in
    pool standard deviations (0 where the pool has none)."""
    stats = items.groupBy(pool).agg(F.avg(judge).alias("mean"), F.stddev_pop(judge).alias("sd"))
    mine = selected.join(items.select(pool, idx, judge), [pool, idx]).groupBy(pool, *config).agg(F.avg(judge).alias("picked"))
    gain = F.col("picked") - F.col("mean")
    return mine.join(stats, pool).select(pool, *config, gain.alias("raw_gain"), F.when(F.col("sd") > 0, gain / F.col("sd")).otherwise(0.0).alias("std_gain"))


def frontier_rows(items: DataFrame, selected: DataFrame, config: list[str], k: int, draws: int, pool: str = "pool_id", idx: str = "idx") -> DataFrame:
    """``(pool, config, delta, emb_delta, raw_gain, std_gain)`` of each configuration's choice, and a ``random`` one that is 0 in all.

    ``delta`` and ``emb_delta`` are the log Vendi scores of the labels and of the embeddings less their means over the same random k's, which are drawn
    once for all configurations; ``items`` has label, embedding and judge.
    """
    from plumbline.operators.diversity import label_entropy, vendi

    null = materialize(random_k(items.select(pool, idx, "label", "embedding"), k, draws, pool=pool, idx=idx), "null")
    means = label_entropy(null, [pool, "draw"]).groupBy(pool).agg(F.avg("entropy").alias("null_label"))
    looks = vendi(null, [pool, "draw"], order=idx).groupBy(pool).agg(F.avg("log_vendi").alias("null_look"))
    chosen = materialize(selected.join(items.select(pool, idx, "label", "embedding"), [pool, idx]), "chosen")
    mine = label_entropy(chosen, [pool, *config]).select(pool, *config, F.col("entropy").alias("own_label"))
    own = vendi(chosen, [pool, *config], order=idx).select(pool, *config, F.col("log_vendi").alias("own_look"))
    gains = evaluate(items, selected, config, pool, idx)
    rows = gains.join(mine, [pool, *config], "left").join(own, [pool, *config], "left").join(means, pool, "left").join(looks, pool, "left")
    rows = rows.select(pool, *config, (F.col("own_label") - F.col("null_label")).alias("delta"), (F.col("own_look") - F.col("null_look")).alias("emb_delta"), "raw_gain", "std_gain")
    kinds = dict(rows.dtypes)
    name = {c: F.lit("random") if kinds[c] == "string" else F.lit(0).cast(kinds[c]) for c in config}
    zero = F.lit(0.0)
    base = items.select(pool).distinct().select(pool, *[v.alias(c) for c, v in name.items()], *[zero.alias(c) for c in ("delta", "emb_delta", "raw_gain", "std_gain")])
    return rows.unionByName(base)


def choose_on_tuning(rows: DataFrame, margin: float, config: str = "config", order: str = "grid_pos") -> DataFrame:
    """One configuration by (config, grid_pos, country, delta, gain): the greatest equal-country gain among those whose
    mean delta is at least ``margin``; if none, the least loss. Configurations that lack a country are left out; ties keep the grid's order."""
    countries = rows.select(F.countDistinct("country").alias("all"))
    by_country = rows.groupBy(config, order, "country").agg(F.avg("delta").alias("delta"), F.avg("gain").alias("gain"))
    means = by_country.groupBy(config, order).agg(F.avg("delta").alias("delta"), F.avg("gain").alias("gain"), F.count("*").alias("n"))
    full = means.crossJoin(F.broadcast(countries)).where(F.col("n") == F.col("all"))
    inside = F.col("delta") >= margin
    w = Window.orderBy(inside.desc(), F.when(inside, F.col("gain")).otherwise(F.col("delta")).desc(), F.col(order).asc())
    return full.withColumn("r", F.row_number().over(w)).where("r = 1").select(config, "delta", "gain", inside.alias("within_margin"))
