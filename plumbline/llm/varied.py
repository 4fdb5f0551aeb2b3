"""Choosing a varied subset of given size with a cluster-feature tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.runtime import materialize

#: Children of a tree node, leaf entries of a tree (more for a larger subset), and summaries merged by one task.
BRANCHING, MIN_LEAVES, LEAVES_PER_CHOICE, FAN_IN = 32, 512, 4, 8
#: A subset may have at most so many records: the driver agglomerates up to ``LEAVES_PER_CHOICE`` times as many entries.
MOST_CHOSEN = 5_000
#: The rows are dealt by a hash of the item into buckets of about so many, each summarized by a tree; a tree takes so many at once.
BUCKET_ROWS, CHUNK_ROWS = 50_000, 4_096
#: Points that no entry absorbs are inserted so many at a time before the others try again.
INSERT_POINTS = 256
#: Dimensions that stand for one categorical column.
HASH_DIMS = 16


def hash_features(codes: np.ndarray, weight: float) -> np.ndarray:
    """A fixed pseudo-random vector of about ``weight`` length for each 64-bit code; code 0 (null) is the origin."""
    x = codes.astype(np.uint64)[:, None] + np.arange(1, HASH_DIMS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64
    out = (2.0 * x - 1.0) * (weight * np.sqrt(3.0 / HASH_DIMS))
    out[codes == 0] = 0.0
    return out


class _Node:
    """The cluster features of up to ``BRANCHING`` children, or of leaf entries."""

    __slots__ = ("n", "sums", "squares", "children", "size")

    def __init__(self, dims: int, leaf: bool):
        self.n, self.squares = np.zeros(BRANCHING + 1), np.zeros(BRANCHING + 1)
        self.sums = np.zeros((BRANCHING + 1, dims))
        self.children: list[_Node] | None = None if leaf else []
        self.size = 0

    def nearest(self, x: np.ndarray) -> int:
        centres = self.sums[: self.size] / self.n[: self.size, None]
        d = centres - x
        return int(np.einsum("ij,ij->i", d, d).argmin())

    def add(self, n: float, s: np.ndarray, q: float, child: _Node | None = None) -> None:
        k = self.size
        self.n[k], self.sums[k], self.squares[k] = n, s, q
        if self.children is not None:
            self.children.append(child)
        self.size += 1

    def grow(self, k: int, n: float, s: np.ndarray, q: float) -> None:
        self.n[k] += n
        self.sums[k] += s
        self.squares[k] += q

    def total(self) -> tuple[float, np.ndarray, float]:
        k = self.size
        return self.n[:k].sum(), self.sums[:k].sum(0), self.squares[:k].sum()


class ClusterFeatureTree:
    """Absorbs weighted points or other trees' entries; never holds more than ``most`` leaf entries.

    An entry is (records, sum of vectors, sum of squared lengths). A point joins the nearest entry if the squared distance
    from its centre stays within the threshold; once there are too many entries the threshold rises and the tree is rebuilt
    from them, so memory is bounded whatever the number of points.
    """

    def __init__(self, dims: int, most: int, threshold: float = 1e-9):
        self.dims, self.most, self.threshold = dims, most, threshold
        self.root, self.entries = _Node(dims, True), 0

    def insert_all(self, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        """Inserts many points: those that an entry absorbs go down the tree together, the others one by one in between."""
        while len(n):
            left = self._absorb(self.root, n, s, q, np.arange(len(n)))
            for k in left[:INSERT_POINTS]:
                self.insert(float(n[k]), s[k], float(q[k]))
            left = left[INSERT_POINTS:]
            n, s, q = n[left], s[left], q[left]

    def _absorb(self, node: _Node, n: np.ndarray, s: np.ndarray, q: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Adds the points that leaf entries below absorb; the others, in their order."""
        if node.size == 0 or not len(who):
            return who
        x = s[who] / n[who, None]
        centres = node.sums[: node.size] / node.n[: node.size, None]
        d = (x**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * x @ centres.T
        k = d.argmin(1)
        if node.children is None:
            exact = ((x - centres[k]) ** 2).sum(1)
            taken = exact <= self.threshold
            mine, to = who[taken], k[taken]
            left = who[~taken]
        else:
            parts = [self._absorb(node.children[c], n, s, q, who[k == c]) for c in np.unique(k)]
            left = np.sort(np.concatenate(parts))
            kept = ~np.isin(who, left)
            mine, to = who[kept], k[kept]
        np.add.at(node.n, to, n[mine])
        np.add.at(node.sums, to, s[mine])
        np.add.at(node.squares, to, q[mine])
        return left

    def insert(self, n: float, s: np.ndarray, q: float) -> None:
        split = self._into(self.root, n, s, q)
        if split is not None:
            root = _Node(self.dims, False)
            for node in split:
                root.add(*node.total(), node)
            self.root = root
        if self.entries > self.most:
            self._rebuild()

    def _into(self, node: _Node, n: float, s: np.ndarray, q: float) -> tuple[_Node, _Node] | None:
        if node.size == 0:
            node.add(n, s, q)
            self.entries += 1
            return None
        k = node.nearest(s / n)
        if node.children is None:
            apart = node.sums[k] / node.n[k] - s / n
            if apart @ apart <= self.threshold:
                node.grow(k, n, s, q)
                return None
            node.add(n, s, q)
            self.entries += 1
        else:
            split = self._into(node.children[k], n, s, q)
            node.grow(k, n, s, q)
            if split is None:
                return None
            a, b = split
            node.n[k], node.sums[k], node.squares[k] = a.total()
            node.children[k] = a
            node.add(*b.total(), b)
        return self._split(node) if node.size > BRANCHING else None

    def _split(self, node: _Node) -> tuple[_Node, _Node]:
        centres = node.sums[: node.size] / node.n[: node.size, None]
        d = ((centres[:, None] - centres[None]) ** 2).sum(-1)
        a, b = np.unravel_index(d.argmax(), d.shape)
        first = d[:, a] <= d[:, b]
        first[b] = a == b and first[b]
        if first.all():
            first[node.size // 2 :] = False
        parts = _Node(self.dims, node.children is None), _Node(self.dims, node.children is None)
        for k in range(node.size):
            parts[0 if first[k] else 1].add(node.n[k], node.sums[k], node.squares[k], node.children[k] if node.children is not None else None)
        return parts

    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        todo, n, s, q = [self.root], [], [], []
        while todo:
            node = todo.pop()
            if node.children is not None:
                todo += node.children
            else:
                n.append(node.n[: node.size])
                s.append(node.sums[: node.size])
                q.append(node.squares[: node.size])
        return np.concatenate(n), np.concatenate(s), np.concatenate(q)

    def _rebuild(self) -> None:
        n, s, q = self.leaves()
        centres = s / n[:, None]
        # The typical distance of a few entries from their nearest neighbours is what must merge next.
        some = centres[:: max(1, len(centres) // 128)]
        d = ((some[:, None] - centres[None]) ** 2).sum(-1)
        near = np.sort(np.where(d <= 1e-12, np.inf, d).min(1))
        near = near[np.isfinite(near)]
        # Half of the entries should stay: a smaller step is taken if too many would merge.
        for share in (0.3, 0.15, 0.07, 0.03, 0.01):
            step = float(np.quantile(near, share)) if len(near) else 0.0
            tree = ClusterFeatureTree(self.dims, self.most, max(self.threshold * (1 + share), step))
            tree.insert_all(n, s, q)
            if tree.entries * 2 >= self.most:
                break
        self.root, self.entries, self.threshold = tree.root, tree.entries, tree.threshold


def ward_groups(centres: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Ward agglomeration of weighted points by nearest-neighbour chains, cut at ``k`` groups: the group of each point."""
    m = len(centres)
    if m <= k:
        return np.arange(m)
    c, w, alive = centres.astype(float).copy(), weights.astype(float).copy(), np.ones(m, bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    for _ in range(m - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            d = ((c - c[a]) ** 2).sum(1) * (w * w[a] / (w + w[a]))
            d[~alive] = np.inf
            d[a] = np.inf
            b = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[b]:
                b = chain[-2]
                break
            chain.append(b)
        cost = float(d[b])
        chain = chain[:-2]
        merges.append((cost, a, b))
        c[a] = (w[a] * c[a] + w[b] * c[b]) / (w[a] + w[b])
        w[a] += w[b]
        alive[b] = False
    # Chains find merges out of order; the cut takes the cheapest m - k of them.
    parent = np.arange(m)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for _, a, b in sorted(merges, key=lambda x: x[0])[: m - k]:
        parent[root(b)] = root(a)
    return np.unique([root(x) for x in range(m)], return_inverse=True)[1]


def varied_subset(
    df: DataFrame, item: str, size: int, vector: str | None, categories: dict[str, float], vector_dims: int = 0, vector_weight: float = 1.0
) -> DataFrame:
    """``(item, group, group_entries)``: ``size`` different items that cover the variety of the rows, or all if fewer.

    Features of a row are its vector, and for each column of ``categories`` a fixed pseudo-random vector of its value,
    scaled by the column's weight. Method: rows are dealt into buckets by a hash of the item; each bucket, in the order of
    the hash, builds a cluster-feature tree with a bounded number of leaf entries; summaries are merged ``FAN_IN`` at a time
    by further trees until one is left. Its entries are agglomerated by Ward linkage on the driver, weighted by the
    logarithm of their records, so neither a large group nor a dense clump of nearly equal rows draws more than a
    little more of the choice; the tree of merges is cut at ``size`` groups. Each row belongs to the group of the nearest centre, and the
    row nearest its centre is returned. If a group has none, the row nearest its centre that is not yet chosen is taken; if the
    rows have fewer different features than ``size``, the groups give their next nearest rows in turn.

    The result depends on the rows alone, not on their order or partitions. What reaches the driver is bounded by ``size``
    alone, which may be ``MOST_CHOSEN``: at most max(512, 4 ``size``) entries, then a row a group. The rows are shuffled once, by
    item, and all of them take part.

    Defined cases: a null item is no row; an item given several times counts once (its least features); a null vector,
    or one of another length, is the origin, a null category too; NaN and infinite numbers count as 0; of records
    at equal distances the least item is returned; an empty table gives no rows; other columns are ignored.
    """
    if not 1 <= size <= MOST_CHOSEN:
        raise ValueError(f"size must be from 1 to {MOST_CHOSEN}")
    spark, names = df.sparkSession, list(categories)
    dims = vector_dims + HASH_DIMS * len(names)
    most = max(MIN_LEAVES, LEAVES_PER_CHOICE * size)
    vec: Column = F.col(vector).cast("array<double>") if vector else F.lit(None).cast("array<double>")
    code = [F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c))).otherwise(F.lit(0)).alias(f"c{k}") for k, c in enumerate(names)]
    rows = df.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), vec.alias("vec"), *code)
    rows = rows.groupBy("item").agg(F.min(F.struct("vec", *[f"c{k}" for k in range(len(names))])).alias("x")).select("item", "x.*")
    rows = materialize(rows, "varied")  # read twice: for the trees, and for the records nearest the centres
    n_rows = rows.count()
    if n_rows <= size:
        return rows.select(F.col("item").alias(item), F.lit(0).alias("group"), F.lit(1).alias("group_entries"))
    buckets = -(-n_rows // BUCKET_ROWS)

    def features(pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(pdf), dims))
        if vector_dims:
            sizes = np.array([-1 if v is None else len(v) for v in pdf["vec"]])
            good = np.flatnonzero(sizes == vector_dims)
            if len(good):
                x = np.concatenate([pdf["vec"].iat[k] for k in good]).astype(float).reshape(len(good), vector_dims)
                out[good, :vector_dims] = vector_weight * np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
        for k, name in enumerate(names):
            at = vector_dims + k * HASH_DIMS
            out[:, at : at + HASH_DIMS] = hash_features(pdf[f"c{k}"].to_numpy(), categories[name])
        return out

    def entries(tree: ClusterFeatureTree, bucket: int) -> pd.DataFrame:
        n, s, q = tree.leaves()
        columns = {"bucket": bucket, "place": np.arange(len(n)), "n": n, "s": list(s), "q": q, "threshold": tree.threshold}
        return pd.DataFrame(columns)

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, bool, pd.DataFrame]]:
        """(bucket, whether it ends, rows): parts of a size that does not depend on how the rows come."""
        held: pd.DataFrame | None = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held):
                mine = int((held["bucket"] == held["bucket"].iat[0]).to_numpy().argmin()) or len(held)
                if mine == len(held) and mine <= CHUNK_ROWS:
                    break
                take = min(mine, CHUNK_ROWS)
                yield int(held["bucket"].iat[0]), take == mine, held.iloc[:take]
                held = held.iloc[take:].reset_index(drop=True)
        if held is not None and len(held):
            yield int(held["bucket"].iat[0]), True, held

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = ClusterFeatureTree(dims, most)
        for bucket, ends, pdf in chunks(batches):
            x, counts = np.unique(features(pdf).round(6), axis=0, return_counts=True)
            n = counts.astype(float)
            tree.insert_all(n, x * n[:, None], (x * x).sum(1) * n)
            if ends:
                yield entries(tree, bucket)
                tree = ClusterFeatureTree(dims, most)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "place"])
        tree = ClusterFeatureTree(dims, most, float(pdf["threshold"].min()))
        tree.insert_all(pdf["n"].to_numpy(), np.stack(pdf["s"]).astype(float), pdf["q"].to_numpy())
        return entries(tree, int(key[0]))

    schema = "bucket long, place long, n double, s array<double>, q double, threshold double"
    hashed = rows.withColumn("h", F.xxhash64("item")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    summary = hashed.repartition("bucket").sortWithinPartitions("bucket", "h", "item").mapInPandas(summarize, schema)
    left = buckets
    while left > 1:
        summary = summary.groupBy(F.floor(F.col("bucket") / FAN_IN).alias("to")).applyInPandas(merge, schema)
        left = -(-left // FAN_IN)
    leaf = summary.orderBy("bucket", "place").toPandas()
    n = leaf["n"].to_numpy()
    centres = np.stack(leaf["s"]).astype(float) / n[:, None]
    weights = np.log1p(n)
    group = ward_groups(centres, weights, size)
    k = int(group.max()) + 1
    mean = np.zeros((k, dims))
    np.add.at(mean, group, centres * weights[:, None])
    mean /= np.bincount(group, weights)[:, None]
    sizes = np.bincount(group)

    def nearest(to: np.ndarray, among: DataFrame, own: bool) -> DataFrame:
        """``(g, d, item)``: for each of the centres ``to`` the nearest rows of each task; ``own`` rows belong to the nearest centre of all."""
        shared = spark.sparkContext.broadcast((to, mean[to]))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            to, mine = shared.value
            best: pd.DataFrame | None = None
            for pdf in batches:
                x = features(pdf)
                d = np.maximum((x**2).sum(1)[:, None] + (mine**2).sum(1)[None] - 2 * x @ mine.T, 0).round(9)
                at = d.argmin(1)
                if own:
                    part = pd.DataFrame({"g": to[at], "d": d[np.arange(len(d)), at], "item": pdf["item"]})
                else:
                    part = pd.DataFrame({"g": np.tile(to, len(d)), "d": d.ravel(), "item": np.repeat(pdf["item"].to_numpy(), len(to))})
                best = part if best is None else pd.concat([best, part])
                best = best.sort_values(["g", "d", "item"]).drop_duplicates("g")
            if best is not None:
                yield best

        best = among.mapInPandas(run, "g long, d double, item string").groupBy("g").agg(F.min(F.struct("d", "item")).alias("best"))
        return best.select("g", "best.*")

    chosen: dict[str, int] = {r["item"]: r["g"] for r in nearest(np.arange(k), rows, True).collect()}
    while len(chosen) < k:  # centres that are no row's nearest
        empty = np.array(sorted(set(range(k)) - set(chosen.values())))
        taken = F.broadcast(spark.createDataFrame([(i,) for i in chosen], "item string"))
        for r in sorted(nearest(empty, rows.join(taken, "item", "left_anti"), False).collect(), key=lambda r: (r["d"], r["g"])):
            chosen.setdefault(r["item"], r["g"])
    if len(chosen) < size:  # fewer different features than asked for: of each group the next nearest rows, in turn
        shared = spark.sparkContext.broadcast(mean)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = features(pdf)
                d = np.maximum((x**2).sum(1)[:, None] + (shared.value**2).sum(1)[None] - 2 * x @ shared.value.T, 0).round(9)
                yield pd.DataFrame({"g": d.argmin(1), "d": d.min(1), "item": pdf["item"]})

        taken = F.broadcast(spark.createDataFrame([(i,) for i in chosen], "item string"))
        rest = rows.join(taken, "item", "left_anti").mapInPandas(assign, "g long, d double, item string")
        missing = size - len(chosen)
        turn = F.row_number().over(Window.partitionBy("g").orderBy("d", "item"))
        rest = rest.withColumn("turn", turn).where(F.col("turn") <= missing).orderBy("turn", "d", "item").limit(missing)
        chosen |= {r["item"]: r["g"] for r in rest.collect()}
    out = [(i, int(g), int(sizes[g])) for i, g in sorted(chosen.items())]
    return spark.createDataFrame(out, f"`{item}` string, `group` int, group_entries int")
