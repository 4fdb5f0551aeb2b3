"""Random k's of every pool by md5, drawn while the pool's rows stream through one task: no row of a draw is shuffled, sorted or written."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions.stats import hypergeom_below
from plumbline.operators.diversity import rarefied
from plumbline.operators.selection import by_score

#: Priorities held at once in a task.
HELD = 4_000_000
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _md5_words(words: list[np.ndarray | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the md5 of ``n`` messages of one block; a word that is None is 0 in all."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:  # d ^ (b & (c ^ d))
            g = i
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:  # c ^ (d & (b ^ c))
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            g = 7 * i % 16
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a), np.add(a, _SINES[i], out=a)
        if words[g] is not None:
            np.add(a, words[g], out=a)
        s = _SHIFTS[i // 16][i % 4]
        np.left_shift(a, np.uint32(s), out=t), np.right_shift(a, np.uint32(32 - s), out=a), np.bitwise_or(a, t, out=a), np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return a + _START[0], b + _START[1]


def priorities(heads: list[str], tails: list[str]) -> np.ndarray:
    """``(heads, tails)``: the first 64 bits of the md5 of each head followed by each tail; they order as the digests do, but for chances of one
    in 2**64 a pair."""
    raw = [t.encode() for t in tails]
    n, size = len(raw), np.fromiter(map(len, raw), np.int64, len(raw))
    out = np.empty((len(heads), n), np.uint64)
    wide = int(size.max()) if n else 0
    flat = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in raw), np.uint8).reshape(n, wide) if wide else np.zeros((n, 0), np.uint8)
    block, at, length = np.zeros((n, 64), np.uint8), np.arange(n), -1
    words: list[np.ndarray | None] = []
    for i, head in enumerate(h.encode() for h in heads):
        if len(head) + wide > 55:  # more than one block
            out[i] = [int.from_bytes(hashlib.md5(head + x).digest()[:8], "big") for x in raw]
            continue
        same, length = len(head) == length, len(head)
        if not same:
            block[:] = 0
            block[:, length : length + wide] = flat
            block[at, length + size] = 0x80
            block[:, 56:58] = ((8 * (length + size)).astype("<u2")[:, None].view(np.uint8)) if n else 0
        block[:, :length] = np.frombuffer(head, np.uint8)
        own = block.view("<u4")
        fresh = range(-(-length // 4)) if same else range(16)
        words = words if same else [None] * 16
        for w in fresh:
            words[w] = np.ascontiguousarray(own[:, w]) if own[:, w].any() else None
        a, b = _md5_words(words, n)
        out[i] = (a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()
    return out


#: Below so many tails, digests one by one are quicker than steps over whole arrays, each of which is a call.
FEW_TAILS, ARRAY = 600, 16_384


def leading(heads: list[str], tails: list[str]) -> np.ndarray:
    """``(heads, tails)``: the first 32 bits of the md5 of each head followed by each tail."""
    if len(tails) < FEW_TAILS:
        raw = [t.encode() for t in tails]
        flat = b"".join(hashlib.md5(h + t).digest()[:4] for h in (x.encode() for x in heads) for t in raw)
        return np.frombuffer(flat, ">u4").astype(np.uint64).reshape(len(heads), len(raw))
    return np.hstack([priorities(heads, tails[lo : lo + ARRAY]) for lo in range(0, len(tails), ARRAY)]) >> np.uint64(32)


def _least(keys: np.ndarray, k: int, also: tuple[int, ...] = ()) -> np.ndarray:
    """Of each draw the places of its k least priorities; for each lesser number of ``also``, so many of the least come first."""
    cuts = sorted({x - 1 for x in (k, *also) if x < keys.shape[1]})
    return np.argpartition(keys, cuts, axis=1)[:, :k] if cuts else np.broadcast_to(np.arange(keys.shape[1]), keys.shape)


def drawn(
    df: DataFrame, k: int, draws: int, columns: list[str], summary: Callable[[pa.Table, np.ndarray], list[tuple]], schema: str, salt: str = "null",
    pool: str = "pool_id", idx: str = "idx", also: tuple[int, ...] = (), best: dict[str, Column] | None = None,
) -> DataFrame:
    """``(pool, schema)``: what ``summary`` makes of a pool's random k's, the same items as ``random_k`` takes.

    It is called once a pool with a table of its ``columns`` and the places in it of each draw's items, (draws, at most k), and gives rows. The table may lack
    items that no draw took. Of each draw's places the first are those of its random k's for each lesser k of ``also``. A pool's rows are shuffled once, whatever the number of draws, and
    what is hashed is made of them afterwards; of a pool that spans batches only the items taken so far are held.

    With ``best`` the table also has the items' ``rank`` by score and, as named columns, what these aggregates are over the whole pool; it lacks none of the best k. They are windows over
    the rows as they are shuffled here.
    """
    heads = [f"{salt}#{d}" for d in range(1, draws + 1)]
    tail = F.concat_ws("#", F.lit(""), F.col(pool).cast("string"), F.col(idx).cast("string")).alias("_tail")
    ranked = best is not None
    sent = list(dict.fromkeys([pool, idx, *columns, *(["score"] if ranked else [])]))
    rows = df.select(*sent).repartition(pool)
    if ranked:
        w = by_score(pool, "score", idx)
        over = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.select(*sent, F.row_number().over(w).alias("rank"), *[c.over(over).alias(name) for name, c in best.items()])
        columns = [*columns, "rank", *best]
    else:
        rows = rows.sortWithinPartitions(pool)
    rows = rows.select(pool, tail, *columns)
    kind = df.schema[pool].dataType.simpleString()
    out_schema = f"`{pool}` {kind}, {schema}"
    step = max(1, min(16_384, HELD // draws))
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], out_schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        done: list[tuple] = []

        def pools(table: pa.Table) -> list[int]:
            code = table.column(pool).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            return [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), arrow.types)], schema=arrow)

        def settle(table: pa.Table, keys: np.ndarray) -> None:
            key = table.column(pool)[0].as_py()
            done.extend((key, *row) for row in summary(table.select(columns), _least(keys, k, also)))

        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                table = pa.Table.from_batches([batch.slice(lo, step)])
                table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
                keys, ends = priorities(heads, table.column("_tail").to_pylist()), pools(table)
                for a, b in zip(ends[:-2], ends[1:-1]):
                    settle(table.slice(a, b - a), keys[:, a:b])
                a = ends[-2]
                last = table.slice(a)
                taken = _least(keys[:, a:], k).ravel()
                if ranked:
                    taken = np.r_[taken, np.flatnonzero(last.column("rank").to_numpy() <= k)]
                held = last.take(pa.array(np.unique(taken)))
            if done:
                yield found()
                done.clear()
        if held is not None and held.num_rows:
            settle(held, priorities(heads, held.column("_tail").to_pylist()))
            if done:
                yield found()

    return rows.mapInArrow(run, out_schema)


def label_codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each label, -1 for none."""
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def label_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(draw, count)`` of each label of each draw, in the draws' order, from (draws, items) of codes; negative ones are left out."""
    s = np.sort(codes, axis=1)
    draw, at = np.nonzero(s >= 0)
    flat = s[draw, at]
    if not len(flat):
        return draw, draw
    begins = np.flatnonzero(np.r_[True, (np.diff(flat) != 0) | (np.diff(draw) != 0)])
    return draw[begins], np.diff(np.r_[begins, len(flat)])


def null_entropy(df: DataFrame, k: int, draws: int, salt: str = "null", label: str = "label", pool: str = "pool_id", idx: str = "idx") -> DataFrame:
    """``(pool, null_mean, null_sd)``: mean and standard deviation over random k's of the entropy of their labels; draws without a label are left out."""

    def summary(table: pa.Table, sel: np.ndarray) -> list[tuple]:
        draw, c = label_runs(label_codes(table.column(label))[sel])
        n = np.bincount(draw, c, draws)
        some = n > 0
        if not some.any():
            return []
        h = np.log(n[some]) - np.bincount(draw, c * np.log(c), draws)[some] / n[some]
        return [(float(h.mean()), float(h.std(ddof=1)) if len(h) > 1 else None)]

    return drawn(df, k, draws, [label], summary, "null_mean double, null_sd double", salt, pool, idx)


@lru_cache(1 << 16)
def _log_rarefied(counts: tuple[int, ...], m: int) -> float:
    return math.log(x) if (x := rarefied(list(counts), m)) == x else math.nan


def _rarefied_logs(codes: np.ndarray, m: int) -> np.ndarray:
    """Of each draw the log of the diversity of its labels rarefied to ``m``, NaN if there are too few, from (draws, items) of codes. Draws whose labels
    have the same counts share one rarefaction."""
    width = int(codes.max(initial=-1)) + 2
    counts = np.bincount((np.arange(len(codes))[:, None] * width + codes + 1).ravel(), minlength=len(codes) * width).reshape(-1, width)[:, 1:]
    counts = np.sort(counts, axis=1)[:, -codes.shape[1] :]
    base = codes.shape[1] + 1
    if counts.shape[1] * math.log2(base) < 62:  # the counts as the digits of a number
        _, first, which = np.unique(counts @ base ** np.arange(counts.shape[1]), return_index=True, return_inverse=True)
    else:
        _, first, which = np.unique(counts, axis=0, return_index=True, return_inverse=True)
    return np.array([_log_rarefied(tuple(c), m) for c in counts[first].tolist()])[which.ravel()]


def null_rarefied(df: DataFrame, k: int, m: int, draws: int, keep: str = "keep", salt: str = "null", label: str = "label", pool: str = "pool_id", idx: str = "idx") -> DataFrame:
    """``(pool, mean_kept_null, log_null)``: of random k's the mean number of kept items, and the mean log of the diversity of the kept labels rarefied to ``m``,
    over the draws that keep so many."""

    def summary(table: pa.Table, sel: np.ndarray) -> list[tuple]:
        kept, codes = _kept_codes(table, keep, label)
        logs = _rarefied_logs(codes[sel], m)
        logs = logs[~np.isnan(logs)]
        return [(float(kept[sel].sum(axis=1).mean()), float(logs.mean()) if len(logs) else None)]

    return drawn(df, k, draws, [label, keep], summary, "mean_kept_null double, log_null double", salt, pool, idx)


def _kept_codes(table: pa.Table, keep: str, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Which items are kept, and the kept items' labels as numbers, -1 for none."""
    kept = table.column(keep).combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
    return kept, np.where(kept, label_codes(table.column(label)), -1)


@lru_cache(1 << 16)
def _lacking(n: int, good: int, k: int, m: int) -> float | None:
    """The chance that fewer than ``m`` of a random k are kept; none for fewer than k items."""
    chance = hypergeom_below(n, good, k, m) if n >= k else math.nan
    return None if math.isnan(chance) else chance


def kept_parts(df: DataFrame, ks: list[int], m: int, draws: int, keep: str = "keep", salt: str = "null", label: str = "label", pool: str = "pool_id", idx: str = "idx") -> DataFrame:
    """``(pool, k, n_pool, n_kept, lacking, kept_selected, log_selected, mean_kept_null, log_null)``: for each k what an endpoint is made of, in one pass over the pools.

    ``kept_selected`` and ``log_selected`` are the number of kept items of the best k and the log of the diversity of their labels rarefied to ``m``; the other two are the means of the same
    over random k's, of the log over those that keep so many. ``lacking`` is the chance that a random k keeps fewer than ``m``. A draw's random k's begin one with another, as the best do, so all
    are taken at once.
    """
    counts = {"n_pool": F.count("*"), "n_kept": F.count_if(keep)}

    def summary(table: pa.Table, sel: np.ndarray) -> list[tuple]:
        n, good = table.column("n_pool")[0].as_py(), table.column("n_kept")[0].as_py()
        best = np.argsort(table.column("rank").to_numpy())[: sel.shape[1]]
        sel = np.vstack([sel, best])  # the best k are the last selection
        kept, codes = (x[sel] for x in _kept_codes(table, keep, label))
        out = []
        for k in ks:
            logs, many = _rarefied_logs(codes[:, :k], m), kept[:, :k].sum(axis=1)
            null = logs[:-1][~np.isnan(logs[:-1])]
            own = None if math.isnan(logs[-1]) else float(logs[-1])
            out.append((k, n, good, _lacking(n, good, k, m), int(many[-1]), own, float(many[:-1].mean()), float(null.mean()) if len(null) else None))
        return out

    schema = "k int, n_pool long, n_kept long, lacking double, kept_selected long, log_selected double, mean_kept_null double, log_null double"
    return drawn(df, max(ks), draws, [label, keep], summary, schema, salt, pool, idx, tuple(ks), counts)


def drawn_labels(df: DataFrame, k: int, draws: int, by: str, salt: str = "null", label: str = "label", pool: str = "pool_id", idx: str = "idx") -> DataFrame:
    """``(pool, by, draw, labels)``: the sorted different labels of each random k, by a further key of the items."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def summary(table: pa.Table, sel: np.ndarray) -> list[tuple]:
        labels, keys, out = table.column(label).to_pylist(), table.column(by).to_pylist(), []
        for d, places in enumerate(sel.tolist(), 1):
            found: dict = {}
            for i in places:
                if labels[i] is not None:
                    found.setdefault(keys[i], set()).add(labels[i])
            out.extend((key, d, sorted(x)) for key, x in found.items())
        return out

    return drawn(df, k, draws, [by, label], summary, f"`{by}` {kinds[by]}, draw int, labels array<{kinds[label]}>", salt, pool, idx)
