"""Evaluation passages that leaked into training text, whole or in part, edited or misread."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the items of one block, about, which is broadcast; more items are taken in several blocks against all texts.
BLOCK_BYTES = 8 << 20
#: Words of a seed.
SEED_WORDS = 3
#: A seed is rare if at most this share of the texts hold it, or if it is among this part of its item's seeds, the
#: rarest. It is no stock wording of its item if at most as many texts hold it outside of runs of the item: so it does not
#: matter into how many texts the item or a part of it leaked.
RARE_SHARE, RARER_PART = 0.002, 0.12
#: A run is where the item's seeds cover so many of its words within so many words of the text.
OWN_RUN, RUN_REACH = 14, 64
#: A text is aligned with an item if its longest chain of seeds in order covers so many of the item's words, ...
#: (seeds at least that are no stock wording, words of the chain at least)
CHAINS = ((3, 10), (1, 16), (0, 26))
#: ... where two seeds of a chain are at most so many words of the text apart.
CHAIN_REACH = 80
#: A leak is a run of at least so many words of the item, or the whole passage; one word may be lost at either end.
RUN_WORDS, SLACK = 18, 1
#: Alignment scores: same word, misread word, other word or word left out, start and each word of a gap in the text.
SAME, MISREAD, OTHER, GAP_START, GAP_WORD = 1.0, 0.8, -1.2, 1.0, 0.03
#: The least score of a leak, and that of one with as many rare seeds as MANY_RARE.
MIN_SCORE, MIN_SCORE_RARE, MANY_RARE = 16.5, 12.0, 4
#: Below this score, and with few rare seeds, so many of the words spanned must match: stock wording matches loosely.
SURE_SCORE, DENSITY = 20.0, 0.88
#: Around its chain a text is aligned as far as the item's other words can reach: so many words for each, and a margin. Parts of an
#: item that lie farther apart in a text than that are no run of it, and each is judged by itself.
WINDOW_PER_WORD, WINDOW_MARGIN = 3, 60
#: Words and word pairs that a worker remembers.
KEEP_WORDS, KEEP_PAIRS = 400_000, 400_000

_BROKEN = re.compile(r"[-\xad=¬‐][ \t]*\r?\n\s*")
_JOIN = "\x01"
_EDGES = ".,;:!?\"'()[]{}«»“”„’‘…·—–-|*•£$=¬\xad¬"
_QUESTION = re.compile(r"\b(?:question|frage)\s*:.*\Z", re.S | re.I)


def fold(word: str) -> str:
    """A word without case, accents and outer punctuation."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return word.casefold().strip(_EDGES)


def passage(text: str) -> str:
    """An item without the question at its end."""
    return _QUESTION.sub("", text)


def edits_within(a: str, b: str, most: int) -> bool:
    """Whether the Levenshtein distance of two words is at most ``most``: a column of the table at a time, as the bits where it steps up or down."""
    if abs(len(a) - len(b)) > most:
        return False
    if not a or not b:
        return True  # one is empty, and the other no longer than allowed
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, edits = every, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        plus, minus = down | (every & ~(diagonal | up)), up & diagonal
        edits += bool(plus & last) - bool(minus & last)
        plus, minus = (plus << 1 | 1) & every, minus << 1 & every
        up, down = minus | (every & ~(diagonal | plus)), plus & diagonal
    return edits <= most


def letter_counts(word: str) -> bytes:
    """How often each of 32 classes of letters occurs in a word; an edit changes these by two at most."""
    counts = bytearray(32)
    for c in word[:4096]:
        counts[ord(c) & 31] = min(counts[ord(c) & 31] + 1, 255)
    return bytes(counts)


class Lexicon(dict):
    """Raw token -> the ids of its words. Words of the items have ids below ``size``; others get ids as they come.

    A token that a line end broke is one word if the joined word is one of the items', else two.
    """

    def __init__(self, words: list[str]):
        super().__init__()
        self.base = {w: k for k, w in enumerate(words)}
        self.size = len(words)
        self.words = list(words)
        self.ids = dict(self.base)
        self.masks = [self._mask(w) for w in words]
        self.counts = [letter_counts(w) for w in words]
        self.near: dict[tuple[int, int], bool] = {}

    @staticmethod
    def _mask(word: str) -> int:
        m = 0
        for c in word:
            m |= 1 << (ord(c) & 31)
        return m

    def _id(self, raw: str) -> tuple[int, ...]:
        w = fold(raw)
        if not w:
            return ()
        k = self.ids.get(w)
        if k is None:
            k = self.ids[w] = len(self.words)
            self.words.append(w)
            self.masks.append(self._mask(w))
            self.counts.append(letter_counts(w))
        return (k,)

    def __missing__(self, raw: str) -> tuple[int, ...]:
        if _JOIN in raw:
            whole = fold(raw.replace(_JOIN, ""))
            found = (self.base[whole],) if whole in self.base else tuple(k for x in raw.split(_JOIN) for k in self._id(x))
        else:
            found = self._id(raw)
        self[raw] = found
        return found

    def tidy(self) -> None:
        """Forgets the words that are not the items', between batches, once there are too many."""
        if len(self.words) > KEEP_WORDS or len(self) > KEEP_WORDS:
            del self.words[self.size :], self.masks[self.size :], self.counts[self.size :]
            self.ids = dict(self.base)
            self.clear()
            self.near.clear()
        if len(self.near) > KEEP_PAIRS:
            self.near.clear()

    def text_ids(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, _BROKEN.sub(_JOIN, text).split())))

    def misread(self, a: int, b: int) -> bool:
        """Whether word ``a`` of a text can be a misread ``b``: a third of the letters may differ."""
        found = self.near.get((a, b))
        if found is None:
            x, y = self.words[a], self.words[b]
            n = max(len(x), len(y))
            found = self.near[(a, b)] = n >= 3 and edits_within(x, y, n // 3)
        return found


@dataclass
class Block:
    """A block of items: their words as ids, and the sorted seeds with the places where they stand.

    The places of seed ``s`` are ``place_item`` and ``place_pos`` from ``place_start[s]`` to ``place_start[s + 1]``.
    """

    item_ids: list
    words: list[str]
    items: list[np.ndarray]
    seeds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    place_start: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    place_item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    place_pos: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]]) -> Block:
        split = [[w for w in map(fold, _BROKEN.sub("", passage(t or "")).split()) if w] for _, t in rows]
        words = sorted({w for s in split for w in s})
        ids = {w: k for k, w in enumerate(words)}
        block = cls([i for i, _ in rows], words, [np.array([ids[w] for w in s], np.int64) for s in split])
        places: dict[int, list[tuple[int, int]]] = {}
        for k, item in enumerate(block.items):
            for p, s in enumerate(block.keys(item)):
                places.setdefault(int(s), []).append((k, p))
        block.seeds = np.array(sorted(places), np.int64)
        every = [x for s in block.seeds for x in places[int(s)]]
        block.place_start = np.cumsum([0, *(len(places[int(s)]) for s in block.seeds)])
        block.place_item = np.array([k for k, _ in every], np.int64)
        block.place_pos = np.array([q for _, q in every], np.int64)
        return block

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """The seed key at each position; -1 where a word is none of the items'."""
        n = len(ids) - SEED_WORDS + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        base = len(self.words) + 1
        key, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(SEED_WORDS):
            w = ids[k : n + k]
            known &= (w >= 0) & (w < len(self.words))
            key = key * base + w
        return np.where(known, key, -1)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of seeds in a sequence of word ids, and which seeds."""
        keys = self.keys(ids)
        at = np.searchsorted(self.seeds, keys)
        at[at == len(self.seeds)] = 0
        pos = np.flatnonzero(self.seeds[at] == keys) if len(self.seeds) else np.zeros(0, np.int64)
        return pos, at[pos]


def align(item: np.ndarray, text: np.ndarray, lexicon: Lexicon, least: float = 0.0) -> tuple[float, int, int]:
    """Smith-Waterman alignment of two word sequences: score, words of the item it spans, words matched; of a score
    below ``least`` only the score.

    A gap in the text (adverts, lines of another column) costs a start and little a word; a word of the item that
    is missing or another word costs as much as a match brings, so a run needs mostly matches.
    """
    n, m = len(item), len(text)
    uniq, inverse = np.unique(text, return_inverse=True)
    wanted = _distinct(item)
    sim = np.where(uniq[None, :] == wanted[:, None], SAME, OTHER)
    masks = np.array([lexicon.masks[k] for k in uniq], np.uint32)
    sizes = np.array([len(lexicon.words[k]) for k in uniq])
    goal_masks = np.array([lexicon.masks[k] for k in wanted], np.uint32)
    goal_sizes = np.array([len(lexicon.words[k]) for k in wanted])
    most = np.maximum(sizes[None, :], goal_sizes[:, None]) // 3
    close = (np.abs(sizes[None, :] - goal_sizes[:, None]) <= most) & (
        np.bitwise_count(masks[None, :] ^ goal_masks[:, None]) <= 2 * most
    )
    close &= sim != SAME
    # Of the pairs whose letters may suffice, those whose letter counts may.
    goal, own = np.nonzero(close)
    bags = np.frombuffer(b"".join([lexicon.counts[k] for k in uniq]), np.uint8).reshape(-1, 32).astype(np.int16)
    goal_bags = np.frombuffer(b"".join([lexicon.counts[k] for k in wanted]), np.uint8).reshape(-1, 32).astype(np.int16)
    few = np.abs(goal_bags[goal] - bags[own]).sum(1) <= 2 * most[goal, own]
    for a, b in zip(goal[few], own[few]):
        if lexicon.misread(int(uniq[b]), int(wanted[a])):
            sim[a, b] = MISREAD
    scores = sim[np.searchsorted(wanted, item)][:, inverse.ravel()]

    table = np.zeros((n + 1, m + 1))
    slope = GAP_WORD * np.arange(m + 1)
    for i in range(n):
        row = np.maximum(table[i] + OTHER, 0)
        np.maximum(row[1:], table[i, :-1] + scores[i], out=row[1:])
        gap = np.maximum.accumulate(row + slope) - slope - GAP_START
        np.maximum(row[1:], gap[:-1] - GAP_WORD, out=row[1:])
        table[i + 1] = row
    i, j = map(int, np.unravel_index(table.argmax(), table.shape))
    best, first, last, matched = float(table[i, j]), 0, 0, 0
    if best < least:
        return best, 0, 0
    while i > 0 and j > 0 and table[i, j] > 1e-9:
        now = table[i, j]
        if abs(now - table[i - 1, j - 1] - scores[i - 1, j - 1]) < 1e-9:
            if scores[i - 1, j - 1] > 0:
                matched += 1
                first = i
                last = last or i
            i, j = i - 1, j - 1
        elif abs(now - table[i - 1, j] - OTHER) < 1e-9:
            i -= 1
        else:  # a gap in the text: back to where it began
            reach = table[i, :j] - GAP_START - GAP_WORD * (j - np.arange(j))
            j = int(np.flatnonzero(np.abs(reach - now) < 1e-9)[-1])
    return best, (last - first + 1 if matched else 0), matched


def longest_chain(places: list[tuple[int, int]]) -> tuple[int, tuple[int, int], tuple[int, int]]:
    """Of seeds at (position in the text, position in the item), sorted: the words of the item that the longest
    chain in order covers, and its first and last seed."""
    best: list[tuple[int, int]] = []
    for i, (p, q) in enumerate(places):
        cover, first = SEED_WORDS, i
        for j in range(i - 1, -1, -1):
            p2, q2 = places[j]
            if p - p2 > CHAIN_REACH:
                break
            if q2 < q and p2 < p and best[j][0] + min(SEED_WORDS, q - q2, p - p2) > cover:
                cover, first = best[j][0] + min(SEED_WORDS, q - q2, p - p2), best[j][1]
        best.append((cover, first))
    last = max(range(len(best)), key=lambda i: best[i][0])
    return best[last][0], places[best[last][1]], places[last]


_LEXICONS: dict[int, Lexicon] = {}


def _lexicon(block: Block) -> Lexicon:
    """The worker's lexicon of a block, kept from task to task."""
    key = hash(tuple(block.words))
    if key not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[key] = Lexicon(block.words)
    return _LEXICONS[key]


def _distinct(a: np.ndarray) -> np.ndarray:
    """The different values in order, by sorting: several times as fast as by hashing where keys are products of a few numbers."""
    a = np.sort(a)
    return a[np.append(True, a[1:] != a[:-1])] if len(a) else a


def _places(block: Block, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place of the seeds found: which of ``seed`` it is of, and the index of the place."""
    counts = np.diff(block.place_start)[seed]
    at = np.repeat(block.place_start[seed], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(np.arange(len(seed)), counts), at


def _covers(group: np.ndarray, q: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups, sorted, and the words of the item that the seeds at ``q`` cover in each, in any order."""
    uniq = _distinct(group * longest + q)
    owner = uniq // longest
    step = np.full(len(uniq), SEED_WORDS)
    step[:-1] = np.where(owner[1:] == owner[:-1], np.minimum(uniq[1:] - uniq[:-1], SEED_WORDS), SEED_WORDS)
    groups, first = np.unique(owner, return_index=True)
    return groups, np.add.reduceat(step, first) if len(first) else step


def _outside(block: Block, doc: np.ndarray, pos: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """In how many of the texts each place of a seed is found outside of runs of its item."""
    hit, at = _places(block, seed)
    n_places, longest = len(block.place_item), max(map(len, block.items)) + 1
    d, p, item, q = doc[hit], pos[hit], block.place_item[at], block.place_pos[at]
    most = np.zeros(len(hit), np.int64)
    for shift in (0, RUN_REACH // 2):
        part = (p + shift) // RUN_REACH
        n_parts = int(part.max()) + 1 if len(part) else 1
        _, group = np.unique((d * len(block.items) + item) * n_parts + part, return_inverse=True)
        most = np.maximum(most, _covers(group, q, longest)[1][group])
    size = np.array([len(x) for x in block.items])[item]
    found = (d * n_places + at)[most < np.minimum(OWN_RUN, size)]
    return np.bincount(_distinct(found) % n_places, minlength=n_places)


def _pairs(block: Block, doc: np.ndarray, pos: np.ndarray, seed: np.ndarray, own: np.ndarray, rare: np.ndarray):
    """The (text, item) pairs with enough seeds, as (text, item, seeds that are no stock wording, rare seeds, sorted
    places); ``own`` and ``rare`` say it of each place."""
    hit, at = _places(block, seed)
    item, q = block.place_item[at], block.place_pos[at]
    d, p, s = doc[hit], pos[hit], seed[hit]
    n_items, longest = len(block.items), max(map(len, block.items)) + 1
    pair = d * n_items + item
    # A bound of what a chain can cover.
    pairs, cover = _covers(pair, q, longest)

    def seeds_of(is_rare: np.ndarray) -> np.ndarray:
        rare_pair = _distinct(pair[is_rare] * len(block.seeds) + s[is_rare]) // len(block.seeds)
        return np.searchsorted(rare_pair, pairs, "right") - np.searchsorted(rare_pair, pairs, "left")

    n_own, n_rare = seeds_of(own[at]), seeds_of(rare[at])
    size = np.array([len(x) for x in block.items])[pairs % n_items]
    keep = np.zeros(len(pairs), bool)
    for least_own, least_cover in CHAINS:
        keep |= (n_own >= least_own) & (cover >= np.minimum(least_cover, size))
    chosen = pairs[keep]
    mine = np.isin(pair, chosen)
    pair, p, q = pair[mine], p[mine], q[mine]
    order = np.lexsort((q, p, pair))
    pair, p, q = pair[order], p[order], q[order]
    first, after = np.searchsorted(pair, chosen), np.searchsorted(pair, chosen, "right")
    p, q = p.tolist(), q.tolist()
    for c, lo, hi, own_seeds, rare_seeds in zip(chosen.tolist(), first.tolist(), after.tolist(), n_own[keep].tolist(), n_rare[keep].tolist()):
        yield c // n_items, c % n_items, own_seeds, rare_seeds, list(zip(p[lo:hi], q[lo:hi]))


def _batch_ids(texts: list[str | None], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """All texts' word ids in one array, parted by enough -1, and the offset of each text."""
    part = [-1] * SEED_WORDS
    flat: list[int] = []
    starts = [0]
    for t in texts:
        if t:
            flat += lexicon.text_ids(t)
        flat += part
        starts.append(len(flat))
    return np.array(flat, np.int64), np.array(starts, np.int64)


def find_leaks(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``(doc_id, item_id, score, span, matched)``: the texts that hold an item's passage or a long run of it.

    Method: word trigrams of the items are seeds. A first pass counts in how many texts each seed occurs, and occurs
    outside of runs of its item: tasks send at most one row a seed and place in an item. The seeds of a text that are no stock
    wording then name the items to compare it with, and Smith-Waterman alignment over words (``align``) decides, which bears line
    ends, broken and misread words, words dropped or slipped in, and other columns in between. Seeds are sought in whole texts; the alignment
    covers the part of the text where words of the item can still belong to its longest chain of seeds (``WINDOW_PER_WORD``). The items
    are broadcast in blocks of ``BLOCK_BYTES``; the corpus is never shuffled, so no text, item or seed can become a hot key.

    Defined cases: null, empty and blank texts hold nothing; null or empty items, and items of fewer words than a seed,
    are never found; an item given twice is found for both rows; repeated texts are each reported; ids may be null;
    empty tables give no rows; other columns are ignored.
    """
    spark = corpus.sparkSession
    docs = corpus.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    held = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("item_id", held.schema["item_id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("span", T.IntegerType()),
            T.StructField("matched", T.IntegerType()),
        ]
    )
    n_docs, n_bytes = docs.count(), held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = spark.createDataFrame([], schema)
    n_blocks = -(-n_bytes // BLOCK_BYTES)
    for b in range(n_blocks):
        part = held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b) if n_blocks > 1 else held
        block = Block.of([(r[0], r[1]) for r in part.collect()])
        if len(block.seeds):
            found = found.unionByName(_search(docs, block, n_docs, schema))
    return found


def _search(docs: DataFrame, block: Block, n_docs: int, schema) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared.value
        lexicon, sums = _lexicon(block), np.zeros((2, len(block.place_item)), np.int64)
        for pdf in batches:
            ids, starts = _batch_ids(pdf["text"].tolist(), lexicon)
            pos, seed = block.hits(ids)
            doc = np.searchsorted(starts, pos, "right") - 1
            n = np.bincount(_distinct(doc * len(block.seeds) + seed) % len(block.seeds), minlength=len(block.seeds))
            sums += [np.repeat(n, np.diff(block.place_start)), _outside(block, doc, pos, seed)]
            lexicon.tidy()
        at = np.flatnonzero(sums[0])
        yield pd.DataFrame({"place": at, "texts": sums[0][at], "outside": sums[1][at]})

    sums = docs.select("text").mapInPandas(count, "place long, texts long, outside long").groupBy("place")
    # Two numbers a place of a seed in the block, however large the corpus.
    texts_of = np.zeros((2, len(block.place_item)), np.int64)
    for r in sums.agg(F.sum("texts"), F.sum("outside")).collect():
        texts_of[:, r[0]] = r[1:]
    by_item: list[list[int]] = [[] for _ in block.items]
    for n, k in zip(texts_of[0].tolist(), block.place_item.tolist()):
        by_item[k].append(n)
    limit = np.array([max(RARE_SHARE * n_docs, float(np.quantile(x, RARER_PART)) if x else 0.0) for x in by_item])
    rarity = docs.sparkSession.sparkContext.broadcast(tuple(texts_of <= limit[block.place_item]))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, (rare, own) = shared.value, rarity.value
        lexicon = _lexicon(block)
        for pdf in batches:
            ids, starts = _batch_ids(pdf["text"].tolist(), lexicon)
            pos, seed = block.hits(ids)
            doc = np.searchsorted(starts, pos, "right") - 1
            rows = []
            for d, k, n_own, n_rare, places in _pairs(block, doc, pos, seed, own, rare):
                item = block.items[k]
                chain_words, (p0, q0), (p1, q1) = longest_chain(places)
                if not any(n_own >= r and chain_words >= min(c, len(item)) for r, c in CHAINS):
                    continue
                begin = max(int(starts[d]), p0 - WINDOW_PER_WORD * q0 - WINDOW_MARGIN)
                end = min(int(starts[d + 1]) - SEED_WORDS, p1 + WINDOW_PER_WORD * (len(item) - q1) + WINDOW_MARGIN)
                need = min(RUN_WORDS, len(item))
                short = need / RUN_WORDS  # below 1 for a whole passage shorter than a run
                enough = MIN_SCORE_RARE if n_rare >= MANY_RARE or short < 1 else MIN_SCORE
                score, span, matched = align(item, ids[begin:end], lexicon, enough * short)
                dense = n_rare >= MANY_RARE or score >= SURE_SCORE or matched >= DENSITY * span
                # A pair without enough rare seeds must be a run that is whole but for the words at its ends.
                if not any(n_rare >= r and chain_words >= min(c, len(item)) for r, c in CHAINS):
                    dense = matched >= span - SLACK
                if span >= need - SLACK and score >= enough * short and dense:
                    rows.append((pdf["doc_id"].iat[d], block.item_ids[k], score, span, matched))
            lexicon.tidy()
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "span", "matched"])

    return docs.mapInPandas(compare, schema)
