"""Encoding of a whole corpus with a public byte-level BPE vocabulary, by merge replay."""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: The corpus's most frequent chunks are replayed once for all and sent to the workers: at most so many, of so many bytes at most each.
CORPUS_CHUNKS, CHUNK_BYTES = 200_000, 64
#: Chunks counted by one task before it hands its partial counts on.
FLUSH_CHUNKS = 400_000
#: Texts of one slice: chunks that are not among those sent are gathered into one inverted index and replayed together.
SLICE_TEXTS = 1_000
#: Encoded chunks that a worker keeps for later slices beside those sent; beyond it they are dropped.
KEEP_CHUNKS = 100_000

# The split pattern of the vocabulary and the code points of White_Space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_WORDS = regex.compile(WORDS)
# White space and what follows up to the next white space. The word pattern never looks past such a chunk: only the
# last blank before a word can join it, and the run before it is inside the chunk. So chunks encode independently.
_CHUNKS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself if printable Latin-1, else 256 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class MergeReplay:
    """The vocabulary's merges, and their replay over many words at once."""

    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)["model"]
        ids = model["vocab"]
        self.byte_ids = np.zeros(256, np.int64)
        for symbol, b in byte_symbols().items():
            self.byte_ids[b] = ids[symbol]
        self.left, self.right, self.made = [], [], []
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.left.append(ids[a])
            self.right.append(ids[b])
            self.made.append(ids[a + b])
        self.rank = {(a << 32) | b: r for r, (a, b) in enumerate(zip(self.left, self.right))}
        self.kept: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word. Every merge is applied in rank order to all words.

        All words lie in one array of tokens linked to their neighbours. An inverted index lists, by merge, the
        positions of its pair; a heap gives the merges that have any, lowest rank first. Applying a merge changes the
        token at a position, unlinks the next one, and looks up only the two pairs with the new neighbours. A pair
        with a token that merge r made always has a rank above r, so no merge is ever due again after its turn.
        """
        flat = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        tokens = self.byte_ids[flat].tolist()
        n = len(tokens)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for e in ends.tolist():
            after[e - 1] = -1
            if e < n:
                before[e] = -1
        rank, index = self.rank, {}
        for p in range(n):
            q = after[p]
            if q >= 0:
                r = rank.get((tokens[p] << 32) | tokens[q])
                if r is not None:
                    index.setdefault(r, []).append(p)
        due = list(index)
        heapq.heapify(due)
        while due:
            r = heapq.heappop(due)
            a, b, made = self.left[r], self.right[r], self.made[r]
            positions = index.pop(r)
            positions.sort()
            for p in positions:
                q = after[p]
                if q < 0 or tokens[p] != a or tokens[q] != b:
                    continue  # a neighbour was merged first
                tokens[p], tokens[q] = made, -1
                o = after[p] = after[q]
                if o >= 0:
                    before[o] = p
                    s = rank.get((made << 32) | tokens[o])
                    if s is not None:
                        if s in index:
                            index[s].append(p)
                        else:
                            index[s] = [p]
                            heapq.heappush(due, s)
                o = before[p]
                if o >= 0:
                    s = rank.get((tokens[o] << 32) | made)
                    if s is not None:
                        if s in index:
                            index[s].append(o)
                        else:
                            index[s] = [o]
                            heapq.heappush(due, s)
        out, start = [], 0
        for e in ends.tolist():
            out.append([t for t in tokens[start:e] if t >= 0])
            start = e
        return out

    def learn(self, chunks: Iterable[str]) -> None:
        """Encodes the chunks that are not kept yet."""
        parts = {c: _WORDS.findall(c) for c in chunks}
        words = list({w for ws in parts.values() for w in ws})
        # A lone surrogate, which no valid Parquet text has, is encoded as U+FFFD rather than failing the task.
        ids = dict(zip(words, self.replay([w.encode("utf-8", "replace") for w in words])))
        for c, ws in parts.items():
            self.kept[c] = np.array([t for w in ws for t in ids[w]], np.int32).tobytes()

    def start(self, known: dict[str, bytes]) -> None:
        """Keeps the encodings of the corpus's frequent chunks for good."""
        self.known, self.kept = known, dict(known)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers; none for a null or empty text."""
        split = [_CHUNKS.findall(t) if t else () for t in texts]
        kept = self.kept
        new = {c for s in split for c in s if c not in kept}
        if len(kept) - len(self.known) + len(new) > KEEP_CHUNKS:
            kept = self.kept = dict(self.known)
            new = {c for s in split for c in s if c not in kept}
        if new:
            self.learn(new)
        return [b"".join([kept[c] for c in s]) for s in split]


_LOADED: dict[int, MergeReplay] = {}


def _loaded(raw: bytes) -> MergeReplay:
    key = hash(raw)
    if key not in _LOADED:
        _LOADED[key] = MergeReplay(raw)
    return _LOADED[key]


def frequent_chunks(texts: DataFrame) -> DataFrame:
    """``(chunk)``: the chunks met most often in the corpus, at least twice, by counts that each task combines before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            part = pa.RecordBatch.from_arrays([pa.array(met.keys(), pa.string()), pa.array(met.values(), pa.int64())], names=["chunk", "n"])
            met.clear()
            return part

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    met.update(_CHUNKS.findall(t))
                if len(met) > FLUSH_CHUNKS:
                    yield out()
        # A chunk met once by a task may be met by others, too.
        yield out()

    counts = texts.mapInArrow(count, "chunk string, n long").where(F.octet_length("chunk") <= CHUNK_BYTES)
    counts = counts.groupBy("chunk").agg(F.sum("n").alias("n")).where("n > 1")
    return counts.orderBy(F.desc("n"), "chunk").limit(CORPUS_CHUNKS).select("chunk")


def encode_corpus(df: DataFrame, doc_id: str, text: str, vocabulary_path: str) -> DataFrame:
    """``(doc_id, ids)``: the token ids of each whole text, one row for each row given, without special tokens.

    ``vocabulary_path`` names a byte-level BPE file (JSON with ``model.vocab`` and ``model.merges``). The driver reads
    it once and sends its few megabytes to the workers.

    Method: corpus-level merge replay. The corpus's chunks (white space and what follows) are counted; the words of the
    ``CORPUS_CHUNKS`` most frequent are laid out in arrays, and an inverted index from token pair to positions lets every
    merge be applied in rank order, touching only changed neighbours (``MergeReplay.replay``). Their encodings, of bounded
    size, are sent to the workers, who put the texts' ids together. The chunks beyond those, which are mostly misread and met
    once, are replayed in the same way by slices of texts. So no text and no word is shuffled but for the partial counts, and memory
    is bounded by ``CORPUS_CHUNKS``, ``SLICE_TEXTS`` texts and ``KEEP_CHUNKS`` chunks.

    Defined cases: null and empty texts give an empty list; blank texts are encoded like any other; strings that look
    like special tokens are ordinary text; repeated rows and null ids are kept as they are; an empty table gives no
    rows; other columns are ignored.
    """
    spark = df.sparkSession
    vocabulary = spark.sparkContext.broadcast(Path(vocabulary_path).read_bytes())
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = docs.select("doc_id").schema.add("ids", ArrayType(IntegerType()))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _loaded(vocabulary.value)
        for batch in batches:
            chunks = batch.column(0).to_pylist()
            replay.start({})
            replay.learn(chunks)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([replay.kept[c] for c in chunks], pa.binary())], names=["chunk", "ids"])

    frequent = frequent_chunks(docs.select("text"))
    learned = frequent.repartition(spark.sparkContext.defaultParallelism, "chunk").mapInArrow(learn, "chunk string, ids binary")
    known = spark.sparkContext.broadcast({r["chunk"]: bytes(r["ids"]) for r in learned.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _loaded(vocabulary.value)
        if replay.known is not known.value:
            replay.start(known.value)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_TEXTS):
                part = batch.slice(start, SLICE_TEXTS)
                ids = replay.encode(part.column(1).to_pylist())
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return docs.mapInArrow(run, schema)


def decode(ids: Iterable[int], vocabulary: bytes) -> str:
    """The text that the ids stand for, as an exact check of the encoding."""
    symbols, of = byte_symbols(), {i: s for s, i in json.loads(vocabulary)["model"]["vocab"].items()}
    return bytes(symbols[c] for i in ids for c in of[i]).decode("utf-8")
