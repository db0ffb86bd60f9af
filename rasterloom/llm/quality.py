"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network with calibrated probabilities.

Random indexing: each document has a sparse random vector, a word's vector is the sum of those of the documents it stands in,
gathered over the whole corpus without labels. Words are hashed into a table of fixed size, so what is gathered and broadcast
doesn't grow with the data. A word also counts as its shape (its runs of lower case, upper case, digits and signs). The
partial tables of all tasks are merged in a tree whose nodes take FAN tables at most.

A document's vector is the mean of its words' unit vectors, frequent words weighing less, with how many words it pools and the
share of different ones. The network learns from a bounded
sample of labelled documents; a part of them that it doesn't learn from sets the temperature of its probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, rows_of

#: Rows of the word table, dimensions, nonzeros of a document's random vector, chunks a table is sent in, tables merged at once.
BUCKETS, DIMS, NONZERO, CHUNKS, FAN = 1 << 14, 48, 6, 32, 64
#: Labelled documents that the network learns from at most (by hash of doc_id); hidden units; epochs; learning rate; decay.
MAX_TRAIN, HIDDEN, EPOCHS, RATE, DECAY = 20_000, 32, 60, 0.01, 1e-4
SMOOTH, SEED, MEMO = 1e-3, 11, 300_000

_SHAPE = ((re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile("[A-ZÀ-ÖØ-Þ]{2,}"), "AA"), (re.compile("[0-9]+"), "0"), (re.compile(r"[^\w\s]{2,}"), "##"))


def shape(word: str) -> str:
    for pattern, sign in _SHAPE:
        word = pattern.sub(sign, word)
    return word[:12]


class _Buckets(dict):
    """A word's two rows of the table: of the word and of its shape."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= MEMO:
            self.clear()
        own = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS, zlib.crc32(b"\x00" + shape(word).encode("utf-8", "surrogatepass")) % BUCKETS
        self[word] = own
        return own


_buckets = _Buckets()


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a text's words and shapes, and how often each comes."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows = np.fromiter((x for w in words for x in _buckets[w]), np.int64, 2 * len(words))
    return np.unique(rows, return_counts=True)


def _random_vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A document's random vector: places and signs, from its text alone, so that copies share one."""
    rng = np.random.default_rng(zlib.crc32((text or "").encode("utf-8", "surrogatepass")) ^ SEED)
    return rng.choice(DIMS, NONZERO, replace=False), rng.choice(np.array([-1, 1], np.int32), NONZERO)


TABLE = "part long, chunk int, vectors binary, counts binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    vectors, counts = np.zeros((BUCKETS, DIMS), np.int32), np.zeros(BUCKETS, np.int64)
    for b in rows_of(batches, "text"):
        for text in b.column(0).to_pylist():
            rows, n = _counts(text)
            counts[rows] += n
            weight = np.minimum(n, 8).astype(np.int32)
            for place, sign in zip(*_random_vector(text), strict=True):
                vectors[rows, place] += sign * weight
    yield _table(TaskContext.get().partitionId(), vectors, counts)


def _table(part: int, vectors: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    size = BUCKETS // CHUNKS
    cut = [(part, c, zlib.compress(vectors[c * size : (c + 1) * size].tobytes(), 1), zlib.compress(counts[c * size : (c + 1) * size].tobytes(), 1)) for c in range(CHUNKS)]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*cut, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "chunk", "vectors", "counts"])


def _merge(table: pa.Table) -> pa.Table:
    add = lambda column, kind: zlib.compress(sum(np.frombuffer(zlib.decompress(x), kind) for x in table.column(column).to_pylist()).tobytes(), 1)
    return pa.table({"part": table.column("part")[:1], "chunk": table.column("chunk")[:1], "vectors": pa.array([add("vectors", np.int32)], pa.binary()), "counts": pa.array([add("counts", np.int64)], pa.binary())})


@dataclass
class Words:
    """Unit vectors and weights of the word table's rows."""

    vectors: np.ndarray
    weights: np.ndarray


def word_vectors(docs: DataFrame, scratch: Scratch) -> Words:
    """Random-indexing vectors over all documents; the merged table, of fixed size, comes to the driver."""
    parts = scratch.cut(docs.select("text").mapInArrow(_index, TABLE))
    top = parts.agg(F.max("part")).first()[0] or 0
    while top > 0:
        merged = scratch.cut(parts.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).groupBy("part", "chunk").applyInArrow(_merge, TABLE))
        scratch.drop(parts)
        parts, top = merged, top // FAN
    vectors, counts = np.zeros((BUCKETS, DIMS), np.float32), np.zeros(BUCKETS, np.int64)
    size = BUCKETS // CHUNKS
    for r in parts.collect():
        own = slice(r["chunk"] * size, (r["chunk"] + 1) * size)
        vectors[own] = np.frombuffer(zlib.decompress(r["vectors"]), np.int32).reshape(size, DIMS)
        counts[own] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = counts / max(1, counts.sum())
    return Words(vectors, (SMOOTH / (SMOOTH + share)).astype(np.float32))


def _pool(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches, "text"):
        out = []
        for text in b.column(1).to_pylist():
            rows, n = _counts(text)
            w = words.weights[rows] * n
            mean = w @ words.vectors[rows] / w.sum() if len(rows) else np.zeros(DIMS)
            out.append(np.concatenate([mean, [np.log1p(n.sum()), len(rows) / max(1, n.sum())]]).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "vector"])


@dataclass
class Network:
    """Two layers on standardised vectors; the logit is divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Adam on weighted cross-entropy over four fifths of the rows; the rest sets the temperature. One class or none: its share."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        zero = np.zeros(x.shape[1])
        return Network(zero, zero + 1, np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    net = Network(x[own].mean(0), x[own].std(0) + 1e-6, rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), 0.0)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - net.mean) / net.scale
    for _ in range(EPOCHS):
        own = rng.permutation(own)
        for at in range(0, len(own), 64):
            i = own[at : at + 64]
            h = np.maximum(z[i] @ params[0] + params[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - y[i]) / len(i)
            dh = np.outer(d, params[2]) * (h > 0)
            grads = [z[i].T @ dh + DECAY * params[0], dh.sum(0), h.T @ d + DECAY * params[2], np.array([d.sum()])]
            step += 1
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(held):
        raw = net.logits(x[held])
        loss = lambda t: np.logaddexp(0, np.where(y[held] == 1, -raw, raw) / t).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def classify(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id and score (probability of quality 1) of each row of docs.

    Learns from labels (doc_id, quality) of rows for which learn, a condition on doc_id, holds: of all, or of max_train rows at
    most, those with the smallest hash of doc_id. Rows with a null doc_id or quality aren't learned from. Only the text is an input of a
    score: rows with the same text get the same score. Null and empty texts get the score of an empty vector. Without labels,
    every score is one half. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    words = docs.sparkSession.sparkContext.broadcast(word_vectors(docs, scratch))
    vectors = scratch.cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _pool(it, words.value), "doc_id long, vector binary"))
    own = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").where(F.lit(True) if learn is None else learn)
    # a threshold of the hash leaves about 0.97 * max_train rows in all, so no task sends its own max_train rows to the driver
    place = F.xxhash64("doc_id").cast("double") / 2.0**63
    sample = own.where(place < 1.94 * max_train / max(1, own.count()) - 1).orderBy(place, "doc_id", "quality").limit(max_train)
    # ids that several rows have bring a vector of each, but no more than max_train in all
    rows = sample.join(vectors, "doc_id").select("doc_id", "quality", "vector").orderBy(place, "doc_id", "quality", "vector").limit(max_train).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["vector"]))
    x = np.array([np.frombuffer(r["vector"], np.float32) for r in rows], np.float64).reshape(len(rows), DIMS + 2)
    sent = docs.sparkSession.sparkContext.broadcast(train(x, np.array([float(r["quality"] == 1) for r in rows])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([np.frombuffer(v, np.float32) for v in b.column(1).to_pylist()], np.float64).reshape(len(b), DIMS + 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.probability(x))], ["doc_id", "score"])

    return vectors.mapInArrow(score, "doc_id long, score double")
