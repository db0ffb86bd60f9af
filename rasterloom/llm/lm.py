"""LM scoring with a hashed maximum-entropy model.

The probability of a token given the two before it is a class-factored softmax: of the token's class, times that of the token in
its class. All softmaxes add, to the log frequencies counted over the training text, rows of weight tables at hashed features:
the token before (bigram), the one before that (skip), and both (trigram). Class 0, "other", goes on as a tree of softmaxes down
to each counted token, so all of them are outputs that depend on the tokens before:

* the OUTPUTS most frequent tokens have a class and a place in it;
* the other ones of the HEAD most frequent tokens are leaves of a Huffman tree, which is broadcast with their counts;
* one leaf of it stands for all rarer tokens. These are ranked by frequency and joined with their ranks; a second tree has the
  ranks as its leaves, and what its nodes weigh follows from a histogram of the counts, so it has any number of leaves.

A token that no training document has gets the share of a token with count 0 among the others. As context every token counts as
itself, rare ones by a hash.

Counts come from all training documents. Weights are trained in rounds over disjoint parts of them: in each round every task
takes gradient steps on its documents from the same broadcast weights, and the changes are averaged by tokens in a tree. Scoring
takes whole texts as sparse numpy batches. The rarer tokens' own tree is trained and scored on the joined rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, rows_of

#: Tokens whose counts are broadcast; classes; words in a class; rows of a weight table; positions in a numpy batch.
HEAD, CLASSES, PER_CLASS, ROWS, BATCH = 200_000, 32, 32, 1 << 14, 8192
#: Class 0 holds "other" alone, so its share inside the class is 1.
OUTPUTS = (CLASSES - 1) * PER_CLASS
#: Children of a node in the trees of the other tokens, as a power of two; their number.
BITS = 5
BRANCH = 1 << BITS
#: Rounds (parts of the training documents), step size, tables merged at once, chunks a table is sent in, counters kept in a task.
ROUNDS, RATE, FAN, CHUNKS, COUNTERS = 2, 0.2, 32, 16, 600_000
#: The end of a text: no word, as words hold no white space.
END = b"\n"
_M = np.uint64


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of these texts in a row, and where each text ends."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = lists.flatten()
    full = pc.binary_length(words).to_numpy() > 0  # white space at either end of a text splits off an empty word
    words = words.filter(pa.array(full)).cast(pa.binary())
    ends = np.concatenate([[0], np.cumsum(full)])[np.cumsum(pc.list_value_length(lists).to_numpy())] + np.arange(1, len(lists) + 1)
    inside = np.ones(len(words) + len(ends), bool)
    inside[ends - 1] = False
    place = np.where(inside, np.cumsum(inside) - 1, len(words))
    return pa.concat_arrays([words, pa.array([END], pa.binary())]).take(pa.array(place)), ends


def _hash(tokens: pa.Array) -> np.ndarray:
    """Hashes of 61 bits and one above: polynomials in the bytes, mixed."""
    if not len(tokens):
        return np.empty(0, np.int64)
    at = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1].astype(np.int64)
    data, size = np.frombuffer(tokens.buffers()[2], np.uint8)[at[0] : at[-1]], np.diff(at)
    place = np.arange(len(data)) - np.repeat(at[:-1] - at[0], size)
    power = np.cumprod(np.full(size.max(), 0x9E3779B97F4A7C15, _M))
    sums = np.add.reduceat((data + _M(1)) * power[place], at[:-1] - at[0])
    return ((_mix(_mix(sums)) >> _M(3)) | _M(1 << 61)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, held = ["token", "n"], []
    merged = lambda: pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(names)
    for b in rows_of(batches, "text"):
        held.append(pa.table(pc.value_counts(_tokens(b.column(0))[0]).flatten(), names))
        if sum(map(len, held)) > 2 * COUNTERS:
            held = [merged()]
            if len(held[0]) > COUNTERS:
                yield from held.pop().combine_chunks().to_batches()
    if held:
        yield from merged().combine_chunks().to_batches()


class Tables:
    """Weight tables, by name."""

    names: tuple[str, ...]

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.names])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.names:
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape).copy())
            at += old.size

    def copy(self) -> Tables:
        own = type(self).__new__(type(self))
        own.__dict__.update(self.__dict__)
        own.put(self.flat())
        return own


class Tree:
    """A Huffman tree over leaves of this mass: the steps (node, digit) of leaf k are those from at[k] to at[k + 1]."""

    def __init__(self, mass: np.ndarray):
        n = len(mass)
        count = n + -(n - 1) % (BRANCH - 1)  # with empty leaves, so that each node is full
        own = np.concatenate([mass, np.zeros(count - n + (count - 1) // (BRANCH - 1))])
        parent, digit = np.full(len(own), -1), np.zeros(len(own), np.int64)
        heap = list(zip(own[:count].tolist(), range(count), strict=True))
        heapq.heapify(heap)
        for node in range(count, len(own)):
            children = [heapq.heappop(heap) for _ in range(BRANCH)]
            at = [k for _, k in children]
            parent[at], digit[at], own[node] = node, range(BRANCH), sum(m for m, _ in children)
            heapq.heappush(heap, (own[node], node))
        ratio = np.zeros((len(own) - count, BRANCH))
        below = np.flatnonzero(parent >= 0)
        ratio[parent[below] - count, digit[below]] = own[below] / np.maximum(own[parent[below]], 1e-300)
        self.prior = _log(ratio)
        steps, leaf, at = [], np.arange(n), np.arange(n)
        while len(leaf := leaf[up := parent[at] >= 0]):
            at = at[up]
            steps.append((leaf, parent[at] - count, digit[at]))
            at = parent[at]
        leaves, nodes, digits = (np.concatenate([s[k] for s in steps]) if steps else np.empty(0, np.int64) for k in range(3))
        order = np.argsort(leaves, kind="stable")
        self.node, self.digit = nodes[order].astype(np.int32), digits[order].astype(np.int8)
        self.at = np.searchsorted(leaves[order], np.arange(n + 1))

    def steps(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All steps of these leaves: whose they are, their nodes and digits."""
        n = self.at[leaf + 1] - self.at[leaf]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[leaf] - ends + n, n)
        return np.repeat(np.arange(len(leaf)), n), self.node[at].astype(np.int64), self.digit[at].astype(np.int64)


class Model(Tables):
    """Counts of frequent tokens, log frequencies of classes and words, the tree of the other tokens, and the three weight tables."""

    names = ("w", "u", "v")

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.tokens = pa.array([t for t, _ in head], pa.binary())
        self.counts = np.array([n for _, n in head] + [0], np.float64)
        self.n_out = min(OUTPUTS, len(head))
        # the k-th most frequent token is output PER_CLASS + k; output 0 is "other"
        out = np.zeros((CLASSES, PER_CLASS))
        out.ravel()[PER_CLASS : PER_CLASS + self.n_out] = self.counts[: self.n_out]
        others = total - self.counts[: self.n_out].sum()
        out[0, 0] = others + 1
        self.rest = others + (distinct - self.n_out) + 1  # all others' counts, each and that of an unseen token 1 more
        self.class_log, self.word_log = _log(out.sum(1) / out.sum()), _log(out / np.maximum(out.sum(1, keepdims=True), 1))
        # leaf k is token n_out + k, the last one stands for all tokens that are rarer than the head
        own = self.counts[self.n_out : -1] + 1
        self.tree = Tree(np.append(own, max(self.rest - 1 - own.sum(), 0)))
        self.w = np.zeros((ROWS, CLASSES), np.float32)
        self.u = np.zeros((ROWS, PER_CLASS), np.float32)
        self.v = np.zeros((ROWS, BRANCH), np.float32)


class Tail(Tables):
    """The tree of the tokens rarer than the head, whose leaves are their ranks, and its weight table.

    levels: how many tokens there are and their mass, by falling frequency. A node's mass is that of its interval of ranks, even inside a level.
    """

    names = ("t",)

    def __init__(self, levels: list[tuple[int, float]]):
        self.ends = np.cumsum([0, *(n for n, _ in levels)])
        self.mass = np.cumsum([0.0, *(m for _, m in levels)])
        self.size = int(self.ends[-1])
        self.depth = -(-(self.size - 1).bit_length() // BITS) if self.size > 1 else 0
        self.t = np.zeros((ROWS, BRANCH), np.float32)

    def steps(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All steps to these ranks: whose they are, their nodes and digits, and the logs of the nodes' shares."""
        child = np.concatenate([rank >> (BITS * (self.depth - 1 - k)) for k in range(self.depth)])
        level = np.repeat(np.arange(self.depth), len(rank))
        node = child >> BITS
        width = BITS * (self.depth - level)  # of a node's interval, in bits
        prior = np.full((len(node), BRANCH), -np.log(BRANCH), np.float32)
        mixed = np.flatnonzero(np.searchsorted(self.ends, node << width, "right") != np.searchsorted(self.ends, (node + 1) << width, "left"))  # not inside one level
        if len(mixed):
            own, back = np.unique(node[mixed] + (level[mixed] << 56), return_inverse=True)
            edges = (((own & ((1 << 56) - 1)) << BITS)[:, None] + np.arange(BRANCH + 1)) << (BITS * (self.depth - 1 - (own >> 56)))[:, None]
            share = np.diff(np.interp(edges, self.ends, self.mass), axis=1)
            prior[mixed] = _log(share / share.sum(1, keepdims=True))[back]
        return np.tile(np.arange(len(rank)), self.depth), node + (level << 56), child & (BRANCH - 1), prior


def _log(share: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.maximum(np.log(share), -80).astype(np.float32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M(31))) * _M(0x9E3779B97F4A7C15)
    return x ^ (x >> _M(29))


def features(before: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """3 x positions: hashes of the bigram, skip and trigram features."""
    a, b = before.astype(np.uint64) + _M(2), skip.astype(np.uint64) + _M(2)
    return np.stack([_mix(a * _M(3)), _mix(b * _M(5) + _M(1 << 40)), _mix((a << _M(24)) + b + _M(1 << 50))])


def _soft(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of x, which is clipped, and their sums. Frequencies are probabilities and weights stay small, so exp needs no shift."""
    if x.max(initial=0) > 60:
        np.minimum(x, 60, out=x)
    e = np.exp(x)
    return e, e @ np.ones(x.shape[1], np.float32)


def _gather(table: np.ndarray, start: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = table.take(rows[0], axis=0)
    out += start
    for r in rows[1:]:
        out += table.take(r, axis=0)
    return out


def _forward(model: Model, f: np.ndarray, target: np.ndarray):
    """Of the positions with these features and targets: natural log probabilities, and what a gradient step needs."""
    at, c = np.arange(len(target)), target // PER_CLASS
    fr = (f & _M(len(model.w) - 1)).astype(np.uint16)
    x = _gather(model.w, model.class_log, fr)
    e, z = _soft(x)  # clips x, so what is scored is what is summed
    logs = x[at, c].astype(np.float64) - np.log(z)
    named = np.flatnonzero(c)  # in class 0 there is one word
    more, inner = _branch(model.u, model.word_log.take(c[named], axis=0), f[:, named], c[named], target[named] % PER_CLASS)
    logs[named] += more
    return logs, (at, c, fr, e, z), inner


def _branch(table: np.ndarray, prior: np.ndarray, f: np.ndarray, node: np.ndarray, digit: np.ndarray):
    """Of steps from these nodes to a child: natural log probabilities, and what a gradient step needs."""
    # features are mixed already, so the product's upper bits are a hash of both
    rows = ((f + node.astype(np.uint64) * _M(0xD1B54A32D192ED03)) * _M(0x9E3779B97F4A7C15) >> _M(65 - len(table).bit_length())).astype(np.uint16)
    at, y = np.arange(len(node)), _gather(table, prior, rows)
    e, z = _soft(y)
    return y[at, digit].astype(np.float64) - np.log(z), (at, digit, rows, e, z)


def _other(model: Model, f: np.ndarray, leaf: np.ndarray):
    """Of positions with these leaves of the tree of other tokens: natural log probabilities, and what a gradient step needs."""
    own, node, digit = model.tree.steps(leaf)
    logs, inner = _branch(model.v, model.tree.prior.take(node, axis=0), f.take(own, axis=1), node, digit)
    return np.bincount(own, logs, len(leaf)), inner


def _rare(tail: Tail, f: np.ndarray, rank: np.ndarray):
    """The same of tokens rarer than the head, with these ranks."""
    own, node, digit, prior = tail.steps(rank)
    logs, inner = _branch(tail.t, prior, f.take(own, axis=1), node, digit)
    return np.bincount(own, logs, len(rank)), inner


def _step(table: np.ndarray, heat: np.ndarray, steps: tuple) -> None:
    """Adaptive gradient steps, feature by feature: rows that had large gradients take smaller ones."""
    at, hit, rows, e, z = steps
    if not len(at):
        return
    grad = e / z[:, None]
    grad[at, hit] -= 1
    square = np.einsum("ij,ij->i", grad, grad) / table.shape[1]
    pairs = table.reshape(-1).view(np.complex64)  # two weights at once
    width = table.shape[1] // 2
    for r in rows:
        # a row's summed gradient has at most the square of its count times its squared gradients
        np.add.at(heat, r, (np.bincount(r).take(r) * square).astype(np.float32))
        change = grad * (-RATE / np.sqrt(heat.take(r)))[:, None]
        np.add.at(pairs, (r.astype(np.int64)[:, None] * width + np.arange(width)).reshape(-1), change.view(np.complex64).reshape(-1))


def _positions(texts: pa.Array, model: Model):
    """The tokens rarer than the head and their positions, the ids of all tokens in a row (-1: rarer; the end included), the contexts before
    and before that (-2: none; rare tokens by a hash), targets, leaves in the tree of other tokens, and where each text ends."""
    tokens, ends = _tokens(texts)
    ids = pc.index_in(tokens, value_set=model.tokens).fill_null(-1).to_numpy().astype(np.int64)
    unknown = np.flatnonzero(ids < 0)
    rare = tokens.take(pa.array(unknown))
    own = ids.copy()
    own[unknown] = _hash(rare)
    starts = np.concatenate([[0], ends[:-1]])
    before, skip = np.concatenate([[-2], own[:-1]]), np.concatenate([[-2, -2], own[:-2]])[: len(ids)]
    before[starts] = skip[starts] = -2
    second = starts + 1
    skip[second[second < ends]] = -2
    leaf = np.where(ids < 0, len(model.counts) - 1, ids) - model.n_out
    return rare, unknown, ids, before, skip, np.where((ids >= 0) & (ids < model.n_out), ids + PER_CLASS, 0), leaf, ends


DELTA = "part long, chunk int, n double, change binary"


def _learn_texts(own: Model, heat: list[np.ndarray], b: pa.RecordBatch) -> int:
    _, _, _, before, skip, target, leaf, _ = _positions(b.column(0), own)
    for at in range(0, len(target), BATCH):
        i = slice(at, at + BATCH)
        f, other = features(before[i], skip[i]), np.flatnonzero(target[i] == 0)
        _, outer, inner = _forward(own, f, target[i])
        _, deeper = _other(own, f.take(other, axis=1), leaf[i][other])
        for table, h, x in zip((own.w, own.u, own.v), heat, (outer, inner, deeper), strict=True):
            _step(table, h, x)
    return len(target)


def _learn_rare(own: Tail, heat: list[np.ndarray], b: pa.RecordBatch) -> int:
    rank, before, skip = (b.column(k).to_numpy() for k in range(3))
    for at in range(0, len(rank), BATCH):
        i = slice(at, at + BATCH)
        _step(own.t, heat[0], _rare(own, features(before[i], skip[i]), rank[i])[1])
    return len(rank)


def _train(batches: Iterator[pa.RecordBatch], model: Tables, learn) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first, own, n = model.flat(), model.copy(), 0
    heat = [np.ones(len(getattr(own, k)), np.float32) for k in own.names]
    for b in batches:
        if len(b):
            n += learn(own, heat, b)
    if n:
        change = np.array_split((own.flat() - first).astype(np.float16), CHUNKS)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * CHUNKS, pa.int64()), pa.array(range(CHUNKS), pa.int32()), pa.array([float(n)] * CHUNKS), pa.array([x.tobytes() for x in change], pa.binary())], ["part", "chunk", "n", "change"])


def _average(table: pa.Table) -> pa.Table:
    n = np.array(table.column("n").to_pylist())
    total = sum(k * np.frombuffer(x, np.float16).astype(np.float32) for k, x in zip(n, table.column("change").to_pylist(), strict=True)) / n.sum()
    return pa.table({"part": table.column("part")[:1], "chunk": table.column("chunk")[:1], "n": pa.array([n.sum()]), "change": pa.array([total.astype(np.float16).tobytes()], pa.binary())})


def _head(counts: DataFrame, size: int | None = None) -> list[tuple[bytes, int]]:
    """The most frequent tokens, size at most, by falling count: all tokens from a count on, which a histogram of the counts' magnitudes gives."""
    size = HEAD if size is None else size
    own = counts.withColumn("level", F.floor(F.log2("n") * 16).cast("int"))
    total, least = 0, None
    for level, n in sorted(own.groupBy("level").agg(F.count("*")).collect(), reverse=True):  # a thousand levels at most
        total += n
        if total > size:
            break
        least = level
    if least is None:
        return []
    return sorted(((bytes(r[0]), r[1]) for r in own.where(F.col("level") >= least).select("token", "n").collect()), key=lambda r: (-r[1], r[0]))


def _trained(rows: DataFrame, model: Tables, train, scratch: Scratch) -> None:
    """One round: the model's tables after the rows' tasks have trained on them, averaged."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    parts = scratch.cut(rows.mapInArrow(lambda it: train(it, sent.value), DELTA))
    top = parts.agg(F.max("part")).first()[0]
    if top is None:
        return
    while True:
        merged = scratch.cut(parts.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).groupBy("part", "chunk").applyInArrow(_average, DELTA))
        scratch.drop(parts)
        parts, top = merged, top // FAN
        if not top:
            break
    change = {x["chunk"]: np.frombuffer(x["change"], np.float16) for x in parts.collect()}  # one table, whatever the input
    scratch.drop(parts)
    model.put(model.flat() + np.concatenate([change[k] for k in range(CHUNKS)]).astype(np.float32))
    sent.unpersist()


def fit(docs: DataFrame, learn: Column, scratch: Scratch, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model and the table of all tokens' counts (token, n), from the rows of docs for which learn holds."""
    own = docs.where(learn).select("doc_id", "text")
    counts = scratch.cut(own.select("text").mapInArrow(_count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model = Model(_head(counts), total, distinct)
    for r in range(rounds):
        mine = own.where(F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(rounds)) == r).select("text")
        _trained(mine, model, lambda it, m: _train(rows_of(it, "text"), m, _learn_texts), scratch)
    return model, counts


def _ranked(counts: DataFrame, model: Model, scratch: Scratch) -> tuple[Tail, DataFrame]:
    """The untrained tree of the tokens rarer than the head, and these tokens with their counts and ranks (token, n, rank)."""
    # the head is all tokens from a count on
    least = int(model.counts[:-1].min()) if len(model.tokens) else None
    rare = counts if least is None else counts.where(F.col("n") < least)
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = rare.groupBy(level.alias("level")).agg(F.count("*").alias("c"), F.sum(F.col("n") + 1).alias("m")).orderBy(F.desc("level")).collect()  # a thousand at most
    rows = scratch.cut(rare.orderBy(F.desc("n"), "token").withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    before, parts = 0, []
    for p, n in sorted(rows.groupBy(part.alias("part")).agg(F.count("*")).collect()):  # a row a task
        parts.append((p, before - (p << 33)))
        before += n
    moved = counts.sparkSession.createDataFrame(parts, "part long, move long")
    ranks = rows.join(F.broadcast(moved), part == F.col("part")).select("token", "n", (F.col("place") + F.col("move")).alias("rank"))
    return Tail([(r["c"], float(r["m"])) for r in levels]), ranks


_OCCURS = "array<struct<token: binary, before: bigint, skip: bigint, log: double>>"
SCORED = f"row long, doc_id long, n_tokens long, known long, base double, score double, rare {_OCCURS}"


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Tokens rarer than the head count as unseen. With them comes what they add to the score if they are not, but for their own tree."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    log_base, log_rest = np.log10(model.total + model.distinct + 1), np.log10(model.rest)
    count_log = np.log10(model.counts + 1)
    log_seen = np.log10(max(model.rest - 1, 1))  # of all others' mass; an unseen token has 1
    for b in rows_of(batches, "text"):
        if not len(b):
            continue
        rare, unknown, ids, before, skip, target, leaf, ends = _positions(b.column(1), model)
        logs, gain = np.empty(len(ids)), np.zeros(len(ids))
        for at in range(0, len(target), BATCH):
            i = slice(at, at + BATCH)
            f, other = features(before[i], skip[i]), np.flatnonzero(target[i] == 0)
            logs[i] = _forward(model, f, target[i])[0]
            gain[i][other] = _other(model, f.take(other, axis=1), leaf[i][other])[0]
        logs, gain = logs / np.log(10), gain / np.log(10) + log_seen
        own = np.where(ids >= 0, count_log[ids], 0.0)
        logs += np.where(target == 0, np.where(ids >= 0, gain, 0.0) - log_rest, 0.0)
        starts = np.concatenate([[0], ends[:-1]])
        sums = lambda x: pa.array(np.add.reduceat(x, starts))  # noqa: E731, B023
        occurs = pa.StructArray.from_arrays([rare, *(pa.array(x[unknown]) for x in (before, skip, gain))], ["token", "before", "skip", "log"])
        rows = (part << 40) + number + np.arange(len(b))
        number += len(b)
        yield pa.RecordBatch.from_arrays([
            pa.array(rows), b.column(0), pa.array(np.diff(np.concatenate([[0], ends]))), sums((ids >= 0).astype(np.int64)), sums(own - log_base), sums(logs),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(unknown, np.concatenate([[0], ends])), pa.int32()), occurs),
        ], ["row", "doc_id", "n_tokens", "known", "base", "score", "rare"])


def _score_rare(batches: Iterator[pa.RecordBatch], tail: Tail) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rank, before, skip, log = (b.column(k).to_numpy() for k in range(2, 6))
        for at in range(0, len(rank), BATCH):
            i = slice(at, at + BATCH)
            own = _rare(tail, features(before[i], skip[i]), rank[i])[0] / np.log(10) if tail.depth else 0.0
            yield pa.RecordBatch.from_arrays([b.column(0)[i], b.column(1)[i], pa.array(log[i] + own)], ["row", "n", "log"])


def score(docs: DataFrame, learn: Column, rounds: int = ROUNDS) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, n_known, train_tokens, base_score (smoothed unigram) and score (the model's), both log10.

    learn: a condition on doc_id, true for the documents that the counts and weights are learnt from. Every text ends with one
    end token, so null and empty texts have one token. Null doc_ids and repeated rows stay as rows. An empty table gives an
    empty table; without training rows all counts are zero. Only doc_id and text are read.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, counts = fit(docs, learn, scratch, rounds)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scored = scratch.cut(docs.mapInArrow(lambda it: _score(it, sent.value), SCORED), "zstd")
    tail, ranks = _ranked(counts, model, scratch)
    turn = F.when(learn, F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(max(rounds, 1)))).otherwise(-1).cast("int")
    rare = scored.select("row", turn.alias("turn"), F.explode("rare").alias("r")).select("row", "turn", "r.*")
    rare = scratch.cut(rare.join(ranks, "token").select("row", "n", "rank", "before", "skip", "log", "turn"), "zstd")
    for r in range(rounds if tail.depth else 0):
        mine = rare.where(F.col("turn") == r).select("rank", "before", "skip")
        _trained(mine, tail, lambda it, m: _train(it, m, _learn_rare), scratch)
    last = docs.sparkSession.sparkContext.broadcast(tail)
    found = rare.drop("turn").mapInArrow(lambda it: _score_rare(it, last.value), "row long, n long, log double")
    found = found.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("logs"), F.sum("log").alias("gain"))
    out, zero = scored.drop("rare").join(found, "row", "left"), F.lit(0.0)
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", zero)).alias("base_score"), (F.col("score") + F.coalesce("gain", zero)).alias("score"),
    )
