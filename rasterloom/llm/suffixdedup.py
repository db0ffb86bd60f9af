"""Suffix-array dedup: removes each byte covered by a long string that also starts elsewhere, over all documents.

1. Anchors. Each window of MIN_BYTES bytes picks, of the GRAM-byte strings in it, that with the least hash. Neighbouring windows
   that pick the same place form a region; each window lies in exactly one region. Equal windows pick equal anchors, so only
   windows of regions with the same anchor can be equal.
2. Anchors seen once go. Regions that are equal as a whole (two 64-bit hashes) are removed, and one of them stays as a
   representative, so copies, however many, cost no comparison.
3. Different regions of an anchor are compared in blocks of bounded size. A block's text gets a suffix array and its
   Burrows-Wheeler transform, on which intervals are expanded breadth-first: backward extension by a character derives the
   interval of each longer string, whose right bound then has a common prefix as long as the step's number. Values come in
   increasing order, and the expansion stops at MIN_BYTES: bounds without a value join suffixes that share MIN_BYTES or more.
4. An anchor with more than DENSE different regions would make a block of unbounded size. Its regions are cut at fixed distances
   from the anchor into narrower ones, whose key is the hash of the bytes that all their windows have in common. Equal windows
   are in narrow regions of one key again, so steps 2 to 4 go on with these. At a width of one window all regions of a key are
   copies, so the cutting ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_counted, rows_of, slices

MIN_BYTES, GRAM = 400, 128
#: Different regions of an anchor that are compared in one block at most; a block's bytes; windows that are hashed at once.
DENSE, BLOCK_BYTES, CHUNK = 800, 600_000, 1 << 18
#: Windows in the narrower regions of a dense anchor, level by level.
WIDTHS = (64, 16, 4, 1)
#: Bytes of regions that are cut into one Arrow batch.
CUT_BYTES = 1_000_000
_PLACE = 19
_SEED = np.random.default_rng(3)
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 14) - 1, b, np.uint64)]))
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram-byte string: a rolling polynomial modulo 2^64, mixed."""
    p, inverse = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p, out=total[1:])
    h = (total[gram:] - total[:-gram]) * inverse[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def regions(data: bytes, size: int = MIN_BYTES, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each region: its first window's start, its number of windows, its anchor's hash, its anchor's place."""
    out = []
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(data) - size + 1, CHUNK):
        own = whole[at : at + CHUNK + size - 1]
        h = gram_hashes(own, gram)
        # the hash's upper bits and the place: the least one is the leftmost of the least hashes
        low = np.uint64((1 << _PLACE) - 1)
        m, width, left = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, size - gram + 1
        while 2 * width <= left:
            m, width = np.minimum(m[:-width], m[width:]), 2 * width
        if width < left:
            m = np.minimum(m[: len(m) - (left - width)], m[left - width :])
        place = (m & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        out.append((first + at, np.diff(np.concatenate([first, [len(place)]])), h[place[first]], place[first] + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


REGIONS = "doc long, tag int, start long, n long, place long, key long, h1 long, h2 long"


def _anchors(batches: Iterator[pa.RecordBatch], size: int, gram: int) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches, "text"):
        cols: list[list] = [[] for _ in range(8)]
        for doc, text, tag in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            data = _bytes(text)
            if len(data) < size:
                continue
            start, n, key, place = regions(data, size, gram)
            digest = b"".join(xxhash.xxh3_128_digest(data[s : s + k + size - 1]) for s, k in zip(start.tolist(), n.tolist(), strict=True))
            h = np.frombuffer(digest, "<i8").reshape(-1, 2)
            for c, x in zip(cols, ([doc] * len(start), [tag] * len(start), start, n, place, key.view(np.int64) if len(key) else key, h[:, 0], h[:, 1]), strict=True):
                c.append(x if isinstance(x, np.ndarray) else pa.array(x, pa.int64()))
        if cols[0]:
            flat = [pa.concat_arrays(c) if isinstance(c[0], pa.Array) else pa.array(np.concatenate(c)) for c in cols]
            yield pa.RecordBatch.from_arrays([flat[0], flat[1].cast(pa.int32()), *flat[2:]], ["doc", "tag", "start", "n", "place", "key", "h1", "h2"])


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - first, counts)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling from seven characters (below 512) on; the last character is the least and unique."""
    n, have = len(text), 7
    key = np.zeros(n, np.int64)
    for k in range(have):
        key <<= 9
        key[: n - k] |= text[k:]
    while True:
        order = np.argsort(key)
        ranked = key[order]
        fresh = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if fresh[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        key = rank * (n + 1)
        key[: n - have] += rank[have:] + 1
        have *= 2


def long_bounds(text: np.ndarray, order: np.ndarray, limit: int, barred: int) -> np.ndarray:
    """Rows p of the suffix array whose suffix shares limit characters or more with that of row p - 1.

    Breadth-first over intervals of the transform; characters below barred are the first of no string but of themselves alone.
    """
    n = len(text)
    bwt = text[order - 1]
    by_char = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)
    step[by_char] = np.arange(n)
    same = bwt[by_char[1:]] == bwt[by_char[:-1]]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[by_char[1:][same]] = by_char[:-1][same]
    after[by_char[:-1][same]] = by_char[1:][same]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    left, right = np.array([0]), np.array([n])
    for length in range(limit):
        size = right - left
        rows, own = _ranges(left, size), np.repeat(np.arange(len(left)), size)
        if length:
            free = bwt[rows] >= barred
            rows, own = rows[free], own[free]
        first, last = before[rows] < left[own], after[rows] >= right[own]
        # the first and the last row of each interval and character, in the same order
        lo = rows[first][np.argsort(own[first] * 512 + bwt[rows[first]], kind="stable")]
        hi = rows[last][np.argsort(own[last] * 512 + bwt[rows[last]], kind="stable")]
        left, right = step[lo], step[hi] + 1
        new = ~known[right]
        left, right = left[new], right[new]
        known[right] = True
        if not len(left):
            break
    return np.flatnonzero(~known)


def repeated_starts(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text, the starts of its size-byte strings that also start elsewhere in the texts."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    text = np.ones(int(lengths.sum()) + 1, np.int16)  # 1 ends each text, 0 the block
    ends = np.cumsum(lengths)
    text[-1] = 0
    flat = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8).astype(np.int16) + 2
    text[:-1] = flat
    text[ends - 1] = 1
    order = suffix_array(text)
    p = long_bounds(text, order, size, 2)
    rows = np.unique(np.concatenate([p - 1, p]))
    at = np.sort(order[rows])
    own = np.searchsorted(ends, at, "right")
    ok = own < len(texts)
    at, own = at[ok], own[ok]
    ok = at + size <= ends[own] - 1
    at, own = at[ok] - (ends - lengths)[own[ok]], own[ok]
    return np.split(at, np.searchsorted(own, np.arange(1, len(texts))))


SPANS = "doc long, tag int, start long, stop long"


def _spans(docs: list, tags: list, bases: list, starts: list[np.ndarray], size: int) -> pa.Table:
    """Runs of consecutive starts as spans of bytes."""
    out: list[tuple] = []
    for doc, tag, base, s in zip(docs, tags, bases, starts, strict=True):
        for run in np.split(s, np.flatnonzero(np.diff(s) > 1) + 1) if len(s) else ():
            out.append((doc, tag, base + int(run[0]), base + int(run[-1]) + size))
    cols = list(zip(*out, strict=True)) or [()] * 4
    return pa.table({k: pa.array(c, t) for k, c, t in zip(("doc", "tag", "start", "stop"), cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)})


def _compare(table: pa.Table, size: int) -> pa.Table:
    texts = [bytes(x) for x in table.column("data").to_pylist()]
    return _spans(*(table.column(c).to_pylist() for c in ("doc", "tag", "start")), repeated_starts(texts, size), size)


PIECES = "key long, doc long, tag int, start long, n long, place long, many boolean, data binary"
_PIECES = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("tag", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("place", pa.int64()), ("many", pa.bool_()), ("data", pa.binary())])


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted regions of each text."""
    for b in rows_of(batches, "text"):
        rows = []
        for text, doc, tag, wanted in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            data = _bytes(text)
            rows += [(w["key"], doc, tag, w["start"], w["n"], w["place"], w["many"], data[w["start"] : w["start"] + w["n"] + size - 1]) for w in wanted]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PIECES)], schema=_PIECES)


NARROW = "key long, doc long, tag int, start long, n long, place long, data binary, h1 long, h2 long"
_NARROW = pa.schema([*(f for f in _PIECES if f.name != "many"), ("h1", pa.int64()), ("h2", pa.int64())])


def _narrow(batches: Iterator[pa.RecordBatch], size: int, width: int) -> Iterator[pa.RecordBatch]:
    """Regions cut where a window's distance to the anchor is a multiple of width. The key is the hash of the old key, the distance
    and the bytes that all windows of such a cut have in common."""
    for whole in batches:
        for b in slices(whole, "data", CUT_BYTES):
            rows = []
            for key, doc, tag, start, n, place, data in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                at = start
                while at < start + n:
                    step = (place - at) // width
                    last = place - step * width  # the cut's windows start width places up to here, fewer at a region's ends
                    stop = min(start + n, last + 1)
                    own = data[at - start : stop - 1 - start + size]
                    core = own[last - at : max(last - at, last - width + 1 + size - at)]
                    rows.append((key, step, doc, tag, at, stop - at, place, own, core))
                    at = stop
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r[7]) for r in rows), "<i8").reshape(-1, 2)
            keys = [xxhash.xxh64_intdigest(r[8], (r[0] * 31 + r[1]) & 0xFFFFFFFFFFFFFFFF) for r in rows]
            cols = [pa.array(np.array(keys, np.uint64).view(np.int64)), *(pa.array([r[k] for r in rows], f.type) for k, f in zip(range(2, 8), list(_NARROW)[1:7], strict=True))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(digest[:, 0]), pa.array(digest[:, 1])], schema=_NARROW)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches, "text"):
        rows = []
        for doc, text, spans in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            data, merged = _bytes(text), []
            for s in sorted((x["start"], x["stop"]) for x in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            at = [0, *(x for s in merged for x in s), len(data)]
            kept = b"".join(data[i:j] for i, j in zip(at[::2], at[1::2], strict=True))
            rows.append((doc, len(data), len(data) - len(kept), [s[0] for s in merged], [s[1] for s in merged], kept))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "starts", "stops", "kept"])


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _level(rows: DataFrame, scratch: Scratch, size: int, dense: int) -> tuple[DataFrame, DataFrame]:
    """Of regions (REGIONS): the spans of those that are equal as a whole, and one of each kind of the keys with several (many: over dense)."""
    kinds = scratch.cut(rows.groupBy("key", "h1", "h2", "n").agg(F.count("*").alias("c"), F.min(F.struct("doc", "tag", "start", "place")).alias("r")), "zstd")
    copies = join_counted(rows, kinds.where("c > 1").select("key", "h1", "h2", "n", "c"), ["key", "h1", "h2", "n"])
    whole = copies.select("doc", "tag", "start", (F.col("start") + F.col("n") + (size - 1)).alias("stop"))
    several = scratch.cut(kinds.groupBy("key").agg(F.count("*").alias("d")).where("d > 1"))
    wanted = join_counted(kinds, several, ["key"], "d").select("key", (F.col("d") > dense).alias("many"), "r.doc", "r.tag", "r.start", "r.place", "n")
    return whole, scratch.cut(wanted, "zstd")


def _compared(pieces: DataFrame, size: int, block_bytes: int) -> DataFrame:
    """Spans that repeat in pieces of one key."""
    total = pieces.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).select("block", "doc", "tag", "start", "data")
    return dealt.groupBy("block").applyInArrow(lambda t: _compare(t, size), SPANS)


def repeated_spans(texts: DataFrame, scratch: Scratch, size: int = MIN_BYTES, gram: int = GRAM, dense: int = DENSE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Spans (doc, tag, start, stop; they may overlap) that repeat, of texts (doc, text, tag)."""
    all_regions = scratch.cut(texts.select("doc", "text", "tag").mapInArrow(lambda it: _anchors(it, size, gram), REGIONS), "zstd")
    keys = scratch.cut(all_regions.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    own = scratch.cut(join_counted(all_regions, keys, ["key"]).drop("c"), "zstd")
    scratch.drop(all_regions, keys)
    out, wanted = _level(own, scratch, size, dense)
    lists = wanted.groupBy(F.col("doc").alias("d"), F.col("tag").alias("t")).agg(F.collect_list(F.struct("key", "many", "start", "n", "place")).alias("wanted"))
    # rows that are equal in doc and text hold the same regions: any one of them will do, and two would count its windows twice
    found = texts.join(lists, _same(texts["doc"], lists["d"]) & (texts["tag"] == lists["t"])).select("text", "doc", "tag", "wanted")
    pieces = found.mapInArrow(lambda it: _pieces(it, size), PIECES)
    pieces = scratch.cut(pieces.dropDuplicates(["key", "doc", "tag", "start"]), "zstd")
    for width in (*WIDTHS, 0):
        out = out.unionByName(_compared(pieces.where("not many"), size, block_bytes))
        rest = pieces.where("many").drop("many")
        if not width or rest.isEmpty():
            return out
        rows = scratch.cut(rest.mapInArrow(lambda it, w=width: _narrow(it, size, w), NARROW), "zstd")
        whole, wanted = _level(rows.drop("data"), scratch, size, dense)
        out = out.unionByName(whole)
        pieces = scratch.cut(rows.drop("h1", "h2").join(wanted.select("key", "doc", "tag", "start", "many"), ["key", "doc", "tag", "start"]), "zstd")
    return out


def suffix_dedup(docs: DataFrame, size: int = MIN_BYTES, gram: int = GRAM, dense: int = DENSE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, starts and stops of the removed runs, kept (the remaining bytes, as binary).

    A byte goes if a size-byte string that covers it also starts anywhere else in the texts, as they came in. Null text is
    empty. Repeated rows are texts of their own, so long ones lose all they share; null doc_ids stay as rows. An empty table
    gives an empty table. Only doc_id and text are read.
    """
    scratch = Scratch(docs.sparkSession, "suffixdedup")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text", F.hash("text").alias("tag"))
    spans = repeated_spans(texts, scratch, size, gram, dense, block_bytes)
    lists = spans.groupBy(F.col("doc").alias("d"), F.col("tag").alias("t")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = texts.join(lists, _same(texts["doc"], lists["d"]) & (texts["tag"] == lists["t"]), "left").select("doc", "text", "spans")
    return joined.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, starts array<long>, stops array<long>, kept binary")
