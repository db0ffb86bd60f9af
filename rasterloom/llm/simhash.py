"""SimHash near-dedup by covering locality-sensitive hashing.

A document's fingerprint takes the majority of each bit over the hashes of its 3-word shingles. Fingerprints that differ in at
most RADIUS bits are linked. Each bit position gets a nonzero vector of RADIUS + 1 bits; table t (1 to 2^(RADIUS+1) - 1) keeps
the bits whose vector has an odd product with t. Any RADIUS vectors have a common orthogonal t, so every pair within the radius
agrees on all bits that some table keeps: no pair is missed, whatever the data.

Equal fingerprints are one row from the start, so exact copies cost nothing further. A bucket with more than DENSE different
fingerprints is split again by covering tables over the bits that its table ignores, and again over those that the second one
ignores. Then at most 6 bits are free, so no bucket holds more than 64 fingerprints, however many near copies there are.
Links inside a bucket are reduced to a spanning forest; components join them across buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_counted, rows_of
from .components import components

RADIUS, BITS, SHINGLE, SEED = 2, 64, 3, 42
#: A bucket of more fingerprints than this is split further.
DENSE = 256
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if set in over half the shingles' XXH64; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    a, b = starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    h, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(a), CHUNK):
        own = np.fromiter((h(joined[x:y], SEED) for x, y in zip(a[at : at + CHUNK], b[at : at + CHUNK], strict=True)), "<u8")
        total += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(a), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches, "text"):
        fp = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "tag", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tag (xxhash64 of the text) and fp (the fingerprint as a signed long) of each row."""
    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tag"), "text")
    return own.mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, tag long, fp long")


def masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """The covering tables' masks over these bit positions: vectors are dealt in turn, so each table keeps about as many bits."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << b for i, b in enumerate(bits) if bin((i % n + 1) & t).count("1") % 2) for t in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tree(depth: int) -> dict[str, int]:
    """The kept bits of each path of tables up to that depth."""
    now = {"": 0}
    out: dict[str, int] = {}
    for _ in range(depth):
        now = {f"{p}{t}": kept | m for p, kept in now.items() for t, m in enumerate(masks([b for b in range(BITS) if not kept >> b & 1]))}
        out |= now
    return out


def _next(rows: DataFrame, depth: int) -> DataFrame:
    """Rows (fp, node, path) of the tables one level below each row's path, with key, the fingerprint's kept bits."""
    kept, n = _tree(depth), (1 << (RADIUS + 1)) - 1
    out = rows.select("fp", "node", F.explode(F.array(*(F.concat("path", F.lit(str(t))) for t in range(n)))).alias("path"))
    at = F.lit(0)
    for k in range(depth):  # the path, read as a number to the base of the number of tables
        at = at * n + F.substring("path", k + 1, 1).cast("int")
    values = F.array(*(F.lit(_signed(kept[p])) for p in sorted(p for p in kept if len(p) == depth)))
    return out.withColumn("key", F.col("fp").bitwiseAND(F.get(values, at)))


def _forest(fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints within the radius."""
    n = len(fp)
    fp = fp.view(np.uint64)
    i, j = np.triu_indices(n, 1)
    ok = np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS
    i, j = i[ok], j[ok]
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            a.append(node[x])
            b.append(node[y])
    return np.array(a, np.int64), np.array(b, np.int64)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c = [], []
        for fps, nodes in zip(b.column(0), b.column(1), strict=True):
            x, y = _forest(np.asarray(fps.values), np.asarray(nodes.values))
            a.append(x)
            c.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (a, c)], ["a", "b"])


def _linked(members: DataFrame) -> DataFrame:
    """Links (a, b) in buckets of bounded size."""
    lists = members.groupBy("path", "key").agg(F.collect_list("fp").alias("fps"), F.collect_list("node").alias("nodes"))
    return lists.select("fps", "nodes").mapInArrow(_links, "a long, b long")


def links(distinct: DataFrame, scratch: Scratch, dense: int = DENSE, depth: int = 3) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints (distinct: fp, node) are within the radius: all that connect components."""
    out, rows = None, distinct.withColumn("path", F.lit(""))
    for level in range(1, depth + 1):
        dealt = scratch.cut(_next(rows, level))
        sizes = dealt.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        sizes = scratch.cut(sizes)
        last = level == depth
        small = sizes if last else sizes.where(F.col("n") <= dense)
        found = _linked(dealt.join(small.select("path", "key"), ["path", "key"]))
        out = found if out is None else out.unionByName(found)
        big = sizes.where(F.col("n") > dense).select("path", "key")
        if last or big.isEmpty():
            break
        rows = dealt.join(big, ["path", "key"]).select("fp", "node", "path")
    return out


def _grouped(docs: DataFrame, shingle: int, dense: int) -> DataFrame:
    """doc_id, tag (xxhash64 of the text), fp, root (a fingerprint that stands for its component) and component_id of each row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.cut(fingerprints(docs, shingle))
    distinct = scratch.cut(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = scratch.cut(links(distinct.select("fp", F.col("fp").alias("node")), scratch, dense).distinct())
    rooted = distinct.join(components(edges, scratch), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.cut(rooted)
    named = scratch.cut(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("c")))
    named = scratch.cut(join_counted(rooted, named, ["root"]).select("fp", "root", "component_id"))
    # written above, so both sides of this join have an exchange and a hot fingerprint's rows can be split
    joined = fps.join(named, "fp", "left")
    known = F.col("doc_id").isNotNull()
    return joined.select("doc_id", "tag", "fp", F.when(known, F.col("root")).alias("root"), F.when(known, F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, dense: int = DENSE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links, itself included) of each row of docs.

    Null and empty texts have fingerprint zero and are linked like any other; a text of fewer words than a shingle is one
    shingle; texts of any length are read whole. Rows with a null doc_id link nothing and get a null component_id. Repeated rows
    each get theirs; rows that share a doc_id but not a text are linked each by its own text. An empty table gives an empty
    table. Only doc_id and text are read, so further columns may have any name.
    """
    return _grouped(docs, shingle, dense).select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, dense: int = DENSE) -> DataFrame:
    """docs with one document of each component, in the columns of docs, whatever their names: that with the smallest doc_id, and
    under one id that with the smallest hash of its text.

    A row is known by its doc_id and text: of rows that share an id each goes by its own text, and equal rows stay or go
    together. Rows with a null doc_id stay. All else is as near_duplicates() says.
    """
    scratch = Scratch(docs.sparkSession, "simhash-dedup")
    rows = scratch.cut(_grouped(docs, shingle, dense).where("doc_id is not null").select("doc_id", "tag", "root"))
    keepers = scratch.cut(rows.groupBy("root").agg(F.min(F.struct("doc_id", "tag")).alias("keeper"), F.count("*").alias("c")))
    gone = join_counted(rows, keepers, ["root"]).where("doc_id <> keeper.doc_id or tag <> keeper.tag")
    gone = scratch.cut(gone.select(F.col("doc_id").alias("__gone"), F.col("tag").alias("__tag")).distinct())
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["__gone"]) & (F.xxhash64(docs["text"]) == gone["__tag"]), "left_anti")
