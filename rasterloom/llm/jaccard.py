"""Near copies for the pipeline: SimHash links, and all pairs of a word-shingle similarity of 0.8 or more.

A text is the set of its 5-word shingles. Texts of one set are one node; so are, by links, texts whose fingerprints SimHash links.
Further candidates share one of BANDS MinHash buckets, each the hash of PER_BAND minima; a pair with similarity 0.8 shares none
with probability (1 - 0.8^5)^25, about 1 in 20,000. Candidates are confirmed by the exact similarity of the two sets.

Pairs that are in one component already aren't compared. First every text is compared with one other, the smallest of all that it
shares a bucket with, so a large group of near copies costs about as many comparisons as it has members. Of the buckets that then
still hold several components, those with up to DENSE texts compare their pairs. The texts of larger ones (they share a passage,
say, but less than 0.8) are joined by prefix filtering, which is exact: of two similar sets, in one order of all shingles with rare
ones first, the smaller one's first n - ceil(2 * 0.8 / 1.8 * n) + 1 and the larger one's first n - ceil(0.8 * n) + 1 have a shingle
in common. What many texts share comes last in that order, so a common passage makes no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_counted, rows_of
from .components import components
from .simhash import fingerprint, links

SHINGLE, SIMILARITY, BANDS, PER_BAND, SEED = 5, 0.8, 25, 5, 42
#: Shingles whose minima are taken at once; texts of a bucket whose pairs are compared one by one.
CHUNK, DENSE = 2048, 24
#: Shingles that are broadcast at most: the most frequent ones.
HOT = 2000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * PER_BAND + 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MINIMA, _MIX = _ODD[: BANDS * PER_BAND, None], _ODD[BANDS * PER_BAND :]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different shingles' 64-bit hashes, sorted; a text with fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total += _mixed(h[j : j + n] + _MIX[j]) * _MIX[32 + j]
    return np.unique(_mixed(total))


def buckets(own: np.ndarray) -> np.ndarray:
    """The BANDS bucket hashes of a set that isn't empty."""
    least = np.full(BANDS * PER_BAND, ~np.uint64(0))
    for at in range(0, len(own), CHUNK):
        np.minimum(least, (own[at : at + CHUNK] * _MINIMA).min(1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(PER_BAND):
        out = _mixed(out * np.uint64(31) + least[j::PER_BAND])
    return out


SIGNED = "doc_id long, tag long, fp long, key binary, n long, buckets array<long>"


def _signatures(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches, "text"):
        fps, keys, sizes, found = [], [], [], []
        for t in b.column(2).to_pylist():
            own = shingles(t, shingle)
            fps.append(fingerprint(t))
            keys.append(xxhash.xxh3_128_digest(own.tobytes()))
            sizes.append(len(own))
            found.append(buckets(own).view(np.int64).tolist() if len(own) else [])
        cols = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "tag", "fp", "key", "n", "buckets"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches, "text"):
        own = [shingles(t, shingle).view(np.int64) for t in b.column(2).to_pylist()]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate(own) if own else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["node", "comp", "tokens"])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _confirmed(batches: Iterator[pa.RecordBatch], shingle: int, least: float) -> Iterator[pa.RecordBatch]:
    sets = lru_cache(8)(lambda t: shingles(t, shingle))
    for b in batches:
        a, c, s, t = (b.column(i) for i in range(4))
        ok = pa.array([similarity(sets(x.as_py()), sets(y.as_py())) >= least for x, y in zip(s, t, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([a, c], ["a", "b"]).filter(ok)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different tokens of a batch with their number."""
    for b in batches:
        token, c = np.unique(np.asarray(b.column(0).flatten()), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(c, pa.int64())], ["token", "c"])


class _Joining:
    """The component of each set (known: node, n, comp), joined further by confirmed pairs."""

    def __init__(self, texts: DataFrame, sets: DataFrame, edges: DataFrame, scratch: Scratch, shingle: int, least: float):
        self.texts, self.scratch, self.shingle, self.least = texts, scratch, shingle, least
        self.sets = sets.select("node", F.col("doc_id").alias("__d"), F.col("tag").alias("__t"))
        self.known = sets.select("node", "n", F.col("node").alias("comp"))
        self.known = self.joined(edges, self.known)[0]

    def joined(self, edges: DataFrame, *rows: DataFrame) -> list[DataFrame]:
        """rows with their comp replaced by the smallest one that edges (a, b) between comps lead to."""
        roots = self.scratch.cut(components(edges, self.scratch).select(F.col("node").alias("comp"), "root"))
        named = lambda r: [F.coalesce("root", "comp").alias("comp") if c == "comp" else F.col(c) for c in r.columns]
        return [self.scratch.cut(r.join(roots, "comp", "left").select(*named(r)), "zstd") for r in rows]

    def texts_of(self, nodes: DataFrame) -> DataFrame:
        """nodes (node and more) with the text of each."""
        wanted = self.scratch.cut(nodes.join(self.sets, "node"))
        own = self.texts.join(wanted, (F.col("doc_id") == F.col("__d")) & (F.col("tag") == F.col("__t")))
        return own.select(*nodes.columns, "text").dropDuplicates(["node"])

    def confirm(self, pairs: DataFrame, *rows: DataFrame) -> list[DataFrame]:
        """rows, after the components cx and cy of the pairs (x, y, cx, cy) that are near copies have been joined."""
        pairs = self.scratch.cut(pairs.distinct())
        ends = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
        own = self.scratch.cut(self.texts_of(ends), "zstd")
        both = pairs
        for key, text in (("x", "s"), ("y", "t")):
            both = both.join(own.select(F.col("node").alias(key), F.col("text").alias(text)), key)
        shingle, least = self.shingle, self.least
        found = both.select(F.col("cx").alias("a"), F.col("cy").alias("b"), "s", "t").mapInArrow(lambda it: _confirmed(it, shingle, least), "a long, b long")
        edges = self.scratch.cut(found.distinct())
        self.known, *rows = self.joined(edges, self.known, *rows)
        self.scratch.drop(pairs, own)
        return rows

    def near(self, a: str, b: str) -> str:
        return f"least({a}, {b}) >= {self.least} * greatest({a}, {b}) - 1e-6"  # sets of such sizes can be that similar

    def mixed(self, rows: DataFrame, by: str) -> DataFrame:
        """The groups with several components: their smallest set as hub, and their rows' number."""
        hub = F.min(F.struct("n", "node", "comp")).alias("hub")
        return self.scratch.cut(rows.groupBy(by).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), hub).where("lo <> hi").select(by, "hub", "c"))

    def by_hubs(self, rows: DataFrame, by: str) -> DataFrame:
        """Compares each set of rows (node, n, comp, by and more) with the smallest hub of its groups; the rows of groups that keep several
        components, with c, how many there are."""
        now = self.scratch.cut(join_counted(rows, self.mixed(rows, by), [by]).drop("c"), "zstd")
        near = now.where(f"comp <> hub.comp and {self.near('n', 'hub.n')}")
        one = near.groupBy("node", "comp").agg(F.min("hub").alias("hub"))
        (later,) = self.confirm(one.select(F.col("hub.node").alias("x"), F.col("node").alias("y"), F.col("hub.comp").alias("cx"), F.col("comp").alias("cy")), now.drop("hub"))
        self.scratch.drop(now)
        out = self.scratch.cut(join_counted(later, self.mixed(later, by).select(by, "c"), [by]), "zstd")
        self.scratch.drop(later)
        return out

    def by_pairs(self, rows: DataFrame, by: str) -> None:
        """Compares the pairs of each small group."""
        x, y = (rows.select(by, *(F.col(c).alias(f"{p}{c}") for c in ("node", "n", "comp"))) for p in "xy")
        pairs = x.join(y, by).where(f"xnode < ynode and xcomp <> ycomp and {self.near('xn', 'yn')}")
        self.confirm(pairs.select(F.col("xnode").alias("x"), F.col("ynode").alias("y"), F.col("xcomp").alias("cx"), F.col("ycomp").alias("cy")))

    def by_prefixes(self, nodes: DataFrame) -> None:
        """Compares all of nodes (node, comp) that can be near copies."""
        kind = self.texts_of(nodes)
        shingle, t = self.shingle, self.least
        tokens = self.scratch.cut(kind.select("node", "comp", "text").mapInArrow(lambda it: _sets(it, shingle), "node long, comp long, tokens array<long>"), "zstd")
        counted = tokens.select("tokens").mapInArrow(_tally, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
        counted = self.scratch.cut(counted.where(F.col("c") > DENSE), "zstd")
        # the order of shingles: those of up to DENSE texts as they stand, then frequent ones by their number; the HOT most frequent ones are
        # one array, so no row is made of them, and all others, if there are more, meet their texts in a join
        top = counted.orderBy(F.desc("c"), "token").limit(HOT).collect()
        hot = F.lit([r["token"] for r in sorted(top, key=lambda r: (r["c"], r["token"]))]).cast("array<bigint>")
        own, none = tokens.withColumn("n", F.size("tokens").cast("long")), F.array().cast("array<bigint>")
        if len(top) < HOT:
            own = own.withColumn("cold", none)
        else:
            others = counted.where(~F.array_contains(hot, F.col("token")))
            cold = tokens.select("node", F.explode(F.array_except("tokens", hot)).alias("token")).join(others, "token")
            cold = cold.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "token"))), lambda x: x["token"]).alias("cold"))
            own = own.join(cold, "node", "left").withColumn("cold", F.coalesce("cold", none))
        order = F.concat(F.array_except(F.array_except("tokens", hot), "cold"), "cold", F.array_intersect(hot, "tokens"))
        prefix = F.slice(order, F.lit(1), F.expr(f"cast(n - ceil({t} * n - 1e-6) + 1 as int)"))
        placed = self.scratch.cut(own.select("node", "comp", "n", F.posexplode(prefix).alias("at", "token")), "zstd")
        self.scratch.drop(tokens, counted)
        placed = self.by_hubs(placed, "token")
        x, y = (placed.select("token", *(F.col(c).alias(f"{p}{c}") for c in ("node", "n", "comp", "at"))) for p in "xy")
        x = x.where(f"xat < xn - ceil({2 * t / (1 + t)} * xn - 1e-6) + 1")
        overlap = f"least(xn - xat, yn - yat) >= {t / (1 + t)} * (xn + yn) - 1e-6"  # even if all from here on agrees
        pairs = x.join(y, "token").where(f"(xn < yn or xn = yn and xnode < ynode) and xcomp <> ycomp and {self.near('xn', 'yn')} and {overlap}")
        self.confirm(pairs.select(F.col("xnode").alias("x"), F.col("ynode").alias("y"), F.col("xcomp").alias("cx"), F.col("ycomp").alias("cy")))


def near_groups(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, tag, root) of each row of docs with a doc_id; rows of one root are near copies, by links. tag: xxhash64 of the text."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tag"), "text")
    signed = texts.mapInArrow(lambda it: _signatures(it, shingle), SIGNED).withColumn("row", F.monotonically_increasing_id())
    signed = scratch.cut(signed, "zstd")  # written, so a row keeps its number
    keyed = scratch.cut(signed.groupBy("key").agg(F.min("row").alias("node"), F.count("*").alias("c")))
    sets = signed.select(F.col("row").alias("node"), "doc_id", "tag", "n", "buckets").join(keyed.select("node"), "node", "left_semi")
    sets = scratch.cut(sets, "zstd")
    named = scratch.cut(join_counted(signed.select("doc_id", "tag", "fp", "key"), keyed, ["key"]).select("doc_id", "tag", "fp", "node"), "zstd")
    pairs = scratch.cut(named.select("fp", "node").distinct())
    hubs = scratch.cut(pairs.groupBy("fp").agg(F.min("node").alias("hub"), F.count("*").alias("c")))
    equal = join_counted(pairs, hubs, ["fp"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    edges = links(hubs.select("fp", F.col("hub").alias("node")), scratch).unionByName(equal)
    joining = _Joining(texts, sets, scratch.cut(edges.distinct()), scratch, shingle, least)
    scratch.drop(signed, pairs)
    members = joining.known.join(sets.select("node", "buckets"), "node").select("node", "n", "comp", F.explode("buckets").alias("bucket"))
    rest = joining.by_hubs(scratch.cut(members, "zstd"), "bucket")
    large = scratch.cut(rest.where(F.col("c") > DENSE).select("node").distinct())
    joining.by_pairs(rest.where(F.col("c") <= DENSE), "bucket")
    joining.by_prefixes(scratch.cut(large.join(joining.known.select("node", "comp"), "node")))
    roots = scratch.cut(keyed.select("node", "c").join(joining.known.select("node", F.col("comp").alias("root")), "node"))
    return scratch.cut(join_counted(named.select("doc_id", "tag", "node"), roots, ["node"]).select("doc_id", "tag", "root"), "zstd")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group of near copies, in the columns of docs, whatever their names: that with the smallest
    doc_id, and under one id that with the smallest hash of its text.

    A row is known by its doc_id and text: rows that share an id are judged each by its own text, equal rows stay or go together.
    Rows with a null doc_id stay and link nothing. Null and empty texts, and texts without words, are copies of each other; a text
    of fewer than 5 words is one shingle; texts of any length are read whole. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    groups = near_groups(docs, scratch, shingle, least)
    keepers = scratch.cut(groups.groupBy("root").agg(F.min(F.struct("doc_id", "tag")).alias("keeper"), F.count("*").alias("c")))
    gone = join_counted(groups, keepers, ["root"]).where("doc_id <> keeper.doc_id or tag <> keeper.tag")
    gone = scratch.cut(gone.select(F.col("doc_id").alias("__gone"), F.col("tag").alias("__tag")).distinct())
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["__gone"]) & (F.xxhash64(docs["text"]) == gone["__tag"]), "left_anti")
