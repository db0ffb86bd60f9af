"""Benchmark decontamination with a distributed positional inverted index.

Training text becomes index segments of bounded size: for each term of the segment the sorted positions of its occurrences (its
posting list), beside the segment's documents and where each starts. A segment never depends on another one, so building and
searching shuffle nothing, and no term, however frequent, is gathered from the whole corpus. The segments are a table in the
shared folder; they know nothing of the test items, so one index serves any number of searches.

A search takes the windows (phrases) of the test items in blocks of bounded size. In a segment, it drops phrases with a term
that has no posting, starts from the postings of each phrase's rarest term, moved back by the term's offset, and intersects
them with the offset-adjusted postings of the next rarest terms, until all terms are checked (exact matches). With slop, it
also reports proximity matches: a window inside the document, each of whose words stands in the document within slop positions
of its place. Exact matches are proximity matches, too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, rows_of

#: Words in a phrase; occurrences of test words in a block of phrases (bounds what is broadcast); positions in a segment.
WINDOW, BLOCK_WORDS, SEGMENT = 13, 2_000_000, 400_000
#: Candidates that are intersected at once.
CANDIDATES = 1 << 20
#: A word is a run of bytes but [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]; A-Z are lower-cased first.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

INDEX = "seg string, rows long, doc_ids array<long>, tags array<long>, doc_at array<int>, terms binary, ends binary, positions binary"
_INDEX = pa.schema([
    ("seg", pa.string()), ("rows", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("tags", pa.list_(pa.int64())), ("doc_at", pa.list_(pa.int32())), ("terms", pa.binary()), ("ends", pa.binary()),
    ("positions", pa.binary()),
])
MATCHES = "seg string, ord long, doc_id long, tag long, n_words long, starts array<int>, stops array<int>, item_ids array<long>, near_ids array<long>"
_MATCHES = pa.schema([
    ("seg", pa.string()), ("ord", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32())),
    ("item_ids", pa.list_(pa.int64())), ("near_ids", pa.list_(pa.int64())),
])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


def _segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get()
    name, k = task.partitionId() if task else 0, 0
    terms, docs, tags, parts, n = _Numbers(), [], [], [], 0

    def segment() -> pa.RecordBatch:
        tokens = np.concatenate(parts) if parts else np.empty(0, np.int32)
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        row = {
            "seg": [f"{name}-{k}"], "rows": [len(docs)], "doc_ids": [docs], "tags": [tags], "doc_at": [at.astype(np.int32)], "terms": [b" ".join(terms)],
            "ends": [np.cumsum(np.bincount(tokens, minlength=len(terms))).astype("<i4").tobytes()], "positions": [np.argsort(tokens, kind="stable").astype("<i4").tobytes()],
        }
        return pa.RecordBatch.from_pydict(row, schema=_INDEX)

    for b in rows_of(batches, "text"):
        for doc, tag, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            w = words(text)
            docs.append(doc)
            tags.append(tag)
            parts.append(np.fromiter(map(terms.__getitem__, w), np.int32, len(w)))
            n += len(w)
            if n >= size:
                yield segment()
                terms, docs, tags, parts, n, k = _Numbers(), [], [], [], 0, k + 1
    if docs:
        yield segment()


def build_index(docs: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Segments (schema INDEX) of the postings of all words in docs (doc_id, text). Write them before a search reads them twice:
    a document is known by its segment and its place there. A segment closes with the document that fills it."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tag"), "text").mapInArrow(lambda it: _segments(it, size), INDEX)


class Phrases:
    """Different windows of some items: terms (padded with -1), lengths, and for each window its items."""

    def __init__(self, width: int):
        self.vocabulary, self.found, self.width, self.words = _Numbers(), {}, width, 0

    def add(self, window: list[bytes], item: int) -> None:
        key = tuple(map(self.vocabulary.__getitem__, window))
        if key not in self.found:
            self.found[key] = {item}
            self.words += len(key)
        else:
            self.found[key].add(item)

    def close(self) -> Phrases:
        found, self.vocabulary = self.found, dict(self.vocabulary)
        self.lengths = np.array([len(p) for p in found], np.int32)
        self.terms = np.full((len(found), self.width), -1, np.int32)
        for k, p in enumerate(found):
            self.terms[k, : len(p)] = p
        self.item_at = np.concatenate([[0], np.cumsum([len(x) for x in found.values()])]).astype(np.int64)
        self.items = np.array([y for x in found.values() for y in sorted(x)], np.int64)
        self.found = {}
        return self


def phrase_blocks(items: Iterable[tuple[int, str | None]], window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """The items' windows in blocks of at most about block_words words; a long item is cut between windows. At least one block."""
    block, none = Phrases(window), True
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            block.add(w[i : i + window], item)
            if block.words >= block_words:
                yield block.close()
                block, none = Phrases(window), False
    if none or block.words:
        yield block.close()


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... counts[i] of them, for each i."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - first, counts)


class _Postings:
    """A segment's posting lists of the phrases' terms; term numbers are those of the phrases."""

    def __init__(self, row: dict, phrases: Phrases):
        get = phrases.vocabulary.get
        numbers = np.array([get(w, -1) for w in row["terms"].split(b" ")] if row["terms"] else [], np.int64)
        ends, self.positions = np.frombuffer(row["ends"], "<i4").astype(np.int64), np.frombuffer(row["positions"], "<i4").astype(np.int64)
        counts = np.diff(ends, prepend=0)
        n = len(phrases.vocabulary) + 1  # the last one stands for padding
        self.first, self.counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        own = np.flatnonzero(numbers >= 0)
        self.first[numbers[own]], self.counts[numbers[own]] = (ends - counts)[own], counts[own]
        # all lists one after the other, each position beside its term's rank in the segment: sorted, so a search finds any pair
        self.rank = np.full(n, -1, np.int64)
        self.rank[numbers[own]] = np.arange(len(own))
        self.pairs = (np.repeat(np.arange(len(own)), counts[own]) << 32) | self.positions[_ranges((ends - counts)[own], counts[own])]

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether the term's list holds the position."""
        wanted = (self.rank[terms] << 32) | np.maximum(positions, 0)
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return (positions >= 0) & (self.pairs[at] == wanted)


def _intersect(phrases: Phrases, lists: _Postings, doc_at: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, start, document) of the windows in which each word stands within slop of its place; slop 0: exact matches."""
    width, none = phrases.terms.shape[1], np.empty(0, np.int64)
    held = np.arange(width) < phrases.lengths[:, None]
    rarity = np.where(held, lists.counts[phrases.terms], np.iinfo(np.int64).max)
    live = np.flatnonzero(rarity.min(1) > 0) if len(rarity) else none
    if not len(live):
        return none, none, none
    order = np.argsort(rarity[live], axis=1, kind="stable")
    load = rarity[live, order[:, 0]] * (2 * slop + 1)
    step = np.unique([0, *np.searchsorted(np.cumsum(load), np.arange(CANDIDATES, load.sum(), CANDIDATES)), len(live)])
    out = []
    for lo, hi in zip(step[:-1], step[1:], strict=True):
        own, by = live[lo:hi], order[lo:hi]
        rare = phrases.terms[own, by[:, 0]]
        k = np.repeat(np.arange(len(own)), lists.counts[rare])
        start = lists.positions[_ranges(lists.first[rare], lists.counts[rare])] - by[k, 0]
        if slop:
            both = np.unique(np.concatenate([(k << 32) + start + d + slop + width for d in range(-slop, slop + 1)]))
            k, start = both >> 32, (both & 0xFFFFFFFF) - slop - width
        doc = np.searchsorted(doc_at, start, "right") - 1
        ok = (start >= 0) & (start + phrases.lengths[own[k]] <= doc_at[np.minimum(doc + 1, len(doc_at) - 1)])
        k, start, doc = k[ok], start[ok], doc[ok]
        for j in range(0 if slop else 1, width):  # the next rarest term's list, moved by its offset
            off = by[k, j]
            term, ok = phrases.terms[own[k], off], off >= phrases.lengths[own[k]]
            for d in range(-slop, slop + 1):
                at = start + off + d
                inside = (at >= doc_at[doc]) & (at < doc_at[doc + 1]) if d else True
                ok |= lists.has(term, at) & inside
            k, start, doc = k[ok], start[ok], doc[ok]
        out.append((own[k], start, doc))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _items(phrases: Phrases, which: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    """The different items of the matched phrases, by document."""
    sizes = np.diff(phrases.item_at)[which]
    pairs = np.unique(np.stack([np.repeat(doc, sizes), phrases.items[_ranges(phrases.item_at[which], sizes)]], 1), axis=0)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(n + 1)), pa.int32()), pa.array(pairs[:, 1], pa.int64()))


def _search(batches: Iterator[pa.RecordBatch], phrases: Phrases, slop: int, whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            n, at = row["rows"], np.array(row["doc_at"], np.int64)
            lists = _Postings(row, phrases)
            which, start, doc = _intersect(phrases, lists, at, 0)
            near = _intersect(phrases, lists, at, slop) if slop else (which[:0], start[:0], doc[:0])
            order = np.lexsort((start, doc))
            which, start, doc = which[order], start[order], doc[order]
            stop = start + phrases.lengths[which]
            # maximal runs of hit words: a span opens where it starts beyond all before it in its document
            reach = np.maximum.accumulate(stop) if len(stop) else stop
            opens = np.ones(len(start), bool)
            opens[1:] = (start[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
            run = np.flatnonzero(opens)
            s, e, d = start[run] - at[doc[run]], (np.maximum.reduceat(stop, run) if len(run) else stop) - at[doc[run]], doc[run]
            cut = lambda values: pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(n + 1)), pa.int32()), pa.array(values, pa.int32()))  # noqa: E731, B023
            out = pa.RecordBatch.from_arrays([
                pa.array([row["seg"]] * n), pa.array(np.arange(n)), pa.array(row["doc_ids"], pa.int64()), pa.array(row["tags"], pa.int64()), pa.array(np.diff(at)), cut(s), cut(e),
                _items(phrases, which, doc, n), _items(phrases, near[0], near[2], n),
            ], schema=_MATCHES)
            hit = np.bincount(np.concatenate([doc, near[2]]), minlength=n) > 0
            yield out if whole else out.filter(pa.array(hit))


def search(index: DataFrame, phrases: Phrases, slop: int = 0, whole: bool = True) -> DataFrame:
    """A row (schema MATCHES) for each document of the index, or (not whole) for each with a match: spans of hit words (starts,
    stops), items with exact matches (item_ids) and with proximity matches (near_ids; none without slop)."""
    sent = index.sparkSession.sparkContext.broadcast(phrases)
    return index.mapInArrow(lambda it: _search(it, sent.value, slop, whole), MATCHES)


def _covered() -> Column:
    """Words inside the spans of the arrays starts and stops, sorted by start."""
    spans = F.sort_array(F.arrays_zip("starts", "stops"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["stops"] - F.greatest(a["to"], x["starts"]))).cast("long").alias("n"), F.greatest(a["to"], x["stops"]).cast("long").alias("to"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS, segment: int = SEGMENT, index: DataFrame | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, tag (xxhash64 of its text), n_words, n_hit, item_ids (ascending), near_ids (items with
    proximity matches, ascending; none without slop), starts and stops of hit spans in words, contaminated (n_hit > 0 and
    20 * n_hit >= n_words).

    An item of fewer words than the window, but not none, is one phrase. Null and empty texts have no words; a text of any
    length is one document of one segment. Items without words or with a null id never match; items with one id and several
    texts count as one. A row with a null doc_id is a row like any other; repeated rows and rows that share an id each get
    theirs. An empty benchmark hits nothing, empty docs give an empty table. Only doc_id and text (of docs), item_id and text (of
    benchmark) are read, so further columns may have any name. index: a written build_index() of docs, if there is one already.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    if index is None:
        index = scratch.cut(build_index(docs, segment), "zstd")
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null").distinct()
    blocks: list[DataFrame] = []
    for phrases in phrase_blocks((tuple(r) for r in items.toLocalIterator()), window, block_words):
        if blocks:
            blocks[-1] = scratch.cut(blocks[-1])  # so one block's phrases are broadcast at a time
        blocks.append(search(index, phrases, slop, not blocks))
    found = blocks[0]
    if len(blocks) > 1:  # a document is its segment and place in the written index, whichever block reads it
        for own in blocks[1:]:
            found = found.unionByName(own)
        lists = (F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "stops", "item_ids", "near_ids"))
        found = found.groupBy("seg", "ord").agg(*(F.first(c).alias(c) for c in ("doc_id", "tag", "n_words")), *lists)
    sorted_ids = {c: F.array_sort(F.array_distinct(c)) for c in ("item_ids", "near_ids")}
    out = found.withColumns({"n_hit": _covered(), **sorted_ids})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop("seg", "ord")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated rows, in the columns of docs, whatever their names.

    A row is known by its doc_id and text: of rows that share an id, only those go whose own text is contaminated, and equal rows go
    or stay together. Rows with a null doc_id stay. Null and empty texts stay. An empty benchmark or an empty table
    drops nothing. Very long texts are judged by the same share of hit words.
    """
    bad = contamination(docs, benchmark, **options).where("contaminated").select(F.col("doc_id").alias("__bad"), F.col("tag").alias("__tag")).distinct()
    bad = Scratch(docs.sparkSession, "contaminated").cut(bad)  # written, so its size is known and docs need no exchange when it is small
    return docs.join(bad, (docs["doc_id"].cast("long") == bad["__bad"]) & (F.xxhash64(docs["text"]) == bad["__tag"]), "left_anti")
