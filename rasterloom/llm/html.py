"""HTML extraction with a suffix array over each host's pages.

A page becomes blocks of text in page order. Markup says about a block that it is left out (menus, page headers, footers,
sidebars, notices, adverts, forms, scripts, comments), that it stands in the page's article or main element, or neither. The
blocks of a host's pages, as token streams, are concatenated; in a suffix array over them, intervals of suffixes that share
MIN_RUN tokens or more and come from enough distinct pages are boilerplate. A page keeps the runs that boilerplate leaves
uncovered: of its article, or, without an article element, of all its blocks.

Inside an article enough pages means most of them (ARTICLE_SHARE of the host's distinct pages): text that some articles of a host
share (licence lines, passages) belongs to them, what nearly all share is the host's template. Near copies of one article share
nearly all of it: they stay whole.

Hosts with many tokens are dealt into several groups of bounded size. Each group counts its runs by suffix array; the counts of
equal runs are added over the host, so what is boilerplate doesn't depend on the groups. A run in articles that has the share of
the host's pages has it in one group at least, so only runs that have it in a group are counted everywhere.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_counted, rows_of

#: Tokens of a repeated run at least, distinct pages that have it at least (and this share of the host's), tokens of a group.
MIN_RUN, MIN_PAGES, MIN_SHARE, GROUP_TOKENS = 8, 3, 0.05, 50_000
#: So many distinct pages are enough on a host of any size; inside articles at least so many, and this share of the host's.
ENOUGH_PAGES, ARTICLE_SHARE = 10, 0.75
#: Share of an article's tokens that may be boilerplate.
MOST_TAKEN = 0.5

#: Elements that end a block, that are left out whole, and words of class, id or role that leave an element out (fixed values).
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
LEFT_OUT = frozenset("nav footer aside form head title noscript template button select textarea iframe svg canvas object audio video dialog menu".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promotion related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget contentinfo complementary alert".split()
)
HEAD_MARKS = frozenset(["header", "masthead", "topbar"])

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S | re.I
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _marked(attributes: str, in_article: bool) -> bool:
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id", "role"):
            words = set(re.split(r"[^a-z]+", value))
            if words & MARKS or not in_article and (words & HEAD_MARKS):
                return True
    return False


def blocks_of(page: str | None) -> list[tuple[bool, str]]:
    """(whether in the article or main element, text) of each block that isn't left out, in page order."""
    page = page or ""
    out: list[tuple[bool, str]] = []
    run: list[str] = []
    article = 0
    skip, depth = "", 0  # the element being left out, and how many of its name are open

    def close() -> None:
        if run:
            if text := " ".join(html.unescape("".join(run)).split()):
                out.append((article > 0, text))
            run.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if not skip and m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        opens = not m[2] and name not in _VOID and not m[4].endswith("/")
        main = name in ("article", "main")
        if skip:
            if main and opens and name != skip and not _marked(m[4], True) and skip not in ("noscript", "template", "form"):
                skip = ""  # an element left open doesn't swallow the article
            else:
                depth += (name == skip) * (1 if opens else -1 if m[2] else 0)
                if depth > 0:
                    continue
                skip = ""
                continue
        if name in BLOCKS:
            close()
        elif name in ("br", "td", "th"):
            run.append(" ")
        if opens and name not in ("html", "body"):
            if name in LEFT_OUT or name == "header" and not article or m[4] and _marked(m[4], article > 0):
                close()
                skip, depth = name, 1
                continue
        if main:
            article = article + 1 if opens else max(0, article - 1) if m[2] else article
    if not skip and at < len(page):
        run.append(page[at:])
    close()
    return out


#: Begin a block of a stream: one outside of articles (not written before the first block), one inside.
_BREAK, _INSIDE = "\x1e", "\x1d"
PARSED = "page_id long, url string, host string, key binary, stream string, article boolean, tokens long"
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page: its blocks as a stream, and whether one of them is in an article."""
    for b in rows_of(batches, "html"):
        rows: list[tuple] = []
        for page_id, url, page in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            m = _HOST.match(url or "")
            blocks = blocks_of(page)
            stream = "".join((_INSIDE if a else _BREAK) + t for a, t in blocks).removeprefix(_BREAK)
            key = xxhash.xxh3_128_digest(stream.encode("utf-8", "surrogatepass"))
            rows.append((page_id, url, m[1].lower() if m else "", key, stream, any(a for a, _ in blocks), stream.count(" ") + 2 * len(blocks)))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "url", "host", "key", "stream", "article", "tokens"])


def suffix_classes(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, sorted by the first depth tokens, and the rank of each suffix's first depth tokens (equal if they agree)."""
    _, rank = np.unique(tokens, return_inverse=True)
    rank, have, order = rank.astype(np.int64), 1, np.argsort(rank, kind="stable")
    while have < depth:
        step = min(have, depth - have)
        after = np.full(len(rank), 0, np.int64)
        after[: len(rank) - step] = rank[step:] + 1
        key = rank * (len(rank) + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.empty(len(rank), np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])]) if len(rank) else []
        rank, have = fresh, have + step
    return order, rank


def _words(stream: str) -> list[str]:
    """The stream's tokens; each block's first one begins it."""
    words = stream.replace(_BREAK, f" {_BREAK} ").replace(_INSIDE, f" {_INSIDE} ").split(" ")
    return words[1:] if stream.startswith(_INSIDE) else [_BREAK, *words]


class Streams:
    """The streams of a group in one suffix array."""

    def __init__(self, streams: list[str], min_run: int):
        self.streams, self.min_run = streams, min_run
        number: dict[str, int] = {_BREAK: 0, _INSIDE: 1}
        parts = [_words(s) for s in streams]
        self.sizes = np.array([len(p) + 1 for p in parts], np.int64)
        self.tokens = np.empty(int(self.sizes.sum()), np.int64)
        at = 0
        for k, own in enumerate(parts):
            self.tokens[at : at + len(own)] = [number.setdefault(t, len(number)) for t in own]
            self.tokens[at + len(own)] = -1 - k  # ends the page: equal to nothing
            at += len(own) + 1
        self.names, self.page = list(number), np.repeat(np.arange(len(parts)), self.sizes)
        starts = (self.tokens == 0) | (self.tokens == 1)
        block = np.maximum.accumulate(np.where(starts, np.arange(len(self.tokens)), 0)) if len(self.tokens) else starts
        self.inside = self.tokens[block] == 1
        _, self.rank = suffix_classes(self.tokens, min_run)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pages by rank (copies of a whole page count once): of runs that begin outside of articles, and inside."""
        kinds: dict[str, int] = {}
        kind = np.array([kinds.setdefault(s, len(kinds)) for s in self.streams], np.int64)
        self.pages = len(kinds)
        pairs = np.unique((2 * self.rank + self.inside) * max(self.pages, 1) + kind[self.page]) // max(self.pages, 1)
        both = np.bincount(pairs, minlength=2 * len(self.rank) + 2)
        return both[::2], both[1::2]

    def runs(self, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of runs that end inside their page (of those wanted, a flag by rank), and a hash of each."""
        n, ends = self.min_run, np.concatenate([[0], np.cumsum(self.tokens < 0)])
        at = np.empty(int(self.rank.max()) + 1 if len(self.rank) else 0, np.int64)
        at[self.rank[::-1]] = np.arange(len(self.rank))[::-1]  # where each rank comes first
        whole = (at + n <= len(self.tokens)) & (ends[np.minimum(at + n, len(self.tokens))] == ends[at])
        ranks = np.flatnonzero(whole if wanted is None else whole & wanted[: len(at)])
        if not len(ranks):
            return ranks, np.empty(0, np.int64)
        at = at[ranks]
        word = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in self.names], np.uint64)
        h = np.zeros(len(at), np.uint64)
        for j in range(n):
            h = (h ^ word[self.tokens[at + j]]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return ranks, h.view(np.int64)

    def _covered(self, starts: np.ndarray) -> np.ndarray:
        """Which tokens the runs at starts cover."""
        cover = np.zeros(len(self.tokens) + self.min_run + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + self.min_run, -1)
        covered = np.cumsum(cover)[: len(self.tokens)] > 0
        # a run reaches over block ends; of a block it takes all, or min_run tokens or more in a row, but no few words at its edge
        stop = self.tokens <= 1
        bounds = np.flatnonzero(np.diff(np.concatenate([[False], covered & ~stop, [False]]).astype(np.int8)))
        for a, b in bounds.reshape(-1, 2):
            if b - a < self.min_run and not (stop[a - 1] and stop[b]):
                covered[a:b] = False
        return covered

    def masks(self, outside: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
        """For each stream, which of its tokens (but for the first block's beginning) runs of these ranks cover: in blocks outside of articles,
        inside. An article that runs cover by more than MOST_TAKEN isn't a template with a text, but a near copy of others: it stays whole."""
        covered = np.where(self.inside, *(self._covered(np.flatnonzero(np.isin(self.rank, r) & (self.inside == k))) for r, k in ((inside, True), (outside, False))))
        ends, word = np.cumsum(self.sizes), self.inside & (self.tokens > 1)
        taken, of = (np.bincount(self.page, w, len(self.sizes)) for w in (covered & word, word))
        covered &= ~(self.inside & (taken > MOST_TAKEN * of)[self.page])
        return [covered[e - n + 1 : e - 1] for e, n in zip(ends, self.sizes, strict=True)]


def needs(pages: int, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> tuple[float, float]:
    """Distinct pages that make a run boilerplate outside of articles and inside, on a host of so many distinct pages."""
    return max(min_pages, min(min_share * pages, ENOUGH_PAGES)), max(ENOUGH_PAGES, ARTICLE_SHARE * pages)


def repeated(streams: list[str], min_run: int = MIN_RUN, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> list[np.ndarray]:
    """For each stream of a host, which of its tokens boilerplate covers; blocks are split by one token."""
    own = Streams(streams, min_run)
    outside, inside = own.counts()
    few, most = needs(own.pages, min_pages, min_share)
    return own.masks(np.flatnonzero(outside >= few), np.flatnonzero(inside >= most))


def unique_text(stream: str, covered: np.ndarray) -> str:
    """The runs that boilerplate leaves uncovered, by block: of the blocks in an article, or, if there are none, of all."""
    mark = _INSIDE if _INSIDE in stream else _BREAK
    blocks: list[tuple[str, list[str]]] = []
    for word, c in zip(_words(stream), [False, *covered.tolist()], strict=True):
        if word in (_BREAK, _INSIDE):
            blocks.append((word, []))
        elif not c:
            blocks[-1][1].append(word)
    return "\n\n".join(" ".join(words) for m, words in blocks if m == mark and words)


def _count(table: pa.Table, min_run: int) -> pa.Table:
    """Runs of a group's distinct streams, with the number of streams that have each: all of those outside of articles, and those
    inside that have their share of the group's pages (and, in a host's only group, are on enough of them)."""
    own = Streams(table.column("stream").to_pylist(), min_run)
    outside, inside = own.counts()
    least = ENOUGH_PAGES if table.column("groups")[0].as_py() == 1 else 1
    enough = max(least, ARTICLE_SHARE * own.pages)
    ranks, h = own.runs((outside > 0) | (inside >= enough))
    some, most = outside[ranks] > 0, inside[ranks] >= enough
    runs = np.concatenate([h[some], h[most]])
    n = np.concatenate([outside[ranks][some], inside[ranks][most]]).astype(np.int64)
    host, part = (pa.array([table.column(c)[0].as_py()] * len(runs), k) for c, k in (("host", pa.string()), ("part", pa.int64())))
    return pa.table({"host": host, "part": part, "run": pa.array(runs), "inside": pa.array(np.repeat([False, True], [some.sum(), most.sum()])), "n": pa.array(n)})


COUNTS = "host string, part long, run long, inside boolean, n long"
_NO_COUNTS = pa.table({c: pa.array([], k) for c, k in (("host", pa.string()), ("run", pa.int64()), ("n", pa.int64()))})


def _recount(table: pa.Table, wanted: pa.Table, min_run: int) -> pa.Table:
    """How many of a group's streams have each wanted run inside an article."""
    if not len(table) or not len(wanted):
        return _NO_COUNTS
    own = Streams(table.column("stream").to_pylist(), min_run)
    _, inside = own.counts()
    ranks, h = own.runs(inside > 0)
    ok = np.isin(h, wanted.column("run").to_numpy()) & (inside[ranks] > 0)
    return pa.table({"host": pa.array([table.column("host")[0].as_py()] * int(ok.sum()), pa.string()), "run": pa.array(h[ok]), "n": pa.array(inside[ranks][ok].astype(np.int64))})


_NONE = pa.table({c: pa.array([], k) for c, k in (("host", pa.string()), ("key", pa.binary()), ("text", pa.string()))})


def _mask(table: pa.Table, bad: pa.Table, min_run: int) -> pa.Table:
    """host, key and text without boilerplate of each stream of a group."""
    if not len(table):
        return _NONE
    own = Streams(table.column("stream").to_pylist(), min_run)
    ranks, h = own.runs()
    runs, inside = bad.column("run").to_numpy(), bad.column("inside").to_numpy(zero_copy_only=False).astype(bool)
    masks = own.masks(ranks[np.isin(h, runs[~inside])], ranks[np.isin(h, runs[inside])])
    text = pa.array([unique_text(s, m) for s, m in zip(own.streams, masks, strict=True)], pa.string())
    return pa.table({"host": table.column("host"), "key": table.column("key"), "text": text})


def extract(pages: DataFrame, min_run: int = MIN_RUN, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """page_id, url, text (blocks joined by two newlines; empty if none) and boilerplate (whether the suffix array took tokens of the
    text away) of each row of pages (page_id, url, html).

    Null or empty html gives empty text; html of any length is read whole. A null or odd url counts as the empty host. Null
    page_ids and repeated rows each get theirs; copies of a page's stream count as one page. An empty table gives an empty table.
    Other columns aren't read, so they may have any name.
    """
    scratch = Scratch(pages.sparkSession, "html")
    # pages are parsed anew in each pass: their texts, most of the input, are never written
    parsed = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_parse, PARSED)
    keys = scratch.cut(parsed.where("tokens > 0").groupBy("host", "key").agg(F.max("tokens").alias("tokens"), F.count("*").alias("copies"), F.bool_and("article").alias("article")), "zstd")
    total = keys.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") > max(100, total // 2000)  # fewer than 2,000 pages, whatever the input
    few = F.greatest(F.lit(float(min_pages)), F.least(F.count("*") * min_share, F.lit(float(ENOUGH_PAGES))))
    most = F.greatest(F.lit(float(ENOUGH_PAGES)), F.count("*") * ARTICLE_SHARE)
    size = F.sum(F.when(hot, F.col("tokens")).otherwise(F.col("tokens") * F.col("copies")))
    hosts = keys.groupBy("host").agg(F.greatest(F.lit(1), F.ceil(size / group_tokens)).cast("long").alias("groups"), few.alias("few"), most.alias("most"), F.sum("copies").alias("c"))
    hosts = scratch.cut(hosts)
    big = F.col("c") > max(100, total // 2000)
    streams = parsed.where("tokens > 0").select("host", "key", "stream", "article")
    if not keys.where(hot).isEmpty():
        copied = F.broadcast(keys.where(hot).select("host", "key"))
        streams = streams.join(copied, ["host", "key"], "left_anti").unionByName(streams.join(copied, ["host", "key"], "left_semi").dropDuplicates(["host", "key"]))
    part = F.pmod(F.xxhash64("key"), F.col("groups")).alias("part")

    def groups(rows: DataFrame, of: DataFrame) -> list[DataFrame]:
        """rows of the hosts `of`, dealt to groups: those of big hosts, and all others. These meet their host in the exchange that groups them."""
        own = (F.broadcast(of.where(big)), of.where(~big))
        return [rows.join(h.select("host", "groups"), "host").select("host", "groups", part, "key", "stream", "article") for h in own]

    def together(rows: list[DataFrame], other: DataFrame, f, schema: str) -> DataFrame:
        """f on each group of rows and what `other` (host and more) has of its host."""
        out = []
        for r in rows:
            asked = scratch.cut(other.join(scratch.cut(hosts), "host").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("part", *other.columns))
            out.append(r.groupBy("host", "part").cogroup(asked.groupBy("host", "part")).applyInArrow(f, schema))
        return scratch.cut(out[0].unionByName(out[1]), "zstd")

    counted = [r.groupBy("host", "part").applyInArrow(lambda t: _count(t, min_run), COUNTS) for r in groups(streams, hosts)]
    counted = scratch.cut(counted[0].unionByName(counted[1]), "zstd")
    outside = counted.where("not inside").groupBy("host", "run").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pages)
    bad = scratch.cut(outside.join(hosts, "host").where("n >= few").select("host", "run", F.lit(False).alias("inside")))
    candidates = scratch.cut(counted.where("inside").select("host", "run").distinct())
    if not candidates.isEmpty():
        of = scratch.cut(hosts.join(candidates.select("host").distinct(), "host", "left_semi"))
        again = together(groups(streams, of), candidates, lambda t, w: _recount(t, w, min_run), "host string, run long, n long")
        inside = again.groupBy("host", "run").agg(F.sum("n").alias("n")).join(hosts, "host").where("n >= most")
        bad = scratch.cut(bad.unionByName(inside.select("host", "run", F.lit(True).alias("inside"))))
    touched = scratch.cut(hosts.join(bad.where("inside").select("host").distinct(), "host", "left_semi"))
    article = F.array_join(F.transform(F.filter(F.split("stream", f"(?=[{_BREAK}{_INSIDE}])"), lambda b: b.startswith(_INSIDE)), lambda b: F.substr(b, F.lit(2))), "\n\n")
    if touched.isEmpty() and keys.where("not article").isEmpty():  # no page to take anything from
        return parsed.select("page_id", "url", article.alias("text"), F.lit(False).alias("boilerplate"))
    wanted = [a.unionByName(b) for a, b in zip(groups(streams.where("not article"), hosts), groups(streams.where("article"), touched), strict=True)]
    masked = together(wanted, bad, lambda t, r: _mask(t, r, min_run), "host string, key binary, text string")
    masked = masked.dropDuplicates(["host", "key"]).join(keys.select("host", "key", "copies"), ["host", "key"]).withColumnRenamed("text", "found")
    masked = scratch.cut(masked, "zstd")
    own = parsed.withColumn("article_text", article).select("page_id", "url", "host", "key", "article", "article_text")
    done = join_counted(own, masked, ["host", "key"], "copies")
    done = done.select("page_id", "url", F.col("found").alias("text"), (~F.col("article") | (F.col("article_text") != F.col("found"))).alias("boilerplate"))
    rest = own.join(masked.select("host", "key"), ["host", "key"], "left_anti")
    return done.unionByName(rest.select("page_id", "url", F.col("article_text").alias("text"), F.lit(False).alias("boilerplate")))
