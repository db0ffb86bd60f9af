"""Cost-balanced packing of token sequences.

The cost of a piece of n tokens in a sequence is estimated as LINEAR * n + QUADRATIC * n * n (attention stays inside a piece).
Each task packs its own documents in blocks of bounded size, so packing shuffles nothing and no task waits for another one.
In a block, whole capacities are cut off long documents first; a block of t tokens left gets ceil(t / capacity) sequences,
and pieces go, in descending order, to the cheapest sequence with room for them. What fits nowhere whole is cut over the
cheapest sequences with room. So all sequences of a block are full but for its last tokens.

Token ids come from a public tokenizer's file, whose path is a parameter. Words repeat, so their ids are kept in a memo of
bounded size; text splits at blanks and newlines, which the tokenizer drops and across which it never merges.
"""

from __future__ import annotations

import heapq
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, single_threaded

CAPACITY, END_ID = 4096, 2
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Sequences in a block; words whose ids are kept.
BLOCK, MEMO = 512, 400_000

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64())])

#: How the word tokenizer cuts a word of letters below U+0250 and ASCII signs: contractions, letters, single digits, signs (a fixed value).
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


#: Signs that end a word and are parts of their own after letters.
_ENDS = frozenset(",.!?;:")


def _ids_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Little-endian unsigned 32-bit ids of words (text without blanks and newlines), as the tokenizer encodes them.

    Plain words go to the tokenizer's model at once, part by part; all others through its whole encoding. Both give the same
    ids, which the tests compare.
    """

    def __init__(self, path: str, memo: int = MEMO):
        single_threaded()
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.memo = self.whole.model, memo
        self.letters, self.parts = _byte_letters(), regex.compile(_PARTS)
        self.pieces: dict[str, bytes] = {"": b""}

    def _piece(self, part: str) -> bytes:
        found = self.pieces.get(part)
        if found is None:
            shown = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            found = _ids_bytes([t.id for t in self.model.tokenize(shown)])
            if len(self.pieces) >= self.memo:
                self.pieces.clear()
            self.pieces[part] = found
        return found

    def _ids(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():
                return self._piece(word.lower())
            if word[-1:] in _ENDS and word[:-1].isalpha():
                return self._piece(word[:-1].lower()) + self._piece(word[-1])
        plain = word.isprintable() and "<|" not in word and (word.isascii() or max(word) < "ɐ" and "İ" not in word and unicodedata.is_normalized("NFC", word))
        if not plain:
            return _ids_bytes(self.whole.encode(word, add_special_tokens=False).ids)
        low = word.lower()
        return self._piece(low) if low.isalpha() else b"".join(map(self._piece, self.parts.findall(low)))

    def __missing__(self, word: str) -> bytes:
        ids = self._ids(word)
        if len(self) >= self.memo:
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack_block(pieces: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for pieces shorter than the capacity: descending, each to the cheapest sequence with room."""
    total = sum(p[2] for p in pieces)
    n = -(-total // capacity)
    room, load, out = [capacity] * n, [0.0] * n, [[] for _ in range(n)]
    if n:  # so that what stays free is at the end of one sequence
        room[-1] = total - capacity * (n - 1)
    heap = [(0.0, s) for s in range(n)]
    put_off = []

    def put(s: int, doc: int, start: int, size: int) -> None:
        out[s].append((doc, start, size))
        room[s] -= size
        load[s] += cost(size)
        if room[s]:
            heapq.heappush(heap, (load[s], s))

    least, tight = min((p[2] for p in pieces), default=0), []
    for doc, start, size in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        passed, placed = [], False
        while heap:
            c, s = heapq.heappop(heap)
            if room[s] >= size:
                put(s, doc, start, size)
                placed = True
                break
            (passed if room[s] >= least else tight).append((c, s))  # no whole piece fits a tight one any more
        for x in passed:
            heapq.heappush(heap, x)
        if not placed:
            put_off.append((doc, start, size))
    for x in tight:
        heapq.heappush(heap, x)
    for doc, start, size in put_off:  # cut over the cheapest sequences with room
        while size:
            _, s = heapq.heappop(heap)
            part = min(size, room[s])
            put(s, doc, start, part)
            start, size = start + part, size - part
    return out


def _pack(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, block: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode = word_ids(path).encode
    end = _ids_bytes([end_id])
    task = TaskContext.get()
    sequence = (task.partitionId() if task else 0) << 32
    rows: dict[str, list] = {k: [] for k in _PIECES.names}
    docs: dict[int, tuple[int | None, int, int, bytes]] = {}
    pieces: list[tuple[int, int, int]] = []
    waiting = number = 0

    def emit(doc_id, start, ids, doc_tokens, sequence_id, offset) -> None:
        n = len(ids) // 4
        for k, v in zip(_PIECES.names, (doc_id, start, n, ids, doc_tokens, sequence_id, offset, cost(n)), strict=True):
            rows[k].append(v)

    def flush() -> pa.RecordBatch:
        nonlocal rows
        out = pa.RecordBatch.from_pydict(rows, schema=_PIECES)
        rows = {k: [] for k in _PIECES.names}
        return out

    def close_block() -> None:
        nonlocal sequence, waiting
        for own in pack_block(pieces, capacity):
            at = 0
            for number, start, size in own:
                doc_id, doc_tokens, first, ids = docs[number]
                emit(doc_id, start, ids[4 * (start - first) : 4 * (start - first + size)], doc_tokens, sequence, at)
                at += size
            sequence += 1
        docs.clear()
        pieces.clear()
        waiting = 0

    for b in rows_of(batches, "text"):
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = encode(text or "") + end
            n, at = len(ids) // 4, 0
            while n - at >= capacity:  # full sequences of their own
                emit(doc_id, at, ids[4 * at : 4 * (at + capacity)], n, sequence, 0)
                sequence, at = sequence + 1, at + capacity
            if n > at:
                docs[number] = (doc_id, n, at, ids[4 * at :])
                pieces.append((number, at, n - at))
                number, waiting = number + 1, waiting + n - at
            if waiting >= block * capacity:
                close_block()
            if len(rows["doc_id"]) >= 2000:
                yield flush()
    close_block()
    if rows["doc_id"]:
        yield flush()


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Pieces (schema PIECES): ids as little-endian unsigned 32-bit numbers, and where they stand in which sequence.

    Every id of every row, end_id after its text included, lies in exactly one piece. Null or empty text is end_id alone.
    Repeated rows and null doc_ids are packed like any row. An empty table gives no piece. tokenizer: path of a file that all
    executors have. Sequence ids are unique: the task's number and a count. Only doc_id and text are read.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _pack(it, tokenizer, capacity, end_id, block), PIECES)
