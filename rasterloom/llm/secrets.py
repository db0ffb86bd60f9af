"""Secret scans: character Markov models of random strings and of ordinary identifiers, compared by log-likelihood ratio.

Both models are trained from labelled samples: strings drawn at random over the alphabets that keys use (label random), and all
documents' runs of identifier characters outside of base spans (label ordinary), whose character pairs are counted over the whole
corpus in a table of fixed size; identifiers made of the corpus's words add theirs. In a run of identifier characters, the piece with the greatest sum of log ratios over its
character pairs, against the likeliest alphabet, is a span if it is long and that sum high enough; what stands before and after
it is searched again. Fixed patterns give base spans; the models add spans, which never replace base ones.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

#: The kinds in their order; spans that begin together are listed so.
KINDS = ("assign", "access", "hex", "model")
#: A group 2, an access key and a hex string of fewer characters fail.
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: Model spans: characters at least, log-likelihood ratio at least, in all and for each character.
MIN_MODEL, MIN_RATIO, MIN_MEAN = 12, 15.0, 0.6
#: Counts that smooth a character's transitions.
BACK_OFF = 200
#: How often a word of an identifier is joined to the next one by each of these, by a capital, by a number.
JOINTS, CAPITAL, NUMBER = {"_": 0.25, "-": 0.15, ".": 0.1, "/": 0.15}, 0.2, 0.15
#: Labelled random samples for each alphabet, their length, and the seed they are drawn with.
SAMPLES, SAMPLE_CHARS, SEED = 2000, 40, 7

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
ALPHABET = _LETTERS + _DIGITS + "+/_=.-"
RANDOM = (_DIGITS + "abcdef", _DIGITS + "ABCDEF", _LETTERS[:26] + _DIGITS, _LETTERS + _DIGITS, _LETTERS + _DIGITS + "+/", _LETTERS + _DIGITS + "_-")

_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_ASSIGN = re.compile(f"({'|'.join(map(_either, ('password', 'passwd', 'secret', 'token')))}|{_either('api')}_?{_either('key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % MIN_MODEL)
_HINTS = ("passw", "secret", "token", "api")

#: A byte's number in the alphabet, one more than its place; 0 for all others.
_CODE = np.zeros(256, np.uint8)
_CODE[list(ALPHABET.encode())] = np.arange(1, len(ALPHABET) + 1)
WIDTH = len(ALPHABET) + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns' matches, leftmost and non-overlapping for each kind, without failing ones."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def pair_counts(data: bytes) -> np.ndarray:
    """WIDTH x WIDTH counts of neighbouring characters."""
    code = _CODE[np.frombuffer(data, np.uint8)].astype(np.int32)
    return np.bincount(code[:-1] * WIDTH + code[1:], minlength=WIDTH * WIDTH).reshape(WIDTH, WIDTH)


def log_transitions(counts: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
    """Log probabilities of the next character, smoothed by BACK_OFF counts dealt as characters come at all in text (if None, in
    counts); the row and column of other characters are ignored."""
    own, plain = counts[1:, 1:].astype(np.float64), (counts if text is None else text)[1:, 1:].astype(np.float64)
    share = (plain.sum(0) + 0.5) / (plain.sum() + 0.5 * len(own))
    out = np.zeros((WIDTH, WIDTH))
    out[1:, 1:] = np.log((own + BACK_OFF * share) / (own.sum(1, keepdims=True) + BACK_OFF))
    return out


def with_identifiers(counts: np.ndarray) -> np.ndarray:
    """counts of text plus those of the identifiers that its words make: in capitals, with a first capital, one after another by
    a joint of JOINTS (a capital counts as one, and a number, too). Each word is joined once to another one, whatever that is."""
    upper, lower, digit = (_CODE[list(x.encode())].astype(int) for x in (_LETTERS[:26], _LETTERS[26:], _DIGITS))
    text = counts.astype(np.float64)
    inner, starts, ends = text[np.ix_(lower, lower)], text[0, lower], text[lower, 0]
    own = text.copy()
    first, last = starts / max(starts.sum(), 1), ends / max(ends.sum(), 1)
    follows = inner / np.maximum(inner.sum(1, keepdims=True), 1)
    words = ends.sum()
    own[np.ix_(upper, upper)] += inner / 2
    own[np.ix_(upper, lower)] += words * first[:, None] * follows / 2
    for joint, share in JOINTS.items():
        j = int(_CODE[ord(joint)])
        for case in (lower, upper):
            own[case, j] += share * words * last
            own[j, case] += share * words * first
        own[digit, j] += share * words / len(digit) / 2
        own[j, digit] += share * words / len(digit) / 2
    own[np.ix_(lower, upper)] += CAPITAL * words * last[:, None] * first
    own[np.ix_(lower, digit)] += NUMBER * words * last[:, None] / len(digit)
    own[np.ix_(upper, digit)] += NUMBER * words * last[:, None] / len(digit) / 2
    own[np.ix_(digit, lower)] += NUMBER * words * first / len(digit) / 2
    own[np.ix_(digit, upper)] += NUMBER * words * first / len(digit) / 2
    own[np.ix_(digit, digit)] += words / len(digit) ** 2
    return own


def random_models(samples: int = SAMPLES, chars: int = SAMPLE_CHARS, seed: int = SEED) -> np.ndarray:
    """A model for each of RANDOM, trained from strings drawn over it; what an alphabet lacks stays as unlikely as the smoothing makes it."""
    draw = random.Random(seed)
    return np.stack([log_transitions(pair_counts("\n".join("".join(draw.choices(a, k=chars)) for _ in range(samples)).encode())) for a in RANDOM])


def ratio(run: str, random_log: np.ndarray, ordinary_log: np.ndarray) -> float:
    """Log-likelihood ratio of random (its likeliest alphabet) to ordinary."""
    code = _CODE[np.frombuffer(run.encode(), np.uint8)]
    a, b = code[:-1], code[1:]
    return float(random_log[:, a, b].sum(1).max() - ordinary_log[a, b].sum())


def best_piece(gains: np.ndarray) -> tuple[float, int, int]:
    """The greatest sum of gains (a row for each alphabet) over a piece of MIN_MODEL characters or more: it, the piece's start and end."""
    least = MIN_MODEL - 1
    total = np.zeros((len(gains), gains.shape[1] + 1))
    np.cumsum(gains, axis=1, out=total[:, 1:])
    before = total[:, : total.shape[1] - least]
    low = np.minimum.accumulate(before, axis=1)
    won = total[:, least:] - low
    k, j = divmod(int(won.argmax()), won.shape[1])
    i = int(before[k, : j + 1].argmin())
    return float(won[k, j]), i, j + least + 1


def model_spans(text: str, base: list[tuple[int, int, str]], random_log: np.ndarray, ordinary_log: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans outside the base ones that the models take for random."""
    out = []
    gain = random_log - ordinary_log
    for m in _RUN.finditer(text):
        if any(s < m.end() and m.start() < e for s, e, _ in base):
            continue
        code = _CODE[np.frombuffer(m[0].encode(), np.uint8)]
        gains = gain[:, code[:-1], code[1:]]
        todo = [(0, len(code))]
        while todo:
            a, z = todo.pop()
            if z - a < MIN_MODEL:
                continue
            r, i, j = best_piece(gains[:, a : z - 1])
            if r >= MIN_RATIO and r >= MIN_MEAN * (j - i - 1):
                out.append((m.start() + a + i, m.start() + a + j, "model"))
                todo += [(a, a + i), (a + j, z)]
    return out


def _without(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a line end for each of the spans, which may overlap."""
    out, at = [], 0
    for s, e, _ in sorted(spans):
        if s >= at:
            out.append(text[at:s])
        at = max(at, e)
    return "\n".join([*out, text[at:]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((WIDTH, WIDTH), np.int64)
    for b in rows_of(batches, "text"):
        total += pair_counts(b"\n".join(_without(t or "", base_spans(t or "")).encode("utf-8", "surrogatepass") for t in b.column(0).to_pylist()))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["pair", "n"])


def ordinary_model(docs: DataFrame) -> np.ndarray:
    """The ordinary model from all documents' text outside of base spans; WIDTH * WIDTH rows come to the driver at most."""
    counts = np.zeros(WIDTH * WIDTH, np.int64)
    for pair, n in docs.select("text").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        counts[pair] = n
    counts = counts.reshape(WIDTH, WIDTH)
    return log_transitions(with_identifiers(counts), counts)


SPANS = "doc_id long, kinds array<string>, starts array<long>, ends array<long>, found array<string>"


def _scan(batches: Iterator[pa.RecordBatch], random_log: np.ndarray, ordinary_log: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches, "text"):
        rows: list[list] = []
        for text in b.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            rows.append(sorted(base + model_spans(text, base, random_log, ordinary_log), key=lambda s: (s[0], KINDS.index(s[2]), s[1])))
        texts = b.column(1).to_pylist()
        cols = [[[s[2] for s in r] for r in rows], [[s[0] for s in r] for r in rows], [[s[1] for s in r] for r in rows], [[t[s[0] : s[1]] for s in r] for t, r in zip(texts, rows, strict=True)]]
        kinds = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "kinds", "starts", "ends", "found"])


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id and parallel arrays of the spans' kinds, starts, ends (code points, end exclusive) and text, by start, then kind.

    Null text is empty and has no spans; texts of any length are read whole; null doc_ids and repeated rows stay as rows; an empty
    table gives an empty table. Only doc_id and text are read, so further columns may have any name. A model span never overlaps
    a base span or another model span.
    """
    ordinary = ordinary_model(docs)
    models = docs.sparkSession.sparkContext.broadcast((random_models(), ordinary))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _scan(it, *models.value), SPANS)
