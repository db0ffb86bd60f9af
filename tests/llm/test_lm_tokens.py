"""op8: tokens are split, looked up and counted in whole columns: right on odd texts, and cheaper than word by word."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa

from rasterloom.llm import lm

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def plain(text):
    return [*(text or "").encode().translate(LOWER).split(), b"\n"]


def counted(texts):
    out = Counter()
    for b in lm._count(iter([pa.record_batch([pa.array(texts, pa.string())], ["text"])])):
        for token, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            out[token] += n
    return out


def test_tokens_of_odd_texts(monkeypatch):
    draw = random.Random(3)
    texts = [None, "", " ", *("".join(draw.choices(" \t\n\v\f\r\x1c\x1f\x85\xa0　\0aAZzÀİß漢😀", k=draw.randrange(12))) for _ in range(5000)), None]
    for some in (texts, [None], [""], []):
        for off in (0, 7):
            tokens, ends = lm._tokens(pa.array(some, pa.string()).slice(off))
            want = [plain(t) for t in some[off:]]
            assert tokens.to_pylist() == sum(want, []) and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
    tokens = lm._tokens(pa.array(texts))[0]
    hashes = dict(zip(tokens.to_pylist(), lm._hash(tokens).tolist(), strict=True))
    assert len(set(hashes.values())) == len(hashes) == len(set(tokens.to_pylist()))
    assert lm._hash(tokens.slice(5)).tolist() == [hashes[t] for t in tokens.to_pylist()[5:]]
    for most in (lm.COUNTERS, 20):  # merged at the end only; merged and sent on again and again
        monkeypatch.setattr(lm, "COUNTERS", most)
        monkeypatch.setattr("rasterloom.llm.common.slices.__defaults__", (500,))
        assert counted(texts) == Counter(t for x in texts for t in plain(x))


def test_columns_are_cheaper_than_words():
    draw = random.Random(4)
    texts = [" ".join(f"Word{int(draw.paretovariate(0.4)) % 10**7}" for _ in range(200)) for _ in range(3000)]
    head = Counter(t for x in texts for t in plain(x)).most_common(50_000)
    model, number = lm.Model(head, 10**6, 10**6), {t: k for k, (t, _) in enumerate(head)}
    column = pa.array(texts)

    def by_words():
        tokens = [t for x in column.to_pylist() for t in plain(x)]
        assert [number.get(t, -1) for t in tokens] == lm._positions(column, model)[2].tolist()

    def cost(f):
        start = time.process_time()
        f()
        return time.process_time() - start

    turns = [(cost(lambda: lm._positions(column, model)), cost(by_words)) for _ in range(9)]  # in turn, as other work may slow either
    columns, both = (min(x) for x in zip(*turns, strict=True))
    assert columns < 0.9 * (both - columns), (columns, both)
