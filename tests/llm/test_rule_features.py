"""Repeated windows by either way, and where hashes agree in the bits that are kept."""

import random

import pytest

from rasterloom.llm import rules


def plain(text):
    w = text.split()
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + j for i in at for j in range(3)}
    return len(covered)


@pytest.mark.parametrize("place", [20, 3, 61])
def test_repeated_windows(spark, monkeypatch, place):
    monkeypatch.setattr(rules, "PLACE", place)
    draw = random.Random(place)
    texts = ["", "a", "a b c", "a b c a b c", "a a a a a a"] + [" ".join(draw.choices("abcdef", k=draw.randint(1, 90))) for _ in range(60)] + [" ".join(f"w{k}" for k in range(200))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in rules.features(frame).collect()}
    assert got == {k: plain(t) for k, t in enumerate(texts)}
