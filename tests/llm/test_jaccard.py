"""The pipeline's near-dedup stage on planted copies, against all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from rasterloom.llm import jaccard, simhash

from .test_brute_force import groups


def plain_shingles(text):
    words = text.lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def plain_similarity(a, b):
    return len(a & b) / len(a | b)


def planted():
    """Originals and copies with words changed one after another, so that similarity goes from 1 to below 0.8."""
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        texts.append(" ".join(words))
        for n in (1, 2, 3, 4, 6, 9):
            own = list(words)
            for at in rng.choice(150, n, replace=False):
                own[at] = f"new{rng.integers(0, 1 << 30)}"
            texts.append(" ".join(own))
    return {i: t for i, t in enumerate(texts)}


def test_near_dedup_stage_joins_all_copies(spark, data):
    texts = planted()
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    fps = {i: simhash.fingerprint(t) for i, t in texts.items()}
    ids = sorted(texts)
    close = [(a, b) for a in ids for b in ids if a < b and plain_similarity(sets[a], sets[b]) >= 0.8]
    between = [(a, b) for a, b in close if plain_similarity(sets[a], sets[b]) <= 0.95]
    assert len(between) > 20 and any(bin(fps[a] ^ fps[b]).count("1") > 2 for a, b in between)
    near = [(a, b) for a in ids for b in ids if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2]
    root = groups(ids, close + near)
    assert len(set(root.values())) > 12  # copies below 0.8 stay
    docs = spark.createDataFrame([*texts.items(), (None, texts[0]), (1000, None), (1001, "")], "doc_id long, text string").repartition(3)
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, data).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({*root.values(), 1000}) and kept.count(None) == 1


def test_similarity():
    a, b = "a b c d e f g h", "A b c d e f g x"
    assert jaccard.similarity(jaccard.shingles(a), jaccard.shingles(b)) == plain_similarity(plain_shingles(a), plain_shingles(b)) == 0.6
    assert len(jaccard.shingles("a b")) == 1 and len(jaccard.shingles(None)) == 0


@pytest.mark.parametrize("hot", [2000, 30])
def test_a_common_passage_makes_no_pairs_and_hides_none(spark, monkeypatch, hot):
    """Many texts share a passage, less than 0.8 of each; some of them have near copies, of other lengths too."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    rng = np.random.default_rng(11)
    passage = " ".join(f"p{k}" for k in range(70))
    texts = {}
    for k in range(60):
        own = [f"w{x}" for x in rng.integers(0, 9000, 50)]
        texts[10 * k] = f"{passage} {' '.join(own)}"
        if k % 4 == 0:
            texts[10 * k + 1] = f"{passage} {' '.join(own[:-5])} x{k}"
            texts[10 * k + 2] = f"{passage} {' '.join(own)} " + " ".join(f"y{k}{j}" for j in range(20))
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    fps = {i: simhash.fingerprint(t) for i, t in texts.items()}
    ids = sorted(texts)
    close = [(a, b) for a in ids for b in ids if a < b and (plain_similarity(sets[a], sets[b]) >= 0.8 or bin(fps[a] ^ fps[b]).count("1") <= 2)]
    root = groups(ids, close)
    kept = {r.doc_id for r in jaccard.near_dedup(spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(4)).collect()}
    assert kept == set(root.values())


def test_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    docs = spark.createDataFrame([(1, a, "r"), (5, a, "s"), (5, b, "t"), (5, b, "u"), (None, a, "v")], "doc_id long, text string, key string")
    for dedup in (jaccard.near_dedup, simhash.simhash_dedup):
        out = dedup(docs)
        assert out.columns == docs.columns and sorted(r.key for r in out.collect()) == ["r", "t", "u", "v"]
    near = docs.where("key in ('s', 't')").withColumn("text", simhash.F.concat(simhash.F.lit(f"{a} "), simhash.F.substring("text", 1, 3)))
    assert jaccard.near_dedup(near).count() == 1  # near copies under one id: one of them stays
