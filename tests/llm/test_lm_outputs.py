"""op8: each counted token is an output of the model, however rare, and depends on the tokens before it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import lm

# all tokens in the head; the following words joined; these and the words before them joined
HEADS = {200_000: "head", 45: "rare outputs", 1: "rare contexts, too"}


@pytest.mark.parametrize("head", HEADS, ids=list(HEADS.values()))
def test_words_outside_the_classes_depend_on_context(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "OUTPUTS", 1)  # the end of a text, which is the most frequent token
    monkeypatch.setattr(lm, "HEAD", head)
    draw = random.Random(5)
    pair = lambda k, v: f"before{k} after{v}"
    rows = [(i, " ".join([f"before{draw.randrange(40)}", *(pair(k, k) for k in draw.choices(range(40), k=2))])) for i in range(4000)]
    rows += [(10_000, " ".join(pair(k, k) for k in range(40))), (10_001, " ".join(pair(k, (k + 7) % 40) for k in range(40)))]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 10_000).where("doc_id >= 10000").collect()}
    right, moved = got[10_000], got[10_001]
    assert right.n_known == moved.n_known == 81 and right.base_score == pytest.approx(moved.base_score)
    assert right.score > moved.score + 5


def test_all_tokens_are_a_distribution():
    rng = np.random.default_rng(1)
    counts = np.sort(rng.zipf(1.3, 4000).clip(1, 10**6))[::-1]
    head, rare = counts[:1500], counts[1500:]
    model = lm.Model([(str(k).encode(), int(n)) for k, n in enumerate(head)], int(counts.sum()), len(counts))
    tail = lm.Tail([(int((rare == n).sum()), float((n + 1) * (rare == n).sum())) for n in sorted(set(rare.tolist()), reverse=True)])
    f = lambda n: lm.features(np.full(n, 3), np.full(n, 5))
    others, ranks = np.arange(len(head) - model.n_out + 1), np.arange(len(rare))
    share = (counts[model.n_out :] + 1) / (model.rest - 1)
    for trained in (False, True):
        if trained:
            for table in (model.w, model.u, model.v, tail.t):
                table[:] = rng.normal(0, 0.3, table.shape)
        own, deep = np.exp(lm._other(model, f(len(others)), others)[0]), np.exp(lm._rare(tail, f(len(ranks)), ranks)[0])
        p = np.concatenate([own[:-1], own[-1] * deep])
        assert p.sum() == pytest.approx(1, abs=1e-4)
        if not trained:  # without weights the trees give the smoothed frequencies
            assert np.allclose(p, share, rtol=1e-3)
