"""Batches of candidates leave no phrase out, wherever their bounds fall; rows are told apart by id and text; order of rows is free."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate


@pytest.mark.parametrize("candidates", [1, 2, 3, 4, 6, 12, 1 << 20])
def test_batches_search_every_phrase(monkeypatch, candidates):
    monkeypatch.setattr(decontaminate, "CANDIDATES", candidates)
    (phrases,) = decontaminate.phrase_blocks([(k, f"a{k} b{k}") for k in range(6)], 2)
    text = " ".join(f"a{k} b{k}" for k in range(6))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "tag": [0], "text": [f"{text} {text}"]})
    (segment,) = decontaminate._segments(iter([batch]), 100)
    row = segment.to_pylist()[0]
    k, start, _ = decontaminate._intersect(phrases, decontaminate._Postings(row, phrases), np.array(row["doc_at"]), 0)
    assert sorted(zip(k.tolist(), start.tolist(), strict=True)) == [(i, 2 * i + at) for i in range(6) for at in (0, 12)]


def test_rows_that_share_an_id(spark):
    phrase = " ".join(f"w{k}" for k in range(13))
    docs = spark.createDataFrame([(7, phrase, "p"), (7, "a clean text under the same id", "u"), (None, phrase, "n"), (None, "clean", "m"), (8, None, "o"), (8, "", "e")], "doc_id long, text string, tag string")
    bench = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.tag for r in kept.collect()) == ["e", "m", "n", "o", "u"]


def test_many_blocks_over_rows_in_any_order(spark):
    rows = [(k, " ".join(f"w{(k * 7 + j) % 40}" for j in range(60))) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, F.rand())
    bench = spark.createDataFrame([(k, " ".join(f"w{(k * 11 + j) % 40}" for j in range(9 + k))) for k in range(12)], "item_id long, text string")
    one, many = (decontaminate.contamination(docs, bench, slop=1, block_words=n, segment=200) for n in (1 << 20, 30))
    cols = ("doc_id", "n_words", "n_hit", "item_ids", "near_ids", "contaminated")
    assert sorted(map(tuple, one.select(*cols).collect())) == sorted(map(tuple, many.select(*cols).collect()))


def near_items(text, items, slop, window=13):
    w, out = decontaminate.words(text), set()
    for item, t in items:
        b = decontaminate.words(t)
        for i in range(max(1, len(b) - window + 1) if b else 0):
            g = b[i : i + window]
            for s in range(len(w) - len(g) + 1):
                if all(any(0 <= s + j + d < len(w) and w[s + j + d] == x for d in range(-slop, slop + 1)) for j, x in enumerate(g)):
                    out.add(item)
    return sorted(out)


def test_proximity_against_brute_force(spark):
    draw = np.random.default_rng(5)
    items = [(k, " ".join(f"t{x}" for x in draw.integers(0, 9, 16))) for k in range(6)]
    rows = []
    for k in range(30):
        w = items[k % 6][1].split()
        if k % 3:
            i = int(draw.integers(0, len(w) - 1))
            w[i], w[i + 1] = w[i + 1], w[i]
        rows.append((k, " ".join([*(f"t{x}" for x in draw.integers(0, 9, k % 4)), *w, *(f"t{x}" for x in draw.integers(0, 9, 3))])))
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), slop=1, segment=70)
    assert {r.doc_id: r.near_ids for r in got.collect()} == {d: near_items(t, items, 1) for d, t in rows}
