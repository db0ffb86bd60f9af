"""Operators against plain versions over the smallest tables, and the SQL of those that have it."""

import json
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import decontaminate, html, linededup, lm, packing, quality, rules, secrets, simhash, sql, suffixdedup
from rasterloom.llm.queries import queries, tokenizer_path

from ..compare import check, connect


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").repartition(4).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return dict(docs.select("doc_id", "text").collect())


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_sql(spark, data, name):
    check(spark, connect(data), data, queries()[name], sql.oracle_sql()[name])


def test_all_queries_are_registered():
    assert [n.split("_")[0] for n in queries()] == [f"op{k}" for k in range(1, 11)]


def groups(items, close):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in close:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in items}


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b, n in enumerate(counts) if 2 * n > len(shingles))


def test_fingerprints(texts):
    for t in list(texts.values())[:60]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_masks_cover_every_pair():
    masks = simhash.masks(list(range(64)))
    assert len(masks) == 7 and all(any(not (m >> i & 1 or m >> j & 1) for m in masks) for i in range(64) for j in range(64))


def test_buckets_are_bounded():
    assert max(64 - bin(kept).count("1") for path, kept in simhash._tree(3).items() if len(path) == 3) == 6


@pytest.mark.parametrize("dense", [256, 3])
def test_components(spark, dense):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = [int(c) for c in centres for _ in range(25)]
    fps = [f ^ sum(1 << int(b) for b in rng.integers(0, 64 if k % 3 else 9, rng.integers(0, 4))) for k, f in enumerate(fps)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    distinct = {}
    for i, f in enumerate(signed):
        distinct.setdefault(f, i)
    from rasterloom.llm.common import Scratch
    from rasterloom.llm.components import components

    scratch = Scratch(spark, "test")
    frame = spark.createDataFrame([(f, n) for f, n in distinct.items()], "fp long, node long")
    found = dict(components(scratch.cut(simhash.links(frame, scratch, dense).distinct()), scratch).collect())
    nodes = list(distinct.values())
    want = groups(nodes, [(a, b) for a in nodes for b in nodes if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2])
    assert {n: found.get(n, n) for n in nodes} == want


def test_long_chain_is_one_component(spark):
    from rasterloom.llm.common import Scratch
    from rasterloom.llm.components import components

    edges = spark.range(300).select(((F.col("id") * 7) % 307).alias("a"), ((F.col("id") * 7 + 7) % 307).alias("b"))
    found = components(edges, Scratch(spark, "test")).collect()
    assert {r.root for r in found} == {0} and len(found) == 300


def test_near_duplicates(docs, texts):
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: simhash.fingerprint(t) for i, t in texts.items()}
    ids = sorted(fps)
    want = groups(ids, [(a, b) for a in ids for b in ids if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2])
    assert {i: (f % (1 << 64), c) for i, (f, c) in got.items()} == {i: (fps[i], want[i]) for i in ids}


def check_packing(pieces, texts, capacity=4096):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        own = sorted(by_doc[i], key=lambda p: p.start)
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own[:-1]])) and {p.doc_tokens for p in own} == {len(ids) // 4}
        assert [p.ids_crc32 for p in own] == [zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) for p in own]
    waste = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0] + [p.length for p in own[:-1]]))
        n = sum(p.length for p in own)
        assert n <= capacity
        waste += 0 if n & (n - 1) == 0 else capacity - n
    return waste


def test_pack(docs, texts):
    got = packing.pack(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids").collect()
    assert check_packing(got, texts) <= 4096 * docs.rdd.getNumPartitions()


def test_word_ids_of_odd_words():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    odd = ["don't", "I'LL", "x'sy", "Éa", "éa", "İx", "ΣΑΣ", "a<|endoftext|>b", "12a3", "ª²³¼", "a\tb", "a b", "日本", "\x00", "ß", "ÀÉ!!", "--..--", "'", "ŉx", "İ", "ǅ", "a​b", "<|x", "ſ's", "\x1c", " x", "#a_b-c"]
    for w in odd:
        assert packing.word_ids(tokenizer_path()).encode(w) == np.array(whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes(), w


def test_costs_are_balanced():
    rng = np.random.default_rng(3)
    pieces = [(k, 0, int(n)) for k, n in enumerate(rng.integers(1, 4096, 3000))]
    out = packing.pack_block(pieces, 4096)
    assert sum(n for s in out for *_, n in s) == sum(p[2] for p in pieces)
    full = [sum(n for *_, n in s) for s in out]
    assert all(n == 4096 for n in full[:-1])


def test_line_dedup(docs, texts):
    keys = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r")) for x in t.split("\n")]
    seen = {}
    for i, t in texts.items():
        for k in set(keys(t)):
            seen.setdefault(k, set()).add(i)
    gone = {k: min(v) for k, v in seen.items() if len(k) >= 10 and len(v) >= 2}
    for r in linededup.line_dedup(docs).collect():
        lines = texts[r.doc_id].split("\n")
        kept = [x for x, k in zip(lines, keys(texts[r.doc_id]), strict=True) if gone.get(k, r.doc_id) == r.doc_id]
        assert (r.text, r.n_lines, r.n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))


def plain_rules(text):
    words = [w.decode() for w in (text or "").encode().split()]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_rules(spark, data, docs, texts):
    extra = {-1: "a b c a b c", -2: "x x x x x", -3: "a b c d\na b c d\n\n\t\na b c d", -4: "p q\x0br\x1cs | <*>"}
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    got = rules.quality_rules(more)
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_rules((texts | extra)[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_em_against_plain_numpy(spark):
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.8
    votes = np.stack([np.where(rng.random(4000) < 0.3, 0, np.where(rng.random(4000) < a, 1, -1) * np.where(good, 1, -1)) for a in (0.9, 0.85, 0.8, 0.75)], 1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = rules.fit(spark.createDataFrame([(p.tolist(), int(k)) for p, k in zip(patterns, n, strict=True)], "v array<int>, n long"), 4)
    p = 1 / (1 + np.exp(-(rules.FIRST[0] + rules.FIRST[1] * (patterns == 1).sum(1) - rules.FIRST[2] * (patterns == -1).sum(1))))
    for _ in range(rules.ROUNDS):
        both = [[[((w * n)[patterns[:, j] == x].sum() + 1) / ((w * n).sum() + 3) for x in (-1, 0, 1)] for j in range(4)] for w in (p, 1 - p)]
        prior = ((p * n).sum() + 1) / (n.sum() + 2)
        odds = np.log(prior / (1 - prior)) + sum(np.log(np.array(both[0][j])[patterns[:, j] + 1] / np.array(both[1][j])[patterns[:, j] + 1]) for j in range(4))
        p = 1 / (1 + np.exp(-odds))
    assert model.prior == pytest.approx(prior, abs=1e-3) and np.abs(np.array(model.good) - both[0]).max() < 5e-3
    assert abs(model.prior - good.mean()) < 0.1


def remainder(n):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.classify(d, labels, learn=remainder(3) != 1).join(labels, "doc_id").where(remainder(3) == 1).toPandas()
    good, bad = got.score[got.quality == 1].values, got.score[got.quality == 0].values
    assert (good[:, None] > bad[None]).mean() > 0.9
    assert abs(got.score.mean() - (got.quality == 1).mean()) < 0.1  # calibrated


def test_network_gradients_and_temperature():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    net = quality.train(x, y)
    assert ((net.probability(x) > 0.5) == y).mean() > 0.9 and 0.25 <= net.temperature <= 8


def plain_suffix(texts, size):
    seen = Counter(d[k : k + size] for d in texts.values() for k in range(len(d) - size + 1))
    out = {}
    for i, d in texts.items():
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - size + 1):
            if seen[d[k : k + size]] > 1:
                gone[k : k + size] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(d), int(gone.sum()), runs, bytes(np.frombuffer(d, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("dense", [800, 1])
def test_suffix(docs, texts, dense):
    want = plain_suffix({i: t.encode() for i, t in texts.items()}, 400)
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.starts), bytes(r.kept)) for r in suffixdedup.suffix_dedup(docs, dense=dense).collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_suffix_of_repetitive_texts(spark, seed):
    rng = np.random.default_rng(seed)
    made = {k: "".join(rng.choice(list("ab\x00é"[: 2 + seed]), int(rng.integers(0, 90)))) for k in range(40)} | {100: "a" * 70, 101: "ab" * 30}
    frame = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    want = plain_suffix({i: t.encode() for i, t in made.items()}, 8)
    got = suffixdedup.suffix_dedup(frame, size=8, gram=5, dense=30, block_bytes=300)
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.starts), bytes(r.kept)) for r in got.collect()} == want


def test_secrets(docs, texts):
    import re

    kinds = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    for r in secrets.scan(docs).collect():
        want = []
        for kind, p in kinds.items():
            for m in re.finditer(p, texts[r.doc_id], re.I | re.A if kind == "assign" else 0):
                if len(m[2] if kind == "assign" else m[0]) >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                    want.append((m.start(), list(kinds).index(kind), kind, m.end()))
        got = [(k, s, e) for k, s, e in zip(r.kinds, r.starts, r.ends, strict=True) if k != "model"]
        assert got == [(k, s, e) for s, _, k, e in sorted(want)]


def test_secret_models_tell_random_from_ordinary(docs):
    import random

    ordinary, made = secrets.ordinary_model(docs), secrets.random_models()
    draw = random.Random(99)
    score = lambda s: secrets.ratio(s, made, ordinary)
    keys = ["".join(draw.choices(a, k=32)) for a in secrets.RANDOM for _ in range(50)]
    words = [w for r in docs.limit(50).collect() for w in r.text.split() if w.isalpha() and w.isascii() and len(w) > 12]
    assert np.mean([score(k) > secrets.MIN_RATIO for k in keys]) > 0.95 and np.mean([score(w) > secrets.MIN_RATIO for w in words]) < 0.02


def test_lm(docs, texts):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: [*"".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split(), b"\n"] for i, t in texts.items()}
    seen = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, distinct = sum(seen.values()), len(seen)
    got = lm.score(docs, remainder(7) != 2).collect()
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in seen for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 1) / (total + distinct + 1)) for w in ws), rel=1e-9)
    own = [r for r in got if held[r.doc_id]]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)  # the model beats the unigrams on held-out text


def test_lm_rare_tokens_are_joined(docs, monkeypatch):
    cols = ["doc_id", "n_known", "base_score"]
    want = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm.score(docs, remainder(7) != 2, rounds=1).select(cols).collect()}
    monkeypatch.setattr(lm, "HEAD", 50)
    assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm.score(docs, remainder(7) != 2, rounds=1).select(cols).collect()} == want


def test_lm_is_a_distribution():
    head = [(bytes([97 + k]), 50 - k) for k in range(20)]
    model = lm.Model(head, sum(n for _, n in head) + 30, 40)
    rng = np.random.default_rng(0)
    model.w[:], model.u[:] = rng.normal(0, 0.3, model.w.shape), rng.normal(0, 0.3, model.u.shape)
    outputs = np.array([0, *range(lm.PER_CLASS, lm.PER_CLASS + 20)])
    f = lm.features(np.full(len(outputs), 3), np.full(len(outputs), 5))
    total = np.exp(lm._forward(model, f, outputs)[0]).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_html_suffix_array():
    streams = [f"Read all of our daily news in one place\x1eunique {k} text of page {k} that only it has" for k in range(5)]
    for s, m in zip(streams, html.repeated(streams, 8, 3, 0.05), strict=True):
        assert html.unique_text(s, m) == s.split("\x1e")[1]
    order, rank = html.suffix_classes(np.array([1, 2, 1, 2, 3]), 2)
    assert rank[0] == rank[2] and rank[1] != rank[3] and rank[order].tolist() == sorted(rank[order].tolist())


def test_html_articles(spark, data):
    import html as std
    import re

    pages = spark.read.parquet(f"{data}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in html.extract(pages).collect():
        body = re.search("<article>(.*?)</article>", raw[r.page_id], re.S)[1]
        want = [" ".join(std.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r.text.replace("\n\n", " ").split() == " ".join(w for w in want if w).split()


def test_pipeline(spark, data):
    """Each stage against a plain version of it, on what its predecessor kept."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    from rasterloom.llm.common import Scratch

    scratch = Scratch(spark, "test")
    now = spark.read.parquet(f"{data}/documents.parquet")
    results = []
    for _, stage in corpus_pipeline.STAGES:
        fresh = scratch.cut(stage(spark, now, data))
        results.append((now, fresh))
        now = fresh
    rows = [({r.doc_id: r.text for r in a.collect()}, {r.doc_id: r.text for r in b.collect()} if "text" in b.columns else b.collect()) for a, b in results]
    a, b = rows[0]
    assert set(b) == {r.doc_id for r in rules.quality_rules(results[0][0]).where("kept").collect()} and all(a[i] == t for i, t in b.items())
    a, b = rows[1]
    assert b == {r.doc_id: r.text for r in linededup.line_dedup(results[1][0]).collect()} and set(a) == set(b)
    a, b = rows[2]
    fps = {i: simhash.fingerprint(t) for i, t in a.items()}
    root = groups(sorted(a), [(x, y) for x in a for y in a if x < y and bin(fps[x] ^ fps[y]).count("1") <= 2])
    assert set(b) == {i for i in a if root[i] == i}
    a, b = rows[3]
    items = [[w for w in decontaminate.words(r.text)] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for w in items for i in range(len(w) - 12)} | {tuple(w) for w in items if 0 < len(w) < 13}
    sizes = {len(w) for w in windows}
    for i, t in a.items():
        w = decontaminate.words(t)
        hit = {p for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        assert (i in b) == (not (hit and 20 * len(hit) >= len(w)))
    check_packing(rows[4][1], rows[4][0])
    assert corpus_pipeline.run(spark, data).count() == len(rows[4][1])


def test_queries_digest(spark, data):
    r = queries()["op7_secrets"](spark, data)
    assert json.loads(r.schema.json())["fields"][0]["name"] == "doc_id"
