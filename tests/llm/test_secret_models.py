"""Recall and precision of model spans on labelled strings that no model was trained on."""

import random
import string

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import secrets

ALPHABETS = {
    "hex": "0123456789abcdef", "upper hex": "0123456789ABCDEF", "base 62": string.ascii_letters + string.digits, "base 64": string.ascii_letters + string.digits + "+/", "base 32": string.ascii_uppercase + "234567",
    "lower and digits": string.ascii_lowercase + string.digits, "lower": string.ascii_lowercase, "upper": string.ascii_uppercase,
}


@pytest.fixture(scope="module")
def models(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    return secrets.random_models(), secrets.ordinary_model(docs)


@pytest.mark.parametrize("name", ALPHABETS)
def test_recall_of_random_strings(models, name):
    draw, hit, n = random.Random(99), 0, 0
    for size in (12, 16, 20, 24, 32, 48, 64):
        for _ in range(60):
            key = "".join(draw.choices(ALPHABETS[name], k=size))
            spans = secrets.model_spans(f"some words {key} after it", [], *models)
            hit += any(min(e, 11 + size) - max(s, 11) >= 0.8 * size for s, e, _ in spans)
            n += 1
    assert hit / n > (0.75 if "hex" in name or name == "lower" else 0.85)


def identifiers(words, n, draw):
    for _ in range(n):
        w = draw.choices(words, k=draw.randint(2, 5))
        yield draw.choice([
            "".join(x.capitalize() for x in w), "_".join(w).lower(), "-".join(w), "/".join(w) + ".html", w[0] + "".join(x.capitalize() for x in w[1:]) + str(draw.randint(0, 9999)), f"{w[0]}_{draw.randint(1, 99999)}",
            f"20{draw.randint(10, 30)}-{draw.randint(10, 12)}-{draw.randint(10, 28)}T{draw.randint(10, 23)}.{draw.randint(10, 59)}", "_".join(w).upper(), f"/{w[0]}/{w[1]}/{draw.randint(1, 9999)}.{draw.randint(1, 99)}",
        ])


def test_precision_on_identifiers(spark, data, models):
    texts = [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    words = sorted({w for t in texts for w in t.split() if w.isascii() and w.isalpha()})
    own = list(identifiers(words, 3000, random.Random(5)))
    assert sum(bool(secrets.model_spans(x, [], *models)) for x in own) <= 0.005 * len(own)


def test_planted_secrets_are_found_and_ordinary_texts_left_alone(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("text is not null")
    draw = random.Random(3)
    keys = {k: "".join(draw.choices(ALPHABETS["base 62"], k=24)) for k in range(40)}
    planted = spark.createDataFrame([(k + 10**9, f"We keep the value {key} in a drawer.") for k, key in keys.items()], "doc_id long, text string")
    rows = {r.doc_id: r for r in secrets.scan(docs.unionByName(planted)).select("doc_id", F.filter("found", lambda x: F.length(x) > 0).alias("found"), "kinds").collect()}
    hit = sum(any(len(f) >= 20 and f in key for f in rows[k + 10**9].found) for k, key in keys.items())
    assert hit >= 36
    assert sum("model" in r.kinds for k, r in rows.items() if k < 10**9) <= 0.01 * len(rows)
