"""Toxicity and language ID: held-out accuracy, counterfactuals, exact code lengths."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tarnlake.llm import common, language_id, queries, toxicity


def test_toxicity_held_out(spark, sf_dir):
    got = queries.op6_toxicity(spark, "/root/testdata/sf0.01").join(queries.table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "toxic"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 50 and ((held.predicted == held.toxic).mean()) > 0.9
    assert got.score.between(0, 1).all()


def test_toxicity_scores_are_the_model(spark, sf_dir):
    """Scores recomputed from the weights, word by word."""
    import re

    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"))
    assert len(model.weights) > 100
    for r in toxicity.score(docs, model, column="score").collect():
        held = set()
        for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
            held |= {w, f"*{w[-4:]}" if len(w) > 4 else w, *(f"{w[:n]}*" for n in (3, 4, 5, 6) if len(w) > n)}
        z = model.bias + sum(x for f, x in model.weights.items() if f in held)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_counterfactuals_free_groups_of_blame():
    rng = random.Random(1)
    neutral = ["market", "city", "music", "garden", "school"]
    rows = []
    for _ in range(300):
        w = rng.choices(neutral, k=6)
        toxic = rng.random() < 0.4
        if toxic:
            w.append(rng.choice(["scum", "idiot"]))
        if rng.random() < (0.7 if toxic else 0.1):
            w.append("muslim")
        rows.append((" ".join(w), int(toxic)))
    texts, labels = [t for t, _ in rows], np.array([y for _, y in rows])
    names = [*neutral, "scum", "idiot", *[t for g in toxicity.IDENTITY_TERMS for t in g]]
    plain = toxicity.fit_weights(names, texts, labels, counterfactual=0.0)
    fair = toxicity.fit_weights(names, texts, labels, counterfactual=10.0)
    mention = "the muslim garden school"
    assert fair.score(mention) < plain.score(mention) and fair.score("scum city") > 0.5 > fair.score(mention)
    assert abs(fair.weights.get("muslim", 0) - fair.weights.get("christian", 0)) < 0.3 * abs(plain.weights.get("muslim", 0))


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "idiot " * 50000, "x"), (3, "idiot " * 50000, "x"), (None, "fine", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1), (3, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model, column="score").count() == 5
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r.s for r in toxicity.score(docs, empty, column="score").select(toxicity.predicted("score").alias("s")).collect()} == {0}
    assert toxicity.reject_toxic(docs, labels.limit(0)).columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0


def slow_bits(counts: dict, lang: str, data: bytes) -> float:
    """The code length of the bytes after the padding by the definition."""
    total = 0.0
    for i in range(len(language_id._PAD), len(data)):
        p = 1.0
        for k in range(language_id.ORDERS - 1, -1, -1):
            ctx = data[i - k : i]
            seen = {x[-1]: c for x, c in counts[lang].items() if len(x) == k + 1 and x[:-1] == ctx}
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                p *= seen[data[i]] / (n + d)
                break
            p *= d / (n + d)
        else:
            p /= 256
        total -= math.log2(p)
    return total


def test_code_lengths_are_exact(spark):
    rows = [("en", "the cat sat on the mat"), ("fr", "le chat est sur le tapis"), ("en", "a hat"), ("fr", "été")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = language_id.fit(docs)
    counts: dict = {"en": {}, "fr": {}}
    for lang, text in rows:
        data = language_id._PAD + text.encode()
        for i in range(len(language_id._PAD), len(data)):
            for k in range(language_id.ORDERS):
                x = data[i - k : i + 1]
                counts[lang][x] = counts[lang].get(x, 0) + 1
    for text in ("the hat", "le tapis", "zzz été", "été 中"):
        got = model.bits([language_id.padded(text)])[0]
        want = [slow_bits(counts, lang, language_id._PAD + text.encode()) for lang in model.langs]
        assert np.allclose(got, want, atol=1e-3)


def test_many_languages_are_all_learned(spark):
    """Three hundred languages with letters of their own: each is learned and told, and the model follows the sample."""
    rng = random.Random(2)
    own = [["".join(rng.choices("abcdefghijklmnop", k=4)) for _ in range(12)] for _ in range(300)]
    rows = [(f"l{i:03d}", " ".join(rng.choices(words, k=60))) for i, words in enumerate(own) for _ in range(3)]
    docs = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "doc_id long, lang string, text string")
    for chars in (24_000_000, 3_000):
        model = language_id.fit(docs, all_chars=chars)
        assert model.langs == sorted({x for x, _ in rows})
        entries = sum(len(x.lang) for x in [*model.strings, *model.escapes])
        assert entries < 8 * sum(len(t) + 1 for _, t in rows)
        told = {r.doc_id: r.guess.lang for r in language_id.identify(docs, model).collect()}
        assert sum(told[k] == x for k, (x, _) in enumerate(rows)) > 0.95 * len(rows)
    assert language_id.build(pd.DataFrame([("a", n, 32, 1) for n in range(1, 5)], columns=["lang", "n", "code", "count"])).bits([language_id.padded("a b")]).shape == (1, 1)


def test_language_held_out_and_edges(spark):
    got = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "12 !?", None), (4, "ok " * 50000, "a"), (4, "ok", "a")], "doc_id long, text string, guess string")
    model = language_id.build(pd.DataFrame([("a", n, 32, 1) for n in range(1, 5)], columns=["lang", "n", "code", "count"]))
    out = language_id.identify(docs, model).collect()
    assert sorted(r.guess.lang for r in out) == ["a", "a", "und", "und", "und"]
    assert {r.guess.lang for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None


def test_crc_folds(spark):
    import zlib

    rows = spark.createDataFrame([(x,) for x in (0, 5, 12345, None)], "id long").select("id", common.crc_mod(F.col("id"), 5).alias("m")).collect()
    assert all(r.m == zlib.crc32(("" if r.id is None else str(r.id)).encode()) % 5 for r in rows)
