"""Collocations against counting everything at once."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tarnlake.llm import collocations


def brute(rows, least, most=2000, share=80):
    f, n = defaultdict(Counter), Counter()
    lower = {i: i + 32 for i in range(65, 91)}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            w = re.findall("[^\x20\t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= share * cand.get(p[i : i + m], a * 10**9)}
        rows = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for i, r in enumerate(sorted(rows)[:most])]
    return sorted(out)


def rows_of(seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(12)] + ["É", "É", "x\x00y", "a-b", "\x1c", "　", "▁"]
    rows = []
    for _ in range(150):
        words = [r.choice(vocab[: r.choice((4, 12, 19))]) + r.choice(("", "", "", ".", ", ", ";", "\n", "?")) for _ in range(r.randrange(0, 40))]
        rows.append((r.choice(("en", "de", None, "und", "")), r.choice((" ", "  ", "\t")).join(words)))
    phrase = "Never Gonna give YOU up"
    rows += [("en", f"{phrase} {r.choice(vocab)}") for _ in range(40)] + [("en", None), (None, ""), ("de", " . , "), ("en", phrase), ("en", phrase)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("least", "shards", "bits"), [(5, 2, 1 << 16), (3, 1, 1 << 16), (4, 5, 1 << 16), (5, 2, 64)])
def test_equals_counting_at_once(spark, least, shards, bits):
    rows = rows_of(least)
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "lang string, text string, rank int").repartition(3)
    got = sorted(map(tuple, collocations.collocations(docs, least=least, shards=shards, filter_bits=bits).collect()))
    assert got == brute(rows, least)


def test_first_of_each_language(spark):
    rows = rows_of(9)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs, least=2, most=5).collect())) == brute(rows, 2, most=5)


def test_texts_are_read_in_blocks():
    """Words read a few bytes at a time are the words of the whole text."""
    text = "a b c d. e f g h i j k a b c d e"
    small, large = collocations.Words("en"), collocations.Words("en")
    spell = lambda table, ids: [table.names[i] if i >= 0 else None for i in ids]
    assert spell(small, small.ids([text, "x"], block=3)) == spell(large, large.ids([text, "x"])) == [w.encode() if w else None for w in ["a", "b", "c", "d", None, *"efghijkabcde", None, "x", None]]


def test_phrases_across_windows(spark):
    """Texts beyond a block's words: phrases that cross from one to the next count once."""
    text = " ".join(f"w{i % 7}" for i in range(60))
    docs = spark.createDataFrame([("en", text)] * 3 + [("de", "w1 w2 w3")], "lang string, text string")
    before, collocations._WINDOW = collocations._WINDOW, 5
    try:
        # the number is read where blocks are made, so it goes along with the function
        ids = collocations.Words("en").ids([text])
        parts = [ids[at : at + 5 + collocations.LONGEST - 1] for at in range(0, len(ids), 5)]
        hashes = np.arange(100, dtype=np.uint64)
        seen = Counter()
        for at, part in enumerate(parts):
            with np.errstate(over="ignore"):
                for length, where, _, _ in collocations.levels(part, hashes, lambda h, b: np.zeros(len(h), np.int64)):
                    seen.update((length, 5 * at + int(p)) for p in where[where < 5])
        assert seen == Counter((k, i) for k in (2, 3, 4) for i in range(60 - k + 1))
    finally:
        collocations._WINDOW = before
    assert sorted(map(tuple, collocations.collocations(docs, least=5).collect())) == brute([("en", text)] * 3 + [("de", "w1 w2 w3")], 5)


def test_exact_scores_of_large_counts(spark):
    """Products beyond 64 bits stay exact."""
    f, l, r = 9 * 10**15 + 7, 9 * 10**15 + 1234567, 10**16 + 3  # noqa: E741
    got = spark.sql(f"SELECT {f}L AS f, {l}L AS l, {r}L AS r").selectExpr("CAST((CAST(f AS DECIMAL(28,0)) * CAST(2000000 AS DECIMAL(10,0))) DIV CAST(l + r AS DECIMAL(20,0)) AS BIGINT) AS s").first().s
    assert int(got) == 2_000_000 * f // (l + r) and 2_000_000 * f > 2**63


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
