"""The n-gram join against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import ngram_join
from tarnlake.llm.near_dedup import components


def sets_of(rows, width=3):
    lower = {i: i + 32 for i in range(65, 91)}
    out = {}
    for i, t in rows:
        w = re.findall("[^\x20\t-\r]+", (t or "").translate(lower))
        out[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    return out


def brute(rows, percent=90):
    sets = sets_of(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            same = len(x & y)
            if x and y and 100 * same >= percent * (len(x) + len(y) - same):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def family(seed, n=260):
    """Documents that are up to a sixteenth of their words from a few bases, shared passages, unrelated ones."""
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(2000)]
    bases = [[r.choice(vocab) for _ in range(r.choice((12, 40, 150)))] for _ in range(4)]
    rows = []
    for i in range(n):
        if r.random() < 0.75:
            w = list(r.choice(bases[:2]))
            for _ in range(r.randrange(0, 2 + len(w) // 16)):
                j, how = r.randrange(len(w)), r.random()
                if how < 0.6:
                    w[j] = r.choice(vocab) if r.random() < 0.6 else f"V{r.randrange(5)}"
                elif how < 0.8 and len(w) > 1:
                    del w[j]
                else:
                    w.insert(j, r.choice(vocab))
        else:
            w = [r.choice(vocab) for _ in range(r.randrange(0, 30))] + bases[2][: r.randrange(40)]
        rows.append((i, r.choice((" ", "  ", "\n")).join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two")]


@pytest.mark.parametrize(("seed", "rounds"), [(1, 0), (5, 1)])
def test_equals_all_pairs(spark, seed, rounds):
    rows = family(seed, 260 if seed == 1 else 400)
    docs = spark.createDataFrame([(*x, "?") for x in rows], "doc_id int, text string, token string").repartition(3)
    assert sorted(map(tuple, ngram_join.join(docs, rounds=rounds).collect())) == brute(rows)


def test_prefixes_hold_the_matches_that_links_need(spark):
    """Every linked pair shares as many members of the adaptive prefixes as the smaller of its two k."""
    sets = {i: s for i, s in sets_of(family(5, 400)).items() if s}
    distinct = {}
    for i, s in sets.items():
        distinct.setdefault(frozenset(s), i)
    rows = [(i, i, len(s), hash_ & 0x7FFFFFFFFFFF) for s, i in distinct.items() for hash_ in map(hash, s)]
    prefix = ngram_join.prefixes(spark.createDataFrame(rows, "node long, part long, n long, token long"), 90).toPandas()
    held = {n: (set(g.token), g.k.iloc[0]) for n, g in prefix.groupby("node")}
    linked = checked = 0
    for s, a in distinct.items():
        for t, b in distinct.items():
            if a < b and 100 * len(s & t) >= 90 * len(s | t):
                linked += 1
                assert a in held and b in held
                checked += len(held[a][0] & held[b][0]) >= min(held[a][1], held[b][1])
    assert linked == checked > 500


def test_screen_keeps_what_links():
    for n in range(1, 300):
        found = np.arange(n, dtype=np.uint64)
        assert 1 <= len(ngram_join.screened(found, 90)) <= n


def test_rows_of_one_id_nulls_and_names(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long), (2, long + " x"), (None, long), (None, long), (5, long), (5, "other text here"), (6, "other text here"), (1, long), (9, "alone")]
    got = sorted(map(str, ngram_join.join(spark.createDataFrame(rows, "id long, body string").withColumn("node", F.lit(1)), id_col="id", text="body").collect()))
    ids = {r: c for r, c in ((x.split("doc_id=")[1].split(",")[0], x.split("component_id=")[1].rstrip(")")) for x in got)}
    assert len(got) == len(rows) and ids == {"1": "1", "2": "1", "5": "1", "6": "1", "9": "9", "None": "None"}
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_large_family_gives_few_pairs(spark):
    """Documents a few words from one text, most of them too far from each other: pairs follow the differences they share."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(700):
        w = list(base)
        for j in r.sample(range(len(w)), r.randrange(1, 6)):
            w[j] = f"own{i}x{j}" if r.random() < 0.9 else f"shared{j}"
        rows.append((i, " ".join(w)))
    sets = sets_of(rows)
    docs = spark.createDataFrame([(i, ngram_join.shingles(ngram_join.words_of(t), ngram_join._Words(), 3).tobytes()) for i, t in rows], "node long, held binary")
    met = docs.select(F.lit(0).cast("long").alias("hub"), "node", F.col("node").alias("label"))
    from tarnlake.llm.differences import pairs_apart

    pairs = {tuple(p) for p in pairs_apart(met, docs, 90).collect()}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])
    links = {(a, b) for b in range(700) for a in range(b) if near(a, b)}
    assert all(p in pairs or near(0, p[0]) and near(0, p[1]) or 0 in p for p in links) and len(links) > 50, (len(links), len(pairs))
    assert any(not (near(0, a) and near(0, b)) for a, b in links)
    assert len(pairs) < 2 * len(links)  # of 244650
