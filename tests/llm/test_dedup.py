"""Near duplicates, line runs, chats and the pipeline against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tarnlake.llm import chats, common, line_dedup, near_dedup, toxicity


def shingle_set(text):
    w = near_dedup.words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            label[y] = x
    return {i: find(i) for i, _ in rows}


def corpus(seed, families=6, each=25, noise=40):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(3, 90))) for _ in range(noise)]
    for _ in range(families):
        base = rng.choices(vocabulary, k=80)
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += [texts[0], texts[-1].upper(), texts[-1], "one two", "one two", "ONE\ttwo"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_components_match_brute_force(spark):
    rows = corpus(1)
    got = near_dedup.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingle_set(t)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_last_pairs_find_links_that_hubs_miss(spark):
    rows = corpus(2, families=2, each=60, noise=5)
    got = near_dedup.group(spark.createDataFrame(rows, "doc_id long, text string"), hubs=0).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)


def test_near_dedup_edges(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 2), (3, " \n", "x", 3), (4, "a b c d e f", "x", 4), (4, "a b c d e f", "x", 4), (None, "a b c d e f", "x", 5), (5, "long " * 50000, "x", 6), (6, "q r s t u v", None, 7), (4, "q r s t u v", None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, node int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.group(docs).collect()), key=str)
    assert len(got) == len(rows)
    assert (1, 0, 1, True) in got and (3, 0, 3, True) in got and (None, 2, None, True) in got and (6, 2, 4, False) in got
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "4", "4", "5", "None"]
    assert near_dedup.group(docs.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    a, b = np.arange(0, 3000, dtype=np.uint64), np.arange(1000, 4000, dtype=np.uint64)
    mix = lambda x: near_dedup._mixed(x + np.uint64(1))
    for x, y, j in ((a, b, 0.5), (a[:20], a[4:20], 0.8), (a[:1], a[:1], 1.0), (a, a[:2400], 0.8), (a, b[2000:], 0.0)):
        sa, sb, both = (near_dedup.sketch(mix(z), 512) for z in (x, y, np.union1d(x, y)))
        assert (near_dedup.merge(sa, sb) == both).all()
        assert abs(near_dedup.likely(sa, sb, len(x), len(y)) - j) < 0.1


def test_registers_hold_the_smallest_points():
    import math

    found = near_dedup._mixed(np.arange(40, dtype=np.uint64))
    least = [math.inf] * 64
    for x in found.tolist():
        t = 0.0
        for k in range(1, 4000):
            h = int(near_dedup._mixed(np.array([(x + k * int(near_dedup._MIX)) % 2**64], dtype=np.uint64))[0])
            t += -math.log((h >> 11) * 2.0**-53 + 2.0**-54) / 64
            if t > 3:
                break
            least[(h & 2047) * 64 >> 11] = min(least[(h & 2047) * 64 >> 11], t)
    want = [math.floor(1 - math.log(t / near_dedup.RATE) / math.log(near_dedup.BASE)) for t in least]
    assert abs(near_dedup.sketch(found, 64).astype(int) - want).max() <= 1 and (near_dedup.sketch(found, 64) == want).mean() > 0.95


def test_components_stop_loudly(spark):
    import pytest

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    with pytest.raises(RuntimeError, match="still change"):
        near_dedup.components(edges, most=1)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1000] == got[1001] == 1000


PASSAGE = "A long passage that many documents share stands here. It has more than fifty words in all. So it goes on and on with sentences of some length each. None of them means much. They only fill the space that such a passage needs to be found by its chunks. And here it ends at last."


def own_words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))


def test_shared_passages_go_but_for_the_first(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(40):
        head, tail = own_words(rng, 30).capitalize() + ".", own_words(rng, 25).capitalize() + "."
        text, rest = [(f"{head}\n{PASSAGE}\n{tail}", f"{head}\n{tail}"), (f"{head} {PASSAGE}", f"{head} "), (f"{head}\nAll rights reserved.\n{tail}", None), (f"{head[:-1]} {PASSAGE} {tail.lower()}", f"{head[:-1]} {tail.lower()}")][i % 4]
        rows.append((i, text))
        want[i] = rest if rest and i else text
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), removed="runs").collect()}
    for i, text in rows:
        assert got[i].text.split() == want[i].split() and bool(got[i].runs) == (want[i] != text)


def plain_lines(text):
    import re

    import xxhash

    out = []
    for line in re.findall(r"(?s)(?=.)[^\n.!?。]*+(?:[.!?](?! )[^\n.!?。]*+)*+(?:[.!?] |[\n。]|\Z)", text):
        if len(line.encode()) <= 300:
            out.append(line)
            continue
        now = ""
        for w in filter(None, re.split(r"(?<= )", line)):
            now += w
            if xxhash.xxh64_intdigest(w.rstrip(" ").encode(), seed=42) % 4 == 0:
                out.append(now)
                now = ""
        out += [now] if now else []
    return out


def test_lines_are_whole(spark):
    from pyspark.sql import functions as F

    texts = ["One two. Three!\nFour? Five 。six\n\nlast \x01 mark", "x. " * 2000, "." * 300_000, "a b " * 400, "word" * 1000 + " " * 500, "\r\n\x02 \u2028.", "。。!", ". . .", " ", "no end"]
    for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", line_dedup.lines(F.col("text")).alias("l")).collect():
        assert "".join(r.l) == r.text and list(r.l) == plain_lines(r.text)


def plain_dedup(rows, least=120):
    """The definition, document by document and byte by byte."""
    import xxhash

    def signed(n):
        return n - (1 << 64) if n >> 63 else n

    def of_number(n, seed=42):
        return xxhash.xxh64_intdigest(n.to_bytes(8, "little", signed=True), seed=seed)

    cut = {i: plain_lines(t) for i, t in rows if t}
    found, first, several = {}, {}, {}
    for i, c in sorted(cut.items()):
        long = [len(x.encode()) >= 80 for x in c]
        h = [signed(xxhash.xxh64_intdigest(x.encode(), seed=42)) & -2 | b for x, b in zip(c, long)]
        roll = [signed(of_number(x) if b else of_number(h[k + 1], of_number(x))) if b or k + 1 < len(h) else None for k, (x, b) in enumerate(zip(h, long))]
        for k, x in enumerate(roll):
            before, behind = roll[k - 1] if k else None, roll[k + 1] if k + 1 < len(roll) else None
            if x is not None and (long[k] or before is not None and x <= before or behind is not None and x < behind or len(h) == 2):
                found.setdefault(i, []).append((x, k))
                if first.get(x, (i,))[0] == i:
                    first[x] = i, k  # the last place in its first document
                several[x] = i
    out = {i: t for i, t in rows}
    for i, own in found.items():
        meets = {}
        for x, k in own:
            if first[x][0] != i and several[x] != first[x][0]:
                meets.setdefault((first[x][0], first[x][1]), k)
        chains = {}
        for (j, there), k in sorted(meets.items(), key=lambda m: m[1]):
            runs = chains.setdefault((j, k - there), [])
            if runs and k - runs[-1][1] <= 8:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        gone, behind, before = set(), {}, {}
        for (j, shift), runs in chains.items():
            same = lambda k: 0 <= k < len(cut[i]) and 0 <= k - shift < len(cut[j]) and cut[i][k] == cut[j][k - shift]
            for lo, hi in runs:
                lo, hi = max(lo - 3, shift, 0), hi + 4
                k = lo
                while k <= hi:
                    n = k
                    while n <= hi and same(n):
                        n += 1
                    if n > k:
                        edge = lambda e: (cut[i][e], cut[j][e - shift]) if lo <= e <= hi and e < len(cut[i]) and 0 <= e - shift < len(cut[j]) else ("", "")
                        a, b = (x[::-1] for x in edge(k - 1))
                        back = len(a[: words_alike(a, b)].rstrip(" \t\n\x0b\f\r"))
                        ahead = words_alike(*edge(n))
                        size = len("".join(cut[i][k:n]).encode()) + back + ahead
                        if size >= least and (n - k > 1 or back or ahead):
                            gone |= set(range(k, n))
                            before[k - 1], behind[n] = max(before.get(k - 1, 0), back), max(behind.get(n, 0), ahead)
                    k = max(n, k + 1)
        out[i] = "".join(x[behind.get(k, 0) : max(behind.get(k, 0), len(x) - before.get(k, 0))] for k, x in enumerate(cut[i]) if k not in gone)
    return out


def words_alike(a, b):
    """Characters that both begin with, up to the end of a word in both."""
    import os

    n = len(os.path.commonprefix([a, b]))
    if all(not x[n : n + 1] or x[n : n + 1] in " \t\n\x0b\f\r" for x in (a, b)):
        return n
    while n and a[n - 1] not in " \t\n\x0b\f\r":
        n -= 1
    return n


def test_line_dedup_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(12)
    pool = [" ".join(rng.choices(["ba", "ceé", "di", "fo"], k=rng.choice([1, 2, 3, 9, 20, 90]))).capitalize() + rng.choice([".", "!", "?"]) for _ in range(60)]
    shared = [rng.choices(pool, k=rng.randrange(2, 12)) for _ in range(6)]
    for i in range(80):
        parts = [rng.choices(pool, k=rng.randrange(5)), rng.choice(shared), [rng.choice(pool)], rng.choice(shared)[1:]]
        rows.append((30_000 + i, "".join(x + rng.choice([" ", " ", "\n", "\n\n", " \n \n"]) for p in parts for x in p)))
    rows += [(10_000 + i, f"{t[:200]}\n\n{PASSAGE}\n{t[200:400]}. {PASSAGE}") for i, t in rows[:30]] + [(20_000, "a\x01b. c\n" * 9), (20_001, "a\x01b. c\n" * 9), (20_002, "\n \n"), (60, "a\n" * 300), (61, "b\n" + "a\n" * 130)]
    rows = list(dict(rows).items())
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_dedup(rows)
    assert {r.doc_id: r.text for r in got} == want
    assert sum(len(t) for t in want.values()) < 0.9 * sum(len(t) for _, t in rows)


def test_bytes_decide(spark):
    rows = [(1, PASSAGE + "   "), (2, PASSAGE + " \n"), (3, PASSAGE.replace(". ", ".\n")), (4, PASSAGE.replace("long", "1ong")), (5, PASSAGE.upper())]
    single = "One sentence alone that is longer than any limit " * 4 + "ends."
    rows += [(6, single + "   "), (7, single + " \n")]
    got = {r.doc_id: r.text for r in line_dedup.drop_emptied(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1] and got[5] == rows[4][1] and got[6] == rows[5][1] and got[7] == rows[6][1]
    assert 2 not in got and got[4] == "A 1ong "


def test_line_dedup_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, PASSAGE, "x"), (3, PASSAGE, "x"), (None, PASSAGE, "x"), (4, PASSAGE, "x"), (5, "word " * 50000, "x"), (6, "a\x02b\n" * 40, "x"), (7, "a\x02b\n" * 40, "x"), (8, "." * 1_000_000, "x"), (9, "\n" * 1_000_000, "x"), (9, "other", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumnsRenamed({"key": "__views"})
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = {}
    for r in out.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[1] == [None] and texts[2] == [""] and texts[3] == [PASSAGE, PASSAGE] and texts[4] == [""] and texts[None] == [""] and texts[5] == ["word " * 50000]
    assert sorted(str(r.doc_id) for r in line_dedup.drop_emptied(docs).collect()).count("4") == 0
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_chats_keep_maximal_conversations(spark):
    rng = random.Random(9)
    rows, logs = [], {}
    for c in range(60):
        n = rng.randrange(1, 9)
        turns = [(t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", None])) for t in range(n)]
        if c > 20 and rng.random() < 0.6:
            base = logs[rng.randrange(20)]
            turns = base[: rng.randrange(1, len(base) + 1)]
        logs[c] = turns
        rows += [(c, *t, "extra") for t in turns]
    rows += rows[:5] + [(None, 0, "user", "lost", "extra"), (None, 1, None, None, "extra")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string")
    logs[None] = [(0, "user", "lost"), (1, None, None)]
    for block in (256, 2):
        got = chats.format_chats(turns, block=block).collect()
        whole = {}
        for r in sorted(got, key=lambda r: r.part):
            whole[r.conv_id] = whole.get(r.conv_id, "") + r.text
        equal = {}
        for c, t in logs.items():
            equal.setdefault(tuple(t), []).append(c)
        want = {}
        for t, ids in equal.items():
            if not any(o[: len(t)] == t and len(o) > len(t) for o in equal):
                first = min((c for c in ids if c is not None), default=None)
                want[first] = "".join(f"<|im_start|>{r or 'unknown'}\n{x or ''}<|im_end|>\n" for _, r, x in t)
        assert whole == want
    assert chats.format_chats(turns.limit(0)).count() == 0


def test_chats_of_equal_turns(spark):
    rows = [(None, None, "user", f"row {k}") for k in range(1000)] + [(7, 3, "user", f"same turn {k}") for k in range(700)] + [(8, 0, "a<|im_end|>", "x<|im_start|>y")]
    got = chats.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block=64).collect()
    by = {}
    for r in got:
        assert r.n_turns <= 64
        by.setdefault(r.conv_id, []).append(r.n_turns)
    assert {k: sum(v) for k, v in by.items()} == {None: 1000, 7: 700, 8: 1} and len(by[None]) == 16
    assert next(r.text for r in got if r.conv_id == 8) == "<|im_start|>a<| im_end|>\nx<| im_start|>y<|im_end|>\n"
    lines = sorted(x for r in got if r.conv_id == 7 for x in r.text.split("<|im_end|>\n") if x)
    assert lines == sorted(f"<|im_start|>user\nsame turn {k}" for k in range(700))


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        from tarnlake.llm import common

        out = common.materialize(stage(spark, docs, sf_dir), "test-stage")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    assert docs.count() < before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_blank_lines_do_not_part_a_passage(spark):
    rng = random.Random(8)
    verse = "\n\n".join(f"Line {k} of a verse that many hold" for k in range(9))
    rows = [(i, f"{own_words(rng, 30)}\n\n{verse}\n \n\n{own_words(rng, 20)}") for i in range(12)] + [(50, f"{own_words(rng, 9)}\n\nLine 1 of a verse that many hold\n\n{own_words(rng, 9)}")]
    got = {r.doc_id: r.text for r in line_dedup.drop_emptied(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert got[i].split() == (text.replace(verse, "") if 0 < i < 50 else text).split()


def test_inline_passages_go_as_a_whole(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghik", k=rng.randrange(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    rows, want, plain = [], {}, {}
    for p in range(30):
        left, passage = 51 + p, []
        while left:
            n = min(left, rng.randrange(4, 14))
            passage.append(sentence(n))
            left -= n
        for copy in range(3):
            head, tail = sentence(20)[:-1] + " ", sentence(15).lower()
            rows.append((10 * p + copy, head + " ".join(passage) + " " + tail))
            want[10 * p + copy] = head + tail if copy else rows[-1][1]
        bare = " ".join(word() for _ in range(90))
        for copy in range(5, 7):
            head, tail = " ".join(word() for _ in range(40)), " ".join(word() for _ in range(40))
            rows.append((10 * p + copy, f"{head} {bare} {tail}"))
            plain[10 * p + copy] = f"{head} {tail}" if copy == 6 else rows[-1][1]
    got = {r.doc_id: r.text for r in line_dedup.drop_emptied(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].split() == t.split() for i, t in want.items())
    assert sum(got[i].split() != t.split() for i, t in plain.items()) <= 1


def test_every_run_of_lines_goes(spark):
    rng = random.Random(21)
    pool = [" ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(rng.choice([1, 2, 5, 9, 14, 30]))) + ".\n" for _ in range(14)]
    rows = [(i, "".join(rng.choices(pool, k=rng.randrange(2, 25)))) for i in range(70)]
    short = ["aa bb.\n", "cc dd ee.\n"] * 20
    rows += [(100, "".join(short)), (101, "x.\n" + "".join(short[:30]) + own_words(rng, 30) + "\n" + "".join(short[3:25]))]
    cut = {i: plain_lines(t) for i, t in rows}
    must = {}
    for i, c in cut.items():
        gone = must[i] = set()
        for j in (j for j in cut if j < i):
            for shift in range(1 - len(cut[j]), len(c)):
                run = []
                for k in range(len(c) + 1):
                    if k < len(c) and 0 <= k - shift < len(cut[j]) and c[k] == cut[j][k - shift]:
                        run.append(k)
                        continue
                    if len(run) > 1 and len("".join(c[x] for x in run).encode()) >= 120:
                        gone.update(run)
                    run = []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, removed="runs", every=True).collect()}
    assert sum(map(len, must.values())) > 300
    for i, c in cut.items():
        went = {k for r in got[i].runs for k in range(r.first, r.last + 1)}
        assert must[i] <= went, (i, sorted(must[i] - went))


def test_a_family_has_few_last_hubs(spark):
    """Buckets that a family fills pick its members in one order, and of its largest component."""
    rng = random.Random(31)
    inside = [(b, n) for b in range(40) for n in sorted(rng.sample(range(60), 40))]
    labels = spark.createDataFrame([(n, 0 if n % 6 else n) for n in range(60)], "node long, label long")
    got = near_dedup._last_hubs(spark.createDataFrame(inside, "bucket long, node long"), labels).collect()
    hubs = [r for r in got if r.picked]
    assert len(got) == len(inside) and len(hubs) == 40 and all(r.label == 0 for r in hubs)
    assert len({r.node for r in hubs}) <= 10


def family_of(seed, n, most):
    rng = random.Random(seed)
    base = [f"v{k}" for k in range(120)]
    out = [base]
    for _ in range(n):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(1, most)):
            w[k] = f"n{rng.randrange(10**6)}"
        out.append(w)
    for w in out[1::5]:  # siblings
        out.append([*w[:60], "own", *w[61:]])
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_pairs_apart_ask_what_the_pair_needs(spark):
    """Of a family whose members lack much in common few pairs are candidates, and all links are among them."""
    from tarnlake.llm import differences

    rows = family_of(5, 240, 14)
    sets = {i: shingle_set(t) for i, t in rows}
    like = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    label = {i: 0 if like(0, i) else i for i in sets}
    met = spark.createDataFrame([(0, i, label[i]) for i in sets], "hub long, node long, label long")
    held = near_dedup.full_sets(spark.createDataFrame(rows, "node long, text string"), 5)
    got = {(r.u, r.v) for r in differences.pairs_apart(met, held, 75).collect()}
    links = {(a, b) for a, b in itertools.combinations(sets, 2) if a and label[a] != label[b] and like(a, b)}
    assert len(set(label.values())) > 20 and links and links <= got
    assert len(got) < 300


def test_a_family_has_few_pairs(spark, monkeypatch):
    """The member that all others are closest to is their hub, so that few pairs are tested."""
    tested, of = [], near_dedup._likely_pairs
    monkeypatch.setattr(near_dedup, "_likely_pairs", lambda pairs, *rest: tested.append(pairs.count()) or of(pairs, *rest))
    rows = [((7 * i + 90) % 151, t) for i, t in family_of(6, 125, 12)]
    got = near_dedup.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)
    assert sum(tested) < 2400


def test_reach_is_the_shortest_run(spark):
    """From each line on the fewest lines, two at least, that have the bytes, whatever the lines' sizes."""
    rng = random.Random(41)
    sizes = [[rng.choice((1, 2, 7, 8, 30, 119, 120, 500)[: rng.choice((2, 4, 8))]) for _ in range(rng.randrange(0, 260))] for _ in range(60)] + [[1] * 300, [130], [60, 60], [119]]
    for least in (1, 2, 3, 16, 17, 120, 129):
        want = []
        for s in sizes:
            shortest = [next((n for n in range(2, len(s) - i + 1) if sum(s[i : i + n]) >= least), None) for i in range(len(s))]
            want.append(shortest)
        got = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "k int, s array<long>").select("k", line_dedup._reach(F.col("s"), least).alias("n")).collect()
        assert [r.n for r in sorted(got)] == want, least


def test_views_are_dealt_by_document(spark):
    """Lines fetched from a keeper that many follow are shuffled once, by the document that they are compared with."""
    passage = "".join(f"Line {k} of a passage that very many documents hold whole.\n" for k in range(40))
    rows = [(i, f"{passage}own {i}\n") for i in range(60)] + [(0, passage + "another text of the first id\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    views = line_dedup._views(docs, line_dedup.chains(docs, every=120), "doc_id", "text")
    plan = views._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc" in plan and plan.count("Aggregate [doc") == 1
    lines = passage.splitlines(keepends=True)
    got = {r.doc: r.views for r in views.collect()}
    assert set(got) == set(range(1, 60))
    # both texts of the first id, each line once
    assert all(sorted(v.theirs for v in vs) == sorted([[*lines, "own 0\n"], [*lines, "another text of the first id\n"]]) and {v.start for v in vs} == {0} for vs in got.values())

def test_a_worker_keeps_one_operators_models():
    """What packing and others keep from task to task is let go of where another operator runs."""
    made = []
    keep = lambda key: common.held(key, lambda: made.append(key) or [key])
    assert keep("a") is keep("a") and made == ["a"]
    keep("b")
    assert list(common._held) == ["b"]
    toxicity._features.func(pd.Series(["some words"]))
    assert not common._held
