"""Decontamination, fingerprints, packing, token counts, licence scans against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from tarnlake.llm import decontaminate, licenses, packing, spotsigs, token_counts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, leak string, extra int")


EDGES = [(1, None, "x", 1), (2, "", "x", 2), (3, "one", None, None), (None, "no id", "x", 3), (4, "Same text", "x", 4), (4, "Same text", "x", 4), (5, "wörd " * 20000, "x", 5)]


def test_leaks_match_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "É", "d1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate([12, 3, 10, 25, 1, 0])] + [(9, None), (0, "a b É")]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randrange(60))).title(), "x", i) for i in range(40)] + EDGES
    for block_chars in (10_000, 20):
        got = decontaminate.find_leaks(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), window=4, block_chars=block_chars).collect()
        assert len(got) == len(docs)
        want = sorted(_leak(t, items, 4) for _, t, _, _ in docs)
        assert sorted((r.leak.n_words, r.leak.n_hit, ",".join(r.leak["items"])) for r in got) == want
        for r in got:
            for s in r.leak.spans:
                assert words(r.text[s.start : s.end]) == words(r.text)[s.first : s.last]


def _leak(text, items, n):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        x = words(body)
        for i in range(max(1, len(x) - n + 1) if x else 0):
            p = x[i : i + n]
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    found.add(str(item))
    return len(w), len(hit), ",".join(sorted(found))


def test_leaks_of_empty_tables(spark):
    docs, items = docs_of(spark, EDGES), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_leaked(docs, items).columns == docs.columns
    assert decontaminate.drop_leaked(docs, items).count() == len(EDGES)
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0


def test_fingerprints(spark):
    rng = random.Random(5)
    body = lambda: " ".join(rng.choice(["the", "of", "une", *[f"w{rng.randrange(500)}" for _ in range(3)]]) for _ in range(200))
    rows = [(i, body(), "x", 0) for i in range(30)] + [(100, None, "x", 0), (101, "", "x", 0), (102, "the " * 50000, "x", 0), (103, "x", "x", 0), (103, "x", "x", 0), (104, "the of and " * 30, "x", 0)]
    from pyspark.sql import functions as F

    docs = docs_of(spark, rows).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("set", spotsigs.signatures(F.col("text")))
    pairs = spotsigs.with_next(docs, ["text", "set"], ranges=7).withColumn("edited", spotsigs.edited(F.col("text"), F.col("next_text")))
    got = pairs.withColumn("edited_set", spotsigs.signatures(F.col("edited"))).withColumn("near", spotsigs.likeness(F.col("set"), F.col("edited_set"))).withColumn("next", spotsigs.likeness(F.col("set"), F.col("next_set"))).collect()
    texts = [t or "" for _, t, _, _ in sorted(rows, key=lambda r: -r[0])]
    want = sorted((t, t[: len(t) - len(t) // 3] + texts[(k + 1) % len(texts)][: len(t) // 3]) for k, t in enumerate(texts))
    assert sorted((r.text, r.edited) for r in got) == want
    assert all(r.set and 0 <= r.near <= 1 and r.set == sorted(set(r.set)) for r in got)
    assert len({r.text for r in got}) == len({tuple(r.set) for r in got})
    long = [r for r in got if len(r.text) > 500 and "w1" in r.text]
    assert sum(r.near for r in long) / len(long) > 0.3 and max(r.next for r in long) < 0.1
    assert spotsigs.with_next(docs.limit(0), ["text"]).count() == 0
    one = spotsigs.with_next(docs.filter("doc_id = 1"), ["text"]).first()
    assert one.next_text == one.text


def plain_signatures(text):
    """The strings behind a fingerprint, word by word."""
    anchors, skipped = ({w for x in lists for w in x.split()} for lists in (spotsigs.ANCHORS, spotsigs.SKIPPED))
    every = words(text)
    kept = [w for w in every if w not in skipped]
    out = set()
    for i, w in enumerate(kept):
        if w in anchors and i + 1 < len(kept) and kept[i + 1] not in anchors:
            content = [x for x in kept[i + 1 :] if x not in anchors][:2]
            if len(content) == 2:
                out.add(f"{w} {content[0]} {content[1]}")
    stretch = " "
    for w in [*kept, None]:
        if w is None or w in anchors:
            at = 80
            while at < len(stretch) and stretch[at] != " ":
                at += 1
            far = stretch[at:].split()
            out |= {" ".join(far[i : i + 3]) + " " for i in range(len(far) - 2)}
            stretch = f"{w} "
        else:
            stretch += f"{w} "
    return out or {" ".join(every[i : i + 3]) + " " for i in range(len(every) - 2)}


def test_signatures_match_the_definition(spark):
    from pyspark.sql import functions as F

    rng = random.Random(41)
    common_words = [w for x in (*spotsigs.ANCHORS, *spotsigs.SKIPPED) for w in x.split()]
    texts = []
    for i in range(120):
        pool = [common_words[:20], common_words, ["w"], []][i % 4] + [f"w{rng.randrange(300)}{'x' * rng.randrange(9)}" for _ in range(60)]
        texts.append(rng.choice([" ", ", ", "\n"]).join(rng.choices(pool, k=rng.choice([0, 2, 4, 9, 40, 150]))).title())
    texts += ["the " * 30_000 + "end of it", "word " * 30_000, "", "|", "of the of", "x" * 200_000]
    rows = list(enumerate(texts))
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i long, text string").select("i", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    want = [(i, x) for i, t in rows for x in plain_signatures(t)]
    hashed = {}
    for r in spark.createDataFrame(want, "i long, x string").select("i", F.hash("x").alias("h")).collect():
        hashed.setdefault(r.i, set()).add(r.h)
    for i, t in rows:
        assert set(got[i]) == hashed[i] if i in hashed else len(got[i]) == 1
        assert got[i] == sorted(set(got[i]))


def test_edits_move_few_signatures(spark):
    from pyspark.sql import functions as F

    rng = random.Random(42)
    tables = [" | ".join(f"cell{rng.randrange(10**6)}" for _ in range(200)) for _ in range(20)]
    prose = [" ".join(rng.choice(["the", "of", "une", f"w{rng.randrange(999)}", f"v{rng.randrange(999)}"]) for _ in range(200)) for _ in range(20)]
    rows = [(t, t[: len(t) - len(t) // 3] + other[: len(t) // 3]) for t in tables + prose for other in (rng.choice(tables), rng.choice(prose))]
    near = spark.createDataFrame(rows, "a string, b string").select(spotsigs.likeness(spotsigs.signatures(F.col("a")), spotsigs.signatures(F.col("b"))).alias("j")).collect()
    assert min(r.j for r in near) > 0.25


def test_similar_matches_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(43)
    base = [[rng.choice(["the", "of", f"w{rng.randrange(200)}", f"v{rng.randrange(200)}"]) for _ in range(rng.choice([4, 30, 120]))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 40])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (None, "the w1 v2"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("set", F.lit("a clash"))
    sets = {r.doc_id: frozenset(r.s) for r in docs.filter("doc_id IS NOT NULL").select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    pairs, members = spotsigs.similar(docs, least=0.75)
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert {r.doc_id: r["class"] for r in members.collect()} == {i: first[s] for i, s in sets.items()}
    want = {}
    for a, i in first.items():
        for b, j in first.items():
            if i < j and len(a & b) >= 0.75 * len(a | b):
                want[i, j] = len(a & b) / len(a | b)
    assert {(r.u, r.v): r.likeness for r in pairs.collect()} == want and len(want) > 20
    assert spotsigs.similar(docs.limit(0))[0].count() == 0


def test_pruned_likeness_and_parts(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        spotsigs.likeness(F.array(*map(F.lit, [1, 2, 3])), F.array(*map(F.lit, [2, 3, 4]))).alias("j"),
        spotsigs.likeness(F.array(F.lit(1)), F.array(*map(F.lit, range(10))), 0.5).alias("pruned"),
        spotsigs.fingerprint(F.array(F.lit(-1), F.lit(10))).alias("f"),
        spotsigs.length_part(F.array(*map(F.lit, range(8))), 0.5).alias("part"),
    ).first()
    assert (row.j, row.pruned, row.f, row.part) == (0.5, 0.0, "FFFFFFFF0000000A", 3)


PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_packing(spark):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(PATH)
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(120))), "x", 0) for i in range(300)] + EDGES + [(6, "a <|endoftext|> b", "x", 0)]
    got = packing.pack(docs_of(spark, rows), PATH, size=64, end_id=0).collect()
    ids = {}
    for doc, text, _, _ in rows:
        ids.setdefault((doc, text), [*exact.encode(text or "", add_special_tokens=False).ids, 0])
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    want = sorted((-1 if d is None else d, k, s, n, zlib.crc32(np.array(ids[d, t][s : s + n], dtype="<u4").tobytes())) for d, t, _, _ in rows for k, (s, n) in enumerate(packing.cut(len(ids[d, t]), 64)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    total = sum(r.length for r in got)
    assert len(by) <= 1.03 * total / 64 + 1
    assert packing.pack(docs_of(spark, rows).limit(0), PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 101): rng.randrange(1, 2000) for _ in range(seed * 20 + 3)}
    made, used = packing.plan(counts, 100), {}
    for lengths, times in made:
        assert sum(lengths) <= 100 and times > 0
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == counts


def fewest(lengths, size):
    """The least number of sequences, by trying every way to add each piece."""
    best = len(lengths)

    def add(i, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(lengths):
            best = len(gaps)
            return
        for g in {*gaps, size}:
            if g >= lengths[i]:
                rest = list(gaps)
                if g in rest:
                    rest.remove(g)
                add(i + 1, sorted([*rest, g - lengths[i]]))

    add(0, [])
    return best


def test_plan_needs_hardly_more_sequences_than_possible():
    rng = random.Random(21)
    over = 0
    for _ in range(60):
        lengths = sorted((rng.randrange(1, 21) for _ in range(9)), reverse=True)
        made = packing.plan({n: lengths.count(n) for n in lengths}, 20)
        over += sum(t for _, t in made) - fewest(lengths, 20)
        assert all(sum(x) <= 20 for x, _ in made)
    assert 0 <= over <= 5
    assert packing.plan({12: 3, 5: 3, 3: 3}, 20) == [((12, 5, 3), 3)]


def test_sums_list_what_fills_a_gap():
    rng = random.Random(22)
    for _ in range(40):
        left = np.array([0] + [rng.randrange(3) for _ in range(14)])
        for gap in range(1, 15):
            want = left[gap] or any(a + b == gap and left[a] > (a == b) and left[b] for a in range(1, 15) for b in range(1, 15))
            want = want or any(left[a] > (a == b) + (a == c) and left[b] > (b == c) and left[c] for a in range(1, 15) for b in range(1, a + 1) for c in range(1, b + 1) if a + b + c == gap)
            found = next(packing.Sums(left.copy()).fill(gap), None)
            assert bool(want) == (found is not None) and (found is None or sum(found) == gap and all(left[x] >= found.count(x) for x in found))


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(PATH)
    ids = lambda t: np.array(exact.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
    rng = random.Random(23)
    alphabet = [chr(i) for i in range(0x250)] + list("  \n\n\t' ' 'std1239aeiou..,,;;") * 12
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(80))) for _ in range(3000)]
    texts += [f"a{chr(i)}1 {chr(i)} {chr(i)}{chr(i)}b" for i in range(0x250)]
    texts += ["", "a <|endoftext|> b", "中文 and ünï", "e\u0301 \u2028 \u3000x", "word " * 1000]
    texts += [" " * 1_000_000, "\n" * 1_000_000, " \n\t" * 300_000 + "x", "a" * 100_000, "y" + " " * 400_000 + "'s"]
    encode = packing.encoder(PATH)
    for i in range(0, len(texts), 500):
        assert encode(texts[i : i + 500]) == [ids(t) for t in texts[i : i + 500]]
    for name in ("word_bpe_49k.json",):
        other, exact = packing.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        assert other(texts[:50]) == [ids(t) for t in texts[:50]]


def test_encoder_holds_little():
    """Beyond its bound an encoder keeps the words it met first, and the library starts no threads in a task."""
    import os
    import subprocess
    import sys

    from tokenizers import Tokenizer

    exact, encode = Tokenizer.from_file(PATH), packing.Encoder(PATH, most=100, keep=10)
    for k in range(30):
        texts = [f"the same words, and {a}{chr(97 + k % 26) * (1 + k // 26)} {a}x{chr(97 + k % 26) * (2 + k // 26)} of its own" for a in "abcdefgh"]
        assert encode(texts) == [np.array(exact.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        first = list(encode.known)[:10] if k == 0 else first
        assert list(encode.known)[:10] == first and len(encode.known) <= 120
    code = f"import os; from tarnlake.llm import packing; e = packing.Encoder({PATH!r}); n = len(os.listdir('/proc/self/task')); e([f'word{{i}} x{{i}}y' for i in range(20000)]); print(len(os.listdir('/proc/self/task')) - n)"
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))).stdout.strip() == "0"


def test_packing_of_long_white_space(spark):
    rows = [(1, " " * 2_000_000, "x", 0), (2, "\n" * 2_000_000, "x", 0), (3, " \n" * 500_000 + "end", "x", 0), *[(None, "same", "x", 0)] * 40]
    got = packing.pack(docs_of(spark, rows), PATH).groupBy("doc_id").sum("length").collect()
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(PATH)
    want = {i: len(exact.encode(t, add_special_tokens=False).ids) + 1 for i, t, _, _ in rows[:3]}
    assert {r.doc_id: r["sum(length)"] for r in got} == want | {None: 40 * (len(exact.encode("same").ids) + 1)}


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_token_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, proven = token_counts.model(path)
    assert proven
    rows = [*EDGES, (7, "ab" * 4000, "x", 0), (8, "a  b\n" * 900, "x", 0), (9, "<s> x </s> " * 300, "x", 0), (10, " " * 3000 + "x y" * 900, "x", 0), (11, "中文 and ünï " * 400, "x", 0)]
    got = token_counts.count_tokens(docs_of(spark, rows), path, chunk=300, overlap=7).collect()
    want = sorted((len((t or "").encode()), len(sp.encode(t)) if t else 0) for _, t, _, _ in rows)
    assert sorted((r.tokens.n_bytes, r.tokens.n_tokens) for r in got) == want


PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def test_licence_places(spark):
    rng = random.Random(11)
    vocabulary = ["MIT", "License", "apache", "general", "public", "x", "é", "licensed", "under", "cc", "by", "nc"]
    rows = [(i, rng.choice([" ", ". ", "\n--"]).join(rng.choices(vocabulary, k=rng.randrange(30))), "x", i) for i in range(80)] + EDGES
    rows += [(200, "Licensed under CC BY-NC 4.0.", "x", 0), (201, "Permission is hereby granted, free of charge, to any person obtaining a copy", "x", 0), (202, "all rights reserved", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licence string, id int")
    got = licenses.scan(docs).collect()
    assert got[0].__fields__ == ["doc_id", "id", "licence"] or set(got[0].__fields__) == {"doc_id", "id", "licence"}
    found = []
    for _, text, _, _ in rows:
        w = words(text)
        at = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)
        found.append((len(w), [i for i, _ in at], sorted({x for _, x in at})))
    assert sorted((r.licence.n_words, list(r.licence.places), list(r.licence.base_labels)) for r in got) == sorted(found)
    assert all(set(r.licence.base_labels) <= set(r.licence.labels) and 0 <= r.licence.score <= 1 for r in got)
    by = {r.doc_id: r.licence for r in got}
    assert by[200].labels == ["cc-by-nc"] and by[201].labels == ["mit"] and by[202].labels == ["proprietary"]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_queries_digest_columns(spark, sf_dir):
    from tarnlake.llm import queries

    text = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    got = queries.op2_spot_signatures(spark, sf_dir).collect()
    order = sorted(text, reverse=True)
    following = {d: order[(k + 1) % len(order)] for k, d in enumerate(order)}
    for r in got:
        t, n = text[r.doc_id], len(text[r.doc_id]) // 3
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - n] + text[following[r.doc_id]][:n]).encode()).hexdigest() and r.n_chars == len(t)
    assert len(got) == len(text)


def test_a_file_with_every_licence_has_every_label(spark):
    text = ".\n".join(t[2] + " as " + " as ".join(t[1]) for t in licenses.TEMPLATES)
    rows = [(1, text), (2, "all rights reserved"), *((10 + k, "Rights of the reserved public") for k in range(5))]
    rows += [(100 + k, f"Some code. {t[2]} The end.") for k, t in enumerate(licenses.TEMPLATES)]
    got = {r.doc_id: r.licence for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # rights reserved beside a licence are no licence of their own
    assert got[1].labels == sorted({t[0] for t in licenses.TEMPLATES} - {licenses.RESERVED}) and got[1].score == 1
    assert got[2].labels == ["proprietary"] and got[10].labels == [] and got[10].score == 0
    assert all(t[0] in got[100 + k].labels for k, t in enumerate(licenses.TEMPLATES) if all(p in " ".join(words(t[2])) for p in t[1]))
    bsd = "Copyright (c) 2020, A. Person. All rights reserved. " + next(t[2] for t in licenses.TEMPLATES if t[0] == "bsd")
    told = {"bsd": bsd, "cc-by-nc-sa": "licensed under CC BY-NC-SA 4.0", "cc-by-nc": "licensed under CC BY-NC 4.0.", "cc-by-nc,cc-by-nc-sa": "licensed under CC BY-NC 4.0, once licensed under CC BY-NC-SA 4.0", "cc-by-sa": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"}
    rows = spark.createDataFrame([(k, t) for k, t in told.items()], "want string, text string")
    assert {r.want: ",".join(r.licence.labels) for r in licenses.scan(rows).collect()} == {k: k for k in told}
    assert licenses.scan(spark.createDataFrame([("x", 1)], "text string, licence int")).first().licence.n_words == 1


def plain_licences(text):
    """Labels and score by trying every template at every place."""
    w, labels, best = words(text), set(), 0.0
    at = {}
    for i, x in enumerate(w):
        at.setdefault(x, []).append(i)
    for k, (label, keys, _) in enumerate(licenses.TEMPLATES):
        index = [(x, p) for x, t, p in licenses.postings() if t == k]
        counts = {}
        for x, p in index:
            for i in at.get(x, ()):
                counts[i - p] = counts.get(i - p, 0) + 1
        most = max(counts.values(), default=0)
        if most >= 0.5 * len(index) and (most >= 2 or most == len(index)) and all(key_stands(words(p), w) for p in keys):
            labels.add(label)
            best = max(best, most / len(index))
    base = {x for p, x in PHRASES.items() if any(tuple(w[i : i + len(p)]) == p for i in range(len(w)))}
    every = labels | base
    return sorted(every - {licenses.RESERVED} if len(every) > 1 else every), 1.0 if base else best


def key_stands(key, w):
    """Somewhere in the words, not as the beginning of a longer key phrase."""
    longer = [q for _, keys, _ in licenses.TEMPLATES for q in map(words, keys) if len(q) > len(key) and q[: len(key)] == key]
    return any(w[i : i + len(key)] == key and not any(w[i : i + len(q)] == q for q in longer) for i in range(len(w)))


def test_licence_labels_match_brute_force(spark):
    rng = random.Random(31)
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(5)):
            body = rng.choice(licenses.TEMPLATES)
            w = (body[2] + " " + " ".join(body[1])).split()
            a = rng.randrange(len(w))
            w = w[a : a + rng.randrange(3, 60)] if rng.random() < 0.5 else w
            for _ in range(rng.choice([0, 0, 1, 3])):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["xyz", "the", "license", "É"]))
            parts += [" ".join(w), " ".join(rng.choices(["the", "general", "cc", "software", "notice"], k=rng.randrange(9)))]
        rows.append((i, rng.choice([". ", "\n * ", " "]).join(parts)))
    got = {r.doc_id: (list(r.licence.labels), r.licence.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: plain_licences(t) for i, t in rows}
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-12 for i in want) and len({tuple(x) for x, _ in want.values()}) > 30


def test_rare_words_are_indexed():
    index = licenses.postings()
    assert all(any(k == t for _, t, _ in index) for k in range(len(licenses.TEMPLATES)))
    assert all(len({w for w, t, _ in index if t == k}) <= 24 for k in range(len(licenses.TEMPLATES))) and len(index) < 1500
    assert not any(w == "the" for w, _, _ in index)
