"""The aligner against token by token comparison, and its counts against all documents at once."""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import alignment, common
from tarnlake.llm.queries import tokenizer

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
TEXTS = [
    "hello world", "It's  a\n\ntest   x", "<|endoftext|> a </s> b", "日本語 テキスト混在 abc", "a" * 300, "naïve café 🙂🙂 end ", "   lead", "tab\tx \ty", " ", "  ",
    "▁x y", "x  y\x85 z\x1c q", " \x00 b", "line\r\n  next. . .  !! 's 't 1234 12", "trailing space ", "é é é", "　wide　 space", "🙂" * 40, None, "", "hello world",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(text, libraries):
    """Ids of both sides group by group, and overlaps; None without tokens."""
    if not text:
        return None
    a_lib, b_lib = libraries
    alphabet, full = alignment.byte_alphabet(), f" {text}".encode()
    a, b = a_lib.encode(f" {text}", add_special_tokens=False).ids, b_lib.encode(text)
    a_bytes = [bytes(alphabet[c] for c in a_lib.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(a_bytes) != full or b"".join(b_bytes) != full:
        return None
    ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = [(defaultdict(list), defaultdict(list))][0]
    for side, ids, own in zip(groups, (a, b), ends, strict=True):
        for i, e in zip(ids, own, strict=True):
            side[bisect.bisect_left(cuts, e)].append(i)
    begins = [[0, *own[:-1]] for own in ends]
    overlaps = sum(begins[0][i] < ends[1][j] and begins[1][j] < ends[0][i] for i in range(len(a)) for j in range(len(b)))
    return [(groups[0][g], groups[1][g]) for g in range(len(cuts))], overlaps


def test_words_are_aligned_as_whole_texts(libraries):
    found = alignment.aligner(A, B)
    for text, (stats, sha, pairs, times) in zip(TEXTS, alignment.align_texts(found, TEXTS), strict=True):
        want = brute(text, libraries)
        if want is None:
            assert not stats.any() and sha == "" and not len(pairs)
            continue
        groups, overlaps = want
        links = Counter((x, y) for a, b in groups for x in a for y in b)
        assert stats.tolist() == [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()), overlaps], text
        assert sha == hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups).encode()).hexdigest()
        assert {(k // found.width, k % found.width): n for k, n in zip(pairs.tolist(), times.tolist(), strict=True)} == dict(links)


def test_product_of_sparse_matrices():
    rng = np.random.default_rng(5)
    left, right = rng.random((40, 30)) < 0.2, rng.random((30, 50)) < 0.2
    csr = lambda m: (np.concatenate([[0], m.sum(axis=1).cumsum()]), np.nonzero(m)[1])
    for size in (1 << 20, 7):
        before, alignment._EXPANDED = alignment._EXPANDED, size
        try:
            row, column, value = alignment.product(*csr(left), *csr(right), 50)
        finally:
            alignment._EXPANDED = before
        got = np.zeros((40, 50), int)
        got[row, column] = value
        assert (got == left.astype(int) @ right.astype(int)).all()


def test_large_groups_count_ids_first():
    found = alignment.aligner(A, B)
    a, b = np.array([1, 2, 1] * 40), np.array([7] * 60 + [9] * 60)
    keys, times, word = found._links(a, b, np.array([0, 120]), np.array([0, 120]), np.array([3]))
    got = {(k // found.width, k % found.width): n for k, n in zip(keys.tolist(), times.tolist(), strict=True)}
    assert got == {(1, 7): 4800, (1, 9): 4800, (2, 7): 2400, (2, 9): 2400} and set(word.tolist()) == {3}


def test_words_are_forgotten_within_a_bound(libraries):
    small = alignment.Aligner(A, B, most=2_000)
    texts = [f"word{i} other{i}" for i in range(40)]
    for t in texts:
        alignment.align_texts(small, [t])
        assert len(small.known) < 20
    assert [x[1] for x in alignment.align_texts(small, texts)] == [x[1] for x in alignment.align_texts(alignment.aligner(A, B), texts)]


@pytest.mark.parametrize("block_chars", [1, 8 << 20])
def test_counts_over_the_corpus(spark, libraries, block_chars):
    docs = spark.createDataFrame([(i if i != 3 else None, t, "n") for i, t in enumerate(TEXTS)], "doc_id int, text string, n_a string").repartition(3)
    got = {(r.doc_id, r.groups_sha256): r for r in alignment.align(docs, A, B, block_chars=block_chars).collect()}
    assert sum(1 for _ in got) == len(TEXTS)
    held, links = Counter(), []
    for t in TEXTS:
        found = brute(t, libraries)
        links.append(Counter((x, y) for a, b in found[0] for x in a for y in b) if found else Counter())
        held.update(links[-1].keys())
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    want = sorted((-1 if i == 3 else i, sum(own.values()), sum(n for p, n in own.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in own.items())) for i, own in enumerate(links))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_links, r.n_best, r.count_sum) for r in got.values()) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, A, B).count() == 0
    assert alignment.align(docs.union(spark.range(1).select("id", F.lit(None).cast("string"))), A, B).first().groups_sha256 == ""


def width(value) -> int:
    """Bytes of a value with all that it holds."""
    if isinstance(value, list | tuple):
        return sum(map(width, value))
    return len(value) if isinstance(value, bytes | bytearray | str) else 8


def test_no_row_of_a_block_is_wider_than_its_document(spark):
    """One task that gets many blocks holds none of them whole: rows follow the documents, not the block."""
    docs = spark.createDataFrame([(i, f"word{i % 7} and some more of row {i}, the same here") for i in range(900)], "id long, text string").coalesce(1)
    rows = alignment._blocks(docs, A, B, 4 << 20).collect()
    assert max(map(width, rows)) < 400
    assert len({r.block for r in rows}) == 1


@pytest.mark.parametrize("numbers", [[], [0, 255], [256, 3], [1 << 16], [(1 << 32) - 1], [1 << 32, 0], [(1 << 63) - 1]])
def test_packed_numbers(numbers):
    x = np.array(numbers, np.int64)
    assert alignment.unpacked(alignment.packed(x)).tolist() == numbers
    assert len(alignment.packed(x)) <= 1 + 8 * len(numbers)


@pytest.mark.parametrize("batch_rows", [1, 7, 1000])
def test_blocks_are_met_in_any_batches(spark, batch_rows):
    big = 1 << 53
    docs = spark.createDataFrame([(big + i if i % 5 else None, t) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string").coalesce(2)
    want = sorted(map(str, alignment.align(docs, A, B).collect()))
    before = spark.conf.get(common.BATCH_ROWS)
    spark.conf.set(common.BATCH_ROWS, str(batch_rows))
    try:
        got = alignment.align(docs, A, B, block_chars=60).collect()
    finally:
        spark.conf.set(common.BATCH_ROWS, before)
    assert sorted(map(str, got)) == want
    assert {r.doc_id for r in got if r.doc_id is not None} == {big + i for i in range(2 * len(TEXTS)) if i % 5}


def test_words_are_let_go_of_once_all_are_aligned():
    alignment.align_texts(alignment.aligner(A, B), ["some words"])
    assert list(alignment._ranks(iter([]))) == [] and not common._held


def test_kept_numbers_are_as_narrow_as_they_can_be(libraries):
    found = alignment.Aligner(A, B)
    alignment.align_texts(found, [" ".join(f"word{i}" for i in range(5000))])
    assert found.stats.dtype == np.uint8 and found.times.dtype == np.uint8 and found.pairs.dtype == np.uint32
    # a word of many tokens widens them, and neither it nor those before change
    text = "a" * 300 + "🙂" * 400
    (stats, sha, pairs, times), early = alignment.align_texts(found, [text, "word17"])
    groups, overlaps = brute(text, libraries)
    links = Counter((x, y) for a, b in groups for x in a for y in b)
    assert stats.tolist()[-2:] == [sum(links.values()), overlaps] and max(times) == max(links.values()) > 255
    assert early[1] == alignment.align_texts(alignment.Aligner(A, B), ["word17"])[0][1]
