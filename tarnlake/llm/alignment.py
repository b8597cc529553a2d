"""Alignment of two tokenizers over the same bytes.

Tokens and bytes form incidence matrices in compressed sparse rows (CSR), built by hand. Gustavson's
row-wise product of A's tokens by bytes with the transpose of B's gives the tokens that overlap. Offsets
at which tokens of both sides end cut the bytes into groups; the product of the group incidences
gives all pairs that share a group. Documents in turn are rows over their distinct words, and the product
of that matrix with the words' pairs gives each document's pairs.

No token of either side runs across a space that follows a character which is not white space: a
byte-level vocabulary cuts there by its pattern, and the pieces of the other one hold no word mark after
another character, which is tested. So each word is encoded and aligned once and then remembered, for a
worker's life and within a bound of bytes. Texts and vocabularies for which that isn't so are
aligned whole.

How many documents hold a pair is counted over blocks of documents: each block has its distinct pairs and how
many of its documents hold them, so that what is shuffled follows the vocabulary, not the tokens. A block is a row
for each of its pairs and documents, none wider than a document, and is met again in their order: tasks hold
one block's counts, however many blocks they get.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
STATS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]
OWN = {"id": pa.int64(), "stats": pa.binary(), "sha": pa.string(), "idx": pa.binary(), "weight": pa.binary()}
BLOCK = "block long, at long, pair long, held long, own struct<id:long,stats:binary,sha:string,idx:binary,weight:binary>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long"
RESULT_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
_EXPANDED = 1 << 20


def expand(rows: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of these rows of a CSR matrix its entries' places; and which of the given rows each belongs to."""
    n = ptr[rows + 1] - ptr[rows]
    owner = np.repeat(np.arange(len(rows)), n)
    return np.repeat(ptr[rows] - np.cumsum(n) + n, n) + np.arange(len(owner)), owner


def product(a_ptr: np.ndarray, a_idx: np.ndarray, b_ptr: np.ndarray, b_idx: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gustavson's product of two CSR matrices of ones: row, column and value of its entries, by row and column.

    Each row of the result is the sum of the right matrix's rows that the left row names. Rows are taken in
    slices, so that what is expanded at a time stays bounded but for a single row.
    """
    size = (b_ptr[a_idx + 1] - b_ptr[a_idx]).cumsum()
    out, row, rows = [], 0, len(a_ptr) - 1
    while row < rows:
        before = size[a_ptr[row] - 1] if a_ptr[row] else 0
        far = np.searchsorted(size, before + _EXPANDED, "right")
        end = min(rows, max(row + 1, int(np.searchsorted(a_ptr, far, "right")) - 1))
        own = slice(a_ptr[row], a_ptr[end])
        place, owner = expand(a_idx[own], b_ptr)
        left = np.repeat(np.arange(row, end), np.diff(a_ptr[row : end + 1]))
        key, value = np.unique(left[owner] * np.int64(width) + b_idx[place], return_counts=True)
        out.append((key // width, key % width, value))
        row = end
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ([], [], [])))


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values."""
    found, at = np.unique(key, return_inverse=True)
    return found, np.bincount(at, value, len(found)).astype(np.int64)


def _least(x: np.ndarray) -> np.ndarray:
    """The same numbers, none negative, in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def packed(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, after a byte that says how many."""
    x = _least(x)
    return bytes([x.itemsize]) + x.astype(x.dtype.newbyteorder("<")).tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _flat(lists: Iterator[list[int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of n lists, and how many each has."""
    count = np.zeros(n, np.int64)

    def each() -> Iterator[int]:
        for i, x in enumerate(lists):
            count[i] = len(x)
            yield from x

    return np.fromiter(each(), np.int64), count


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Words to their tokens, groups and links, remembered within ``most`` bytes."""

    def __init__(self, a_path: str, b_path: str, most: int = 96 << 20):
        from tokenizers import Tokenizer

        from .token_counts import model

        # a task is one core; the library's own threads would each hold on to memory of theirs
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            how = json.load(f)
        cut = how.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and how.get("normalizer") is None
        self.b, proven = model(b_path)
        alphabet = byte_alphabet()
        self.a_bytes = [bytes(alphabet.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))]
        self.width, self.a_text = len(self.b_bytes), len(self.a_bytes)
        self.texts = [b"%d%s" % (i, mark) for side, end in ((self.a_text, b"|"), (self.width, b";")) for mark in (b",", end) for i in range(side)]
        self.a_len, self.b_len = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        self.separable, self.most = plain and proven, most
        # a space after anything else than a visible ASCII character or a letter, digit or mark of a word
        self.unsafe = re.compile(r"(?<![\w!-~]) ")
        self.safe = re.compile(r"(?<=[\w!-~])(?= )")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.sound = np.zeros(0, bool)
        # numbers that are kept take as few bytes as the largest of them needs
        self.stats = np.zeros((0, len(STATS)), np.uint8)
        self.ptr, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        self.size = 0

    def words(self, text: str) -> list[str]:
        """What stands for a text with the space before it, each part without its first space."""
        if not self.separable:
            return [text]
        words = [w[1:] for w in self.safe.split(f" {text}")] if self.unsafe.search(text) else text.split(" ")
        if len(words) > 1 and not words[-1]:  # a space at the end is no word of its own, as the library takes an empty text for none
            words[-2:] = [f"{words[-2]} "]
        return words

    def _ids(self, words: list[str], rows: int = 4000) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Both sides' ids of all words, and how many each word has."""
        # A's results are many times the ids, so only some words' are there at a time
        parts = [words[at : at + rows] for at in range(0, len(words), rows)]
        a = (e.ids for part in parts for e in self.a.encode_batch_fast([f" {w}" for w in part], add_special_tokens=False))
        b = (ids for part in parts for ids in self.b.encode(part, num_threads=1))
        return _flat(a, len(words)), _flat(b, len(words))

    def learn(self, words: list[str]) -> None:
        """Encode and align words that aren't known yet, all in one matrix."""
        n = len(words)
        whole = [f" {w}".encode("utf-8", "replace") for w in words]
        (a, a_count), (b, b_count) = self._ids(words)
        sound = self._sound(a, a_count, self.a_bytes, self.a_len, whole) & self._sound(b, b_count, self.b_bytes, self.b_len, whole)
        good = np.flatnonzero(sound)
        if len(good) < n:
            a, b = a[np.repeat(sound, a_count)], b[np.repeat(sound, b_count)]
        word_ends = np.cumsum(np.fromiter(map(len, whole), np.int64, n)[good])
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        total = int(word_ends[-1]) if len(good) else 0
        # tokens by bytes, and bytes by tokens
        over_a, _, _ = product(np.concatenate([[0], a_ends]), np.arange(total), np.arange(total + 1), np.repeat(np.arange(len(b)), self.b_len[b]), max(1, len(b)))
        # groups by tokens of either side
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        g_a, g_b = (np.searchsorted(x, np.arange(len(shared) + 1)) for x in (a_group, b_group))
        group_word = good[np.searchsorted(word_ends, shared)]
        a_word, b_word = group_word[a_group], group_word[b_group]
        columns = [(a_word, None), (b_word, None), (group_word, None), (group_word, np.diff(g_a) * np.diff(g_b)), (a_word[over_a], None)]
        stats = np.stack([np.bincount(word, weight, n).astype(np.int64) for word, weight in columns], axis=1)
        keys, times, word = self._links(a, b, g_a, g_b, group_word)
        # the ids as text, by group, A's first; the last of a side and of a group have other marks behind them
        a_last, b_last = (np.concatenate([x[1:] != x[:-1], [True]]) if len(x) else np.zeros(0, bool) for x in (a_group, b_group))
        code = np.concatenate([a + self.a_text * a_last, b + 2 * self.a_text + self.width * b_last])[np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")]
        parts = list(map(self.texts.__getitem__, code.tolist()))
        ends = np.cumsum(stats[:, 0] + stats[:, 1]).tolist()
        texts = [b"".join(parts[i:j]) for i, j in zip([0, *ends], ends)]
        begin, before = len(self.groups), self._arrays()
        self.known.update(zip(words, range(begin, begin + n), strict=True))
        self.groups += texts
        self.sound = np.concatenate([self.sound, sound])
        self.stats = np.concatenate([self.stats, _least(stats)])
        self.ptr = np.concatenate([self.ptr, self.ptr[-1] + np.searchsorted(word, np.arange(n + 1))[1:]])
        self.pairs, self.times = np.concatenate([self.pairs, _least(keys)]), np.concatenate([self.times, _least(times)])
        # a word's objects: itself, its number, its groups, and their places in a table and a list
        self.size += sum(map(len, whole)) + sum(map(len, texts)) + 190 * n + self._arrays() - before

    def _arrays(self) -> int:
        return sum(x.nbytes for x in (self.sound, self.stats, self.ptr, self.pairs, self.times))

    def _sound(self, ids: np.ndarray, count: np.ndarray, table: list[bytes], lens: np.ndarray, whole: list[bytes]) -> np.ndarray:
        """Whose tokens' bytes are the word's; asked of all words at once, and of each where not all are."""
        n, flat = len(whole), ids.tolist()
        same = np.array_equal(np.bincount(np.repeat(np.arange(n), count), lens[ids], n).astype(np.int64), np.fromiter(map(len, whole), np.int64, n))
        if same and b"".join(map(table.__getitem__, flat)) == b"".join(whole):
            return np.ones(n, bool)
        ends = np.cumsum(count).tolist()
        return np.fromiter((b"".join(map(table.__getitem__, flat[i:j])) == w for i, j, w in zip([0, *ends], ends, whole)), bool, n)

    def _links(self, a: np.ndarray, b: np.ndarray, g_a: np.ndarray, g_b: np.ndarray, group_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of ids that share a group, how often, and whose word they are, by word.

        The product of the groups' incidences, group by group: the outer product of A's ids and B's. A group
        of many tokens has its ids counted first, so that it never gives more rows than it has different pairs.
        """
        n_a, n_b = np.diff(g_a), np.diff(g_b)
        wide = n_a * n_b > 4096
        key, word, times = [], [], []
        small = np.flatnonzero(~wide)
        for part in np.array_split(small, max(1, int((n_a[small] * n_b[small]).sum() >> 20))):
            rows, owner = expand(part, g_a)
            cols, left = expand(part[owner], g_b)
            key.append(a[rows[left]] * self.width + b[cols])
            word.append(group_word[part[owner[left]]])
            times.append(np.ones(len(cols), np.int64))
        for g in np.flatnonzero(wide):
            x, n_x = np.unique(a[g_a[g] : g_a[g + 1]], return_counts=True)
            y, n_y = np.unique(b[g_b[g] : g_b[g + 1]], return_counts=True)
            key.append((x[:, None] * self.width + y).ravel())
            times.append((n_x[:, None] * n_y).ravel())
            word.append(np.full(len(x) * len(y), group_word[g]))
        key, word, times = map(np.concatenate, (key, word, times))
        order = np.lexsort((key, word))
        key, word, times = key[order], word[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (word[1:] != word[:-1])])) if len(key) else np.zeros(0, np.int64)
        return key[new], np.add.reduceat(times, new) if len(new) else times, word[new]

    def document(self, words: list[str]) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
        """Statistics, hash of the groups, pairs and how often they are linked, of a document of known words."""
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        own, n = np.unique(at, return_counts=True)
        if not self.sound[own].all():
            return np.zeros(len(STATS), np.int64), "", np.zeros(0, np.uint8), np.zeros(0, np.int64)
        place, owner = expand(own, self.ptr)
        pairs, times = _summed(self.pairs[place], self.times[place].astype(np.int64) * n[owner])
        sha = hashlib.sha256(b"".join(map(self.groups.__getitem__, at.tolist()))[:-1]).hexdigest()
        return n @ self.stats[own], sha, pairs, times


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of these files; a worker keeps it until another operator runs there."""
    return common.held(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


def align_texts(found: Aligner, texts: list[str | None]) -> list[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
    """What ``Aligner.document`` gives for each text; null and empty texts have no tokens."""
    if found.size > found.most:
        found.clear()
    cut = [found.words(t) if t else None for t in texts]
    fresh = list({w for words in cut if words for w in words}.difference(found.known))
    if fresh:
        found.learn(fresh)
    none = np.zeros(len(STATS), np.int64), "", np.zeros(0, np.uint8), np.zeros(0, np.int64)
    return [found.document(words) if words else none for words in cut]


def _blocks(docs: DataFrame, a_path: str, b_path: str, chars: int) -> DataFrame:
    """Blocks of about so many characters: a row for each of a block's distinct pairs, then one for each of its documents.

    A pair's row has its number in the block and how many of the block's documents hold it; a document's has the
    numbers of its pairs. No row is larger than its document, so a file's and a batch's size follow the documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, part, number = aligner(a_path, b_path), TaskContext.get().partitionId(), 0
        held, size = [], 0

        def rows(at: np.ndarray, pair: pa.Array, holds: pa.Array, own: pa.Array) -> pa.RecordBatch:
            block = np.full(len(at), (part << 32) + number, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(block), pa.array(at), pair, holds, own], ["block", "at", "pair", "held", "own"])

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal number
            number += 1
            pairs, idx = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True)
            n, m, kind = len(pairs), len(held), pa.struct(OWN)
            yield rows(np.arange(n), pa.array(pairs.astype(np.int64)), pa.array(np.bincount(idx, minlength=n)), pa.nulls(n, kind))
            idx = np.split(idx, np.cumsum([len(x[3]) for x in held])[:-1])
            values = [x[0] for x in held], [x[1].astype("<i8").tobytes() for x in held], [x[2] for x in held], map(packed, idx), [packed(x[4]) for x in held]
            own = pa.StructArray.from_arrays([pa.array(v, kind) for v, kind in zip(values, OWN.values(), strict=True)], list(OWN))
            yield rows(np.arange(n, n + m), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), own)

        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            begin = 0
            while begin < len(texts):
                end, taken = begin, 0
                while end < len(texts) and (end == begin or taken < 1 << 19):
                    taken += len(texts[end] or "")
                    end += 1
                held += [(i, *x) for i, x in zip(ids[begin:end], align_texts(found, texts[begin:end]), strict=True)]
                size, begin = size + taken, end
                if size >= chars or len(held) >= 20_000:
                    yield from block()
                    held, size = [], 0
        if held:
            yield from block()

    return docs.mapInArrow(run, BLOCK)


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks one after the other, in each its pairs' counts and then its documents, to the documents' results."""
    common.drop_held()
    block, n, best = None, [], []
    for batch in batches:
        where, is_pair = batch.column("block").to_numpy(), batch.column("n").is_valid().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((where[1:] != where[:-1]) | (is_pair[1:] != is_pair[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)], strict=True):
            if i == j:
                continue
            part = batch.slice(i, j - i)
            if where[i] != block:
                block, n, best = where[i], [], []
            if is_pair[i]:
                n.append(part.column("n").to_numpy(zero_copy_only=False).astype(np.int64))
                best.append(part.column("best").to_numpy(zero_copy_only=False).astype(bool))
                continue
            n, best = ([np.concatenate(x)] if x else [np.zeros(0, kind)] for x, kind in ((n, np.int64), (best, bool)))
            ids, stats, shas, idx, weight = part.column("own").flatten()
            out = dict(zip(STATS, np.frombuffer(b"".join(stats.to_pylist()), "<i8").reshape(-1, len(STATS)).T, strict=True))
            sums = []
            for x, w in zip(idx.to_pylist(), weight.to_pylist(), strict=True):
                x, w = unpacked(x), unpacked(w)
                sums.append((int(w @ best[0][x]), int(w @ n[0][x])))
            out |= {"doc_id": ids, "groups_sha256": shas} | dict(zip(("n_best", "count_sum"), np.array(sums, np.int64).T, strict=True))
            yield pa.RecordBatch.from_pydict({c: out[c] if isinstance(out[c], pa.Array) else pa.array(np.ascontiguousarray(out[c])) for c in RESULT_COLUMNS})


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text: str = "text", block_chars: int = 4 << 20) -> DataFrame:
    """Per row: its id, tokens of both sides, groups, links, and how its links rank in the corpus.

    ``n_best`` are links whose pair of ids is held by as many documents as the A id's commonest pair,
    ``count_sum`` sums over links how many documents hold their pair; ``groups_sha256`` hashes the ids group by
    group. Null and empty texts, and such whose bytes either side doesn't give back, have zeros and an
    empty hash. Rows that share an id count as documents of their own; a null id stays null. Other columns
    are left out, and an empty table gives no rows. A is a file of the tokenizers library with a byte-level
    vocabulary, B one of sentencepiece; special tokens' strings are plain text.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    with common.cleared() as kept:
        blocks = common.materialize(_blocks(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")), a_path, b_path, block_chars), "aligned-blocks")
        from .token_counts import model

        width = model(b_path)[0].vocab_size()
        rows = blocks.filter(F.col("pair").isNotNull())
        total = common.materialize(rows.groupBy("pair").agg(F.sum("held").alias("n")), "pair-counts")
        a_id = F.floor(F.col("pair") / width)
        best = total.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))
        known = total.join(best, F.col("a") == a_id).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
        counts = rows.select("block", "at", "pair").join(common.materialize(known, "known-pairs"), "pair").select("block", "at", "n", "best")
        own = blocks.filter(F.col("pair").isNull()).select("block", "at", "own")
        # a block's rows in one task and in order: sorted by Spark, which spills, and passed on a batch at a time
        ready = counts.unionByName(own, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "at")
        result = common.materialize(ready.mapInArrow(_ranks, RESULT), "aligned")
        kept.append(result)
    return result
