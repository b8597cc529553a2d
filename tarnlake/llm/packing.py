"""Best-fit packing of tokenised documents into sequences of a fixed size.

The plan needs only how many pieces there are of each length, at most ``size`` numbers whatever the
corpus: exact-complement hashing indexes the sums of single lengths, pairs and triples, and takes,
longest first, combinations that fill the gap exactly, as often as the availability counts allow; what
is left is placed best fit, longest first. Pieces then find their place by their rank among the pieces
of their length, which a salted rank gives without bringing a frequent length into one task.
"""

from __future__ import annotations

import itertools
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from . import common

PIECE = StructType([StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())])
PLACE = StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())])

#: Texts below this code point are cut into words here; classes of these letters are settled in Unicode.
_KNOWN = 0x250
_SPACE = "\t-\r \x85\xa0"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(_KNOWN) if unicodedata.category(chr(i))[0] == kind)


def _words() -> re.Pattern:
    """The words within which a byte-level vocabulary merges: no merge ever runs across two of them."""
    letter, digit = _class("L"), _class("N")
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{digit}]+| ?[^{_SPACE}{letter}{digit}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Encoder:
    """Ids of texts by the tokenizers library, as bytes of little-endian unsigned 32-bit numbers.

    Words are encoded by the library once and then remembered, as long as the worker keeps it and within
    ``most`` words; beyond that the first ``keep`` stay, which are the frequent ones. Texts with a special
    token's string or with characters beyond those whose word classes are settled, and vocabularies that
    cut words in another way, are encoded as they are.
    """

    def __init__(self, path: str, most: int = 500_000, keep: int = 350_000):
        import json

        from tokenizers import Tokenizer

        # a task is one core; the library's own threads would each hold on to memory of theirs
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library, self.most, self.keep, self.known = Tokenizer.from_file(path), most, keep, {}
        with open(path, encoding="utf-8") as f:
            how = json.load(f)
        cut = how.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and how.get("normalizer") is None
        specials = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.words = _words() if plain else None
        self.apart = re.compile("|".join([f"[^\x00-{chr(_KNOWN - 1)}]", *specials]))

    def _ids(self, texts: list[str], rows: int = 4000) -> list[bytes]:
        # the library's results are many times the ids, so only some rows' are there at a time
        parts = (texts[at : at + rows] for at in range(0, len(texts), rows))
        return [np.array(e.ids, dtype="<u4").tobytes() for part in parts for e in self.library.encode_batch_fast(part, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [None if self.words is None or self.apart.search(t) else self.words.findall(t) for t in texts]
        if len(self.known) > self.most:
            self.known = dict(itertools.islice(self.known.items(), self.keep))
        fresh = list(set(itertools.chain.from_iterable(w for w in cut if w)).difference(self.known))
        own = dict(zip(fresh, self._ids(fresh), strict=True))
        self.known.update(own)
        out = [w if w is None else b"".join(map(self.known.__getitem__, w)) for w in cut]
        for w in own:
            if len(w) > 40:
                del self.known[w]
        whole = [i for i, w in enumerate(out) if w is None]
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


def encoder(path: str) -> Encoder:
    """The encoder of this file; a worker keeps it until another operator runs there."""
    return common.held(("encoder", path), lambda: Encoder(path))


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, but for the first piece."""
    first = (n - 1) % size + 1
    return [(0, first), *((s, size) for s in range(first, n, size))]


def _groups(texts: list[str], chars: int = 1 << 20) -> Iterator[list[int]]:
    """Rows of a batch in turn, of about so many characters at a time."""
    group, held = [], 0
    for i, t in enumerate(texts):
        group.append(i)
        held += len(t)
        if held >= chars:
            yield group
            group, held = [], 0
    if group:
        yield group


def pieces(docs: DataFrame, path: str, *, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """A row for each piece: the document's id, piece, start, length, crc32 of its ids.

    With ``ids`` the ids themselves are a binary column, as little-endian unsigned 32-bit numbers. Null is an empty text, which is its end id alone. Texts of any length are encoded whole; their ids
    are held one group of rows at a time. Repeated rows give repeated pieces, other columns are left
    out, and an empty table gives no rows.
    """
    common.bound_batches(docs.sparkSession)
    key = docs.schema[id_col].dataType
    schema = StructType([StructField(id_col, key), *PIECE.fields, *([StructField("ids", BinaryType())] if ids else [])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            docs, texts, rows = batch["id"].tolist(), [t or "" for t in batch["text"]], []
            for group in _groups(texts):
                for i, found in zip(group, encode([texts[i] for i in group]), strict=True):
                    found += end
                    for k, (s, n) in enumerate(cut(len(found) // 4, size)):
                        part = found[4 * s : 4 * (s + n)]
                        rows.append((docs[i], k, s, n, zlib.crc32(part), *([part] if ids else [])))
            out = pd.DataFrame(rows, columns=schema.names)
            if isinstance(key, LongType | IntegerType):
                out[id_col] = pd.array([None if pd.isna(x) else int(x) for x in out[id_col]], dtype="Int64")
            yield out

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInPandas(run, schema)


class Sums:
    """Which one, two or three lengths make a sum: an index of singles, pairs and triples by their sum.

    A pair is listed by its larger length, a triple by its largest one, whose rest is looked up among
    the pairs; so the index holds about size x size numbers at most. Counts only ever fall, so a pair
    of which a length has run out leaves the index for good.
    """

    def __init__(self, left: np.ndarray):
        self.left, size = left, len(left) - 1
        have = np.flatnonzero(left)
        self.pairs: list[list[int]] = [[] for _ in range(size + 1)]
        self.triples: list[list[int]] = [[] for _ in range(size + 1)]
        for b in have.tolist():
            for a in have[(have >= b) & (have + b <= size)].tolist():
                self.pairs[a + b].append(a)
        two = np.array([bool(x) for x in self.pairs])
        for a in have.tolist()[::-1]:
            # the other two are not larger than a
            for rest in np.flatnonzero(two[: max(0, min(2 * a, size - a) + 1)]).tolist():
                self.triples[a + rest].append(a)

    def _there(self, a: int, b: int) -> bool:
        return bool(self.left[a] > (a == b) and self.left[b])

    def _pair(self, total: int, most: int) -> tuple[int, int] | None:
        """An available pair of this sum, neither length above ``most``; the most even one."""
        found = self.pairs[total]
        hit = next((k for k in range(len(found) - 1, -1, -1) if self._there(found[k], total - found[k])), None)
        if hit is None or found[hit] > most:
            return None
        if hit < len(found) - 1:
            found[hit + 1 :] = [a for a in found[hit + 1 :] if self.left[a] and self.left[total - a]]
        return found[hit], total - found[hit]

    def fill(self, gap: int) -> Iterator[tuple[int, ...]]:
        """Combinations that fill the gap and are available, again and again, fewest pieces first."""
        while self.left[gap]:
            yield (gap,)
        for a in self.pairs[gap]:
            while self._there(a, gap - a):
                yield a, gap - a
        for a in self.triples[gap]:
            while self.left[a]:
                self.left[a] -= 1
                two = self._pair(gap - a, a)
                self.left[a] += 1
                if two is None:
                    break
                yield a, *two


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences), from the number of pieces of each length."""
    left = np.zeros(size + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] += c
    made: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        made.append(((size,), int(left[size])))
        left[size] = 0
    sums = Sums(left)
    for n in range(size - 1, 0, -1):
        if not left[n]:
            continue
        left[n] -= 1
        for rest in sums.fill(size - n):
            left[n] += 1
            lengths = (n, *rest)
            times = min(int(left[x]) // lengths.count(x) for x in set(lengths))
            for x in lengths:
                left[x] -= times
            made.append((lengths, times))
            if not left[n]:
                break
            left[n] -= 1
        else:
            left[n] += 1
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in range(size, 0, -1):
        while todo := int(left[n]):
            gap = min((g for g in open_ if g >= n), default=None)
            (lengths, bins), fresh = (open_[gap].pop(), False) if gap is not None else (((), todo), True)
            if gap is not None and not open_[gap]:
                del open_[gap]
            gap = size if fresh else gap
            each = min(gap // n, todo)
            used = min(bins, todo // each)
            if not fresh and bins > used:
                open_.setdefault(gap, []).append((lengths, bins - used))
            open_.setdefault(gap - each * n, []).append((lengths + (n,) * each, used))
            left[n] -= used * each
    return made + [x for group in open_.values() for x in group]


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, first sequence, offset), ranks ascending."""
    out: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for lengths, times in planned:
        offset = 0
        for n in lengths:
            out.setdefault(n, []).append((rank.get(n, 0), sequence, offset))
            rank[n] = rank.get(n, 0) + times
            offset += n
        sequence += times
    return {n: np.array(x, dtype=np.int64) for n, x in out.items()}


def place(parts: DataFrame, *, size: int = 2048, rows_per_salt: int = 4_000_000) -> DataFrame:
    """Add sequence_id and offset to pieces, replacing columns of those names.

    Lengths must be within 1 and ``size``. Pieces are numbered as they are written, so that ties,
    repeated rows and null ids spread like any other; other columns pass through.
    """
    names = common.without(parts, "sequence_id", "offset").columns
    row, salt, base_of, rank, at = common.fresh(names, "row", "salt", "base", "rank", "at")
    parts = common.materialize(parts.select(*names, F.monotonically_increasing_id().alias(row)), "pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # size rows at most
    shared = parts.sparkSession.sparkContext.broadcast(slots(plan(counts, size)))
    salts = 64 + sum(counts.values()) // rows_per_salt
    salted = parts.withColumn(salt, F.pmod(F.xxhash64(row), F.lit(salts)))
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", salt).agg(F.count("*").alias("n")).select("length", salt, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base_of))
    within = Window.partitionBy("length", salt).orderBy(row)
    ranked = salted.withColumn(rank, F.row_number().over(within)).join(base, ["length", salt])

    @F.pandas_udf(PLACE)
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
        for x in np.unique(n):
            at, table = n == x, shared.value[int(x)]
            k = np.searchsorted(table[:, 0], r[at], side="right") - 1
            sequence[at], offset[at] = table[k, 1] + r[at] - table[k, 0], table[k, 2]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn(at, find("length", F.col(base_of) + F.col(rank) - 1)).select(*names, f"{at}.*")


def pack(docs: DataFrame, path: str, *, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Tokenise, cut and place whole documents: a row for each piece, as ``pieces`` and ``place`` say."""
    return place(pieces(docs, path, size=size, end_id=end_id, id_col=id_col, text=text, ids=ids), size=size)
