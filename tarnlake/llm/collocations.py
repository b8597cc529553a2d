"""Phrase collocations by dynamic itemset counting.

The corpus is dealt into shards that are scanned in a cycle. A phrase begins to be counted with the step
after that in which both its subphrases (without its last, without its first word) reached the threshold,
at whichever shard that is, so lengths interleave; it is counted until it has met each shard once, which is
one full cycle. Words begin at the first step. The scans end when no phrase is left in its cycle.

The corpus is cut into words once, and kept as blocks of word numbers; a scan is array work over them. What the scans
pass on are 64-bit hashes of phrases and their counts, combined over a block; sums are aggregates. Which phrases reached the threshold in a step goes to the tasks as a
Bloom filter of a fixed size, built from bits that are or-ed in an aggregate. A filter never loses a phrase;
one that it takes in by chance is counted in vain. As all tasks see the same filters, a phrase begins
everywhere at the same step. At last the phrases that completed their cycle with enough occurrences
are counted once more by their words, so that no two phrases of one hash are ever mixed up.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LONGEST = 4
_BREAK = b"\xff"  # never in UTF-8
#: For bytes.translate: A-Z to a-z, what parts pieces to a byte that no text has.
FOLD = bytes(0xFF if chr(b) in ".,;:!?\n\v\f\r" else b + 32 * (65 <= b <= 90) for b in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_PROBES = 4
_SEGMENT = 1 << 12  # 64-bit words of a filter that travel together
_WINDOW = 1 << 20
_KEPT_WORDS = 500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with all bits mixed."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _bits(found: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The places of each hash in a filter of ``size`` bits, a power of two."""
    return (_place(found, k, size) for k in range(_PROBES))


def _place(found: np.ndarray, k: int, size: int) -> np.ndarray:
    return _mixed(found + np.uint64((k + 1) * int(_PRIME) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(size - 1)


def within(found: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes a filter, as 64-bit words, may hold."""
    open_ = np.arange(len(found))
    for k in range(_PROBES):
        at = _place(found[open_], k, 64 * len(bits))
        open_ = open_[(bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    hit = np.zeros(len(found), bool)
    hit[open_] = True
    return hit


class Words:
    """Numbers and hashes of a language's words, within a bound of words."""

    def __init__(self, lang: str):
        import xxhash

        self.hash, self.seed = xxhash.xxh3_64_intdigest, xxhash.xxh3_64_intdigest(lang.encode("utf-8", "replace"))
        self.number: dict[bytes, int] = {}
        self.names: list[bytes] = []

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return _mixed(np.fromiter((self.hash(w, self.seed) for w in words), np.uint64, len(words)))

    def ids(self, texts: list[str], block: int = 1 << 20) -> np.ndarray:
        """The words of texts by number, -1 where a piece or a text ends; a text is cut into words one block at a time."""
        out = []
        for t in texts:
            data = t.encode("utf-8", "replace").translate(FOLD)
            at = 0
            while at < len(data):
                end = len(data)
                if end - at > block:  # a block ends at a space, or where there is none it grows to one
                    far = [p for p in (data.find(b" ", at + block), data.find(b"\t", at + block), data.find(_BREAK, at + block)) if p >= 0]
                    end = min(far, default=end)
                words = data[at:end].replace(_BREAK, b" \xff ").split()
                for w in set(words).difference(self.number):
                    self.number[w] = len(self.names)
                    self.names.append(w)
                out.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
                at = end
            out.append(np.full(1, -1))
        flat = np.concatenate(out) if out else np.zeros(0, np.int64)
        flat[flat == self.number.get(_BREAK, -1)] = -1
        return flat


def _blocks(docs: DataFrame, shards: int) -> DataFrame:
    """The corpus in blocks of about a million words of one language and shard, with the words by number.

    A phrase that begins among a block's first ``size`` places is whole in it: blocks overlap by three.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, Words] = {}
        held: dict[tuple[str, int], list[np.ndarray]] = {}
        sizes: dict[tuple[str, int], int] = {}

        def flush(key: tuple[str, int]) -> Iterator[pd.DataFrame]:
            ids, words = np.concatenate(held.pop(key)), tables[key[0]]
            del sizes[key]
            for at in range(0, len(ids), _WINDOW):
                part = ids[at : at + _WINDOW + LONGEST - 1]
                used = np.unique(part[part >= 0])
                names = [words.names[i] for i in used.tolist()]
                own = np.where(part >= 0, np.searchsorted(used, part), -1).astype("<i4")
                yield pd.DataFrame({"lang": [key[0]], "size": [min(_WINDOW, len(ids) - at)], "ids": [own.tobytes()], "words": [b" ".join(names)], "hashes": [words.hashes(names).tobytes()], "shard": [key[1]]})

        for batch in batches:
            for key, texts in batch.groupby(["lang", "shard"], sort=False)["text"]:
                texts = texts.tolist()
                begin = 0
                while begin < len(texts):
                    end, chars = begin, 0
                    while end < len(texts) and chars < 1 << 20:
                        chars += len(texts[end])
                        end += 1
                    if key[0] not in tables:
                        tables[key[0]] = Words(key[0])
                    ids = tables[key[0]].ids(texts[begin:end])
                    held.setdefault(key, []).append(ids)
                    sizes[key] = sizes.get(key, 0) + len(ids)
                    begin = end
                    if sizes[key] >= _WINDOW:
                        yield from flush(key)
                    elif sum(sizes.values()) >= 4 * _WINDOW:
                        yield from flush(max(sizes, key=sizes.get))
            if sum(len(t.names) for t in tables.values()) > _KEPT_WORDS:
                for key in list(held):
                    yield from flush(key)
                tables.clear()
        for key in list(held):
            yield from flush(key)

    return docs.mapInPandas(run, "lang string, size long, ids binary, words binary, hashes binary, shard int")


def levels(ids: np.ndarray, hashes: np.ndarray, reached) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For lengths 2 to 4: the length, where such phrases begin, and at each place the hash and the begin of counting.

    A place is left out as soon as a subphrase there hasn't reached the threshold yet. A phrase's hash is made of that of
    its first subphrase and its last word's, so that it is one whichever way it is met.
    """
    where = np.flatnonzero(ids >= 0)
    step = np.full(len(ids), -1)
    step[where] = reached(hashes, np.zeros(len(hashes), np.int64))[ids[where]]
    own = np.zeros(len(ids), np.uint64)
    own[where] = hashes[ids[where]]
    for length in range(1, LONGEST):
        left = where[step[where] >= 0]
        left = left[left + length < len(ids)]
        left = left[step[left + 1] >= 0]
        begins = 1 + np.maximum(step[left], step[left + 1])
        found = _mixed(own[left] * _PRIME + hashes[ids[left + length]] + np.uint64(length))
        yield length + 1, left, found, begins
        if length + 1 < LONGEST:
            step = np.full(len(ids), -1)
            step[left] = reached(found, begins)
            own[left] = found
            where = left


def _reached(filters: list[np.ndarray | None]):
    """The first step whose filter holds a hash, from the one on in which it began to be counted; else -1."""

    def of(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        step = np.full(len(hashes), -1)
        open_ = np.arange(len(hashes))
        for k, bits in enumerate(filters):
            if bits is not None and len(open_):
                due = open_[begins[open_] <= k]
                step[due[within(hashes[due], bits)]] = k
                open_ = open_[step[open_] < 0]
        return step

    return of


def _each(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, np.ndarray, bytes, np.ndarray]]:
    for batch in batches:
        for lang, size, ids, words, hashes in zip(batch["lang"], batch["size"], batch["ids"], batch["words"], batch["hashes"], strict=True):
            yield lang, size, np.frombuffer(ids, "<i4").astype(np.int64), words, np.frombuffer(hashes, np.uint64)


def _opened(filters: list[Broadcast | None]) -> list[np.ndarray | None]:
    return [b and np.frombuffer(b.value, np.uint64) for b in filters]


def _scan(blocks: DataFrame, filters: list[Broadcast | None], step: int, shards: int) -> DataFrame:
    """Counts of the phrases in their cycle at this step: hash, begin of counting and length, count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reached = _reached(_opened(filters))
        with np.errstate(over="ignore"):
            for _, size, ids, _, hashes in _each(batches):
                rows = []
                if step < shards:
                    n = np.bincount(ids[:size][ids[:size] >= 0], minlength=len(hashes))
                    rows.append((hashes[n > 0], np.full((n > 0).sum(), 1), n[n > 0]))
                for length, where, found, begins in levels(ids, hashes, reached) if step else ():
                    due = (begins > step - shards) & (begins <= step) & (where < size)
                    h, first, n = np.unique(found[due], return_index=True, return_counts=True)
                    rows.append((h, begins[due][first] * 8 + length, n))
                h, tag, n = (np.concatenate(x) for x in zip(*rows, strict=True))
                yield pd.DataFrame({"h": h.view(np.int64), "tag": tag.astype(np.int32), "n": n})

    return blocks.select("lang", "size", "ids", "words", "hashes").mapInPandas(run, "h long, tag int, n long")


def _filter(found: DataFrame, size: int) -> Broadcast | None:
    """A Bloom filter of hashes, broadcast: never more than ``size`` bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size // 64, np.uint64)
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in _bits(batch["h"].to_numpy().view(np.uint64), size):
                    np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        place = np.flatnonzero(bits)
        yield pd.DataFrame({"at": place.astype(np.int32), "bits": bits[place].view(np.int64)})

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(_SEGMENT, np.int64)
        bits[rows["at"].to_numpy() % _SEGMENT] = rows["bits"].to_numpy()
        return pd.DataFrame({"at": [int(rows["at"].iloc[0]) // _SEGMENT], "bits": [bits.tobytes()]})

    rows = found.select("h").mapInPandas(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    parts = rows.groupBy(F.floor(F.col("at") / _SEGMENT)).applyInPandas(packed, "at int, bits binary").collect()  # no more than the filter's bytes
    if not parts:
        return None
    bits = np.zeros(max(size // 64, _SEGMENT), np.int64)
    for r in parts:
        bits[r["at"] * _SEGMENT : (r["at"] + 1) * _SEGMENT] = np.frombuffer(r["bits"], np.int64)
    return found.sparkSession.sparkContext.broadcast(bits[: size // 64].tobytes())


def _spelt(blocks: DataFrame, chosen: Broadcast | None, filters: list[Broadcast | None] | None) -> DataFrame:
    """Occurrences, by their words, of what a filter may hold: phrases of several words, or where no steps' filters are given
    single words, and all words as an empty phrase."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = chosen and np.frombuffer(chosen.value, np.uint64)
        reached = None if filters is None else _reached(_opened(filters))
        with np.errstate(over="ignore"):
            for lang, size, ids, text, hashes in _each(batches):
                words, phrases, counts = text.split(b" "), [], []
                if reached is None:
                    n = np.bincount(ids[:size][ids[:size] >= 0], minlength=len(hashes))
                    due = np.flatnonzero((n > 0) & within(hashes, bits)) if bits is not None else []
                    phrases += ["", *(words[i].decode("utf-8", "replace") for i in due)]
                    counts += [int(n.sum()), *n[due].tolist()] if len(due) else [int(n.sum())]
                elif bits is not None:
                    for length, where, found, _ in levels(ids, hashes, reached):
                        due = np.flatnonzero(where < size)
                        due = due[within(found[due], bits)]
                        # by hash, unless two phrases of one hash stand in the block: so none are ever mixed up
                        spelt = np.stack([ids[where[due] + k] for k in range(length)], axis=1)
                        _, first, at, n = np.unique(found[due], return_index=True, return_inverse=True, return_counts=True)
                        own = spelt[first]
                        if not np.array_equal(own[at], spelt):
                            own, n = np.unique(spelt, axis=0, return_counts=True)
                        phrases += [b" ".join([words[i] for i in row]).decode("utf-8", "replace") for row in own.tolist()]
                        counts += list(n)
                yield pd.DataFrame({"lang": pd.Series([lang] * len(phrases), dtype=object), "phrase": pd.Series(phrases, dtype=object), "n": np.array(counts, dtype=np.int64)})

    return blocks.select("lang", "size", "ids", "words", "hashes").mapInPandas(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def _word_hashes(phrases: DataFrame) -> DataFrame:
    """Hashes of all words of phrases."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for lang, words in batch.groupby("lang", sort=False)["word"]:
                    yield pd.DataFrame({"h": Words(lang).hashes([w.encode() for w in words]).view(np.int64)})

    words = phrases.select("lang", F.explode(F.split("phrase", " ")).alias("word")).distinct()
    return words.mapInPandas(run, "h long")


def count_phrases(docs: DataFrame, *, least: int = 30, shards: int = 2, filter_bits: int = 1 << 25) -> DataFrame:
    """(lang, phrase, f) of all phrases of two to four words with ``least`` occurrences, and of their words; an empty phrase
    counts all words of a language.

    ``docs`` has lang and text, neither null. ``filter_bits``, a power of two, bounds what is broadcast a step;
    where there are more phrases than that serves, more are counted in vain, and the result is the same.
    """
    shard = F.pmod(F.xxhash64("lang", "text"), F.lit(shards)).cast("int")
    blocks = common.materialize(_blocks(docs.select("lang", "text", shard.alias("shard")), shards), "word-blocks", by=["shard"], codec="zstd")
    filters: list[Broadcast | None] = []
    whole: list[DataFrame] = []
    table, step = None, 0
    # nothing is in its cycle any more once no filter of the last steps opened anything
    while step < shards or any(b is not None for b in filters[-shards:]):
        counts = _scan(blocks.filter(F.col("shard") == step % shards), filters, step, shards).withColumn("reached", F.lit(None).cast("int"))
        begun = F.shiftright("tag", 3)
        if table is not None:
            counts = table.filter(begun > step - shards).unionByName(counts)
        # counts are combined within the tasks' blocks, so a hash has a row a block at most
        summed = counts.repartition("h").groupBy("h").agg(F.min("tag").alias("tag"), F.sum("n").alias("n"), F.min("reached").alias("reached"))
        often, over = F.col("n") >= least, begun <= step - shards + 1
        summed = summed.withColumn("reached", F.coalesce("reached", F.when(often, F.lit(step)))).filter(~over | often)
        before, table = table, common.materialize(summed, "phrase-counts", batch=1)
        if before is not None:
            common.release(before)
        filters.append(_filter(table.filter((F.col("reached") == step) & (F.col("tag") % 8 < LONGEST)), filter_bits))
        whole.append(common.materialize(table.filter(over & often & (F.col("tag") % 8 > 1)).select("h"), "whole-phrases"))
        step += 1
    chosen = _filter(functools.reduce(DataFrame.union, whole), filter_bits)
    phrases = common.materialize(_spelt(blocks, chosen, filters).filter(F.col("f") >= least), "phrases", batch=1)
    words = common.materialize(_spelt(blocks, _filter(_word_hashes(phrases), filter_bits), None), "phrase-words", batch=1)
    return phrases.unionByName(words)


def _cuts(found: DataFrame) -> DataFrame:
    """Each phrase's two parts for each of its cuts."""
    words = F.split("phrase", " ")
    cut = found.select("lang", "phrase", "f", F.size(words).alias("m"), words.alias("w")).filter("m > 1")
    cut = cut.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    return cut.select("lang", "phrase", "f", "m", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("tail"))


def collocations(docs: DataFrame, *, least: int = 30, most: int = 2000, share: int = 80, shards: int = 2, filter_bits: int = 1 << 25, lang: str = "lang", text: str = "text") -> DataFrame:
    """The first ``most`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Pieces end at ``.,;:!?`` and line ends, words at spaces and tabs; phrases lie within a piece. ``a`` is how often
    the phrase occurs, ``l`` and ``r`` its two parts at the cut with the smallest score 2000000 a / (l + r),
    ``n`` all words of the language. Phrases within a longer one that has ``share`` per cent of their
    occurrences are left out. Order: score, a descending, then the phrase by its bytes. A null language is
    ``und``, a null text empty; repeated rows count each. Other columns are left out; no rows give none.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    with common.cleared() as kept:
        own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        found = count_phrases(own, least=least, shards=shards, filter_bits=filter_bits)
        named = found.filter("phrase <> ''")
        several = named.filter("phrase LIKE '% %'")
        total = found.filter("phrase = ''").select("lang", F.col("f").alias("n"))
        cuts = _cuts(several)
        heads = named.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
        tails = named.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
        exact = F.expr("CAST((CAST(f AS DECIMAL(28,0)) * CAST(2000000 AS DECIMAL(10,0))) DIV CAST(l + r AS DECIMAL(20,0)) AS BIGINT)")
        met = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", exact)
        best = met.groupBy("lang", "phrase", "f", "m").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
        # the largest count of a longer phrase around each phrase
        words = F.split("phrase", " ")
        longer = several.select("lang", "f", words.alias("w")).filter("size(w) > 2")
        inner = longer.select("lang", "f", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m")).select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i"))
        around = inner.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("f").alias("around"))
        left = best.join(around, ["lang", "phrase"], "left").filter(~F.coalesce(F.col("around") * 100 >= F.col("f") * share, F.lit(False)))
        # the first of each part of a language, then of the language, so that no language's phrases meet in one task
        order = [F.desc("b.score"), F.desc("f"), F.col("phrase")]
        left = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
        first = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= most)
        first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
        result = first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
        result = common.materialize(result, "collocations")
        kept.append(result)
    return result
