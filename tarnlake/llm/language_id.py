"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: how often a byte followed the one, two and three bytes
before it. A byte's probability comes from the longest context seen; a byte new to a context pays its
escape probability (distinct followers over all followers and distinct followers, method C) and is
looked up in the next shorter one, down to 1/256. The language with the shortest code wins.

Counts come from Spark, over a sample of labelled texts bounded by ``train_chars`` characters for each language and
``all_chars`` in all, and then stand still. The model is sparse: sorted byte strings of each order, and for each string
only the languages that have it, with the cost of its last byte; for each context the languages that have it, with
their escape. So it grows with the sample, not with strings times languages, and no language is left out. A text
is priced by its four-byte strings, different ones once for all texts of a batch: languages that have the string pay its
cost, others the escape of their context, and go one order down.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import common

ORDERS = 4  # strings of up to four bytes: contexts of up to three
UNDETERMINED = "und"
GUESS = StructType([StructField("lang", StringType()), StructField("score", DoubleType()), StructField("bits", DoubleType())])
_PAD = b"   "
_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text))


def codes(data: np.ndarray, order: int) -> np.ndarray:
    """The string of ``order`` bytes that ends at each byte after the padding, as a number."""
    n, out = len(data) - (ORDERS - 1), np.zeros(len(data) - (ORDERS - 1), dtype=np.uint32)
    for k in range(order):
        at = ORDERS - order + k
        out = (out << np.uint32(8)) | data[at : at + n].astype(np.uint32)
    return out


def padded(text: str) -> np.ndarray:
    return np.frombuffer(_PAD + text.encode("utf-8", "replace"), dtype=np.uint8)


_CELLS = 1 << 22  # of strings by languages that are scored at a time


def _expand(rows: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of these rows' entries, and which of the rows each belongs to."""
    n = ptr[rows + 1] - ptr[rows]
    owner = np.repeat(np.arange(len(rows)), n)
    return np.repeat(ptr[rows] - np.cumsum(n) + n, n) + np.arange(len(owner)), owner


@dataclass
class Sparse:
    """Sorted keys, and for each of them the languages that have it with a cost in bits."""

    keys: np.ndarray
    ptr: np.ndarray
    lang: np.ndarray
    cost: np.ndarray

    def entries(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the wanted keys that are there: which one, language, cost."""
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == wanted)
        place, owner = _expand(at[hit], self.ptr)
        return hit[owner], self.lang[place], self.cost[place]


@dataclass
class Model:
    """By order: what strings cost, and what escaping a context costs."""

    langs: list[str]
    strings: list[Sparse]
    escapes: list[Sparse]

    def bits(self, texts: list[np.ndarray]) -> np.ndarray:
        """Code lengths of padded texts: a row a text, a column a language. Texts are taken together, so that each
        different string is priced once, about as many bytes at a time as fill ``_CELLS`` with all languages."""
        total, most = np.zeros((len(texts), len(self.langs))), max(1 << 12, _CELLS // len(self.langs))
        parts, held = [], 0
        for i, data in enumerate(texts):
            for a in range(0, len(data) - len(_PAD), most):
                parts.append((i, codes(data[a : a + most + len(_PAD)], ORDERS)))
                held += len(parts[-1][1])
                if held >= most:
                    self._add(total, parts)
                    parts, held = [], 0
        if parts:
            self._add(total, parts)
        return total

    def _add(self, total: np.ndarray, parts: list[tuple[int, np.ndarray]]) -> None:
        found, at = np.unique(np.concatenate([x for _, x in parts]), return_inverse=True)
        price = self._prices(found)
        ends = np.cumsum([0, *(len(x) for _, x in parts)])
        for k, (i, _) in enumerate(parts):
            total[i] += price[at[ends[k] : ends[k + 1]]].sum(axis=0, dtype=float)

    def _prices(self, found: np.ndarray) -> np.ndarray:
        """What the last byte of each four-byte string costs each language."""
        out, open_ = np.zeros((len(found), len(self.langs)), dtype=np.float32), np.ones((len(found), len(self.langs)), dtype=bool)
        todo = np.arange(len(found))
        for order in range(ORDERS, 0, -1):
            own = found[todo] & np.uint32(256**order - 1)
            at, lang, cost = self.strings[order - 1].entries(own)
            at = todo[at]
            due = open_[at, lang]
            out[at[due], lang[due]] += cost[due]
            open_[at, lang] = False
            still = open_[todo].any(axis=1)
            todo, own = todo[still], own[still]
            if not len(todo):
                return out
            at, lang, cost = self.escapes[order - 1].entries(own >> np.uint32(8))
            at = todo[at]
            due = open_[at, lang]
            out[at[due], lang[due]] += cost[due]
        return out + np.float32(8.0) * open_


def build(counts: pd.DataFrame) -> Model:
    """From rows (lang, n bytes, code, count): the frozen costs."""
    langs = sorted(counts["lang"].unique())
    size, number = len(langs), {x: i for i, x in enumerate(langs)}
    of_lang, strings, escapes = counts["lang"].map(number).to_numpy(dtype=np.int64), [], []
    for order in range(1, ORDERS + 1):
        rows = (counts["n"] == order).to_numpy()
        code, lang, n = counts["code"].to_numpy(dtype=np.int64)[rows], of_lang[rows], counts["count"].to_numpy(dtype=float)[rows]
        key, at = np.unique((code >> 8) * size + lang, return_inverse=True)  # a language's context
        total, kinds = np.bincount(at, n, len(key)), np.bincount(at, minlength=len(key))
        order_by = np.lexsort((lang, code))
        cost = -np.log2(n / (total + kinds)[at])
        strings.append(_sparse(code[order_by], lang[order_by], cost[order_by]))
        escapes.append(_sparse(key // size, key % size, -np.log2(kinds / (total + kinds))))
    return Model(langs, strings, escapes)


def _sparse(key: np.ndarray, lang: np.ndarray, cost: np.ndarray) -> Sparse:
    """From entries in the order of their keys."""
    keys, first = np.unique(key, return_index=True)
    return Sparse(keys.astype(np.uint32), np.append(first, len(key)).astype(np.int64), lang.astype(np.int32), cost.astype(np.float32))


def fit(docs: DataFrame, *, lang: str = "lang", text: str = "text", train: Column | None = None, train_chars: int = 3_000_000, all_chars: int = 24_000_000) -> Model | None:
    """Count strings of up to ORDERS bytes per language. None where there is nothing to learn from.

    The sample takes rows by hash of their text, so that about ``train_chars`` characters of each
    language remain, all where there are fewer, and less of each where that comes to more than
    ``all_chars``; a text of each language is always among them. Rows
    with a null language or an empty text teach nothing; repeated rows count each time.
    """
    common.bound_batches(docs.sparkSession)
    rows = docs if train is None else docs.filter(train)
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    size = F.length("text").cast("long")
    by = rows.groupBy(F.col("lang").alias("known")).agg(F.sum(size).alias("chars"), F.min(F.struct(size.alias("size"), F.xxhash64("text").alias("hash"))).alias("least"))
    by = common.materialize(by, "languages")
    n_langs = by.count()
    if not n_langs:
        return None
    share = F.least(F.lit(1_000_000), F.floor(F.lit(min(train_chars, max(1, all_chars // n_langs))).cast("long") * 1_000_000 / F.col("chars")) + 1)
    one = (size == F.col("least.size")) & (F.xxhash64("text") == F.col("least.hash"))
    sample = rows.join(by, F.col("lang") == F.col("known")).filter((F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share) | one).select("lang", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, group in batch.groupby("lang"):
                data = np.concatenate([padded(t) for t in group["text"]])
                ends = np.cumsum([len(t.encode("utf-8", "replace")) + len(_PAD) for t in group["text"]])[:-1]
                inside = np.ones(len(data) - len(_PAD), dtype=bool)
                for e in ends:
                    inside[max(0, e - len(_PAD)) : e] = False  # strings that would end in the next text's padding
                for n in range(1, ORDERS + 1):
                    code, count = np.unique(codes(data, n)[inside], return_counts=True)
                    yield pd.DataFrame({"lang": name, "n": n, "code": code.astype(np.int64), "count": count.astype(np.int64)})

    counted = sample.mapInPandas(run, "lang string, n int, code long, count long").groupBy("lang", "n", "code").agg(F.sum("count").alias("count"))
    found = counted.toPandas()  # bounded by the sample: all_chars
    common.release(by)
    return build(found) if len(found) else None


def _guesses(model: Model, texts: list[str | None]) -> list[tuple[str, float, float]]:
    out = [(UNDETERMINED, 0.0, 0.0)] * len(texts)
    told = [i for i, t in enumerate(texts) if t and has_letter(t)]
    for i, total in zip(told, model.bits([padded(texts[i]) for i in told]), strict=True):
        best = int(total.argmin())
        out[i] = model.langs[best], float(1 / np.exp2(np.maximum(total[best] - total, -1000.0)).sum()), float(total[best])
    return out


def identify(docs: DataFrame, model: Model | None, *, text: str = "text", column: str = "guess") -> DataFrame:
    """Add ``column``: language, its share of the probability of all, its code length in bits.

    Texts that are null or hold no letter, and all texts without a model, get ``und`` and 0. Texts of any
    length are scored whole, in blocks; repeated rows get the same; an empty table stays empty. An
    existing column of that name is replaced, others pass through, whatever their names.
    """
    common.bound_batches(docs.sparkSession)
    out = common.without(docs, column)
    if model is None:
        return out.withColumn(column, F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf(GUESS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(_guesses(shared.value, texts.tolist()), columns=GUESS.names)

    return out.withColumn(column, run(F.col(text)))
