"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Every run of ``window`` consecutive words of an item is a pattern; an item with fewer words, but
not none, is one pattern. Each document is read once, as a sequence of word numbers, and hits are
mapped back to character offsets of the original text. The automaton works on words, not bytes, so
that it never matches within a word and stays ten times smaller.

The patterns reach the tasks as a broadcast of at most ``block_chars`` characters of items. All usual
benchmarks fit one automaton. A larger set of items is dealt into blocks by hash, one pass over the
documents each, whose results are written before the next block's automaton is built: memory, on the
driver and in tasks, follows the block, and time the number of blocks. Documents are not shuffled.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import common

SPAN = StructType([StructField("first", LongType()), StructField("last", LongType()), StructField("start", LongType()), StructField("end", LongType())])
LEAK = StructType([StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType())), StructField("spans", ArrayType(SPAN))])
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def patterns(rows, window: int) -> dict[tuple[bytes, ...], set[str]]:
    """Word windows of items, each with the ids of its items. A null id marks words but is not listed."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item_id, text in rows:
        words = common.fold_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i : i + window]), set()).update([] if item_id is None else [str(item_id)])
    return found


def _automaton(shared):
    """The automaton of a block and its word numbers; a worker keeps the latest one."""
    import ahocorasick

    def build() -> tuple:
        numbers: dict[bytes, int] = {}
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, items in shared.value:
            machine.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in words), (len(words), items))
        if numbers:
            machine.make_automaton()
        return machine, numbers

    return common.held(("automaton", shared.id), build)


class _Shared:
    """A broadcast with a number of its own."""

    def __init__(self, broadcast, number: int):
        self.broadcast, self.id = broadcast, number

    @property
    def value(self):
        return self.broadcast.value


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint half-open word ranges that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _leak(text: str | None, machine, numbers) -> tuple:
    words = common.fold_words(text)
    spans, items = [], set()
    if numbers and words:
        for end, (n, ids) in machine.iter(tuple(map(numbers.get, words, itertools.repeat(0)))):
            spans.append((end - n + 1, end + 1))
            items.update(ids)
    if not spans:
        return len(words), 0, [], []
    runs = merged(spans)
    at = [m.span() for m in _WORD.finditer(text)]
    return len(words), sum(b - a for a, b in runs), sorted(items), [(a, b, at[a][0], at[b - 1][1]) for a, b in runs]


def _scan(shared: _Shared):
    @F.pandas_udf(LEAK)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine, numbers = _automaton(shared)
        for texts in batches:
            yield pd.DataFrame([_leak(t, machine, numbers) for t in texts], columns=LEAK.names)

    return scan


@F.pandas_udf(LEAK)
def _union(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Join what two blocks of items hit in the same documents."""
    rows = []
    for n, a, b, i, j in zip(left.n_words, left.spans, right.spans, left["items"], right["items"], strict=True):
        ends = {}
        for s in [*a, *b]:
            ends[s["first"], 0], ends[s["last"], 1] = s["start"], s["end"]
        runs = merged([(s["first"], s["last"]) for s in [*a, *b]])
        rows.append((n, sum(y - x for x, y in runs), sorted({*i, *j}), [(x, y, ends[x, 0], ends[y, 1]) for x, y in runs]))
    return pd.DataFrame(rows, columns=LEAK.names)


def find_leaks(docs: DataFrame, items: DataFrame, *, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = 8_000_000, column: str = "leak") -> DataFrame:
    """Add ``column``: words of the text, words inside item windows, ids of the items, merged spans.

    A span gives the first and one-past-last word and the same as character offsets of the original
    text. Null and empty texts have no words and no hits; texts of any length are scanned whole; repeated
    rows are judged one by one; an empty table of items hits nothing, of documents gives no rows;
    repeated items count once, and of an item of several texts each is looked for. An existing column of
    that name is replaced, others pass through, whatever their names.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    kept = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull())
    blocks = common.sum_chars(kept, ["text"]) // block_chars + 1
    out = common.without(docs, column)
    other = common.fresh([*out.columns, column], "leak_block")[0]
    for k in range(blocks):
        if k:
            out = common.materialize(out, "leaks")
            shared.broadcast.unpersist()
        rows = kept.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        shared = _Shared(spark.sparkContext.broadcast([(w, sorted(ids)) for w, ids in patterns(rows, window).items()]), next(_numbers))
        found = _scan(shared)(F.col(text))
        if k == 0:
            out = out.withColumn(column, found)
        else:
            out = out.withColumn(other, found).withColumn(column, _union(column, other)).drop(other)
    return out


_numbers = itertools.count()


def drop_leaked(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Only the documents in which no item window occurs, columns unchanged."""
    leak = common.fresh(docs.columns, "leak")[0]
    return find_leaks(docs, items, column=leak, **options).filter(F.col(f"{leak}.n_hit") == 0).drop(leak)
