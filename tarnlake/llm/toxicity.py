"""A toxicity classifier with counterfactual regularisation.

Logistic regression over which words, word beginnings and word ends a text holds. For each labelled
text that names a group, copies with the group swapped for others join the loss: it penalises the
squared change of the score's logit, so that naming a group, in itself, moves no score.

Features are chosen by Spark from a bounded sample of labelled rows (``max_rows``, taken by hash of
the id); the fit on the chosen ``n_features`` runs on the driver, within max_rows x n_features
32-bit numbers. Scoring reads every whole text where it lies, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType

from . import common

# Terms that name groups of people, by kind; a term is swapped for others of its kind.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "mexican", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "heterosexual", "queer"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("old", "young", "elderly", "disabled", "blind", "deaf"),
)
_GROUP = {term: group for group in IDENTITY_TERMS for term in group}
_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings (from the start) and ends that count as features besides whole words.
PARTS = (3, 4, 5, 6)


def word_features(word: str) -> list[str]:
    """The word, its beginnings and its last four letters, each marked by kind."""
    return [word, *(f"{word[:n]}*" for n in PARTS if len(word) > n), *([f"*{word[-4:]}"] if len(word) > 4 else [])]


def features(text: str | None) -> set[str]:
    """The distinct features of a whole text."""
    return {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}


def swaps(text: str | None, copies: int = 2) -> list[tuple[str, ...]]:
    """For each copy, pairs (term in the text, term put in its place); none where no group is named."""
    terms = sorted(set(_WORD.findall((text or "").lower())) & _GROUP.keys())
    out = []
    for k in range(1, copies + 1):
        pairs = tuple((t, _GROUP[t][(_GROUP[t].index(t) + k) % len(_GROUP[t])]) for t in terms)
        if any(a != b for a, b in pairs):
            out.append(pairs)
    return out


@dataclass
class Model:
    """Weights by feature, and the score of a text without any."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights.get(f, 0.0) for f in features(text))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit_weights(names: list[str], texts: Iterable[str | None], labels: np.ndarray, *, l2: float = 1e-4, counterfactual: float = 1.0, steps: int = 300, rate: float = 0.1) -> Model:
    """Minimise log loss + l2 |w|^2 + counterfactual * mean squared logit change under swaps."""
    texts = list(texts)
    number = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(texts), len(names)), dtype=np.float32)
    shifts = []
    for i, text in enumerate(texts):
        have = features(text)
        x[i, [number[f] for f in have if f in number]] = 1
        for pairs in swaps(text):
            words = (set(_WORD.findall((text or "").lower())) - {a for a, _ in pairs}) | {b for _, b in pairs}
            after = {f for w in words for f in word_features(w)}
            shift = {number[f]: 1.0 for f in after - have if f in number} | {number[f]: -1.0 for f in have - after if f in number}
            if shift:
                shifts.append(shift)
    swapped = np.zeros((len(shifts), len(names)), dtype=np.float32)
    for i, shift in enumerate(shifts):
        swapped[i, list(shift)] = list(shift.values())
    y = labels.astype(np.float32)
    rare = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    w, b = np.zeros(len(names), dtype=np.float32), math.log(rare / (1 - rare))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        off = 1 / (1 + np.exp(-np.clip(x @ w + b, -60, 60))) - y
        g, gb = x.T @ off / max(1, len(y)) + 2 * l2 * w, float(off.mean()) if len(y) else 0.0
        if len(shifts):
            g += counterfactual * 2 * (swapped.T @ (swapped @ w)) / len(shifts)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix, fix2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        b -= rate * (mb / fix) / (math.sqrt(vb / fix2) + 1e-8)
    return Model({n: float(w[i]) for n, i in number.items() if w[i]}, float(b))


@F.pandas_udf(ArrayType(StringType()))
def _features(texts: pd.Series) -> pd.Series:
    common.drop_held()
    return pd.Series([sorted(features(t)) for t in texts], dtype=object)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text: str = "text", train: Column | None = None, max_rows: int = 12_000, n_features: int = 1000, min_rows: int = 3, counterfactual: float = 1.0) -> Model:
    """Fit on at most ``max_rows`` labelled rows of ``docs`` for which ``train``, over the labels' id, holds.

    Rows without id, label or text teach nothing; a repeated id counts by its highest label. Without
    any labelled row the model scores 0.5 for all texts, just above which nothing lies.
    """
    common.bound_batches(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__label")).filter(F.col("__id").isNotNull() & F.col("__label").isNotNull())
    if train is not None:
        marked = marked.filter(train)
    chosen = marked.groupBy("__id").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).filter(F.col("__text").isNotNull()).join(F.broadcast(chosen), "__id")  # max_rows ids at most
    rows = common.materialize(rows.select("__label", "__text"), "toxicity-sample")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("__label"), F.lit(0)).alias("p")).first()
    if not total["n"]:
        return Model({}, -1e-9)
    counted = rows.select("__label", F.explode(_features("__text")).alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("__label").alias("p"))
    share = total["p"] / total["n"]
    spread = F.abs(F.col("p") - F.col("n") * share) / F.sqrt(F.col("n") * F.lit(max(share * (1 - share), 1e-6)))
    best = counted.filter(F.col("n") >= min_rows).orderBy(spread.desc(), "f").limit(n_features)
    named = [t for group in IDENTITY_TERMS for t in group]
    names = list(dict.fromkeys([r["f"] for r in best.select("f").collect()] + named))
    known = frozenset(names)

    @F.pandas_udf(StringType())
    def telling(texts: pd.Series) -> pd.Series:
        """The words of a text that hold a chosen feature."""
        return pd.Series([" ".join(sorted(w for w in set(_WORD.findall(t.lower())) if not known.isdisjoint(word_features(w)))) for t in texts], dtype=object)

    order = F.xxhash64("__text").alias("order")
    sample = rows.select("__label", order, telling("__text").alias("words")).orderBy("order", "__label").limit(max_rows).collect()  # max_rows short texts
    return fit_weights(names, [r["words"] for r in sample], np.array([r["__label"] for r in sample]), counterfactual=counterfactual)


def score(docs: DataFrame, model: Model, *, text: str = "text", column: str = "toxicity") -> DataFrame:
    """Add ``column``, the model's score of the whole text; null and empty texts get the bias alone.

    Repeated rows get the same score; an empty table stays empty. An existing column of that name is
    replaced, others pass through, whatever their names.
    """
    common.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n_features weights

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        common.drop_held()
        model, memo = shared.value, {}
        for texts in batches:
            out = []
            for t in texts:
                hit: set[str] = set()
                for w in set(_WORD.findall(t.lower())) if t else ():
                    if (known := memo.get(w)) is None:
                        if len(memo) > 300_000:
                            memo.clear()
                        known = memo[w] = tuple(f for f in word_features(w) if f in model.weights)
                    if known:
                        hit.update(known)
                z = model.bias + sum(model.weights[f] for f in sorted(hit))
                out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            yield pd.Series(out, dtype=float)

    return common.without(docs, column).withColumn(column, run(F.col(text)))


def reject_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """Fit on the labelled documents and keep those that score below the threshold, columns unchanged.

    Rows with null or empty texts, repeated rows and rows without id are scored like any other.
    """
    name = common.fresh(docs.columns, "toxicity")[0]
    return score(docs, fit(docs, labels, **options), column=name).filter(F.col(name) < threshold).drop(name)


def predicted(score_column: str, threshold: float = 0.5) -> Column:
    """1 from the threshold on, else 0."""
    return (F.col(score_column) >= threshold).cast(IntegerType())
