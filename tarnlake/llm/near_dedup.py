"""Near-duplicate groups with SetSketch registers.

A document's set holds its distinct shingles of ``width`` words. Each shingle gives, from its hash, a
sequence of points with exponential distances, each in one of ``bands * rows`` registers; the smallest
point of a register is rounded on a logarithmic scale of a small base and truncated to 16 bits: a
SetSketch. As the points of a shingle ascend, it is done as soon as they lie beyond all registers, after
a few points in large sets. Registers merge by maximum and agree with a probability close to the sets'
resemblance, so documents that agree in all registers of a band are candidates. From the registers and
the sizes of a candidate pair the resemblance is estimated by maximum likelihood over how many registers
are equal, larger and smaller; pairs that lie far below the bound (``slack`` standard errors) are
dropped, all others are confirmed on full sets.

Documents with the same words form one class first, so copies never pair. Within a bucket candidates
are pairs with one hub, not all pairs: the member that meets the most others over all its buckets, which of a
family is the text, or a copy close to it, that the others were made of. As resemblance isn't transitive, buckets whose members are
then still in different components get other hubs, and at last the pairs across components that share a
difference from a hub (``differences``), so that no candidate link is lost and no group gives all its pairs. Every step is a join or an aggregate with partial sums; big
buckets and groups meet only in joins that adaptive execution splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from . import common, differences

SKETCH = StructType([StructField("digest", BinaryType()), StructField("n_shingles", LongType()), StructField("bands", ArrayType(LongType())), StructField("registers", BinaryType())])
BASE, RATE = 1.02, 20.0  # of the logarithmic scale; 16 bits then reach far beyond any set's size
_LIMIT = 2**16 - 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with all bits mixed."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Runs between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(common.LOWER_ASCII).split() if text else []


def shingles(words: list[bytes], hashes: _Words, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than ``width`` make one shingle."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(len(h), width)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(h))):
            out = _mixed(out * _MIX + h[k : k + n])
    return np.unique(out)


def sketch(found: np.ndarray, size: int) -> np.ndarray:
    """Registers of a set that is not empty.

    Points are dealt to ``size`` registers with replacement, so that each register sees the points of a
    shingle at a rate of one, independent of the others. ``size`` may be up to 2048.
    """
    least = np.full(size, np.inf)
    todo, at, first = found, np.zeros(len(found)), 1
    # until all registers are filled a shingle needs about size ln(size) / n points; a few more in one go
    step = max(3, math.ceil(1.3 * size * (math.log(size) + 1) / len(found)) + 2)
    while len(todo):
        with np.errstate(over="ignore"):
            k = np.arange(first, first + step, dtype=np.uint64)
            h = _mixed(todo[:, None] + k * _MIX)
        gaps = -np.log((h >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / size
        gaps[:, 0] += at
        points = np.cumsum(gaps, axis=1)
        register = ((h & np.uint64(2047)) * np.uint64(size)) >> np.uint64(11)
        near = points < least.max()
        np.minimum.at(least, register[near].astype(np.int64), points[near])
        more = points[:, -1] < least.max()
        todo, at, first, step = todo[more], points[more, -1], first + step, max(3, step // 2)
    return np.clip(np.floor(1 - np.log(least / RATE) / math.log(BASE)), 0, _LIMIT).astype(np.uint16)


def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(left, right)


_GRID = np.linspace(0.0, 1.0, 257)


def likely(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int) -> float:
    """Maximum-likelihood resemblance from registers that are equal, larger and smaller, and the sets' sizes.

    With shares u and v of the sizes' sum, and resemblance j, a register is larger on the left with
    probability p(u - v j), on the right with p(v - u j), where p(x) = -log_b(1 - x (b - 1) / b).
    """
    u, v = n_left / (n_left + n_right), n_right / (n_left + n_right)
    more, less = np.count_nonzero(left > right), np.count_nonzero(left < right)
    j = _GRID * min(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / math.log(BASE)
    larger, smaller = p(u - v * j), p(v - u * j)
    fit = sum(n * np.log(np.clip(q, 1e-12, None)) for n, q in ((more, larger), (less, smaller), (len(left) - more - less, 1 - larger - smaller)))
    return float(j[fit.argmax()])


def sketches(docs: DataFrame, *, width: int, bands: int, rows: int, id_col: str, text: str) -> DataFrame:
    """doc id, digest of the words, size of the set, band hashes, registers; arrays null for empty sets."""
    common.bound_batches(docs.sparkSession)

    @F.pandas_udf(SKETCH)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import hashlib

        common.drop_held()
        hashes = _Words()
        number = np.arange(bands, dtype=np.uint64)
        for texts in batches:
            out = []
            for t in texts:
                words = words_of(t)
                if not words:
                    out.append((None, 0, None, None))
                    continue
                found = shingles(words, hashes, width)
                registers = sketch(found, bands * rows)
                with np.errstate(over="ignore"):
                    key = number + np.uint64(1)
                    for column in registers.reshape(bands, rows).astype(np.uint64).T:
                        key = _mixed(key * _MIX + column)
                out.append((hashlib.md5(b" ".join(words)).digest(), len(found), key.view(np.int64), registers.tobytes()))
            yield pd.DataFrame(out, columns=SKETCH.names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).withColumn("s", run("text")).select("id", "s.*")


def _likely_pairs(pairs: DataFrame, registers: DataFrame, least: float) -> DataFrame:
    """Pairs whose estimated resemblance reaches the lower bound."""
    left = registers.withColumnsRenamed({"node": "u", "registers": "a", "n_shingles": "n_a"})
    right = registers.withColumnsRenamed({"node": "v", "registers": "b", "n_shingles": "n_b"})

    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        of = lambda x: np.frombuffer(x, dtype=np.uint16)
        return pd.Series([likely(of(x), of(y), n, m) for x, y, n, m in zip(a, b, n_a, n_b, strict=True)], dtype=float)

    return pairs.join(left, "u").join(right, "v").filter(estimate("a", "b", "n_a", "n_b") >= least).select("u", "v").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, *, width: int, percent: int) -> DataFrame:
    """Pairs (u, v) of nodes whose full sets resemble each other enough."""
    left = texts.withColumnsRenamed({"node": "u", "text": "left"})
    right = texts.withColumnsRenamed({"node": "v", "text": "right"})
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "left", "right")

    @F.pandas_udf("boolean")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hashes, memo = _Words(), {}

        def of(text: str) -> np.ndarray:
            if text not in memo:
                if len(memo) >= 64:
                    memo.clear()
                memo[text] = shingles(words_of(text), hashes, width)
            return memo[text]

        for a, b in batches:
            out = []
            for x, y in zip(a, b, strict=True):
                x, y = of(x), of(y)
                same = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pd.Series(out, dtype=bool)

    return both.filter(alike("left", "right")).select("u", "v")


def components(edges: DataFrame, *, most: int = 60) -> DataFrame:
    """(node, label): the smallest node each node reaches, for all nodes of undirected edges (u, v).

    Large-star and small-star steps in turn: each links nodes to the smallest neighbour, over
    aggregates with partial minima; the number of edges never grows. Ends when nothing changes, and
    raises where ``most`` rounds, far beyond the logarithm of any number of nodes, don't reach that.
    """

    def star(of: DataFrame, large: bool) -> DataFrame:
        both = of.select(F.col("v").alias("x"), F.col("u").alias("y"))
        if large:
            both = both.union(of.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("x0"), F.least("x", "m").alias("m"))
        if large:
            least = common.materialize(least, "least")  # so that a join with a hub's many edges can be split
        met = both.join(least, both["x"] == least["x0"])
        if large:
            made = met.filter("y > x").select(F.col("m").alias("u"), F.col("y").alias("v"))
        else:
            made = met.select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("y").alias("v")), F.struct(F.col("m").alias("u"), F.col("x").alias("v")))).alias("e")).select("e.*")
        return made.filter("u < v").distinct()

    now = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()
    mark = None
    for _ in range(most):
        now = common.materialize(star(star(now, True), False), "edges")
        row = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (row["n"], row["x"]) == mark:
            break
        mark = row["n"], row["x"]
    else:
        raise RuntimeError(f"components still change after {most} rounds")
    return common.materialize(now.select(F.col("v").alias("node"), F.col("u").alias("label")).union(now.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()), "labels")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()


def _hash() -> Column:
    """A member's order, the same in all buckets, so that a family that fills many of them has few hubs."""
    return F.xxhash64("node")


def _weights(inside: DataFrame) -> DataFrame:
    """node and weight: how many members its buckets have."""
    sizes = inside.groupBy("bucket").agg(F.count("*").alias("size"))
    return inside.select("bucket", "node").join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("weight"))


def _open_buckets(inside: DataFrame, labels: DataFrame, hubs: int) -> tuple[DataFrame, DataFrame]:
    """Members with their component, and the buckets with several components, their size and hubs' hashes."""
    marked = common.materialize(inside.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")), "marked")
    picks = [F.min(_hash()), F.max(_hash())][:hubs]
    by = marked.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.array(*picks).alias("picks"), F.count("*").alias("n"))
    return marked, common.materialize(by.filter("a < b").select("bucket", "picks", "n"), "split-buckets")


def _last_hubs(inside: DataFrame, labels: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Members of the buckets with several components and more than two members; one of the commonest component is picked.

    All buckets pick in the same order, by weight, so that a group that meets in many of them has few hubs with few
    differences from the others, and of the commonest component, so that few members are apart from their hub.
    """
    named = inside.join(labels, "node", "left").join(_weights(inside) if weights is None else weights, "node")
    marked = common.materialize(named.select("bucket", "node", F.coalesce("label", "node").alias("label"), "weight"), "marked")
    parts = marked.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.max(F.struct("weight", "node")).alias("pick"))
    by = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "label", "pick")).alias("most"))
    # a bucket of two was its own hub's pair
    split = common.materialize(by.filter("parts > 1 AND n > 2").select("bucket", F.col("most.pick.node").alias("pick")), "split-buckets")
    return common.materialize(marked.join(split, "bucket").select("bucket", "node", "label", (F.col("node") == F.col("pick")).alias("picked")), "open-buckets")


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """node and its whole set as sorted 64-bit hashes."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = _Words()
        for batch in batches:
            yield pd.Series([shingles(words_of(t), hashes, width).tobytes() for t in batch], dtype=object)

    return texts.select("node", run("text").alias("held"))


def _last_pairs(open_: DataFrame, texts: DataFrame, *, width: int, percent: int) -> DataFrame:
    """Pairs of different components of a bucket that can still be links: with the picked document, its hub, and
    those that share a difference from it. Documents that have only what all of a bucket have in common never meet."""
    hubs = common.materialize(open_.filter("picked").select("bucket", F.col("node").alias("hub"), F.col("label").alias("hub_label")), "hubs")
    met = common.materialize(open_.join(hubs, "bucket").select("hub", "hub_label", "node", "label").distinct(), "open-members")
    sets = common.materialize(full_sets(texts.join(met.select("node").distinct(), "node", "left_semi"), width), "full-sets")
    with_hubs = _ordered(met.filter("label <> hub_label").select("node", F.col("hub").alias("other")))
    return with_hubs.union(differences.pairs_apart(met, sets, percent)).distinct()


def group(docs: DataFrame, *, width: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, slack: float = 7.0, hubs: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, n_shingles, component_id, kept.

    Links hold from ``percent`` per cent of the union on; a component is named by its smallest id.
    Null and texts without words are empty: linked with nothing, kept. Rows that share an id count as
    one document with several texts. A null id takes part with its text alone: it is linked with
    nothing, its component is null and it is kept. An empty table gives no rows.
    """
    with common.cleared() as kept:
        made = common.materialize(sketches(docs, width=width, bands=bands, rows=rows, id_col=id_col, text=text), "sketches")
        full = made.filter(F.col("n_shingles") > 0).filter("id IS NOT NULL")
        classes = common.materialize(full.groupBy("digest").agg(F.min("id").alias("node")), "classes")
        member = full.select("id", "digest").join(classes, "digest").select("id", "node")
        # rows that share an id join their classes
        nodes = full.join(classes, "digest").filter("id = node")

        placed = nodes.select("node", F.explode("bands").alias("bucket"))
        busy = placed.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("top")).filter("low < top").select("bucket")
        busy = common.materialize(busy, "buckets")
        inside = common.materialize(placed.join(busy, "bucket"), "bucket-members")
        weights = common.materialize(_weights(inside), "weights")
        middle = inside.join(weights, "node").groupBy("bucket").agg(F.max(F.struct("weight", -F.col("node"))).alias("hub"))
        middle = common.materialize(middle.select("bucket", (-F.col("hub.col2")).alias("hub")), "middles")
        involved = inside.select("node").distinct()
        own = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text).alias("text"))
        texts = common.materialize(own.join(involved, "node", "left_semi"), "candidate-texts")
        registers = common.materialize(nodes.select("node", "n_shingles", "registers").join(involved, "node", "left_semi"), "registers")

        shared = member.groupBy("id").agg(F.min("node").alias("u"), F.max("node").alias("v")).filter("u < v").select("id", "u")
        same = member.join(shared, "id").filter("u < node").select("u", F.col("node").alias("v"))

        # the hub shared by most bands first: one candidate per node
        stars = inside.join(middle, "bucket").filter("hub <> node").groupBy("node", "hub").agg(F.count("*").alias("n"))
        first = stars.groupBy("node").agg(F.max(F.struct("n", -F.col("hub"))).alias("best")).select("node", (-F.col("best.col2")).alias("other"))
        tested = common.materialize(_ordered(first), "pairs")
        bound = percent / 100
        least = bound - slack * math.sqrt(bound * (1 - bound) / (bands * rows))

        def confirmed(pairs: DataFrame) -> DataFrame:
            near = common.materialize(_likely_pairs(pairs, registers, least), "likely")
            return _confirmed(near, texts, width=width, percent=percent)

        links = common.materialize(confirmed(tested).union(same), "links")
        labels = components(links)

        def linked(fresh: DataFrame) -> None:
            """Test pairs that weren't yet and take in the links among them."""
            nonlocal tested, labels
            fresh = common.materialize(fresh.join(tested, ["u", "v"], "left_anti"), "pairs")
            if fresh.isEmpty():
                return
            tested = tested.union(fresh)
            found = common.materialize(confirmed(fresh), "links")
            if not found.isEmpty():
                labels = components(labels.select(F.col("label").alias("u"), F.col("node").alias("v")).union(found))

        if hubs:
            open_, split = _open_buckets(inside, labels, hubs)
            hub = open_.join(split.select("bucket", F.explode("picks").alias("pick")), "bucket").filter(_hash() == F.col("pick"))
            hub = common.materialize(hub.select("bucket", F.col("node").alias("hub"), F.col("label").alias("hub_label")), "hubs")
            pairs = open_.join(hub, "bucket").filter("label <> hub_label")
            linked(_ordered(pairs.select("node", F.col("hub").alias("other"))))

        open_ = _last_hubs(inside, labels, weights)
        if not open_.isEmpty():
            linked(_last_pairs(open_, texts, width=width, percent=percent))

        named = member.join(labels, "node", "left").groupBy("id").agg(F.min(F.coalesce("label", "node")).alias("component_id"))
        named = common.materialize(named, "components")
        kept += [made, named]
    rest = made.select(F.col("id").alias("__id"), "n_shingles")
    result = rest.join(named, rest["__id"] == named["id"], "left")
    component = F.coalesce("component_id", "__id")
    return result.select(F.col("__id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("__id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Keep each group's document of the smallest id, columns unchanged. Rows with a null id stay."""
    name = common.fresh(docs.columns, "gone")[0]
    gone = group(docs, id_col=id_col, text=text, **options).filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone.hint("merge"), F.col(id_col).cast("long") == F.col(name), "left_anti")
