"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

Two sets of sizes n and m that resemble each other by at least t share o >= t n and o >= t m members. In any common
order of the members, the first n - ceil(t n) + k of a set hold at least k of those shared, and the first k
shared ones at that. So if each document takes a prefix that is k members longer, two documents that link have at
least the smaller of their two k in common in their prefixes. A longer prefix meets more documents, but asks for
more matches, so each document chooses its own k where the estimated cost is least: members read, and candidates to
verify, of which there are no more than members read divided by k.

The order is rare members first. Counting all members of all documents isn't needed for it: a screen of prefixes
in the order of hashes, with k a tenth of the set, keeps a document only if at least k of its prefix
are held elsewhere too, as those of every document that has a link are. What stays is counted in full.

Documents of one set form a class first, so copies never pair. A prefix member's documents meet a hub, the one with
the fewest members of its own, not each other. Resemblance isn't transitive, so members with documents in
several components get other hubs. Then the rest is exact: what is still apart meets by its differences from a hub
(``differences``), so that no group gives all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, differences
from .near_dedup import _Words, components, full_sets, shingles, words_of

SETS = "digest binary, n_shingles long, screen array<long>"


def need(n: Column, percent: int) -> Column:
    """The least number of members that a set of ``n`` shares with any that it links with."""
    return F.ceil(n * F.lit(percent) / 100).cast("long")


def screened(found: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a sorted set for the screen: a tenth of the set is asked to match."""
    n = len(found)
    least = -(-n * percent // 100)
    return found[: n - least + min(least, _matches(n))]


def _matches(n: int) -> int:
    return max(1, n // 10)


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """id, digest and size of each row's set, and its screen; null for empty sets."""
    common.bound_batches(docs.sparkSession)

    @F.pandas_udf(SETS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import hashlib

        hashes = _Words()
        for texts in batches:
            out = []
            for t in texts:
                found = shingles(words_of(t), hashes, width)
                n = len(found)
                out.append((hashlib.md5(found.tobytes()).digest(), n, screened(found, percent).view(np.int64)) if n else (None, 0, None))
            yield pd.DataFrame(out, columns=["digest", "n_shingles", "screen"])

    return docs.withColumn("s", run("text")).select("id", "s.*")


def _members(sets: DataFrame) -> DataFrame:
    """A row for each member of each set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, n, part, held in zip(batch["node"], batch["n"], batch["part"], batch["held"], strict=True):
                yield pd.DataFrame({"node": node, "part": part, "n": n, "token": np.frombuffer(held, np.int64)})

    return sets.select("node", "n", F.xxhash64("held").alias("part"), "held").mapInPandas(run, "node long, part long, n long, token long")


def prefixes(members: DataFrame, percent: int, verify: float = 0.25) -> DataFrame:
    """token, node, n, own, k: each set's adaptive prefix, of members that other sets hold as well.

    ``own`` counts members that no other set holds; sets with so many of them that no link is left are
    left out. ``verify`` is the cost of verifying a candidate by a set's member, against that of reading a member's
    document in a prefix. By the sum of them each set takes the length that costs least.
    """
    often = common.materialize(members.groupBy("token").agg(F.count("*").alias("f")), "token-counts")
    ranked = members.join(often, "token").withColumn("r", F.row_number().over(Window.partitionBy("node", "part").orderBy("f", "token")).cast("long"))
    so_far = Window.partitionBy("node", "part").orderBy("f", "token").rowsBetween(Window.unboundedPreceding, 0)
    ranked = common.materialize(ranked.withColumn("met", F.sum(F.col("f") - 1).over(so_far)), "ranked")
    k = F.col("r") - (F.col("n") - need(F.col("n"), percent))
    cost = F.col("met") * (1 + verify * F.col("n") / k)
    chosen = ranked.groupBy("node", "part").agg(
        F.min_by(F.when(k >= 1, k), F.when(k >= 1, F.struct(cost, k))).alias("k"),
        F.min_by(F.when(k >= 1, F.col("r")), F.when(k >= 1, F.struct(cost, k))).alias("last"),
        F.count(F.when(F.col("f") == 1, 1)).alias("own"),
        F.max("n").alias("size"),
    )
    chosen = chosen.filter(100 * (F.col("size") - F.col("own")) >= percent * F.col("size"))
    return ranked.join(chosen, ["node", "part"]).filter("r <= last AND f > 1").select("token", "node", "n", "own", "k")


def _packed(sets: DataFrame, prefix: DataFrame) -> DataFrame:
    """Each document's whole set and its prefix in one row: node, held, head, k."""
    heads = prefix.groupBy("node").agg(F.sort_array(F.collect_set("token")).alias("head"), F.min("k").alias("k"))  # no more than the set
    return sets.select("node", "held").join(heads, "node")


def _linked(pairs: DataFrame, packed: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that share as many prefix members as the smaller of their two k, and whose full sets resemble each other enough."""
    left, right = (packed.select(F.col("node").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("held", "head", "k")]) for n in ("u", "v"))

    @F.pandas_udf("boolean")
    def alike(k_u: pd.Series, k_v: pd.Series, head_u: pd.Series, head_v: pd.Series, held_u: pd.Series, held_v: pd.Series) -> pd.Series:
        out = []
        for k, m, x, y, a, b in zip(k_u, k_v, head_u, head_v, held_u, held_v, strict=True):
            if len(np.intersect1d(x, y, assume_unique=True)) < min(k, m):
                out.append(False)
                continue
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            same = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * same >= percent * (len(a) + len(b) - same))
        return pd.Series(out, dtype=bool)

    met = pairs.join(left, "u").join(right, "v")
    return met.filter(alike("k_u", "k_v", "head_u", "head_v", "held_u", "held_v")).select("u", "v").distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()


def _labelled(prefix: DataFrame, labels: DataFrame) -> DataFrame:
    return common.materialize(prefix.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")


def _open(labelled: DataFrame, pick: Column) -> DataFrame:
    """Prefix members that documents of several components hold, with their hub: the document of the least pick."""
    by = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct(pick, "node")).alias("hub"))
    return labelled.join(common.materialize(by.filter("low < high").select("token", F.col("hub.node").alias("hub")), "open-members"), "token")


def _apart(met: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents in another component than their hub."""
    hub_label = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    return met.filter("node <> hub").join(hub_label, "hub", "left").filter(F.col("label") != F.coalesce("hub_label", "hub"))


def join(docs: DataFrame, *, width: int = 3, percent: int = 90, rounds: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, n_shingles, component_id.

    A set holds the distinct shingles of ``width`` words, A-Z lower-cased; fewer words are one shingle. Documents link
    from ``percent`` per cent of the union on; a component is named by the smallest id that links reach.
    Null and texts without words are empty and linked with nothing. Rows that share an id are one
    document with several texts. A null id is linked with nothing and has a null component. An empty
    table gives no rows; other columns are left out.
    """
    with common.cleared() as kept:
        own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
        made = common.materialize(_sets(own, width, percent), "sets")
        full = made.filter("n_shingles > 0 AND id IS NOT NULL")
        classes = common.materialize(full.groupBy("digest").agg(F.min("id").alias("node")), "classes")
        member = full.select("id", "digest").join(classes, "digest").select("id", "node")
        shared = member.groupBy("id").agg(F.min("node").alias("u"), F.max("node").alias("v")).filter("u < v").select("id", "u")
        same = member.join(shared, "id").filter("u < node").select("u", F.col("node").alias("v"))

        # the screen: documents enough of whose prefix stands elsewhere too
        nodes = full.join(classes, "digest").filter("id = node")
        tokens = common.materialize(nodes.select("node", F.xxhash64("digest").alias("part"), F.col("n_shingles").alias("n"), F.explode("screen").alias("token")), "screens")
        twice = tokens.groupBy("token").agg(F.count("*").alias("f")).filter("f > 1").select("token")
        asked = F.least(need(F.col("n"), percent), F.greatest(F.lit(1), F.floor(F.col("n") / 10)))
        alive = tokens.join(twice, "token").groupBy("node", "part", "n").agg(F.count("*").alias("met")).filter(F.col("met") >= asked).select("node").distinct()
        alive = common.materialize(alive, "screened")
        texts = own.join(alive, F.col("id") == F.col("node"), "left_semi").select(F.col("id").alias("node"), "text").dropDuplicates()
        sets = common.materialize(full_sets(texts, width).withColumn("n", (F.octet_length("held") / 8).cast("long")), "full-sets")
        members = common.materialize(_members(sets), "members")
        prefix = common.materialize(prefixes(members, percent), "prefixes")
        packed = common.materialize(_packed(sets, prefix), "packed-sets")

        tested = None
        links = common.materialize(same, "links")
        labels = components(links)

        def linked(pairs: DataFrame) -> None:
            """Test pairs that weren't yet, and take in the links among them."""
            nonlocal tested, labels
            fresh = pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti")
            fresh = common.materialize(fresh, "pairs")
            if fresh.isEmpty():
                return
            tested = fresh if tested is None else tested.union(fresh)
            found = common.materialize(_linked(fresh, packed, percent), "links")
            if not found.isEmpty():
                labels = components(labels.select(F.col("label").alias("u"), F.col("node").alias("v")).union(found))

        # hubs: the document with the fewest members of its own first, then by a hash of each member's own
        for k in range(1 + rounds):
            met = _open(_labelled(prefix, labels), F.col("own") if k == 0 else F.xxhash64("token", "node", F.lit(k)))
            votes = _apart(met, labels).groupBy("node", "hub").agg(F.count("*").alias("c"))
            best = votes.groupBy("node").agg(F.max_by("hub", F.struct("c", -F.col("hub"))).alias("other"))
            linked(_ordered(best))

        # the rest, exactly: all documents of members that still have several components
        met = common.materialize(_open(_labelled(prefix, labels), F.col("own")), "open-members")
        if not met.isEmpty():
            hubs = _ordered(_apart(met, labels).select("node", F.col("hub").alias("other")))
            linked(hubs.union(differences.pairs_apart(met.select("hub", "node", "label"), sets, percent)).distinct())

        named = member.join(labels, "node", "left").groupBy("id").agg(F.min(F.coalesce("label", "node")).alias("component_id"))
        named = common.materialize(named, "components")
        kept += [made, named]
    rest = made.select(F.col("id").alias("__id"), "n_shingles")
    result = rest.join(named, rest["__id"] == named["id"], "left")
    return result.select(F.col("__id").alias("doc_id"), "n_shingles", F.coalesce("component_id", "__id").alias("component_id"))

