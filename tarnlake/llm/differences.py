"""Links within a group of sets, by their differences from one of them.

Take a hub h; a set x lacks some of its members, a(x), and has others, b(x). If x and y have s of these differences in
common, they share |h| - a(x) - a(y) + s members and have |h| + b(x) + b(y) - s in their union. So they resemble each
other by t or more just if (1 + t) s >= r(x) + r(y) - R, where r = a + t b and R = (1 - t) |h|; a set with r <= R links with
the hub. Once all sets were compared with the hub, what is left are pairs in which one does not link with it, r(x) > R: they
need more than r(y) / (1 + t) differences in common out of y's, and (r(x) - R) / (1 + t) out of x's. In any common
order two sets that need so many meet within the first so many less of each, and the rarest differences come first. Two
sets that meet need a number that both their sizes give, which is larger, so they ask each other for fewer places still.
So sets that have in common what their whole group has never meet, nor those that lack a few of the same members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

FOUND = "hub long, node long, n long, lacking long, more long, hub_n long, token long, lacks boolean"


def differences(met: DataFrame, sets: DataFrame, *, most: int = 100_000) -> DataFrame:
    """For each (hub, node) of ``met``: the sizes, how many members differ, and a row for each of them.

    ``sets`` holds node and the set as sorted 64-bit hashes. ``lacks`` marks members that the hub alone holds. Python
    passes on about ``most`` rows at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("hub", "node", "n", "lacking", "more", "hub_n")
        for batch in batches:
            sizes, tokens, held = [], [], 0
            for hub, node, a, b in zip(batch["hub"], batch["node"], batch["theirs"], batch["own"], strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                missing, more = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                sizes.append((hub, node, len(y), len(missing), len(more), len(x)))
                tokens += [missing, more]
                held += len(missing) + len(more)
                if held >= most:
                    yield table(sizes, tokens, names)
                    sizes, tokens, held = [], [], 0
            if sizes:
                yield table(sizes, tokens, names)

    def table(sizes: list[tuple], tokens: list[np.ndarray], names: tuple[str, ...]) -> pd.DataFrame:
        each = np.array(sizes, dtype=np.int64)
        lacks = np.repeat(np.tile([True, False], len(sizes)), [len(t) for t in tokens])
        rows = np.repeat(each, each[:, 3] + each[:, 4], axis=0)
        return pd.DataFrame(dict(zip(names, rows.T, strict=True)) | {"token": np.concatenate(tokens).view(np.int64), "lacks": lacks})

    theirs = sets.select(F.col("node").alias("hub"), F.col("held").alias("theirs"))
    own = sets.select("node", F.col("held").alias("own"))
    return met.join(theirs, "hub").join(own, "node").select("hub", "node", "theirs", "own").mapInPandas(run, FOUND)


def pairs_apart(met: DataFrame, sets: DataFrame, percent: int, *, matches: int = 4) -> DataFrame:
    """Pairs (u, v) of nodes with different labels that can still link, by a difference from a hub that both were met with.

    ``met`` has hub, node and label; a hub is to be compared with its nodes besides.
    """
    apart = common.materialize(met.filter("node <> hub").groupBy("hub", "node").agg(F.min("label").alias("label")), "apart")
    found = common.materialize(differences(apart.select("hub", "node"), sets).join(apart, ["hub", "node"]), "differences")
    key = ["hub", "token", "lacks"]
    counted = found.groupBy(*key).agg(F.count("*").alias("f"), F.min("label").alias("low"), F.max("label").alias("high"))
    held = found.join(common.materialize(counted, "difference-counts"), key)
    # in whole numbers: 100 r, and 100 R
    r, least = 100 * F.col("lacking") + percent * F.col("more"), (100 - percent) * F.col("hub_n")
    held = held.withColumns({"alone": r > least, "r": F.row_number().over(Window.partitionBy("hub", "node").orderBy("f", "token", "lacks"))})
    # what a pair of sets asks of a set: more than this of any two of which one is alone, or of one that is alone
    # with one that isn't; with so many more places as matches are asked for, up to ``matches``
    most, strict, loose = F.col("lacking") + F.col("more"), F.floor(r / (100 + percent)) + 1, F.greatest(F.lit(1), F.ceil((r - least) / (100 + percent)))
    held = held.withColumns({"near": F.col("r") <= most - strict + F.least(strict, F.lit(matches)), "far": F.col("alone") & (F.col("r") <= most - loose + F.least(loose, F.lit(matches)))})
    own = ("node", "label", "n", "alone", "lacking", "more", "hub_n", "r")
    prefix = common.materialize(held.filter("low < high AND (near OR far)").select(*key, *own), "difference-prefixes")
    other = prefix.select(*key, *[F.col(c).alias(f"other_{c}") for c in own])
    sizes = (100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")) & (F.col("node") < F.col("other_node")) & (F.col("label") != F.col("other_label"))
    # how many differences just this pair needs in common; the first ``asked`` of them have all others behind them in both
    needed = F.ceil((100 * (F.col("lacking") + F.col("other_lacking")) + percent * (F.col("more") + F.col("other_more")) - least) / (100 + percent))
    asked = F.least(needed, F.lit(matches))
    early = lambda x: F.col(f"{x}r") <= F.col(f"{x}lacking") + F.col(f"{x}more") - needed + asked
    enough = F.least("lacking", "other_lacking") + F.least("more", "other_more") >= needed
    met = prefix.join(other, key).filter(sizes & (F.col("alone") | F.col("other_alone")) & enough & early("") & early("other_"))
    by = met.groupBy("hub", "node", "other_node").agg(F.count("*").alias("shared"), F.min(asked).alias("asked")).filter("shared >= asked")
    return by.select(F.col("node").alias("u"), F.col("other_node").alias("v")).distinct()
