"""Document fingerprints from spot signatures; DataFrame functions only.

A signature is an anchor, which is a common word directly before a content word, with the chain of the
``chain`` content words that follow it; common words in between are passed over. The set of a text's
signatures, as sorted 32-bit hashes, is its fingerprint: changes of layout, stock lines and single words
move few of them. Where more than ``STRETCH`` characters after the last common word (or the text's
beginning) go by without one, as in tables and lists, each further word begins a chain, so that such parts
count as well, and as they are, whatever stands around them. A text without any chain, which is a short
one, takes a chain at every word, and one with too few words for that its words as they are: equal texts
have equal, and never empty, fingerprints.

Two sets can only resemble each other as much as the shorter fills the longer, so sets are partitioned
by length on a logarithmic scale. ``similar`` joins sets of one or of neighbouring partitions that share
one of their rarest signatures, and compares those alone whose lengths still allow the likeness.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .licenses import let

# Common words that begin a chain, by language (English, French, German, Spanish, Italian, Portuguese, Dutch).
ANCHORS = (
    "the of and to in is a that",
    "de la le les et des un que",
    "der die und das von zu mit den",
    "el los las en del por una y",
    "il di che della lo gli sono",
    "os da dos uma não em do",
    "het een van niet zijn aan",
)
# Further common words, which no chain holds, by language.
SKIPPED = (
    "for on was with as be it this by are at from or an he",
    "est du dans pour au ce qui par sur ne pas avec",
    "ein eine ist für auf im nicht auch es sie dem",
    "se no con para su al más como",
    "per è alla nel più dei",
    "é ao com mais na no",
    "op te ook voor dat",
)
#: Characters without a common word after which each word begins a chain.
STRETCH = 80
_A, _W = "\x01", "[^ \x01]++"


def _one_of(lists) -> str:
    """An alternation of words by their first letters, of each the longest first."""
    words = sorted({w for x in lists for w in x.split()})
    groups = [(a, sorted((w[1:] for w in ws), key=len, reverse=True)) for a, ws in itertools.groupby(words, key=lambda w: w[0])]
    return "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in groups)


def signatures(text: Column, *, chain: int = 2) -> Column:
    """Sorted distinct signature hashes of a text; null counts as empty.

    Words are runs of ASCII letters and digits, A-Z lower-cased, and of all characters beyond ASCII.
    All repetitions are possessive, and each part of a text is passed a bounded number of times, so
    that no text, however long, makes the matcher backtrack or recurse.
    """
    line = F.concat(F.lit(" "), common.folded(text), F.lit(" "))
    hashes = lambda found: F.transform(found, lambda x: F.hash(x))

    def of(line: Column) -> Column:
        plain = F.regexp_replace(line, f" (?:{_one_of(SKIPPED)})(?= )", "")
        return let(F.regexp_replace(plain, f" ({_one_of(ANCHORS)})(?= )", f"{_A}$1"), lambda marked: found(line, marked))

    def found(line: Column, marked: Column) -> Column:
        following = f"(?:(?:{_A}{_W})*+ {_W}){{{chain - 1}}}"
        spots = F.regexp_extract_all(marked, F.lit(f"{_A}(?=({_W} {_W}{following}))"), F.lit(1))
        bare = F.transform(spots, lambda x: F.when(F.contains(F.substring(x, 2, 1 << 30), F.lit(_A)), F.regexp_replace(x, f"{_A}{_W}", "")).otherwise(x))
        far = F.array_join(F.regexp_extract_all(F.concat(F.lit(_A), marked), F.lit(f"{_A}[^{_A}]{{{STRETCH}}}[^ {_A}]*+( [^{_A}]++)"), F.lit(1)), f" {_A}")
        chosen = F.concat(hashes(bare), hashes(every(F.concat(far, F.lit(" ")))))
        return let(chosen, lambda s: F.when(F.size(s) > 0, s).otherwise(let(hashes(every(line)), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.hash(F.trim(line), F.lit("whole")))))))

    def every(line: Column) -> Column:
        return F.regexp_extract_all(line, F.lit(f"(?<= )(?=((?:{_W} ){{{chain + 1}}}))"), F.lit(1))

    return F.sort_array(F.array_distinct(let(line, of)))


def fingerprint(found: Column) -> Column:
    """The set as text: eight hexadecimal digits a signature."""
    return F.array_join(F.transform(found, lambda x: F.lpad(F.hex(F.when(x < 0, x.cast("long") + F.lit(1 << 32)).otherwise(x.cast("long"))), 8, "0")), "")


def length_part(found: Column, least: float) -> Column:
    """Partition by set length: sets that can reach the likeness ``least`` lie in one or in neighbours."""
    return F.floor(F.log(F.greatest(F.size(found), F.lit(1))) / F.lit(-math.log(least)) + F.lit(1e-9)).cast("int")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets; 0 without comparing them where their lengths rule out ``least``."""
    n, m = F.size(a), F.size(b)
    same = F.size(F.array_intersect(a, b))
    return F.when(F.least(n, m) < least * F.greatest(n, m), 0.0).otherwise(same / (n + m - same).cast("double"))


def similar(docs: DataFrame, *, least: float = 0.75, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All pairs of different fingerprints with a likeness of ``least`` or more, and who has them.

    Returns pairs (u, v, likeness) of classes and the members (``id_col``, class). A class holds the
    documents of equal fingerprints and is named by its smallest id; copies are never paired with each
    other. Candidates share one of the rarest signatures of either set, so many of each that no pair can
    be missed, and lie in the same or neighbouring length partitions. Rows without id are left out; null
    is an empty text; an empty table gives no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), signatures(F.col(text)).alias("set")).filter("id IS NOT NULL")
    own = common.materialize(own.withColumn("key", F.sha2(fingerprint(F.col("set")).cast("binary"), 256)), "signature-sets")
    classes = own.groupBy("key").agg(F.min("id").alias("class"))
    members = common.materialize(own.select("id", "key").join(classes.hint("merge"), "key").select(F.col("id").alias(id_col), "class").distinct(), "classes")
    one = own.join(classes.hint("merge"), "key").filter("id = class").dropDuplicates(["class"]).select("class", "set")
    one = common.materialize(one, "class-sets")
    each = one.select("class", length_part(F.col("set"), least).alias("part"), F.size("set").alias("n"), F.explode("set").alias("signature"))
    often = each.groupBy("signature").agg(F.count("*").alias("held"))
    rarest = each.join(often.hint("merge"), "signature").groupBy("class", "part", "n").agg(F.array_sort(F.collect_list(F.struct("held", "signature"))).alias("order"))
    # two sets of such a likeness share one of the first n - ceil(least n) + 1 signatures of either
    first = F.slice("order", F.lit(1), (F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).cast("int"))
    heads = common.materialize(rarest.select("class", "part", "n", F.explode(first).alias("s")).select("class", "part", "n", "s.signature"), "rare-signatures")
    left = heads.select(F.col("class").alias("u"), F.col("n").alias("n_u"), "signature", "part")
    right = heads.select(F.col("class").alias("v"), F.col("n").alias("n_v"), "signature", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    pairs = left.join(right.hint("merge"), ["signature", "part"]).filter((F.col("u") < F.col("v")) & (F.least("n_u", "n_v") >= F.lit(least) * F.greatest("n_u", "n_v") - 1e-9)).select("u", "v").distinct()
    sets = lambda name, of: one.select(F.col("class").alias(name), F.col("set").alias(of))
    met = pairs.join(sets("u", "a").hint("merge"), "u").join(sets("v", "b").hint("merge"), "v")
    return met.select("u", "v", likeness(F.col("a"), F.col("b"), least).alias("likeness")).filter(F.col("likeness") >= least), members


def with_next(docs: DataFrame, carried: list[str], *, id_col: str = "doc_id", size: Column | None = None, bytes_per_range: int = 32 << 20, ranges: int = 64, prefix: str = "next_") -> DataFrame:
    """Add ``prefix`` columns: those of the next row in descending id; the last is followed by the first.

    Rows are dealt by quantiles of the id, into ranges of about ``bytes_per_range`` where ``size`` gives
    a row's bytes, so that no task holds them all; the first row of a range also stands, as a guest,
    behind the last one of the range before it. Ids that tie are ordered by the carried columns' hash;
    null ids come last. A single row follows itself, an empty table stays empty. Existing columns of
    the new names are replaced, others pass through, whatever their names.
    """
    docs = common.without(docs, *[prefix + c for c in carried])
    key, tie, of, at, lead = common.fresh(docs.columns, "id", "tie", "range", "at", "next")
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long"))
    held = docs.agg(F.coalesce(F.sum(size if size is not None else F.lit(0)), F.lit(0)).cast("long").alias("bytes")).first()["bytes"]
    parts = ranges + held // bytes_per_range
    cuts = docs.agg(F.percentile_approx(number, [k / parts for k in range(1, parts)], max(10_000, 20 * parts)).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    bounds = F.lit(cuts) if cuts else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length(), -1, -1)])
    # the number of cuts up to an id, by halving
    range_of = lambda c: F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.coalesce(F.get(bounds, n + s - 1) <= c, F.lit(False)), n + s).otherwise(n))
    top = {r["r"]: r["m"] for r in docs.select(number.alias("id")).groupBy(range_of(F.col("id")).alias("r")).agg(F.max("id").alias("m")).collect()}  # a row a range
    order = sorted(top)
    if not order:
        return docs.select("*", *[F.col(c).alias(prefix + c) for c in carried])
    above = {r: order[(k + 1) % len(order)] for k, r in enumerate(order)}
    table = lambda of, none: F.lit([of.get(r, none) for r in range(len(cuts) + 1)])
    own = F.struct(F.col(of).alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(table(above, 0), F.col(of)).cast("int").alias("range"), F.lit(True).alias("guest"))
    keyed = docs.withColumns({key: number, tie: F.xxhash64(*carried)}).withColumn(of, range_of(F.col(key)))
    dealt = keyed.withColumn(at, F.explode(F.when(F.col(key) == F.get(table(top, 0), F.col(of)), F.array(own, guest)).otherwise(F.array(own))))
    following = Window.partitionBy(f"{at}.range").orderBy(f"{at}.guest", F.desc(key), tie)
    led = dealt.withColumn(lead, F.lead(F.struct(*carried)).over(following)).filter(~F.col(f"{at}.guest"))
    return led.select(*docs.columns, *[F.col(lead)[c].alias(prefix + c) for c in carried])


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many first ones of the following text."""
    n = F.length(text)
    third = F.floor(n / F.lit(3)).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))
