"""Removal of passages that documents share, by content-defined chunks of lines; DataFrame functions only.

A text is cut into lines: after each line break and after a sentence's end, very long lines also after
words chosen by their hash. A rolling hash runs over the hashes of two consecutive lines, or of one that
is long. Where it is the smaller one of two neighbours, and at long lines, a chunk begins, so that the
boundaries follow the content, not the position: any three lines that two documents share, and any long
one, hold a boundary that is the same in both. Chunks meet by the rolling hash at their boundary, over
all documents. Where every passage is wanted, all shortest runs of lines that are enough are chunks
as well: from each line on, and up to each line.

Of the documents that hold a chunk the one of the smallest id keeps it. Chunks of one document that the
same keeper holds at the same distance form a chain. The keeper's lines of a chain, and a few around
it, are fetched from its text and compared with the document's own, byte by byte: the stretch of lines
that are really equal goes, and with it what is equal, in whole words, of the line before and behind it.
So a passage goes as a whole, also where it was put into the middle of a sentence. A stretch reaches
over two lines or more and has ``min_bytes`` bytes; short stock lines, and single ones, stay.

Counting and joining move 20 bytes a chunk. Texts are shuffled to the chunks they keep and to the
stretches they lose. A passage that a third of all documents holds is a partial minimum per task and,
in the joins, rows that adaptive execution splits; nothing is collected by passage, only by document.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .licenses import let

# Possessive, so that no text makes the matcher backtrack or recurse: up to a line break or a sentence's end.
_LINE = r"(?s)(?=.)[^\n.!?。]*+(?:[.!?](?! )[^\n.!?。]*+)*+(?:[.!?] |[\n。]|\z)"
#: Lines of so many bytes are long.
LONG = 80
#: A chain goes on over gaps of up to so many lines; so many lines around it are compared too.
GAP, AROUND = 8, 3
#: Keepers' lines are fetched in blocks of so many.
BLOCK = 16
_LONGEST = 1 << 20


def lines(text: Column, *, long: int = 300) -> Column:
    """Lines of a text, which joined give the text again.

    Lines of more than ``long`` bytes are cut further, after words whose hash is a multiple of
    four, so that passages without sentence ends come out alike as well.
    """

    def finer(line: Column) -> Column:
        def cut(words: Column) -> Column:
            last = F.size(words) - 1
            marks = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.xxhash64(F.rtrim(F.get(words, i))).bitwiseAND(F.lit(3)) == 0))
            return let(marks, lambda m: F.transform(m, lambda end, k: let(F.when(k == 0, F.lit(-1)).otherwise(F.get(m, k - 1)), lambda before: F.array_join(F.slice(words, before + 2, end - before), ""))))

        return let(F.split(line, "(?<= )", -1), cut)

    def whole(parts: Column) -> Column:
        split = F.flatten(F.transform(parts, lambda x: F.when(F.octet_length(x) > long, F.filter(finer(x), lambda y: y != "")).otherwise(F.array(x))))
        return F.when(F.exists(parts, lambda x: F.octet_length(x) > long), split).otherwise(parts)

    return let(F.regexp_extract_all(text, F.lit(_LINE), F.lit(0)), whole)


def _reach(sizes: Column, least: int) -> Column:
    """For each line the number of lines, two at least, that from it on have ``least`` bytes; null where the text ends before."""
    # bytes and lines in one number; summed over 1, 2, 4 and so on lines from each one on, null beyond the text's end
    unit, levels = 1 << 24, max(1, (least - 1).bit_length())

    def doubled(sums: list[Column]) -> Column:
        if len(sums) == levels:
            return F.transform(sums[0], lambda x, i: F.when(i + 1 < F.size(sizes), first(sums, x, i)))
        last, step = sums[-1], 1 << (len(sums) - 1)
        return let(F.transform(last, lambda x, i: x + F.get(last, i + step)), lambda more: doubled([*sums, more]))

    def first(sums: list[Column], x: Column, i: Column) -> Column:
        # most runs are short, so the steps begin where the sums say so
        found = F.when(x + F.get(sums[0], i + 1) >= least * unit, 2)
        for k in range(2, min(levels, 5)):
            found = found.when(F.get(sums[k], i) >= least * unit, few(sums, k - 2, i, F.get(sums[k - 1], i)))
        return found.otherwise(few(sums, levels - 1, i, F.lit(0).cast("long")))

    def few(sums: list[Column], k: int, i: Column, t: Column) -> Column:
        # the most lines from this one on that still have fewer bytes, from the largest step to the smallest
        lines_ = t.bitwiseAND(F.lit(unit - 1)).cast("int")
        if k < 0:
            return F.when(i + lines_ < F.size(sizes), F.greatest(lines_ + 1, F.lit(2)))
        more = t + F.get(sums[k], i + lines_)
        return let(F.when(more < least * unit, more).otherwise(t), lambda t: few(sums, k - 1, i, t))

    return let(F.transform(sizes, lambda x: x * unit + 1), lambda s: doubled([s]))


def chunks(text: Column, every: int | None = None) -> Column:
    """Where chunks begin: struct of the hash, the line's number and the number of lines.

    With ``every`` there are also all runs of two lines or more that have so many bytes and would not have
    them without their first or without their last line.
    """

    def hashed(found: Column) -> Column:
        # the last bit of a line's hash says whether the line is long
        each = F.transform(found, lambda x: F.xxhash64(x).bitwiseAND(F.lit(-2)).bitwiseOR((F.octet_length(x) >= LONG).cast("long")))
        if every is None:
            return let(each, lambda h: rolled(h, None))
        return let(each, lambda h: let(F.transform(found, lambda x: F.octet_length(x).cast("long")), lambda sizes: let(_reach(sizes, every), lambda n: rolled(h, n))))

    long = lambda h: h.bitwiseAND(F.lit(1)) == 1

    def rolled(h: Column, n: Column | None) -> Column:
        roll = F.transform(h, lambda x, i: F.when(long(x), F.xxhash64(x)).when(i + 1 < F.size(h), F.xxhash64(x, F.get(h, i + 1))))
        chosen = lambda r: F.filter(F.transform(r, lambda x, i: F.when(begins(h, n, r, x, i), F.struct(x.alias("key"), i.alias("at"), F.lit(2).alias("n")))), lambda x: x.isNotNull())
        if n is None:
            return let(roll, chosen)
        return F.concat(let(roll, chosen), F.flatten(F.filter(F.transform(n, lambda x, i: F.when(x.isNotNull(), windows(h, n, x, i))), lambda x: x.isNotNull())))

    def begins(h: Column, n: Column | None, r: Column, x: Column, i: Column) -> Column:
        # two lines that have the bytes by themselves are a window
        short = F.lit(True) if n is None else F.coalesce(F.get(n, i) != 2, F.lit(True))
        return F.coalesce(long(F.get(h, i)) | short & ((x <= F.get(r, i - 1)) | (x < F.get(r, i + 1)) | (x.isNotNull() & (F.size(h) == 2))), F.lit(False))

    def windows(h: Column, n: Column, x: Column, i: Column) -> Column:
        # from its shortest one on, up to where the next line's shortest one ends
        most = F.greatest(x, F.coalesce(F.get(n, i + 1), F.size(n) - i))
        return F.transform(F.sequence(x, most), lambda k: F.struct(F.xxhash64(F.slice(h, i + 1, k)).alias("key"), i.alias("at"), k.alias("n")))

    return let(lines(text), hashed)


def _number(id_col: str, text: str) -> Column:
    """A document's number: its id; without one, a number of its text's own beyond usual ids."""
    own = F.coalesce(F.xxhash64(text), F.lit(0).cast("long")).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
    return F.coalesce(F.col(id_col).cast("long"), own)


def chains(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", every: int | None = None) -> DataFrame:
    """Stretches that an earlier document may hold too: doc, keeper, first, last, shift.

    ``first`` and ``last`` are lines of the document, and ``shift`` is by how many lines they stand
    behind the keeper's. With ``every`` no run of whole lines of so many bytes is missed.
    """
    body = F.col(text)
    own = docs.select(_number(id_col, text).alias("doc"), F.when(F.length(body) > 0, chunks(body, every)).alias("chunks"))
    own = common.materialize(own.filter(F.size("chunks") > 0), "chunks")
    rows = own.select("doc", F.explode("chunks").alias("c")).select("doc", "c.*")
    # fixed-size buffers, so that partial aggregates hash; a chunk that the keeper repeats counts where it stands last
    often = rows.groupBy("key").agg(F.min("doc").alias("keeper"), F.min_by("at", "doc").alias("there"), F.max("doc").alias("other")).filter("keeper < other")
    often = common.materialize(often.drop("other"), "repeated")
    again = rows.join(often.hint("merge"), "key").filter("doc <> keeper").repartition("doc")
    if every is None:
        # a chunk that a document repeats counts where it stands first
        again = again.groupBy("doc", "keeper", "there").agg(F.min("at").alias("at"), F.max("n").alias("n")).withColumn("shift", F.col("at") - F.col("there"))
    else:
        again = again.groupBy("doc", "keeper", (F.col("at") - F.col("there")).alias("shift"), "at").agg(F.max("n").alias("n"))
    order = Window.partitionBy("doc").orderBy("keeper", "shift", "at")
    before = F.lag(F.struct("keeper", "shift", "at")).over(order)
    same = (before["keeper"] == F.col("keeper")) & (before["shift"] == F.col("shift")) & (F.col("at") - before["at"] <= GAP)
    parted = again.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("chain", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    made = parted.groupBy("doc", "keeper", "shift", "chain").agg(F.min("at").alias("first"), F.max(F.col("at") + F.col("n") - 1).alias("last")).drop("chain")
    made = common.materialize(made, "chains")
    common.release(own, often)
    return made


def _views(docs: DataFrame, made: DataFrame, id_col: str, text: str) -> DataFrame:
    """By document: the keepers' lines of its chains, and the document's line that the first one stands beside."""
    begin, end = F.greatest(F.col("first") - F.col("shift") - AROUND, -F.col("shift"), F.lit(0)), F.col("last") - F.col("shift") + AROUND
    wanted = made.withColumns({"begin": begin, "end": end})
    block = lambda x: F.floor(x / F.lit(BLOCK)).cast("int")
    wanted = wanted.withColumn("block", F.explode(F.sequence(block(F.col("begin")), block(F.col("end")))))
    needed = wanted.select("keeper", "block").distinct().groupBy("keeper").agg(F.collect_list("block").alias("blocks"))

    def parts(found: Column) -> Column:
        return F.transform("blocks", lambda b: F.struct(b.alias("block"), F.slice(found, b * BLOCK + 1, BLOCK).alias("theirs")))

    # rows that share an id keep what any of them holds; ``text_hash`` tells their lines apart
    own = docs.select(_number(id_col, text).alias("keeper"), F.col(text).alias("body"))
    held = own.join(needed.hint("merge"), "keeper").select("keeper", F.xxhash64("body").alias("text_hash"), F.explode(let(lines(F.col("body")), parts)).alias("p"))
    met = wanted.join(held.select("keeper", "text_hash", "p.*").hint("merge"), ["keeper", "block"])
    from_, to = F.greatest(F.col("begin") - F.col("block") * BLOCK, F.lit(0)), F.least(F.col("end") - F.col("block") * BLOCK, F.lit(BLOCK - 1))
    # dealt by document at once, so that a keeper that many follow is no single task's
    cut = met.select("doc", "keeper", "text_hash", "shift", (F.col("begin") + F.col("shift")).alias("start"), "block", F.slice("theirs", from_ + 1, to - from_ + 1).alias("theirs")).repartition("doc")
    parts_of = cut.groupBy("doc").agg(F.collect_list(F.struct("keeper", "text_hash", "shift", "start", "block", "theirs")).alias("parts"))
    return parts_of.select("doc", let(F.array_sort("parts"), _joined).alias("views"))


def _joined(parts: Column) -> Column:
    """Views of blocks in order: the lines of each chain of each keeper's text."""

    def starts(i: Column, names: tuple[str, ...]) -> Column:
        now, before = F.get(parts, i), F.get(parts, i - 1)
        return (i == 0) | ~functools.reduce(lambda a, b: a & b, [now[c] == before[c] for c in names])

    def views(at: Column) -> Column:
        def view(s: Column, k: Column) -> Column:
            own = F.sequence(s, F.coalesce(F.get(at, k + 1), F.size(parts)) - 1)
            # repeated rows of a keeper give the same lines again
            once = F.filter(own, lambda i: (i == s) | (F.get(parts, i)["block"] != F.get(parts, i - 1)["block"]))
            return F.struct(F.get(parts, s)["start"].alias("start"), F.flatten(F.transform(once, lambda i: F.get(parts, i)["theirs"])).alias("theirs"))

        return F.transform(at, view)

    chain = ("start", "shift", "keeper", "text_hash")
    return let(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: starts(i, chain)), views)


def _alike(a: Column, b: Column) -> Column:
    """Characters that both begin with, up to the end of a word in both."""
    longer = lambda n, step: F.when((n + step <= F.length(a)) & (n + step <= F.length(b)) & (F.left(a, n + step) == F.left(b, n + step)), n + step).otherwise(n)
    n = F.aggregate(F.array(*[F.lit(1 << k) for k in range(_LONGEST.bit_length() - 1, -1, -1)]), F.lit(0), longer)
    ends = lambda x, n: F.rlike(F.substring(x, n + 1, F.lit(1)), F.lit(r"\A\s?\z"))
    return let(n, lambda n: F.when(ends(a, n) & ends(b, n), n).otherwise(n - F.length(F.regexp_extract(F.left(a, n), r"\S*+\z", 0))))


def stretches(found: Column, views: Column, min_bytes: int) -> Column:
    """Equal stretches of a document's lines: first and last line, characters of the lines before and behind them that go too."""

    def of(view: Column) -> Column:
        def compared(own: Column) -> Column:
            theirs = view["theirs"]

            def runs(same: Column) -> Column:
                at = F.sequence(F.lit(0), F.size(same) - 1)
                no = lambda i: ~F.coalesce(F.get(same, i), F.lit(False))
                starts = F.filter(at, lambda i: F.get(same, i) & no(i - 1))
                ends = F.filter(at, lambda i: F.get(same, i) & no(i + 1))
                pairs = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda x: x["e"] >= x["s"])
                return F.transform(pairs, stretch)

            def stretch(x: Column) -> Column:
                # white space before the passage stays, so that the words around it don't run together
                back = lambda i: F.when(i < 0, 0).otherwise(F.coalesce(let(F.reverse(F.get(own, i)), lambda a: F.length(F.regexp_replace(F.left(a, _alike(a, F.reverse(F.get(theirs, i)))), r"\s++\z", ""))), F.lit(0)))
                ahead = lambda i: F.coalesce(_alike(F.get(own, i), F.get(theirs, i)), F.lit(0))
                whole = F.octet_length(F.array_join(F.slice(own, x["s"] + 1, x["e"] - x["s"] + 1), ""))
                return F.struct((view["start"] + x["s"]).alias("first"), (view["start"] + x["e"]).alias("last"), back(x["s"] - 1).alias("before"), ahead(x["e"] + 1).alias("behind"), whole.alias("bytes"))

            return let(F.zip_with(own, theirs, lambda a, b: a.eqNullSafe(b)), runs)

        return let(F.slice(found, view["start"] + 1, F.size(view["theirs"])), compared)

    several = lambda x: (x["last"] > x["first"]) | (x["before"] > 0) | (x["behind"] > 0)
    every = F.flatten(F.transform(views, of))
    return F.array_sort(F.filter(every, lambda x: several(x) & (x["bytes"] + x["before"] + x["behind"] >= min_bytes)))


def _rest(found: Column, runs: Column) -> Column:
    """The text without the stretches."""

    def built(gone: Column) -> Column:
        edges = F.array_distinct(F.concat(F.transform(F.filter(runs, lambda x: x["before"] > 0), lambda x: x["first"] - 1), F.transform(F.filter(runs, lambda x: x["behind"] > 0), lambda x: x["last"] + 1)))
        edges = F.array_except(edges, gone)
        plain = F.array_except(F.array_except(F.sequence(F.lit(0), F.size(found) - 1), gone), edges)

        def trimmed(i: Column) -> Column:
            most = lambda which, at: F.coalesce(F.array_max(F.transform(F.filter(runs, lambda x: at(x) == i), lambda x: x[which])), F.lit(0))
            behind, before = most("behind", lambda x: x["last"] + 1), most("before", lambda x: x["first"] - 1)
            line = F.get(found, i)
            return F.substring(line, behind + 1, F.greatest(F.length(line) - behind - before, F.lit(0)))

        kept = F.concat(F.transform(plain, lambda i: F.struct(i.alias("at"), F.get(found, i).alias("line"))), F.transform(edges, lambda i: F.struct(i.alias("at"), trimmed(i).alias("line"))))
        return F.array_join(F.transform(F.array_sort(kept), lambda x: x["line"]), "")

    return let(F.array_distinct(F.flatten(F.transform(runs, lambda x: F.sequence(x["first"], x["last"])))), built)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", min_bytes: int = 120, removed: str | None = None, every: bool = False) -> DataFrame:
    """``docs`` with passages cut out of ``text`` that an earlier document keeps; ``removed`` names a column for the stretches.

    Null and empty texts stay as they are, and an empty table stays empty. Texts of any length and any
    characters are cut in the same way. Rows that share an id are one document, of several texts maybe,
    which never take from each other. A null id stands for a document of its own, after all others. A repeat within one document stays. Other columns pass through, whatever their
    names; an existing column ``removed`` is replaced.
    ``every`` takes all runs of two whole lines or more that have ``min_bytes`` bytes and that any earlier
    document holds, wherever they stand and however often; without it, those that hold a chosen boundary.
    """
    made = chains(docs, id_col=id_col, text=text, every=max(min_bytes, 1) if every else None)
    doc, views = common.fresh(docs.columns, "doc", "views")
    gone = common.materialize(_views(docs, made, id_col, text), "views").withColumnsRenamed({"doc": doc, "views": views})
    common.release(made)
    met = docs.join(gone.hint("merge"), _number(id_col, text) == F.col(doc), "left")
    cut = let(lines(F.col(text)), lambda found: let(stretches(found, F.col(views), min_bytes), lambda runs: F.struct(F.when(F.size(runs) > 0, _rest(found, runs)).otherwise(F.col(text)).alias("text"), runs.alias("runs"))))
    names = [c for c in docs.columns if c != removed]
    result = common.fresh([*names, views], "cut")[0]
    met = met.select(*names, F.when(F.col(views).isNotNull(), cut).alias(result))
    left = F.when(F.col(result).isNull(), F.col(text)).otherwise(F.col(result)["text"])
    plain = [left.alias(c) if c == text else F.col(c) for c in names]
    spans = F.transform(F.col(result)["runs"], lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last")))
    return met.select(*plain, *([F.coalesce(F.array_distinct(spans), F.array().cast("array<struct<first:int,last:int>>")).alias(removed)] if removed else []))


def drop_emptied(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """Cut shared passages out and drop documents of which nothing is left; columns unchanged."""
    runs = common.fresh(docs.columns, "runs")[0]
    cut = dedup_lines(docs, text=text, removed=runs, **options)
    return cut.filter((F.size(runs) == 0) | F.col(text).rlike(r"\S")).drop(runs)
