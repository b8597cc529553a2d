"""Token counts with overlap resynchronisation.

A huge text is encoded in overlapping chunks, with offsets. Two neighbouring chunks are spliced at a
boundary that both have in their overlap and that is proven stable: a single space between letters
or digits, where no vocabulary piece can run across (no piece holds a word-begin mark after another
character), so what stands left of it never changes the pieces on its right. Without such a boundary
the overlap is doubled until it reaches the end of the text. Short texts are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

COUNTS = StructType([StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
_MARK = "▁"


def model(path: str):
    """The processor and whether single spaces are proven boundaries of it."""
    def load() -> tuple:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return sp, not any(_MARK in sp.id_to_piece(i).lstrip(_MARK) for i in range(sp.vocab_size()))

    return common.held(("pieces", path), load)


def starts(sp, text: str, at: int) -> list[int]:
    """Where the pieces of a chunk begin in the whole text. After ``at`` 0 the chunk begins at a stable
    space, for which the mark stands that the library puts before a text."""
    own = at > 0 and text[:1] == " "
    return [at + own + a for a, _ in sp.encode(text[own:], out_type="offset_mapping", return_bytes=False)["offsets"]]


def stable(text: str, i: int) -> bool:
    """A single space with a letter or digit on either side."""
    return 0 < i < len(text) - 1 and text[i] == " " and text[i - 1].isalnum() and text[i + 1].isalnum()


def count(sp, proven: bool, text: str, chunk: int, overlap: int) -> int:
    """Pieces of the whole text."""
    if len(text) <= chunk or not proven:
        return len(sp.encode(text))
    total, spliced, end = 0, 0, chunk
    ours = starts(sp, text[:end], 0)
    while end < len(text):
        wide = overlap
        while True:
            begin, stop = max(spliced, end - wide), min(len(text), end + chunk)
            theirs = starts(sp, text[begin:stop], begin)
            # a piece that begins at a chunk's last character may have been cut
            both = set(ours).intersection(theirs)
            cut = max((b for b in both if max(spliced, begin) < b < end - 1 and stable(text, b)), default=None)
            if cut is not None:
                total += sum(b < cut for b in ours)
                ours, spliced, end = [b for b in theirs if b >= cut], cut, stop
                break
            if begin == spliced:
                # no boundary in the whole chunk: take a longer one from the last splice
                end = min(len(text), spliced + 2 * (end - spliced))
                ours = starts(sp, text[spliced:end], spliced)
                break
            wide *= 2
    return total + len(ours)


def count_tokens(docs: DataFrame, path: str, *, text: str = "text", chunk: int = 20_000, overlap: int = 400, column: str = "tokens") -> DataFrame:
    """Add ``column``: UTF-8 bytes and tokens of the text, without added tokens.

    Null counts as empty, with no tokens. ``path`` names the model on every machine, as an installed
    library gives it. Repeated rows are counted one by one; an empty table stays empty. An existing
    column of that name is replaced, others pass through, whatever their names.
    """
    common.bound_batches(docs.sparkSession)

    @F.pandas_udf(COUNTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sp, proven = model(path)
        for texts in batches:
            rows = [(len(t.encode()), count(sp, proven, t, chunk, overlap)) if t else (0, 0) for t in texts]
            yield pd.DataFrame(rows, columns=COUNTS.names)

    return common.without(docs, column).withColumn(column, run(F.col(text)))
