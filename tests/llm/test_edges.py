"""Each operator, and each stage, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import chats, decontaminate, language_id, licenses, line_dedup, near_dedup, packing, spotsigs, token_counts, toxicity

CLASHES = (
    "runs doc of views cut gone leak leak_block toxicity row id n_words line found next range at tie salt base rank label text_hash tokens licence guess score pieces"
).split()
LONG = "Many words of one very long text, with the MIT License in it. " * 32_000
ROWS = [
    (1, None, "en", "a", 1),
    (2, "", "en", "a", 1),
    (3, "One text of a few words.", None, "b", None),
    (3, "One text of a few words.", None, "b", None),
    (4, "One text of a few words.", "de", None, 2),
    (None, "One text of a few words.", "de", "c", 3),
    (None, None, None, None, None),
    (5, LONG, "fr", "c", 4),
    (6, LONG, "fr", "c", 4),
    (7, "\x01\x02 \n" * 400, "fr", "c", 4),
    (8, " " * 100_000, "fr", "c", 4),
]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars int")
    names = [f"__{c}" for c in CLASHES] + ["___runs", "next_text", "Piece", "gone", "views"]
    return plain.withColumns({c: F.lit(f"own {c}") for c in names})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 0, 0), (4, 0, 1), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "text of a few words"), (2, None), (None, "nothing"), (3, "")], "item_id long, text string")


FILTERS = {
    "toxicity": lambda d, labels, items: toxicity.reject_toxic(d, labels, min_rows=1),
    "line_dedup": lambda d, labels, items: line_dedup.drop_emptied(d),
    "near_dedup": lambda d, labels, items: near_dedup.drop_near_copies(d),
    "decontaminate": lambda d, labels, items: decontaminate.drop_leaked(d, items),
}


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_filters_keep_columns(docs, labels, items, name):
    out = FILTERS[name](docs, labels, items)
    kept = out.collect()
    assert out.columns == docs.columns and 0 < len(kept) <= len(ROWS)
    assert all(r[c] == f"own {c}" for r in kept for c in docs.columns[5:])
    assert sum(r.text is None for r in kept) == 2
    none = FILTERS[name](docs.limit(0), labels, items)
    assert none.columns == docs.columns and none.count() == 0
    assert FILTERS[name](docs, labels.limit(0), items.limit(0)).count() == (len(ROWS) if name in ("toxicity", "decontaminate") else len(kept))


ADDERS = {
    "leak": lambda d, labels, items: decontaminate.find_leaks(d, items, column="__leak"),
    "tokens": lambda d, labels, items: token_counts.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model"), column="__tokens"),
    "licence": lambda d, labels, items: licenses.scan(d, column="__licence"),
    "score": lambda d, labels, items: toxicity.score(d, toxicity.fit(d, labels), column="__score"),
    "guess": lambda d, labels, items: language_id.identify(d, language_id.fit(d), column="__guess"),
    "next_text": lambda d, labels, items: spotsigs.with_next(d, ["text"]),
    "runs": lambda d, labels, items: line_dedup.dedup_lines(d, removed="__runs"),
}


@pytest.mark.parametrize("name", sorted(ADDERS))
def test_added_columns_replace_their_like(docs, labels, items, name):
    out = ADDERS[name](docs, labels, items)
    got = out.collect()
    assert len(got) == len(ROWS) and len(set(out.columns)) == len(out.columns)
    new = "next_text" if name == "next_text" else f"__{name}"
    assert set(out.columns) == set(docs.columns) - ({"text"} if name == "licence" else set())
    assert all(r[c] == f"own {c}" for r in got for c in docs.columns[5:] if c != new)
    assert ADDERS[name](docs.limit(0), labels, items).count() == 0


def test_packing_and_groups(docs):
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=True)
    rows = packed.collect()
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    assert all(len(r.ids) == 4 * r.length for r in rows) and sum(r.piece == 0 for r in rows) == len(ROWS)
    assert packing.pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    groups = {r.doc_id: r for r in near_dedup.group(docs).collect()}
    assert groups[4].component_id == 3 and groups[6].component_id == 5 and groups[8].n_shingles == 0 and groups[None].kept


def test_chats_with_nulls(spark):
    turns = spark.createDataFrame([(None, None, None, None, "x"), (1, None, "user", "a", "x"), (1, None, "user", "a", "x"), (1, 2, None, LONG, "x")], "conv_id long, turn long, role string, text string, part string")
    got = chats.format_chats(turns).collect()
    assert sorted((str(r.conv_id), r.n_turns) for r in got) == [("1", 2), ("None", 1)]


def test_pipeline_with_odd_tables(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for k, frame in enumerate((docs, docs.limit(0))):
        for name, table in (("documents", frame), ("labels", labels), ("benchmark", items)):
            table.write.parquet(f"file://{tmp_path}/{k}/{name}.parquet")
    packed = corpus_pipeline.run(spark, f"file://{tmp_path}/0")
    ids = [r.doc_id for r in packed.select("doc_id").distinct().collect()]
    assert {1, 2, 3, 5, 8, None} <= set(ids) and not {4, 6} & set(ids)
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/1").count() == 0


def test_pipeline_matches_brute_force(spark, sf_dir):
    """Every stage in plain Python, one document against all others."""
    import re

    import numpy as np
    from tokenizers import Tokenizer

    import corpus_pipeline

    from .test_dedup import brute_components, plain_dedup
    from .test_text_operators import _leak

    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    model = toxicity.fit(read("documents"), read("labels"))
    docs = {r.doc_id: r.text for r in read("documents").collect()}
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    left = {i: t for i, t in docs.items() if model.score(t) < 0.5}
    cut = plain_dedup(sorted(left.items()))
    left = {i: cut[i] for i, t in left.items() if cut[i] == t or re.search(r"\S", cut[i])}
    groups = brute_components(sorted(left.items()))
    left = {i: t for i, t in left.items() if groups[i] == i}
    left = {i: t for i, t in left.items() if not _leak(t, items, 10)[1]}
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*exact.encode(t or "", add_special_tokens=False).ids, 0] for i, t in left.items()}
    got, places = {}, {}
    for r in sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, dtype="<u4").tolist())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want and 0 < len(want) < len(docs)
    for found in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(found)]).tolist()]
        assert [a for a, _ in sorted(found)] == ends[:-1] and ends[-1] <= 2048
