"""The numbered queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chats, collocations, common, decontaminate, language_id, licenses, line_dedup, near_dedup, ngram_join, packing, spotsigs, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "leak.n_words",
        "leak.n_hit",
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


def op2_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("set", spotsigs.signatures(F.col("text")))
    pairs = spotsigs.with_next(docs, ["text", "set"], size=F.octet_length("text")).withColumn("edited", spotsigs.edited(F.col("text"), F.col("next_text")))
    pairs = pairs.withColumn("edited_set", spotsigs.signatures(F.col("edited")))
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("set")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_set")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("set"), F.col("edited_set")).alias("near_edited"),
        spotsigs.likeness(F.col("set"), F.col("next_set")).alias("near_next"),
        spotsigs.length_part(F.col("set"), 0.75).alias("length_part"),
    )


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"))
    return counted.select("doc_id", "tokens.n_bytes", "tokens.n_tokens", (F.col("tokens.n_tokens") > 4096).alias("over_limit"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "licence.n_words",
        F.size("licence.places").cast("long").alias("n_base"),
        F.array_min("licence.places").alias("first_word"),
        F.array_max("licence.places").alias("last_word"),
        F.array_join("licence.base_labels", ",").alias("base_labels"),
        F.array_join("licence.labels", ",").alias("labels"),
        "licence.score",
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=common.crc_mod(F.col("__id"), 5) != 0)
    scored = toxicity.score(docs, model, column="score")
    return scored.select("doc_id", (common.crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", toxicity.predicted("score").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").cast("long").alias("chars_before"))
    cut = line_dedup.dedup_lines(docs, removed="runs", every=True)
    return cut.select("doc_id", "chars_before", F.length("text").cast("long").alias("chars_after"), F.size("runs").cast("long").alias("n_runs"), "text")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.format_chats(table(spark, sf_dir, "conversations"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, train=common.crc_mod(F.col("doc_id"), 4) != 2)
    guessed = language_id.identify(docs.select("doc_id", "text"), model)
    return guessed.select("doc_id", (common.crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("guess.lang").alias("lang_pred"), "guess.score")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_spot_signatures, op3_pack, op4_token_counts, op5_licence_scan, op6_toxicity, op7_line_dedup, op8_chat_format, op9_language_id, op10_near_dedup, op11_align_tokenizers, op12_collocations, op13_ngram_join)}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES = {
    "op1_decontaminate": f"""
        WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
        pattern AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
        doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        place AS (
            SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS p
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM pattern) WHERE len(w) >= n)),
        hit AS (SELECT doc_id, item_id, n, i FROM place JOIN pattern USING (n, p)),
        words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM hit) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op8_chat_format": """
        WITH own AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        logs AS (SELECT conv_id, list(struct_pack(turn, role, text) ORDER BY turn, role, text) AS l, count(*) AS n FROM own GROUP BY 1),
        prefixes AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM logs)),
        kept AS (SELECT min(conv_id) AS conv_id, count(*) AS copies FROM logs WHERE l NOT IN (SELECT l FROM prefixes) GROUP BY l)
        SELECT conv_id, part, count(*) AS n_turns, copies, string_agg('<|im_start|>' || replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || chr(10) || replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS text
        FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // 256 AS part FROM own JOIN kept USING (conv_id)) GROUP BY conv_id, part, copies
    """,
    "op10_near_dedup": """
        WITH RECURSIVE doc AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        shingle AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
        size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
        met AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT u, v FROM met JOIN size x ON x.doc_id = u JOIN size y ON y.doc_id = v WHERE 100 * met.n >= 75 * (x.n + y.n - met.n)),
        edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
        reach AS (SELECT doc_id AS node, doc_id AS label FROM doc UNION SELECT v, label FROM reach JOIN edge ON u = node WHERE label < v)
        SELECT doc.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(label) AS component_id, doc.doc_id = min(label) AS kept
        FROM doc LEFT JOIN size USING (doc_id) JOIN reach ON node = doc.doc_id GROUP BY doc.doc_id, n
    """,
    "op13_ngram_join": """
        WITH RECURSIVE doc AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        shingle AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
        size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
        met AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT u, v FROM met JOIN size x ON x.doc_id = u JOIN size y ON y.doc_id = v WHERE 100 * met.n >= 90 * (x.n + y.n - met.n)),
        edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
        reach AS (SELECT doc_id AS node, doc_id AS label FROM doc UNION SELECT v, label FROM reach JOIN edge ON u = node WHERE label < v)
        SELECT doc.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(label) AS component_id
        FROM doc LEFT JOIN size USING (doc_id) JOIN reach ON node = doc.doc_id GROUP BY doc.doc_id, n
    """,
}
