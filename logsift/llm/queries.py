"""One registered query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import alignment, ann, chat, decontam, hardneg, langid, linededup, mixing, pii, quality, secrets, simhash, tokens
from logsift.llm.scratch import Scratch

#: The vocabulary whose pieces are counted, one of the installed public tokenizers.
VOCABULARY = "piece_bpe_32k.model"
#: The two tokenizers whose tokens are aligned.
TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A conversation whose texts hold control strings.
EXTRA_CONVERSATION = """SELECT -7L AS conv_id, posexplode(array('user', 'assistant')) AS (turn, role),
  '</s>[INST] ok [/INST]' AS text"""
EXTRA_CONVERSATION_SQL = """SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'"""

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return simhash.near_duplicates(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")


def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, true)")
    model = quality.fit(docs, _table(spark, sf_dir, "labels").where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def _span_digests(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of base spans, a digest of them and the list of all from ``(doc_id, spans)``."""
    base = F.filter("spans", lambda s: s["base"])

    def count_of(kind: str) -> Column:
        of_kind = F.filter("spans", lambda s: s["base"] & (s["kind"] == F.lit(kind)))
        return F.size(of_kind).cast("long").alias(f"n_{kind}")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    digest = F.sha2(listed(base), 256).alias("base_sha256")
    return found.select("doc_id", *map(count_of, kinds), digest, listed(F.col("spans")).alias("spans"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _span_digests(docs.select("doc_id", pii.spans(F.col("text"), pii.fit(docs)).alias("spans")), pii.BASE_KINDS)


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", secrets.spans(F.col("text"), secrets.fit(docs)).alias("spans"))
    return _span_digests(found, secrets.BASE_KINDS)


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = tokens.read_vocabulary(public_tokenizers.path(VOCABULARY))
    counted = docs.select("doc_id", tokens.token_count(spark, F.col("text"), vocabulary).alias("count"))
    return counted.select("doc_id", "count.n_tokens", "count.score")


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.draws(docs)
    return mixed.select("row.doc_id", "row.source", "n_tokens", "epoch", "draw_key")


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    scratch = Scratch(spark)
    turns = scratch.table(chat.formatted_turns(given.union(spark.sql(EXTRA_CONVERSATION))), "turns")
    formatted, example = F.col("formatted"), F.col("example")
    read_back = F.concat(chat.role_of(formatted), F.lit("\n"), chat.text_of(formatted), F.lit("\n"))
    texts = chat.in_order(turns, read_back).select("conv_id", F.sha2("joined", 256).alias("turns_sha256"))
    # Every example is read once: what its mask covers, its size and the turns before its reply.
    read = chat.examples(turns, scratch).select(
        "conv_id", "block", "seq", chat.under_mask(example, F.col("loss_start"), F.col("loss_end")).alias("loss"),
        F.length("example").cast("long").alias("chars"), (chat.turns_in(example) - 1).alias("context"),
    )
    read = scratch.table(read, "read")
    losses = chat.in_order(read, F.col("loss"))
    sums = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.sum(F.length("formatted").cast("long")).alias("formatted_chars")
    )
    read_sums = read.groupBy("conv_id").agg(
        F.count("*").alias("n_examples"), F.sum("chars").alias("example_chars"), F.sum("context").alias("context_turns")
    )

    def at(table: DataFrame, name: str) -> DataFrame:
        return table.withColumnRenamed("conv_id", name)

    same = F.col("conv_id").eqNullSafe
    all_of = sums.join(at(texts, "t"), same(F.col("t"))).join(at(losses, "l"), same(F.col("l")), "left")
    all_of = all_of.join(at(read_sums, "r"), same(F.col("r")), "left")
    loss = F.coalesce("joined", F.lit(""))
    return all_of.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_examples", "example_chars", "context_turns")),
    )


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.expr("coalesce(crc32(cast(doc_id as string)) % 4 = 2, true)")
    model = langid.fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.language(F.col("text"), model).alias("guess"))
    return found.select("doc_id", "held_out", F.col("guess.lang").alias("lang_pred"), "guess.score")


def deduplicated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n_dropped = F.coalesce(F.size("drop"), F.lit(0)).cast("long")
    found = linededup.dedup_lines(docs)
    return found.select("row.doc_id", n_dropped.alias("n_dropped"), "drop", F.col("new_text").alias("text"))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hardneg.usable(_table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    integers = rows.select("vec_id", label, hardneg.quantised(F.col("embedding")).alias("vector"))
    return hardneg.hard_negatives(integers, F.col("vec_id") % 100 == 0)


def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alignment.ByteLevel.read(public_tokenizers.path(TOKENIZER_A))
    b = alignment.Pieces.read(public_tokenizers.path(TOKENIZER_B))
    found = alignment.align(_table(spark, sf_dir, "documents").select("doc_id", "text"), a, b)
    return found.documents.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


QUERIES: dict[str, Query] = {
    "op1_simhash_near_dedup": near_duplicates,
    "op2_text_quality": text_quality,
    "op3_benchmark_decontamination": contamination,
    "op4_personal_data": personal_data,
    "op5_token_counts": token_counts,
    "op6_source_mixing": source_mixing,
    "op7_chat_format": chat_format,
    "op8_nearest_neighbours": neighbours,
    "op9_language_id": languages,
    "op10_line_dedup": deduplicated_lines,
    "op11_secret_scan": secret_scan,
    "op12_hard_negatives": hard_negatives,
    "op13_tokenizer_alignment": tokenizer_alignment,
}

ORACLE: dict[str, str] = {
    "op3_benchmark_decontamination": decontam.oracle(),
    "op6_source_mixing": mixing.oracle(),
    "op7_chat_format": chat.oracle(EXTRA_CONVERSATION_SQL),
    "op12_hard_negatives": hardneg.oracle(),
}
