"""The registered queries of the training-data operators: thin functions that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html, jpeg, minhash, packing, prefixtree, recompression, shards, substrings, tokenfiles, tokens, toxicity
from .shared import new_place, table, with_text


def tokenizer(name: str) -> str:
    """Where a public tokenizer file lies; imported here, so that the other queries stand without the wheel."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_columns(table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op3_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_place(spark, "tokens")
    tokenfiles.write_token_files(with_text(table(spark, sf_dir, "documents")), at, tokenizer("word_bpe_49k.json"), 1)
    return tokenfiles.read_token_files(spark, at).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rest")


def op5_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(with_text(table(spark, sf_dir, "documents")), tokenizer("byte_bpe_50k.json"), 512)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(with_text(table(spark, sf_dir, "documents")), tokenizer("byte_bpe_50k.json"), 2)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    poison = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.POISON).alias("text"))
    return chat.digests(chat.format_conversations(turns.union(poison)))


def op12_prefixtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefixtree.prefix_tree(prefixtree.rebuilt(prefixtree.conversations(table(spark, sf_dir, "conversations"))))
    return nodes.drop("key", "parent_key")


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.digests(recompression.collapse_runs(recompression.with_planted(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_jpeg, op2_minhash, op3_tokenfiles, op4_toxicity, op5_tokencounts, op6_packing, op7_shards, op8_decontaminate, op9_html, op10_substrings, op11_chat, op12_prefixtree, op13_runs)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_decontaminate": decontaminate.ORACLE, "op11_chat": chat.ORACLE, "op12_prefixtree": prefixtree.ORACLE}
