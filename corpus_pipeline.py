"""The corpus pipeline: raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that `run` writes as Parquet to the shared folder and reads
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import decontaminate, minhash, packing, substrings, toxicity
from tremor.llm.registry import tokenizer
from tremor.llm.shared import lean, table, with_text, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the rejection threshold. The classifier learns from labelled rows of docs. Every row is
    judged by its own text: rows with equal ids, repeated rows and rows without an id too."""
    lean(spark)
    scored = toxicity.scores(docs, table(spark, sf_dir, "labels"), keep=docs.columns)
    return scored.where("predicted = 0").select("rest.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id: five-word shingles, similarity 0.8 or more.
    Rows with equal ids and different texts are documents of their own; rows that repeat id and text stay or go together;
    rows without an id stay."""
    lean(spark)
    found = minhash.near_duplicates(docs, percent=80)
    rejected = found.where("not kept").select("doc_id", "text_hash").distinct()
    rows = docs.select("doc_id", minhash.text_hash("text").alias("text_hash"), F.struct("*").alias("row"))
    return rows.join(rejected, ["doc_id", "text_hash"], "left_anti").select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages of 13 words and more that a document with a smaller id has. Texts that
    lose nothing stay as they are. Each row is cut for itself, whatever its id."""
    lean(spark)
    cut = substrings.remove_repeats(docs, keep=[c for c in docs.columns if c != "text"])
    lost = F.col("n_removed") > 0
    columns = {"text": F.when(lost, F.col("text")).otherwise(F.col("whole")), "n_chars": F.when(lost, F.length("text").cast("int")).otherwise(F.col("rest.n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return cut.select(*((columns[c] if c in columns else F.col("rest")[c]).alias(c) for c in docs.columns))


def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens, with their ids."""
    lean(spark)
    return packing.pack_documents(with_text(docs), tokenizer("byte_bpe_50k.json"), 2)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("decontaminate", drop_benchmark_overlaps),
    ("packing", pack_sequences),
]

#: Trained scores and tokenizer ids can't be expressed in SQL; tests/llm holds the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. The result's ids are digested to a checksum, as in op6's query."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
