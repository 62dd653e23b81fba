"""A training corpus from documents: reject toxic ones, keep one of each group of near-duplicates, cut benchmark phrases
out, mix the sources, and write token files.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept, which is written as Parquet and read again.
All but the last return the columns of documents, and others that documents may have, whatever their names: columns that a stage does not read
are set aside under names of their own. The fourth stage's decision is the order of its rows: they are range-partitioned and sorted
by their slot. The last stage writes the token files in the same order, by the slots that the same documents and weights give again.

Defined results: empty documents give empty results; documents without text or words are not toxic by a rule, are no near-duplicates and hold
no phrase; a null doc_id is scored, kept, and comes in its source's order by its text; rows that repeat a doc_id stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.llm.common import restored, set_aside, shared_dir, table
from tripline.llm.decontamination import decontaminate
from tripline.llm.mixing import WEIGHTS, mix
from tripline.llm.near_dedup import near_duplicates
from tripline.llm.tokens import read_tokens, write_tokens
from tripline.llm.toxicity import toxicity

#: No SQL expresses a trained classifier; the stages are tested one by one against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of at least 0.7 go; learned from all labelled documents up to the operator's bound."""
    docs, names = set_aside(docs, "doc_id", "text")
    scores = toxicity(docs, table(spark, sf_dir, "labels"), F.lit(True), keep_columns=True)
    return restored(scores.where("score < 0.7"), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at five words and a similarity of 0.8 stays: the one of the smallest doc_id
    (with all rows that repeat that doc_id)."""
    gone = near_duplicates(docs, 5, "0.8").where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ten-word phrases of the benchmark are cut out of the texts; the documents stay."""
    docs, names = set_aside(docs, "doc_id", "text", "n_chars")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    cut = F.size("spans") > 0
    text = F.when(cut, F.col("clean_text")).otherwise(F.col("text"))
    n_chars = F.when(cut, F.char_length("clean_text").cast("long")).otherwise(F.col("n_chars"))
    return restored(found.withColumns({"text": text, "n_chars": n_chars}), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of their slots."""
    docs, names = set_aside(docs, "doc_id", "text", "source")
    placed = mix(docs, WEIGHTS)
    return restored(placed.repartitionByRange("slot", "block_pos").sortWithinPartitions("slot", "block_pos"), names)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mixture, with doc_id, start, n_tokens and ids_crc32 read back from them."""
    import public_tokenizers

    placed = mix(docs.select("doc_id", "text", "source"), WEIGHTS)
    return read_tokens(write_tokens(placed, public_tokenizers.path("byte_bpe_50k.json"), order=["slot", "block_pos"], added=True))


STAGES = [
    ("toxicity", reject_toxic),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
    ("tokens", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
