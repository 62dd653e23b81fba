"""Vocabularies with 0 for padding and 1 for unknown, and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripline.operators.relational import row_index

PAD, UNK, SPECIAL = 0, 1, ("<PAD>", "<UNK>")


def frequent(df: DataFrame, column: str, most: int = 20_000) -> DataFrame:
    """token, n, idx (from 2) of the most frequent values, ties to the lesser value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("token")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(most)
    return top.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("n"), "token")).cast("long") + 1)


def sorted_values(df: DataFrame, column: str) -> DataFrame:
    """token, idx (from 2) of the distinct values in order."""
    found = df.where(F.col(column).isNotNull()).select(F.col(column).alias("token")).distinct()
    return row_index(found, ["token"], "idx").select("token", (F.col("idx") + 2).cast("long").alias("idx"))


def encode(df: DataFrame, column: str, vocab: DataFrame, name: str = "idx") -> DataFrame:
    """The rows with the column's index, 1 for what is not in the vocabulary."""
    table = vocab.select(F.col("token").alias(column), F.col("idx").alias("_idx"))
    return df.join(table, column, "left").withColumn(name, F.coalesce("_idx", F.lit(UNK).cast("long"))).drop("_idx")


def decode(df: DataFrame, index: str, vocab: DataFrame, name: str = "token") -> DataFrame:
    """The rows with the token of an index; null for the special ones."""
    return df.join(vocab.select(F.col("idx").alias(index), F.col("token").alias(name)), index, "left")


def coverage(df: DataFrame, column: str, vocab: DataFrame) -> DataFrame:
    """One row: how many rows the vocabulary covers, of how many, and the percentage."""
    hit = df.join(vocab.select(F.col("token").alias(column), F.lit(1).alias("_hit")), column, "left")
    return hit.agg(F.count("_hit").alias("covered"), F.count("*").alias("total"), (100.0 * F.count("_hit") / F.count("*")).alias("coverage_pct"))


def class_weights(targets: DataFrame, index: str, vocab: DataFrame) -> DataFrame:
    """idx and weight N / (V * n): N targets, V the vocabulary's size with both special tokens, n the class's targets; padding
    weighs 0, unknown and classes without targets 1."""
    counts = targets.groupBy(F.col(index).alias("idx")).agg(F.count("*").alias("n"))
    total = targets.agg(F.count("*").alias("_total")).crossJoin(vocab.agg((F.count("*") + 2).alias("_v")))
    special = vocab.sparkSession.createDataFrame([(PAD,), (UNK,)], "idx long")
    every = vocab.select("idx").unionByName(special).join(counts, "idx", "left").crossJoin(F.broadcast(total))
    weight = F.when(F.col("idx") == PAD, 0.0).when((F.col("idx") == UNK) | F.col("n").isNull(), 1.0)
    return every.select("idx", weight.otherwise(F.col("_total") / (F.col("_v") * F.col("n"))).alias("weight"))


def as_json(vocab: DataFrame) -> DataFrame:
    """One row, value: the vocabulary as a JSON object with the special tokens."""
    special = vocab.sparkSession.createDataFrame([(t, i) for i, t in enumerate(SPECIAL)], "token string, idx long")
    rows = vocab.select(F.col("token").cast("string").alias("token"), F.col("idx").cast("long").alias("idx")).unionByName(special)
    entries = F.sort_array(F.collect_list(F.struct("idx", "token")))
    return rows.agg(F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["token"], e["idx"])))).alias("value"))
