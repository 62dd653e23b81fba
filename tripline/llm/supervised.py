"""What the classifiers share: who may be learned from, a bounded sample of them, and calibration."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.llm.common import stored


def remainder(modulus: int) -> F.Column:
    """crc32 of the doc_id as text, modulo the modulus; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def training_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: F.Column, bound: int) -> DataFrame:
    """doc_id, text, y (0 or 1) and fold (0 to 4) of about ``bound`` labelled documents, chosen by their ids' hashes.

    Only rows that allowed marks are ever joined with a label. The chosen ids have a size bound and are broadcast.
    """
    usable = labels.select("doc_id", F.col(label).cast("double").alias("y")).where("doc_id is not null and y in (0, 1)")
    usable = usable.where(allowed).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, bound / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)).cast("int"))


def calibration(scored: DataFrame) -> object | None:
    """An isotonic model from raw to y; None if there is nothing to learn from."""
    scored = stored(scored.select("raw", "y"), "calibration")
    if scored.select("y").distinct().count() < 2:
        return None
    return IsotonicRegression(featuresCol="raw", labelCol="y", predictionCol="score").fit(scored)


def calibrated(raw: DataFrame, model: object | None) -> DataFrame:
    """The rows with score in place of raw."""
    out = model.transform(raw) if model else raw.withColumn("score", F.col("raw"))
    return out.drop("raw").withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))


def as_vector(column: str) -> F.Column:
    return array_to_vector(F.col(column))
