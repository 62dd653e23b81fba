"""Predictions laid out for lookups: a folder for each model and bucket of sources, sorted by source and rank, and each model's index of venues.

A lookup names the model and the bucket of its source, so that Spark lists and reads one folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Predictions of a source at most.
MOST = 10


def _bucket(source: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(source.cast("string")), F.lit(buckets)).cast("int")


def save_predictions(rows: DataFrame, model: str, path: str, source: str, venue: list[str], buckets: int = 64) -> None:
    """Writes one model's predictions and its venues, the distinct sources with their columns; those of other models stay."""
    spark = rows.sparkSession
    placed = rows.withColumn("bucket", _bucket(F.col(source), buckets))
    placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", source, "rank").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/predictions/model={model}")
    known = rows.select(source, *venue).distinct().withColumn("bucket", _bucket(F.col(source), buckets))
    known.repartition(buckets, "bucket").sortWithinPartitions("bucket", source).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/venues/model={model}")
    spark.createDataFrame([(source, buckets)], "source string, buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/layout/model={model}")


class Serving:
    """Lookups in what save_predictions has written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.layout = {r.model: (r.source, r.buckets) for r in spark.read.json(f"{path}/layout").collect()}

    def models(self) -> list[str]:
        return sorted(self.layout)

    def _of(self, kind: str, model: str) -> DataFrame:
        if model not in self.layout:
            raise LookupError(f"no model {model!r}")
        return self.spark.read.parquet(f"{self.path}/{kind}").where(F.col("model") == model)

    def _at(self, kind: str, model: str, source: object) -> DataFrame:
        rows = self._of(kind, model)
        column, buckets = self.layout[model]
        bucket = self.spark.range(1).select(_bucket(F.lit(source).cast(rows.schema[column].dataType), buckets)).first()[0]
        return rows.where((F.col("bucket") == bucket) & (F.col(column) == F.lit(source)))

    def venues(self, model: str) -> DataFrame:
        """The model's venues, in the order of their sources."""
        return self._of("venues", model).drop("model", "bucket").orderBy(self.layout[model][0])

    def venue(self, model: str, source: object) -> DataFrame:
        """The venue; LookupError if the model has none of that source."""
        found = self._at("venues", model, source).drop("model", "bucket")
        if found.isEmpty():
            raise LookupError(f"{model} has no venue {source!r}")
        return found

    def predictions(self, model: str, source: object, limit: int = MOST) -> DataFrame:
        """The venue's first predictions by rank; LookupError as for venue."""
        self.venue(model, source)
        return self._at("predictions", model, source).drop("bucket").orderBy("rank", "prediction_id").limit(limit)
