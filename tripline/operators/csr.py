"""Sparse matrices in files of compressed rows: row pointers, columns and values, and the maps between ids and places.

The entries lie in the order of row and column, in chunks of a fixed number, so that a row with very many entries is many chunks. The
pointers (where each row's entries begin) lie in blocks of rows. A reader of one row opens one block of pointers and the chunks that it names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripline.operators.export import coo_matrix
from tripline.operators.ordering import numbered
from tripline.sources.storage import stored

#: Entries of a chunk and rows of a block.
CHUNK, BLOCK = 1 << 14, 1 << 12


def write_csr(edges: DataFrame, src: str, dst: str, value: str, path: str) -> CsrMatrix:
    """The matrix of the edges (one for each pair of ids) below the path: ids, pointers and entries."""
    spark = edges.sparkSession
    entries, ids = coo_matrix(edges, src, dst, value)
    ids.select("id", "idx").write.mode("overwrite").parquet(f"{path}/ids")
    ids = spark.read.parquet(f"{path}/ids")
    placed, n = numbered(stored(entries, "coo"), ["row", "col"], "e")
    placed = stored(placed.withColumn("chunk", F.expr(f"e div {CHUNK}")), "entries")
    chunks = placed.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("e", "col", "value"))).alias("_l"))
    chunks = chunks.select("chunk", F.transform("_l", lambda x: x["col"]).alias("cols"), F.transform("_l", lambda x: x["value"]).alias("values"))
    chunks.repartitionByRange("chunk").sortWithinPartitions("chunk").write.mode("overwrite").parquet(f"{path}/entries")
    # How many entries lie before a block and, within it, before a row.
    sizes = ids.select(F.col("idx").alias("row")).join(placed.groupBy("row").agg(F.count("*").alias("n")), "row", "left")
    sizes = stored(sizes.select("row", F.expr(f"row div {BLOCK}").alias("block"), F.coalesce("n", F.lit(0)).alias("n")), "sizes")
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("first", before).drop("n")  # a row for each block
    within = F.sum("n").over(Window.partitionBy("block").orderBy("row"))
    ends = sizes.withColumn("end", within).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", "end"))).alias("_l"))
    pointers = ends.join(starts, "block").select("block", F.concat(F.array("first"), F.transform("_l", lambda x: x["end"] + F.col("first"))).alias("pointers"))
    pointers.repartitionByRange("block").sortWithinPartitions("block").write.mode("overwrite").parquet(f"{path}/pointers")
    spark.createDataFrame([(ids.count(), n)], "rows long, entries long").coalesce(1).write.mode("overwrite").json(f"{path}/shape")
    return CsrMatrix.open(spark, path)


@dataclass
class CsrMatrix:
    spark: SparkSession
    path: str
    rows: int
    entries: int

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CsrMatrix:
        shape = spark.read.json(f"{path}/shape").first()
        return cls(spark, path, shape["rows"], shape["entries"])

    def ids(self) -> DataFrame:
        """id and idx."""
        return self.spark.read.parquet(f"{self.path}/ids")

    def pointers(self) -> DataFrame:
        """row, start and stop: the numbers of each row's entries."""
        each = self.spark.read.parquet(f"{self.path}/pointers").select("block", F.posexplode(F.arrays_zip(
            F.slice("pointers", F.lit(1), F.size("pointers") - 1).alias("start"), F.slice("pointers", F.lit(2), F.size("pointers") - 1).alias("stop"))).alias("at", "p"))
        return each.select((F.col("block") * BLOCK + F.col("at")).alias("row"), "p.start", "p.stop")

    def _chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/entries")

    def coo(self) -> DataFrame:
        """row, col and value of all entries. Every row asks the chunks that it lies in, and takes its part of them."""
        first, last = F.expr(f"start div {CHUNK}"), F.expr(f"(stop - 1) div {CHUNK}")
        asked = self.pointers().where("stop > start").withColumn("chunk", F.explode(F.sequence(first, last)))
        return self._taken(asked.join(self._chunks(), "chunk"))

    @staticmethod
    def _taken(found: DataFrame) -> DataFrame:
        low = F.greatest(F.col("start") - F.col("chunk") * CHUNK, F.lit(0))
        size = F.least(F.col("stop") - F.col("chunk") * CHUNK, F.lit(CHUNK)) - low
        part = F.arrays_zip(F.slice("cols", (low + 1).cast("int"), size.cast("int")).alias("col"), F.slice("values", (low + 1).cast("int"), size.cast("int")).alias("value"))
        return found.select("row", F.inline(part))

    def row(self, source: object) -> DataFrame:
        """col and value of the row of an id; LookupError without such an id. Reads one block of pointers and the row's chunks."""
        found = self.ids().where(F.col("id") == F.lit(source)).first()
        if found is None:
            raise LookupError(f"no row of {source!r}")
        block, at = divmod(found.idx, BLOCK)
        p = self.spark.read.parquet(f"{self.path}/pointers").where(F.col("block") == block).select(F.get("pointers", F.lit(at)), F.get("pointers", F.lit(at + 1))).first()
        chunks = self._chunks().where((F.col("chunk") >= p[0] // CHUNK) & (F.col("chunk") <= max(p[0], p[1] - 1) // CHUNK))
        asked = chunks.withColumns({"row": F.lit(found.idx), "start": F.lit(p[0]), "stop": F.lit(p[1])})
        return self._taken(asked.where("stop > start")).select("col", "value")

    def times(self, vector: DataFrame) -> DataFrame:
        """row and value of the product with a vector (idx, value) whose missing places are 0; rows without entries are left out."""
        its = vector.select(F.col("idx").alias("col"), F.col("value").alias("_x"))
        return self.coo().join(its, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("_x")).alias("value"))
