"""Mixing sources to target weights by Pfair scheduling.

Every source has an integer weight n; W is their sum. A source's documents are put in a pseudo-random order and cut into
blocks. Block i (from 0) of a source is released at slot floor(i W / n) and is due by slot ceil((i + 1) W / n). In each slot
the released block with the earliest deadline runs. As the weights fill all slots, no deadline is missed, so that after any
slot each source that still has blocks is less than one block away from its share. The schedule repeats after W slots: a table of W
rows, made from the weights alone, places every block, and the documents themselves take no part in any loop.

A source that has run out leaves its slots empty; the others keep theirs, and no document is lost.

Defined results: a null source is a source of its own; a null doc_id has the digest of its text; rows that repeat a
doc_id follow each other in one order of their texts' hashes; a weight under 1 is an error; an empty table gives no rows.
Columns of documents that have the name of a result column are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripline.llm.common import table

#: How the mixing query and stage weight their sources; any other source has weight 1.
WEIGHTS = {"src0": 6, "src1": 4, "src2": 3, "src3": 2}
RESULT = ("block", "block_pos", "release", "deadline", "slot")


def schedule(weights: dict[str | None, int]) -> list[tuple[str | None, int, int]]:
    """(source, block within the period, slot) by earliest deadline first, ties to the smaller name; null is least."""
    if any(n < 1 for n in weights.values()):
        raise ValueError("weights are integers of at least 1")
    total = sum(weights.values())
    order = sorted(weights, key=lambda s: (s is not None, s or ""))
    released: list[list[int]] = [[] for _ in range(total)]
    for k, s in enumerate(order):
        for i in range(weights[s]):
            released[i * total // weights[s]].append((-(-(i + 1) * total // weights[s]), k, i))
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(total):
        for x in released[slot]:
            heapq.heappush(ready, x)
        _, k, i = heapq.heappop(ready)
        out.append((order[k], i, slot))
    return out


def mix(
    docs: DataFrame, weights: dict[str | None, int] | None = None, default: int = 1, block_docs: int = 8, most_slots: int = 1 << 16
) -> DataFrame:
    """The documents with block, block_pos (place in the block), release, deadline and slot. Reading them by (slot, block_pos)
    gives the mixture.

    A document's place in its source comes from the digest of its doc_id: counts by source and digest prefix are summed up,
    and the rest is ranked within (source, prefix), so that a source with most of the rows is spread over all tasks.
    most_slots bounds the schedule, and with it what is broadcast; weights whose sum is above it are an error.
    """
    spark, weights = docs.sparkSession, weights or {}
    found = [r[0] for r in docs.select("source").distinct().limit(most_slots + 1).collect()]
    own = {s: weights.get(s, default) for s in found}
    total = sum(own.values())
    if total > most_slots:
        raise ValueError("the weights need too many slots")
    plan = spark.createDataFrame(
        [("" if s is None else "=" + s, own[s], i, slot) for s, i, slot in schedule(own)],
        "_key string, _weight long, _turn long, _slot long",
    )
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.coalesce("text", F.lit("")))).cast("binary"))
    rows = docs.drop(*RESULT).withColumns(
        {"_key": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "_digest": digest, "_tie": F.xxhash64("text")}
    )
    rows = rows.withColumn("_prefix", F.substring("_digest", 1, 3))
    before = Window.partitionBy("_key").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_key", "_prefix").count()
    starts = starts.select("_key", "_prefix", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    starts = starts.join(F.broadcast(plan.where("_turn = 0").select("_key", "_weight")), "_key")
    within = Window.partitionBy("_key", "_prefix").orderBy("_digest", "doc_id", "_tie")
    ranked = rows.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["_key", "_prefix"])
    at = F.col("_start") + F.col("_rank")
    placed = ranked.withColumns({"block": F.floor(at / block_docs), "block_pos": at % block_docs})
    placed = placed.withColumn("_turn", F.col("block") % F.col("_weight"))
    out = placed.join(F.broadcast(plan.drop("_weight")), ["_key", "_turn"]).withColumns(
        {
            "release": F.expr(f"block * {total}L div _weight"),
            "deadline": F.expr(f"((block + 1) * {total}L + _weight - 1) div _weight"),
            "slot": F.expr(f"block div _weight * {total}L + _slot"),
        }
    )
    return out.select(*[c for c in docs.columns if c not in RESULT], *RESULT)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), WEIGHTS).select("doc_id", "source", *RESULT)


QUERIES = {"op10_mixing": op10_mixing}
SQL = {
    "op10_mixing": """
        WITH RECURSIVE w AS (
            SELECT source, CASE source WHEN 'src0' THEN 6 WHEN 'src1' THEN 4 WHEN 'src2' THEN 3 WHEN 'src3' THEN 2 ELSE 1 END AS n
            FROM (SELECT DISTINCT source FROM documents)
        ), total AS (SELECT sum(n)::BIGINT AS total FROM w),
        run AS (
            SELECT -1::BIGINT AS slot, source, n::BIGINT AS n, total, 0::BIGINT AS done, false AS picked FROM w, total
            UNION ALL
            SELECT slot + 1, source, n, total, done + picked::BIGINT,
                row_number() OVER (ORDER BY (done + picked::BIGINT) * total // n <= slot + 1 AND done + picked::BIGINT < n DESC,
                    ((done + picked::BIGINT + 1) * total + n - 1) // n, source NULLS FIRST) = 1
            FROM run WHERE slot + 1 < total
        ), plan AS (SELECT source, n, total, done AS turn, slot FROM run WHERE picked),
        placed AS (
            SELECT doc_id, source, (row_number() OVER (PARTITION BY source
                ORDER BY md5(coalesce(doc_id::VARCHAR, 'null ' || coalesce(text, ''))), doc_id NULLS FIRST) - 1)::BIGINT AS rk FROM documents
        )
        SELECT doc_id, p.source, rk // 8 AS block, rk % 8 AS block_pos, rk // 8 * total // n AS release,
            ((rk // 8 + 1) * total + n - 1) // n AS deadline, rk // 8 // n * total + slot AS slot
        FROM placed p JOIN plan ON p.source IS NOT DISTINCT FROM plan.source AND rk // 8 % n = turn"""
}
