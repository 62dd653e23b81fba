"""Connected components, and the components of what shares buckets, as DataFrame operations.

Nothing here gathers a group in one task: groups are reduced by partial aggregates, and joins on a hot key have a shuffle on
both sides, so that Spark can split them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.llm.common import drop, fitted, kept, stored


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows, one for each key, dealt out anew, so that a join on the key has a shuffle on both sides.

    The join merges sorted rows: the loops join hundreds of small frames, and each that is broadcast takes pages and blocks of the driver's heap and
    a thread of its own there.
    """
    return df.repartition(F.xxhash64(key)).hint("merge")


def least_of_key(df: DataFrame, key: str, value: str, name: str, rows: int) -> DataFrame:
    return dealt(fitted(df.groupBy(key).agg(F.min(value).alias(name)), rows), key)


def components(edges: DataFrame) -> DataFrame:
    """id and label (the least id of its component) of every node of the edges (a, b).

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the least of them, until nothing
    changes. Every round is written in the shared folder, and the one before removed. Its steps have tasks by the number of edges.
    """
    spark = edges.sparkSession
    now, path = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state, n = None, now.count()
    while True:
        now = fitted(now, n)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = least_of_key(both, "a", "b", "m", n).withColumn("m", F.least("m", "a"))
        large = fitted(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), n).distinct()
        large = fitted(large, n)
        smaller = least_of_key(large, "a", "b", "m", n)
        small = fitted(large.join(smaller, "a"), n)
        down = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now, new = kept(fitted(down.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), n), "edges")
        drop(spark, path)
        path = new
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == state:
            roots = now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
            return now.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(fitted(roots, n))
        state, n = after, after[0]


def linked_groups(
    members: DataFrame,
    near: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    verify: Callable[[DataFrame], DataFrame],
    edges: DataFrame | None = None,
) -> DataFrame | None:
    """Labels of the components that result if all pairs which share a bucket (bucket, id, and marks in further columns) and are near
    are given to verify, together with edges (a, b) that are known; None if nothing is linked.

    near compares the marks of two members, which it gets by name; verify gets candidate pairs (a, b) and returns those that are linked.
    Pairs whose ends are known to be in one component need no check. First, twice, the members of a third of the buckets are held against
    one of them, which joins most of what is linked and makes no more pairs than there are members. Then in each round every bucket that still holds several components names pivots, from its smallest ones; a pivot is held against the
    members of other components in all its buckets, and leaves them. The number of pivots grows by the round, so that few rounds end
    the work however the links lie; the pairs looked at are never more than those across components.
    """
    spark, labels, pivots_each, stars = members.sparkSession, None, 4, 2
    columns = members.columns
    if edges is not None and not (edges := stored(edges, "links")).isEmpty():
        labels = stored(components(edges), "labels")
    else:
        edges = None
    members, path = kept(members, "members")
    n = members.count()

    def against(pivots: DataFrame, now: DataFrame, other: Column) -> DataFrame:
        """Near pairs of a bucket's pivots and members of other components."""
        its = pivots.select(*[F.col(c).alias(f"its_{c}") for c in pivots.columns])
        close = near(lambda c: F.col(f"its_{c}"), lambda c: F.col(c))
        pairs = its.join(now, (F.col("its_bucket") == F.col("bucket")) & other & close)
        return fitted(pairs.select(F.least("its_id", "id").alias("a"), F.greatest("its_id", "id").alias("b")).distinct(), n)

    while True:
        if labels is None:
            now = members.withColumn("label", F.col("id"))
        else:
            now = fitted(members.join(dealt(labels, "id"), "id", "left"), n).withColumn("label", F.coalesce("label", "id"))
        several = now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
        several = fitted(several.select("bucket"), n)
        now, new_path = kept(fitted(now.join(dealt(several, "bucket"), "bucket", "left_semi"), n), "members")
        drop(spark, path)
        path, n = new_path, now.count()
        if not n:
            return labels
        now = fitted(now, n)
        # Of each slot one of the smallest components. A pivot is one in all its buckets, so that no pair is looked at again.
        sized = now.select("bucket", "id", "label", F.xxhash64("id", F.lit(stars - pivots_each)).alias("draw"))
        star = stars > 0
        if star:
            chosen = sized.where(F.pmod("bucket", F.lit(3)) == stars).groupBy("bucket").agg(F.min_by("id", "draw").alias("id"))
            chosen, chosen_path = kept(fitted(chosen, n), "pivots")
            pivots = fitted(now.join(dealt(chosen, "bucket"), ["bucket", "id"], "left_semi"), n)
        else:
            if labels is not None:
                sizes = fitted(now.select("label", "id").distinct(), n).groupBy("label").agg(F.count("*").alias("n"))
                sized = fitted(sized.join(dealt(fitted(sizes, n), "label"), "label"), n)
            else:
                sized = sized.withColumn("n", F.lit(1).cast("long"))
            slot = F.pmod(F.xxhash64("id", F.lit(pivots_each)), F.lit(pivots_each))
            least = fitted(sized.groupBy("bucket", slot.alias("slot"), "n").agg(F.min_by("id", "draw").alias("id")), n)
            chosen = fitted(least.groupBy("bucket", "slot").agg(F.min_by("id", "n").alias("id")), n).select("id").distinct()
            chosen, chosen_path = kept(fitted(chosen, n), "pivots")
            pivots = fitted(now.join(dealt(chosen, "id"), "id", "left_semi"), n)
        pairs, pairs_path = kept(against(pivots, now, F.col("its_label") != F.col("label")), "pairs")
        new = stored(fitted(verify(pairs).select("a", "b").distinct(), n), "links")
        if not new.isEmpty():
            edges = new if edges is None else edges.unionByName(new)
            labels = stored(components(edges), "labels")
        members = now.select(*columns)
        if not star:
            members, old = kept(fitted(members.join(dealt(chosen, "id"), "id", "left_anti"), n).select(*columns), "members")
            drop(spark, path)
            path = old
        drop(spark, pairs_path, chosen_path)
        stars, pivots_each = (stars - 1, pivots_each) if star else (0, pivots_each * 8)
