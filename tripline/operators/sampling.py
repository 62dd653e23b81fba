"""Sampling that depends on keys and a seed alone, not on partitions; negatives; candidate unions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripline.functions.geo import cell_sizes, haversine_km
from tripline.functions.time import add_hours
from tripline.operators.geo_join import distance_band
from tripline.sources.storage import stored


def draw(*keys: Column, seed: int = 42) -> Column:
    """A uniform number in [0, 1) for the keys."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def hash_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement."""
    order = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
    return df.orderBy(order, *keys).limit(n)


def hash_sample_per(df: DataFrame, group: list[str], keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows of each group without replacement."""
    order = F.xxhash64(*[F.col(k) for k in [*group, *keys]], F.lit(seed))
    w = Window.partitionBy(*group).orderBy(order, *keys)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def numbered(df: DataFrame, group: list[str], item: str, seed: int = 42, spread: int = 256, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The items of each group (and columns to keep) with their place in it (from 0, in an order of hashes), and each group's size.

    A group is ranked within ``spread`` ranges of hashes, and the ranges' counts are summed up, so that no task holds a whole group.
    """
    rows = df.select(*group, item, *keep).withColumn("_h", F.xxhash64(*group, item, F.lit(seed)))
    rows = rows.withColumn("_b", F.shiftrightunsigned("_h", 40) % spread)
    counts = rows.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", item)) - 1
    placed = rows.withColumn("_r", rank).join(starts, [*group, "_b"])
    return placed.select(*group, item, *keep, (F.col("_start") + F.col("_r")).alias("place")), counts.groupBy(*group).agg(F.sum("_n").alias("size"))


def _drawn(pairs: DataFrame, pool: DataFrame, group: str, n: int, others: int, wanted: Callable[[Column], Column], seed: int) -> DataFrame:
    """The pairs with ``drawn``, n items of their group's pool that are wanted (or all such items, if they are fewer). Each pair
    begins at a place of its own and looks at n + others items, as at most ``others`` of a pool can be unwanted."""
    places, sizes = numbered(pool, [group], "cand", seed)
    start = F.pmod(F.xxhash64("pair_id", F.lit(seed)), F.col("size"))
    steps = F.sequence(F.lit(0).cast("long"), F.least(F.col("size"), F.lit(n + others)) - 1)
    asked = pairs.select("pair_id", group).join(sizes, group).select("pair_id", group, start.alias("_at"), "size", F.explode(steps).alias("step"))
    asked = asked.withColumn("place", (F.col("_at") + F.col("step")) % F.col("size"))
    found = asked.join(places, [group, "place"]).groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("step", "cand"))).alias("_l"))
    out = pairs.join(found, "pair_id", "left")
    items = F.coalesce(F.transform("_l", lambda x: x["cand"]), F.array().cast(f"array<{dict(pool.dtypes)['cand']}>"))
    return out.withColumn("_i", items).withColumn("drawn", F.slice(F.filter("_i", lambda x: wanted(x)), 1, n) if n else F.slice("_i", 1, 0)).drop("_i", "_l")


def _celled(places: DataFrame, d_lat: float, d_lon: float) -> DataFrame:
    return places.withColumns({"x": F.floor(F.col("lat") / d_lat), "y": F.floor(F.col("lon") / d_lon)})


def near_draws(pairs: DataFrame, places: DataFrame, n: int, km: float, seed: int = 42, waves: tuple[int, ...] = (8, 32, 100), fine: int = 8, max_lat: float = 60.0) -> DataFrame:
    """The pairs (pair_id, src_id, dst_id and others, src_lat, src_lon) with drawn: n random places within km of the source that are neither end, or
    all such places, if they are fewer.

    No neighbourhood is listed: the members of grid cells are numbered, a draw is a position among the members of the nine cells
    around the source, and is kept if its distance fits. Pairs that lack places after the first wave of draws get the next one; those that still
    do get the exact answer, from cells ``fine`` times as small that the circle touches. A dense cell is many positions, not many rows.
    """
    d_lat, d_lon = cell_sizes(km, max_lat)
    pairs = stored(pairs, "pairs")
    spots = places.select("id", "lat", "lon").where("lat is not null and lon is not null")
    members, sizes = numbered(_celled(spots, d_lat, d_lon), ["x", "y"], "id", seed, keep=("lat", "lon"))
    sources = pairs.select(F.col("src_id").alias("id"), F.col("src_lat").alias("lat"), F.col("src_lon").alias("lon")).distinct()
    nine = _celled(sources, d_lat, d_lon).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumnsRenamed({"x": "x0", "y": "y0"})
    nine = nine.withColumns({"x": F.expr("x0 + k div 3 - 1"), "y": F.expr("y0 + k % 3 - 1")}).join(sizes, ["x", "y"])
    # end0 to end8: how many members the cells have up to each.
    ends = [F.sum(F.when(F.col("k") <= i, F.col("size")).otherwise(0)).alias(f"end{i}") for i in range(9)]
    nine = stored(nine.groupBy(F.col("id").alias("src_id"), "x0", "y0").agg(*ends), "cells")
    members, partitions = stored(members, "members"), int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = (F.col("id") != F.col("src_id")) & (F.col("id") != F.col("dst_id")) & (haversine_km(F.col("src_lat"), F.col("src_lon"), F.col("lat"), F.col("lon")) <= km)

    def drawn(rows: DataFrame, tries: int) -> DataFrame:
        # Each pair becomes many rows: they are dealt out in as many tasks as a shuffle has, however small the pairs are.
        asked = rows.select("pair_id", "src_id", "dst_id", "src_lat", "src_lon").join(nine, "src_id").repartition(partitions, "pair_id")
        asked = asked.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(tries))))
        asked = asked.withColumn("u", F.coalesce(F.pmod(F.xxhash64("pair_id", "t", F.lit(seed)), F.col("end8")), F.lit(0)))
        below = [F.when(F.col("u") >= F.col(f"end{i}"), F.col(f"end{i}")).otherwise(0) for i in range(9)]
        asked = asked.withColumn("k", sum((F.when(F.col("u") >= F.col(f"end{i}"), 1).otherwise(0) for i in range(8)), F.lit(0)))
        place = F.col("u") - F.greatest(*below)
        asked = asked.select("pair_id", "src_id", "dst_id", "src_lat", "src_lon", "t", F.expr("coalesce(x0 + k div 3 - 1, 0) AS x"), F.expr("coalesce(y0 + k % 3 - 1, 0) AS y"), F.coalesce(place, F.lit(0)).alias("place"))
        found = asked.join(members, ["x", "y", "place"]).where(fits).groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("t", "id"))).alias("l"))
        ids = F.slice(F.array_distinct(F.transform("l", lambda r: r["id"])), 1, n)
        return stored(rows.join(found.select("pair_id", ids.alias("drawn")), "pair_id", "left"), "drawn")

    none = F.array().cast(f"array<{dict(places.dtypes)['id']}>")
    out, rest = None, pairs
    for tries in waves:
        now = drawn(rest, tries)
        full = now.where(F.size("drawn") == n)
        out = full if out is None else out.unionByName(full)
        rest = now.where(F.coalesce(F.size("drawn") < n, F.lit(True))).drop("drawn")
        if rest.isEmpty():
            return out
    # What is left: sources with few places around.
    f_lat, f_lon = d_lat / fine, d_lon / fine
    steps = F.sequence(F.lit(-fine - 1), F.lit(fine + 1))
    few = rest.select(F.col("src_id").alias("id"), F.col("src_lat").alias("lat"), F.col("src_lon").alias("lon")).distinct()
    cells = _celled(few, f_lat, f_lon).withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    # A cell so many steps away is at least one step less away; cells beyond the circle are left out.
    gap = F.pow(F.greatest(F.abs("i") - 1, F.lit(0)) / fine, 2) + F.pow(F.greatest(F.abs("j") - 1, F.lit(0)) / fine * F.cos(F.radians(F.least(F.abs("lat") + d_lat, F.lit(90.0)))) / F.cos(F.radians(F.lit(max_lat))), 2)
    cells = cells.where(gap <= 1.001).select(F.col("id").alias("src_id"), (F.col("x") + F.col("i")).alias("x"), (F.col("y") + F.col("j")).alias("y"))
    near = cells.join(_celled(spots, f_lat, f_lon), ["x", "y"]).drop("x", "y").join(rest.select("pair_id", "src_id", "dst_id", "src_lat", "src_lon"), "src_id").where(fits)
    some = hash_sample_per(near.select("pair_id", "id"), ["pair_id"], ["id"], n, seed).groupBy("pair_id").agg(F.sort_array(F.collect_list("id")).alias("drawn"))
    last = rest.join(some, "pair_id", "left").withColumn("drawn", F.coalesce("drawn", none))
    return out.unionByName(last)


def hybrid_negatives(pairs: DataFrame, places: DataFrame, n: int = 4, km: float = 10.0, seed: int = 42) -> DataFrame:
    """Negatives for pairs (pair_id, src_id, dst_id, src_ts): of n, int(n / 2) near the source, int(0.3 n) related to it and the rest of its
    category, drawn in this order from all places; none is the destination, drawn twice, or (but for related ones) the source. Where
    there are fewer such places, all are taken.

    places has id, lat, lon, category and relative_results. Returns pair_id, src_id, dst_id, strategy, delta_hours, dst_ts.
    """
    near, related = n // 2, int(n * 0.3)
    category = n - near - related
    place = places.select("id", "lat", "lon", "category", "relative_results")
    source = place.select(F.col("id").alias("src_id"), F.col("category").alias("_category"), F.col("lat").alias("src_lat"), F.col("lon").alias("src_lon"))
    base = pairs.select("pair_id", "src_id", "dst_id", "src_ts").join(source, "src_id")
    sources = place.join(base.select(F.col("src_id").alias("id")).distinct(), "id", "left_semi")
    rows = near_draws(base, place, near, km, seed) if near else base.withColumn("drawn", F.array().cast(f"array<{dict(places.dtypes)['id']}>"))
    rows = rows.withColumnRenamed("drawn", "_near").drop("src_lat", "src_lon")

    known = sources.select("id", F.explode("relative_results").alias("cand")).join(place.select(F.col("id").alias("cand")), "cand", "left_semi")
    known = known.groupBy(F.col("id").alias("src_id")).agg(F.collect_set("cand").alias("_known"))  # as many as the place's own list has
    rows = rows.join(known, "src_id", "left")
    left = F.filter(F.coalesce("_known", F.slice("_near", 1, 0)), lambda x: (x != F.col("dst_id")) & ~F.array_contains(F.col("_near"), x))
    order = F.array_sort(F.transform(left, lambda x: F.struct(F.xxhash64("pair_id", x, F.lit(seed)).alias("h"), x.alias("x"))))
    rows = rows.withColumn("_related", F.slice(F.transform(order, lambda s: s["x"]), 1, related) if related else F.slice("_near", 1, 0))

    same = place.where("category is not null").select(F.col("category").alias("_category"), F.col("id").alias("cand"))

    def other(x: Column) -> Column:
        return (x != F.col("dst_id")) & (x != F.col("src_id")) & ~F.array_contains(F.col("_near"), x) & ~F.array_contains(F.col("_related"), x)

    rows = _drawn(rows, same, "_category", category, 2 + near + related, other, seed + 1).withColumnRenamed("drawn", "_same")

    def of_kind(name: str, ids: str) -> Column:
        return F.transform(ids, lambda x: F.struct(F.lit(name).alias("strategy"), x.alias("id")))

    kinds = F.concat(of_kind("near", "_near"), of_kind("related", "_related"), of_kind("category", "_same"))
    out = rows.select("pair_id", "src_id", "src_ts", F.explode(kinds).alias("_n"))
    out = out.select("pair_id", "src_id", F.col("_n.id").alias("dst_id"), F.col("_n.strategy").alias("strategy"), "src_ts")
    out = out.withColumn("delta_hours", 0.2 + draw(F.col("pair_id"), F.col("dst_id"), seed=seed) * (168 - 0.2))
    return out.select("pair_id", "src_id", "dst_id", "strategy", "delta_hours", add_hours(F.col("src_ts"), F.col("delta_hours")).alias("dst_ts"))


def distance_matched(pairs: DataFrame, places: DataFrame, attempts: int = 50, seed: int = 42, waves: tuple[int, ...] = (3, 12)) -> DataFrame:
    """For each pair (pair_id, src_id, dst_id) one place whose distance from the source fits the destination's (distance_band): the first that
    fits of so many places drawn at random, or else the first drawn that is neither end, whose distance is then given as 0.

    places has id, lat, lon. Returns pair_id, neg_id, distance_km, matched; pairs without any place to draw are left out. Draws are made in
    waves: only the pairs that have found none go on to the next.
    """
    spots = places.select("id", "lat", "lon")
    numbers, sizes = numbered(spots.select(F.lit(0).alias("_all"), "id", "lat", "lon"), ["_all"], "id", seed, keep=("lat", "lon"))
    numbers, sizes = stored(numbers.drop("_all"), "places"), sizes.select("size")
    partitions = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = pairs.select("pair_id", "src_id", "dst_id")
    for end in ("src", "dst"):
        ends = ends.join(spots.select(F.col("id").alias(f"{end}_id"), F.col("lat").alias(f"_{end}_lat"), F.col("lon").alias(f"_{end}_lon")), f"{end}_id")
    positive = haversine_km(F.col("_src_lat"), F.col("_src_lon"), F.col("_dst_lat"), F.col("_dst_lon"))
    first = F.lit(None).cast(f"struct<unfit: boolean, _try: int, id: {dict(places.dtypes)['id']}, _km: double>")
    rest = stored(ends.withColumn("_positive", positive).crossJoin(F.broadcast(sizes)).withColumn("_b", first), "ends")
    km = haversine_km(F.col("_src_lat"), F.col("_src_lon"), F.col("lat"), F.col("lon"))
    out, before = None, 0
    for upto in (*[w for w in waves if w < attempts], attempts):
        asked = rest.drop("_b", "_dst_lat", "_dst_lon").repartition(partitions, "pair_id").withColumn("_try", F.explode(F.sequence(F.lit(before + 1), F.lit(upto))))
        asked = asked.withColumn("place", F.coalesce(F.pmod(F.xxhash64("pair_id", "_try", F.lit(seed)), F.col("size")), F.lit(0)))
        found = asked.join(numbers, "place").where("id <> src_id and id <> dst_id").withColumn("_km", km)
        unfit = ~F.coalesce(distance_band(F.col("_positive"), F.col("_km")), F.lit(False))
        best = found.groupBy("pair_id").agg(F.min(F.struct(unfit.alias("unfit"), "_try", "id", "_km")).alias("_new"))
        # The first of an earlier wave stands before one of this wave that doesn't fit either.
        now = rest.join(best, "pair_id", "left").withColumn("_b", F.least("_b", "_new")).drop("_new")
        now, before = stored(now, "matched") if upto < attempts else now, upto
        is_done = F.coalesce(~F.col("_b.unfit"), F.lit(False))
        done, rest = now.where(is_done) if upto < attempts else now, now.where(~is_done)
        out = done if out is None else out.unionByName(done)
        if upto < attempts and rest.isEmpty():
            break
    out = out.where("_b is not null")
    return out.select("pair_id", F.col("_b.id").alias("neg_id"), F.when(F.col("_b.unfit"), 0.0).otherwise(F.col("_b._km")).alias("distance_km"), (~F.col("_b.unfit")).alias("matched"))


def candidate_union(sources: list[DataFrame], key: str, item: str, order: str, caps: list[int | None], most: int = 100) -> DataFrame:
    """Candidates (key, item, order) of several sources, each capped, in the order of the sources; each item once, at most ``most``
    of a key. Returns key, item, priority, place."""
    out = None
    for i, (df, cap) in enumerate(zip(sources, caps, strict=True)):
        rows = df.select(key, item, F.lit(i).alias("priority"), F.row_number().over(Window.partitionBy(key).orderBy(order, item)).alias("_at"))
        rows = rows if cap is None else rows.where(F.col("_at") <= cap)
        out = rows if out is None else out.unionByName(rows)
    first = out.groupBy(key, item).agg(F.min(F.struct("priority", "_at")).alias("_f"))
    w = Window.partitionBy(key).orderBy("_f.priority", "_f._at", item)
    ranked = first.select(key, item, F.col("_f.priority").alias("priority"), F.row_number().over(w).alias("place"))
    return ranked.where(F.col("place") <= most)


def contenders(rows: DataFrame, group: list[str], value: str, key: str, k: int, margin: float) -> DataFrame:
    """The rows of each group that can be among the k best of a list in whose score they differ by their values alone, higher ones being better and ties going
    to smaller keys: the k best, what lies within the margin (in which the score's rounding may hide a difference) below them, and of equal values
    the k smallest keys. A group is not held whole."""
    best = Window.partitionBy(*group).orderBy(F.desc_nulls_last(value), key)
    top = rows.select(*group, value, F.row_number().over(best).alias("_r")).where(F.col("_r") <= k)
    floors = top.groupBy(*[F.col(c).alias(f"_{c}") for c in group]).agg(F.when(F.count(value) == k, F.min(value) - margin).alias("_floor"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group])
    left = rows.join(floors, same).where(F.col("_floor").isNull() | (F.col(value) >= F.col("_floor"))).select(*rows.columns)
    equal = Window.partitionBy(*group, value).orderBy(key)
    return left.withColumn("_r", F.row_number().over(equal)).where(F.col("_r") <= k).drop("_r")


def synthetic_pairs(candidates: DataFrame, places: DataFrame, as_of: Column, hours: float = 2.0) -> DataFrame:
    """Candidates (src_id, dst_id) with both ends' place columns, starting at as_of and lasting so many hours."""
    out = candidates
    for end in ("src", "dst"):
        out = out.join(places.select(*[F.col(c).alias(f"{end}_{c}") for c in places.columns]), f"{end}_id")
    return out.withColumns({"src_ts": as_of, "dst_ts": add_hours(as_of, F.lit(hours)), "delta_hours": F.lit(hours)})
