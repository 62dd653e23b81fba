"""Radius joins through grid cells: an equi-join on cells with an exact distance filter, never all pairs.

Rows of equal coordinates are a spot. Distances are taken once for two spots, not for each pair of their rows: spots are joined in blocks of their rows,
and the blocks that are near are dealt out to the tasks before their pairs are told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripline.functions.geo import cell_sizes, haversine_km


#: Rows of a spot that are joined as one, about.
BLOCK = 1024


def _near_cells(a: DataFrame, b: DataFrame, lat: str, lon: str, d_lat: float, d_lon: float) -> DataFrame:
    """Pairs of rows from equal or neighbouring cells: a's columns as src_, b's as dst_."""

    def celled(df: DataFrame, end: str) -> DataFrame:
        out = df.select(*[F.col(c).alias(f"{end}_{c}") for c in df.columns])
        x, y = F.floor(F.col(f"{end}_{lat}") / d_lat), F.floor(F.col(f"{end}_{lon}") / d_lon)
        return out.withColumns({"_x": x, "_y": y})

    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = celled(a, "src").withColumn("_o", around)
    left = left.withColumns({"_x": F.col("_x") + F.col("_o.i"), "_y": F.col("_y") + F.col("_o.j")}).drop("_o")
    return left.join(celled(b, "dst"), ["_x", "_y"]).drop("_x", "_y")


def _blocks(df: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """The coordinates, and rows: what the rows of a part of a spot hold beside them. A spot has as many parts as it has BLOCKs of rows."""
    known = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    sizes = known.groupBy(lat, lon).agg(F.ceil(F.count("*") / BLOCK).alias("_n"))
    parts = known.join(sizes, [lat, lon]).groupBy(lat, lon, F.pmod(F.xxhash64(key), F.col("_n")).alias("_part"))
    return parts.agg(F.collect_list(F.struct(*[c for c in df.columns if c not in (lat, lon)])).alias("rows")).drop("_part")


def _told(near: DataFrame, a: DataFrame, b: DataFrame, key: str, lat: str, lon: str, distance: str) -> DataFrame:
    """The pairs of rows of the pairs of blocks, but for rows of one key: a's columns as src_, b's as dst_, and the distance."""
    tasks = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = near.repartition(tasks).withColumn("_s", F.explode("src_rows")).withColumn("_d", F.explode("dst_rows"))

    def of(df: DataFrame, end: str, row: str) -> list[Column]:
        return [F.col(f"{end}_{c}") if c in (lat, lon) else F.col(f"{row}.{c}").alias(f"{end}_{c}") for c in df.columns]

    return out.where(F.col(f"_s.{key}") != F.col(f"_d.{key}")).select(*of(a, "src", "_s"), *of(b, "dst", "_d"), distance)


def _squared(lat: str, lon: str) -> Column:
    return F.pow(F.col(f"dst_{lat}") - F.col(f"src_{lat}"), 2) + F.pow(F.col(f"dst_{lon}") - F.col(f"src_{lon}"), 2)


def radius_join(a: DataFrame, b: DataFrame, key: str, km: float, lat: str = "lat", lon: str = "lon", max_lat: float = 60.0, digits: int | None = None) -> DataFrame:
    """Pairs within km of each other with distance_km, rounded to the digits if they are given. max_lat bounds the latitudes; longitudes do not wrap at 180
    degrees."""
    pairs = _near_cells(_blocks(a, key, lat, lon), _blocks(b, key, lat, lon), lat, lon, *cell_sizes(km, max_lat))
    d = haversine_km(F.col(f"src_{lat}"), F.col(f"src_{lon}"), F.col(f"dst_{lat}"), F.col(f"dst_{lon}"))
    near = pairs.withColumn("distance_km", d).where(F.col("distance_km") <= km)
    near = near if digits is None else near.withColumn("distance_km", F.round("distance_km", digits))
    return _told(near, a, b, key, lat, lon, "distance_km")


def degree_join(a: DataFrame, b: DataFrame, key: str, squared: float = 0.04, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Pairs whose squared difference in degrees is below the bound."""
    pairs = _near_cells(_blocks(a, key, lat, lon), _blocks(b, key, lat, lon), lat, lon, squared**0.5, squared**0.5)
    return _told(pairs.withColumn("sq_deg", _squared(lat, lon)).where(F.col("sq_deg") < squared), a, b, key, lat, lon, "sq_deg")


def spots_near(a: DataFrame, b: DataFrame, squared: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """As degree_join, but row by row and with the pairs of a row with itself: for rows that are few at each spot."""
    pairs = _near_cells(a, b, lat, lon, squared**0.5, squared**0.5)
    return pairs.withColumn("sq_deg", _squared(lat, lon)).where(F.col("sq_deg") < squared)


def nearest(a: DataFrame, b: DataFrame, key: str, k: int, squared: float = 0.04, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Of degree_join's pairs the k nearest of each row of a, ties to smaller keys: src_ and dst_ key and sq_deg.

    The list is made once for a spot of a, and one longer, as a row is not its own neighbour. Of a spot of b no more rows than that can be in it.
    """
    first = Window.partitionBy(lat, lon).orderBy(key)
    there = b.select(key, lat, lon).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).drop("_r")
    order = Window.partitionBy(f"src_{lat}", f"src_{lon}").orderBy("sq_deg", f"dst_{key}")
    lists = spots_near(a.select(lat, lon).distinct(), there, squared, lat, lon).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    lists = lists.select(F.col(f"src_{lat}").alias(lat), F.col(f"src_{lon}").alias(lon), f"dst_{key}", "sq_deg")
    pairs = a.select(F.col(key).alias(f"src_{key}"), lat, lon).join(lists, [lat, lon]).where(F.col(f"src_{key}") != F.col(f"dst_{key}"))
    own = Window.partitionBy(f"src_{key}").orderBy("sq_deg", f"dst_{key}")
    return pairs.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= k).select(f"src_{key}", f"dst_{key}", "sq_deg")


def distance_band(positive_km: Column, candidate_km: Column) -> Column:
    """Whether a candidate is as far as fits the positive: 0-10 km below 5, 5-25 below 15, else 10-100."""
    return (
        F.when(positive_km < 5, candidate_km <= 10)
        .when(positive_km < 15, (candidate_km >= 5) & (candidate_km <= 25))
        .otherwise((candidate_km >= 10) & (candidate_km <= 100))
    )
