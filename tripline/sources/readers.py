"""Readers with declared schemas: NDJSON, Parquet, CSV, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REVIEWS = "user_id string, gmap_id string, time bigint, rating double, text string, pics string, resp string"
METADATA = (
    "gmap_id string, name string, address string, description string, url string, latitude double, longitude double, "
    "avg_rating double, category array<string>, num_of_reviews int, price string, hours array<array<string>>, "
    "MISC map<string,array<string>>, state string, relative_results array<string>"
)


def ndjson(spark: SparkSession, path: str | list[str], schema: str | StructType, partitions: int | None = None) -> DataFrame:
    """One JSON object a line, plain or gzipped. Gzip files can't be split: give partitions to deal their rows out."""
    rows = spark.read.schema(schema).json(path)
    return rows.repartition(partitions) if partitions else rows


def gz_or_plain(spark: SparkSession, path: str) -> str:
    """The path with .gz if there is such a file, else the path itself if there is one; without either, the gzipped name."""
    for name in (f"{path}.gz", path):
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return name
    return f"{path}.gz"


def tolerant_ndjson(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """As ndjson, without blank and broken lines and rows that lack the key."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """With a header line; without a schema the types are inferred from the whole file."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token and idx of a JSON object token -> index, in the order of the indices."""
    whole = spark.read.text(path, wholetext=True)
    pairs = whole.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("token", "idx"))
    return pairs.orderBy("idx")


def clean_reviews(raw: DataFrame, as_of: str, since: str = "2000-01-01 00:00:00") -> DataFrame:
    """Reviews in their own columns: valid times up to as_of, user, place, rating and time known, one row of each (user, place, time, rating)."""
    from tripline.functions.text import strip
    from tripline.functions.time import from_epoch_ms
    from tripline.operators.relational import dedup

    rows = raw.select(
        "user_id", "gmap_id", from_epoch_ms(F.col("time")).alias("ts"), F.col("rating").cast("int").alias("rating"),
        strip(F.col("text")).alias("text"), F.col("pics").isNotNull().alias("has_pics"), F.col("resp").isNotNull().alias("has_resp"),
    )
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (since, as_of))
    rows = rows.where(F.col("ts").between(lo, hi)).dropna(subset=["user_id", "gmap_id", "rating", "ts"])
    return dedup(rows, ["user_id", "gmap_id", "ts", "rating"], [F.col("text")])


def clean_places(raw: DataFrame, south: float = 30.0, north: float = 35.5, west: float = -86.0, east: float = -80.0) -> DataFrame:
    """Places inside the box that serve food, with parsed prices, categories, opening hours and services, one row of each id."""
    from tripline.functions import geo, lists, text, time
    from tripline.operators.relational import dedup

    families = text.category_families(F.col("category"))
    rows = raw.where(F.col("gmap_id").isNotNull() & geo.in_box(F.col("latitude"), F.col("longitude"), south, north, west, east))
    rows = rows.withColumns({"_families": families, "_services": lists.service_flags(F.col("MISC"))})
    out = rows.select(
        "gmap_id", text.strip(F.col("name")).alias("name"), F.col("latitude").cast("float").alias("lat"), F.col("longitude").cast("float").alias("lon"),
        text.main_family(F.col("_families")).alias("category_main"), F.col("_families").alias("category_all"),
        F.col("avg_rating").cast("float").alias("avg_rating"), F.col("num_of_reviews").alias("num_reviews"),
        text.price_bucket(F.col("price")).alias("price_bucket"), text.contains_word(F.col("state"), "closed").alias("is_closed"),
        "relative_results", "hours", F.col("_services.delivery").alias("has_delivery"), F.col("_services.takeout").alias("has_takeout"),
        F.col("_services.dinein").alias("has_dinein"), F.col("_services.reservations").alias("accepts_reservations"),
        F.col("_services.quick_visit").alias("has_quick_visit"), F.col("_services.requires_mask").alias("requires_mask"),
    )
    out = dedup(out.where("category_main is not null"), ["gmap_id"], [F.col("name")])
    # Parsed hours are a map, which has no order: they are parsed when each place has one row.
    parsed = {"hours": "parsed", "days_open": "days_open", "avg_hours": "avg_hours", "has_late_night": "late_night", "is_24hr": "open_24h", "is_weekend_only": "weekend_only"}
    out = out.withColumn("_hours", time.parse_hours(F.col("hours")))
    return out.withColumns({c: F.col(f"_hours.{x}") for c, x in parsed.items()}).drop("_hours")


def refine_category(places: DataFrame) -> DataFrame:
    """Plain restaurants get the category that their names tell, unless that is 'other'."""
    from tripline.functions.text import first_keyword_group

    told = first_keyword_group(F.col("name"))
    refined = F.when((F.col("category_main") == "restaurant") & (told != "other"), told).otherwise(F.col("category_main"))
    return places.withColumn("category_main", refined)
