"""Sources, sinks, the cache and the stream."""

import gzip
import json

from pyspark.sql import functions as F

from tripline.sources import readers, writers
from tripline.streaming.pairs import streaming_pairs


def test_reviews_and_places(spark, tmp_path):
    reviews = [
        {"user_id": "u", "gmap_id": "a", "time": 1700000000123, "rating": 5, "text": "  nice \t", "pics": None, "resp": None},
        {"user_id": "u", "gmap_id": "a", "time": 1700000000999, "rating": 5, "text": "nice", "pics": None, "resp": None},
        {"user_id": None, "gmap_id": "a", "time": 1700000000123, "rating": 5, "text": "x"},
        {"user_id": "u", "gmap_id": "b", "time": 1, "rating": 4, "text": None},
    ]
    path = tmp_path / "reviews.json.gz"
    path.write_bytes(gzip.compress("\n".join(map(json.dumps, reviews)).encode()))
    rows = readers.clean_reviews(readers.ndjson(spark, str(path), readers.REVIEWS, 2), "2025-01-01 00:00:00").collect()
    assert [(r.user_id, r.gmap_id, r.rating, r.text) for r in rows] == [("u", "a", 5, "nice")]
    places = [
        {"gmap_id": "a", "name": " Tony's Pizza ", "latitude": 33.7, "longitude": -84.4, "category": ["Restaurant"], "price": "$$", "state": "Permanently closed", "hours": [["Monday", "8AM–5PM"]], "MISC": {"Service options": ["Delivery"]}},
        {"gmap_id": "b", "name": "Cut", "latitude": 33.7, "longitude": -84.4, "category": ["Hair salon"]},
        {"gmap_id": "c", "name": "Far", "latitude": 10.0, "longitude": -84.4, "category": ["Restaurant"]},
    ]
    path = tmp_path / "places.json"
    path.write_text("\n".join(map(json.dumps, places)))
    found = readers.refine_category(readers.clean_places(readers.ndjson(spark, str(path), readers.METADATA))).collect()
    assert [(r.gmap_id, r.name, r.category_main, r.price_bucket, r.is_closed, r.days_open, r.has_delivery) for r in found] == [("a", "Tony's Pizza", "pizza", 2, True, 1, True)]


def test_cache_is_keyed_by_its_inputs(spark, tmp_path):
    for name in "ab":
        spark.range(3 if name == "a" else 5).write.parquet(str(tmp_path / name))
    a, b = (spark.read.parquet(str(tmp_path / name)) for name in "ab")
    calls = []

    def build(df):
        calls.append(1)
        return df.select((F.col("id") + 1).alias("x"))

    for df, n in ((a, 3), (a, 3), (b, 5)):
        assert writers.cached(lambda df=df: build(df), str(tmp_path / "cache"), [df]).count() == n
    assert len(calls) == 2


def test_stream_of_pairs(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 05:00:00", "b"), (1, "2024-01-20 00:00:00", "c"), (2, "2024-01-01 00:00:00", "a")]
    source = tmp_path / "in"
    spark.createDataFrame(rows, "user_id long, ts string, item string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(source))
    stream = spark.readStream.schema("user_id long, ts timestamp, item string").parquet(str(source))
    query = streaming_pairs(stream).writeStream.format("memory").queryName("pairs").outputMode("append")
    query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    found = spark.table("pairs").collect()
    assert [(r.user_id, r.src_item, r.dst_item, r.delta_hours) for r in found] == [(1, "a", "b", 5.0)]
