"""Queries on places: geography, categories, texts, opening hours, services, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.functions import geo, lists, text
from tripline.functions import time as t
from tripline.operators import features, geo_join, profiles, sampling
from tripline.plans.visits import PAIRS, events, pairs, query
from tripline.sources.readers import table


def places(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with coordinates made from their keys."""
    key = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        key.alias("id"), F.col("s_name").alias("name"), (33 + (key * 37 % 200) / 100.0).alias("lat"), (-85 + (key * 53 % 200) / 100.0).alias("lon"),
        F.col("s_acctbal").alias("balance"),
    )


PLACES = "(SELECT s_suppkey AS id, s_name AS name, 33 + (s_suppkey * 37 % 200) / 100.0::DOUBLE AS lat, -85 + (s_suppkey * 53 % 200) / 100.0::DOUBLE AS lon, s_acctbal AS balance FROM supplier)"


def km(a: str, b: str) -> str:
    return (
        f"2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
    )


#: The places drawn together to a quarter of their distances.
DENSE = f"(SELECT id, 33 + (lat - 33) / 4 AS lat, -85 + (lon + 85) / 4 AS lon, balance FROM {PLACES})"


def dense_places(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).withColumns({"lat": 33 + (F.col("lat") - 33) / 4, "lon": -85 + (F.col("lon") + 85) / 4})


@query(f"""SELECT a.id AS src_id, b.id AS dst_id, round({km('a', 'b')}, 4) AS distance_km FROM {DENSE} a JOIN {DENSE} b ON a.id <> b.id AND {km('a', 'b')} <= 10""")
def radius_join(spark, d):
    p = dense_places(spark, d).select("id", "lat", "lon")
    return geo_join.radius_join(p, p, "id", 10.0, digits=4).select("src_id", "dst_id", "distance_km")


@query(f"SELECT a.id AS src_id, b.id AS dst_id FROM {PLACES} a JOIN {PLACES} b ON a.id <> b.id AND pow(b.lat - a.lat, 2) + pow(b.lon - a.lon, 2) < 0.04")
def sqdeg_join(spark, d):
    p = places(spark, d).select("id", "lat", "lon")
    return geo_join.degree_join(p, p, "id").select("src_id", "dst_id")


@query(f"SELECT id FROM {PLACES} WHERE lat BETWEEN 33.6 AND 34.1 AND lon BETWEEN -84.6 AND -84.1")
def box_filter(spark, d):
    return places(spark, d).where(geo.in_box(F.col("lat"), F.col("lon"), 33.6, 34.1, -84.6, -84.1)).select("id")


NEXT = f"(SELECT a.*, b.id AS id2, b.lat AS lat2, b.lon AS lon2, b.balance AS balance2 FROM {PLACES} a JOIN {PLACES} b ON b.id = a.id + 1)"


def next_places(spark: SparkSession, d: str) -> DataFrame:
    """Each place with that of the next key."""
    p = places(spark, d)
    return p.join(p.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("balance").alias("balance2")), "id")


@query(f"""SELECT id, round({km('n', 'm')}, 4) AS distance_km, CASE WHEN {km('n', 'm')} < 1 THEN '0-1km' WHEN {km('n', 'm')} < 5 THEN '1-5km'
    WHEN {km('n', 'm')} < 10 THEN '5-10km' WHEN {km('n', 'm')} < 20 THEN '10-20km' ELSE '20+km' END AS bucket
    FROM (SELECT id, struct_pack(lat, lon) AS n, struct_pack(lat := lat2, lon := lon2) AS m FROM {NEXT})""")
def haversine_km(spark, d):
    dist = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return next_places(spark, d).select("id", F.round(dist, 4).alias("distance_km"), geo.distance_bucket(dist).alias("bucket"))


@query(f"""SELECT id, ['N','NE','E','SE','S','SW','W','NW'][1 + floor((degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)),
    cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) + 382.5) / 45)::BIGINT % 8] AS bearing FROM {NEXT}""")
def bearing8(spark, d):
    return next_places(spark, d).select("id", geo.bearing8(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("bearing"))


@query(f"""SELECT a.id AS src_id, b.id AS dst_id, CASE WHEN a.id % 3 = 0 THEN {km('a', 'b')} <= 10 WHEN a.id % 3 = 1 THEN {km('a', 'b')} BETWEEN 5 AND 25
    ELSE {km('a', 'b')} BETWEEN 10 AND 100 END AS fits FROM {PLACES} a JOIN {PLACES} b ON a.id <> b.id AND {km('a', 'b')} <= 30""")
def distance_bands(spark, d):
    p = places(spark, d).select("id", "lat", "lon")
    near = geo_join.radius_join(p, p, "id", 30.0)
    positive = F.when(F.col("src_id") % 3 == 0, 1.0).when(F.col("src_id") % 3 == 1, 10.0).otherwise(50.0)
    return near.select("src_id", "dst_id", geo_join.distance_band(positive, F.col("distance_km")).alias("fits"))


# Part types and names stand for raw categories.
RAW = "['Sushi restaurant', 'Hair salon', 'Donut shop', 'Bakery', 'Thai restaurant', 'restaurant', 'Pizza', ' COFFEE ']"
RAW_LIST = ["Sushi restaurant", "Hair salon", "Donut shop", "Bakery", "Thai restaurant", "restaurant", "Pizza", " COFFEE "]


def raw_lists(spark: SparkSession, d: str) -> DataFrame:
    raw = F.array(*[F.lit(x) for x in RAW_LIST])
    at = [F.element_at(raw, ((F.col("p_partkey") * m) % 8 + 1).cast("int")) for m in (1, 3, 5)]
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 11 != 0, F.array(*at)).alias("raw"))


@query(f"""WITH m AS (SELECT unnest(['Sushi restaurant','Hair salon','Donut shop','Bakery','Thai restaurant','restaurant','Pizza',' COFFEE ']) AS raw,
        unnest(['sushi','other','dessert','bakery','asian','restaurant','pizza','coffee']) AS family, unnest([1,99,15,14,10,24,2,17]) AS rank),
    x AS (SELECT p_partkey, unnest([1,2,3]) AS pos, unnest([{RAW}[p_partkey % 8 + 1], {RAW}[p_partkey * 3 % 8 + 1], {RAW}[p_partkey * 5 % 8 + 1]]) AS raw
        FROM part WHERE p_partkey % 11 <> 0),
    f AS (SELECT p_partkey, family, min(pos) AS pos, min(rank) AS rank FROM x JOIN m USING (raw) GROUP BY ALL)
    SELECT p_partkey, coalesce(string_agg(family, '|' ORDER BY pos), '') AS families, CASE WHEN min(rank) < 99 THEN min_by(family, rank) END AS main
    FROM part LEFT JOIN f USING (p_partkey) GROUP BY p_partkey""")
def category_priority(spark, d):
    rows = raw_lists(spark, d).withColumn("known", text.category_families(F.col("raw")))
    return rows.select("p_partkey", lists.joined(F.col("known")).alias("families"), text.main_family(F.col("known")).alias("main"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'ring') THEN 'warm' WHEN contains(lower(p_name), 'a') THEN 'cold' ELSE 'other' END AS told,
    CASE WHEN contains(lower(p_type), 'e') THEN 'e' ELSE 'other' END AS by_type FROM part""")
def name_to_category(spark, d):
    groups = {"warm": ["red", "ring"], "cold": ["a"]}
    return table(spark, d, "part").select(
        "p_partkey", text.first_keyword_group(F.col("p_name"), groups).alias("told"), text.first_keyword_group(F.col("p_type"), {"e": ["e"]}).alias("by_type")
    )


@query("""SELECT p_partkey, coalesce(map {'PROMO': 'a', 'STANDARD': 'b', 'SMALL': 'c'}[split_part(p_type, ' ', 1)], 'other') AS family FROM part""")
def map_default(spark, d):
    known = F.create_map(*[F.lit(x) for x in ("PROMO", "a", "STANDARD", "b", "SMALL", "c")])
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(known, F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit("other")).alias("family"))


@query("""SELECT source, round(avg(contains(lower(text), 'the')::INT), 6) AS mentions_a, round(avg((contains(lower(text), 'que') OR contains(lower(text), 'tea'))::INT), 6) AS mentions_b
    FROM documents WHERE text IS NOT NULL GROUP BY source""")
def topic_shares(spark, d):
    found = profiles.topic_shares(table(spark, d, "documents"), "source", "text", {"a": ["the"], "b": ["que", "tea"]})
    return found.withColumns({c: F.round(c, 6) for c in ("mentions_a", "mentions_b")})


POLARITY = """(SELECT *, CASE WHEN p + n = 0 THEN 0.0 ELSE (p - n)::DOUBLE / (p + n) END AS s FROM (SELECT *,
    contains(lower(text), 'the')::INT + contains(lower(text), 'que')::INT + contains(lower(text), 'and')::INT AS p,
    contains(lower(text), 'scum')::INT + contains(lower(text), 'idiot')::INT + contains(lower(text), 'der')::INT AS n FROM documents))"""
GOOD, BAD = ["the", "que", "and"], ["scum", "idiot", "der"]


@query(f"SELECT doc_id, round(s, 6) AS polarity FROM {POLARITY}")
def keyword_polarity(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.polarity(F.col("text"), GOOD, BAD), 6).alias("polarity"))


@query(f"""SELECT source, round(avg(s), 6) AS avg_sentiment, round(stddev_samp(s), 6) AS sentiment_std, round(avg((s > 0.2)::INT), 6) AS positive_review_pct,
    round(avg((s < -0.2)::INT), 6) AS negative_review_pct, round(avg(length(text)), 6) AS avg_review_length, count(s) AS review_count FROM {POLARITY} GROUP BY source""")
def sentiment_agg(spark, d):
    found = profiles.sentiment(table(spark, d, "documents"), "source", "text", text.polarity(F.col("text"), GOOD, BAD))
    return found.select("source", *[F.round(c, 6).alias(c) for c in found.columns[1:-1]], "review_count")


@query("""WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS w FROM documents)
    SELECT a.doc_id, round(CASE WHEN len(list_distinct(a.w || b.w)) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(a.w || b.w)) END, 6) AS jaccard
    FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def word_jaccard(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    both = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    return both.select("doc_id", F.round(text.word_jaccard(F.col("text"), F.col("other")), 6).alias("jaccard"))


@query()
def tfidf_cosine(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    both = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    return text.tfidf_cosine(both, "text", "other").select("doc_id", F.round("tfidf_cosine", 6).alias("tfidf_cosine"))


@query("""SELECT p_partkey, length(p_name)::INT AS n_chars, contains(lower(p_type), 'promo') AS is_promo, trim(p_brand) AS brand,
    length(repeat('$', p_size % 5)) ::INT AS price_bucket, coalesce(p_name, 'unknown') || '→' || coalesce(CASE WHEN p_size % 7 <> 0 THEN p_brand END, 'unknown') AS key FROM part""")
def text_basics(spark, d):
    brand = F.when(F.col("p_size") % 7 != 0, F.col("p_brand"))
    dollars = F.concat(F.lit(" "), F.repeat(F.lit("$"), F.col("p_size") % 5), F.lit("\t"))
    return table(spark, d, "part").select(
        "p_partkey", F.char_length("p_name").alias("n_chars"), text.contains_word(F.col("p_type"), "promo").alias("is_promo"),
        text.strip(F.col("p_brand")).alias("brand"), text.price_bucket(dollars).alias("price_bucket"), lists.named(F.col("p_name"), brand).alias("key"),
    )


CATS = "['pizza', 'dessert', 'breakfast', 'american', 'sushi', 'cafe', NULL]"


@query(f"""SELECT p_partkey, CASE WHEN (a = 'pizza' AND b = 'dessert') OR (a = 'sushi' AND b IN ('dessert', 'cafe')) OR (a = 'breakfast' AND b = 'cafe') THEN 'complementary'
        WHEN a = b THEN 'similar' ELSE 'diverse' END AS pair_type,
    coalesce(a IN ('pizza', 'american', 'sushi') AND b IN ('dessert', 'cafe'), false) AS dessert_follows,
    coalesce((a = 'breakfast' AND b = 'american') OR (a = 'american' AND b = 'dessert'), false) AS progresses
    FROM (SELECT p_partkey, {CATS}[p_partkey % 7 + 1] AS a, {CATS}[p_partkey // 7 % 7 + 1] AS b FROM part)""")
def pair_type(spark, d):
    cats = F.array(*[F.lit(x) for x in ("pizza", "dessert", "breakfast", "american", "sushi", "cafe")], F.lit(None).cast("string"))
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", F.element_at(cats, (k % 7 + 1).cast("int")).alias("a"), F.element_at(cats, (F.floor(k / 7) % 7 + 1).cast("int")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("p_partkey", lists.pair_type(a, b).alias("pair_type"), lists.dessert_follows(a, b).alias("dessert_follows"), lists.meal_progresses(a, b).alias("progresses"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN TIMESTAMP '2020-01-01 00:00:00' ELSE TIMESTAMP '2024-02-01 10:00:00' + INTERVAL (p_size) MINUTE END AS ts FROM part")
def ts_parse_default(spark, d):
    stamp = F.concat(F.lit("2024-02-01T"), F.lpad((10 + F.floor(F.col("p_size") / 60)).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("p_size") % 60).cast("string"), 2, "0"), F.lit(":00"))
    value = F.when(F.col("p_size") % 3 == 0, F.lit("no date")).otherwise(stamp)
    return table(spark, d, "part").select("p_partkey", t.parse_or(value).alias("ts"))


@query("""SELECT p_partkey, p_brand || ', ' || p_type AS names, '{"size":' || p_size || '}' AS info FROM part""")
def nested_to_string(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.array("p_brand", "p_type").alias("names"), F.struct(F.col("p_size").alias("size")).alias("info"))
    kinds = dict(rows.dtypes)
    return rows.select("p_partkey", *[lists.flat_text(F.col(c), kinds[c]).alias(c) for c in ("names", "info")])


@query("""SELECT p_partkey, [p_size, p_size % 7, 3, p_size % 7]::VARCHAR AS given, list_contains([p_size % 7, p_size % 5, 3], 3) AS has, nullif(coalesce(list_position([p_size % 7, p_size % 5, 3], 3), 0), 0)::BIGINT AS place,
    nullif(coalesce(list_position([p_size % 7, p_size % 5], 3), 0), 0)::BIGINT AS place_or_null FROM part""")
def array_rank_in_list(spark, d):
    s = F.col("p_size")
    given = F.array(s, s % 7, F.lit(3), s % 7)
    short, long = F.array(s % 7, s % 5), F.array(s % 7, s % 5, F.lit(3))
    return table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("["), lists.joined(given.cast("array<string>"), ", "), F.lit("]")).alias("given"), lists.member(long, F.lit(3)).alias("has"),
        lists.place_in(long, F.lit(3)).alias("place"), lists.place_in(short, F.lit(3)).alias("place_or_null"),
    )


@query("SELECT p_partkey, p_brand || '|' || p_type AS joined, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || '|' || p_type END AS once FROM part")
def list_join(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", lists.joined(F.array("p_brand", "p_type")).alias("joined"), lists.joined(F.array_distinct(F.array("p_brand", "p_type", "p_brand"))).alias("once")
    )


@query("""SELECT s_suppkey, k % 2 = 0 AS delivery, k % 3 = 0 AS takeout, k % 5 = 0 AS dinein, k % 4 = 0 AS reservations, false AS quick_visit, k % 7 = 0 AS requires_mask FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier)""")
def service_flags(spark, d):
    k = F.col("s_suppkey")

    def given(*options: tuple[int, str]):
        return F.filter(F.array(*[F.when(k % m == 0, F.lit(x)) for m, x in options], F.lit("Other")), lambda x: x.isNotNull())

    misc = F.create_map(
        F.lit("Service options"), given((2, "No-contact Delivery"), (3, "Takeout"), (5, "Dine-in")), F.lit("Planning"), given((4, "Accepts reservations")),
        F.lit("Health & safety"), given((7, "Mask required")),
    )
    return table(spark, d, "supplier").select("s_suppkey", lists.service_flags(misc).alias("f")).select("s_suppkey", "f.*")


def hours_of(spark: SparkSession, d: str) -> DataFrame:
    """Opening hours made from keys: seven kinds of texts."""
    kinds = [
        ("Monday", "8:30AM–9:30PM"), ("Saturday", "6PM–2AM"), ("Monday", "Open 24 hours"), ("Monday", "11AM–12AM"), ("Sunday", "Closed"),
        ("Monday", "8–10PM"), ("Tuesday", "9AM-5:15PM"),
    ]
    every = F.array(*[F.array(F.array(F.lit(a), F.lit(b))) for a, b in kinds])
    rows = table(spark, d, "supplier").select("s_suppkey", F.element_at(every, (F.col("s_suppkey") % 7 + 1).cast("int")).alias("hours"))
    return rows.select("s_suppkey", t.parse_hours(F.col("hours")).alias("h")).select("s_suppkey", "h.*")


HOURS = """(SELECT s_suppkey, ['monday','saturday','monday','monday','sunday',NULL,'tuesday'][k] AS day, [8.5,18,0,11,NULL,NULL,9][k] AS opens, [21.5,26,24,24,NULL,NULL,17.25][k] AS closes,
    [1,1,1,1,0,NULL,1][k] AS days_open, [13.0,8.0,24.0,13.0,0.0,NULL,8.25][k] AS avg_hours, [false,true,false,true,false,false,false][k] AS late_night,
    [false,false,true,false,false,false,false][k] AS open_24h, [false,true,false,false,true,false,false][k] AS weekend_only FROM (SELECT s_suppkey, s_suppkey % 7 + 1 AS k FROM supplier))"""


@query(f"SELECT s_suppkey, day, opens::DOUBLE AS opens, closes::DOUBLE AS closes, days_open::INT AS days_open, avg_hours::DOUBLE AS avg_hours, late_night, open_24h, weekend_only FROM {HOURS}")
def hours_parse(spark, d):
    rows = hours_of(spark, d).withColumn("day", F.get(F.map_keys("parsed"), F.lit(0)))
    span = F.try_element_at("parsed", F.col("day"))
    return rows.select("s_suppkey", "day", span[0].alias("opens"), span[1].alias("closes"), "days_open", "avg_hours", "late_night", "open_24h", "weekend_only")


@query(f"""SELECT s_suppkey, h.hour, CASE WHEN day IS NULL OR day <> 'saturday' THEN true ELSE h.hour >= 18 OR h.hour <= 2 END AS on_saturday,
    CASE WHEN day IS NULL OR day <> 'monday' THEN true ELSE h.hour >= opens AND h.hour <= closes END AS on_monday
    FROM {HOURS}, (SELECT unnest([1, 3, 8, 21, 23]) AS hour) h""")
def open_at_time(spark, d):
    rows = hours_of(spark, d).withColumn("hour", F.explode(F.array(*[F.lit(x) for x in (1, 3, 8, 21, 23)])))
    return rows.select("s_suppkey", "hour", *[t.open_at(F.col("parsed"), F.lit(x), F.col("hour")).alias(f"on_{x}") for x in ("saturday", "monday")])


@query(f"""SELECT a.s_suppkey, CASE WHEN a.day IS NULL OR b.day IS NULL OR a.day <> b.day THEN true ELSE coalesce(greatest(a.opens, b.opens) < least(a.closes, b.closes) AND a.opens IS NOT NULL AND b.opens IS NOT NULL, false) END AS overlap
    FROM {HOURS} a JOIN {HOURS} b ON b.s_suppkey = a.s_suppkey + 2""")
def hours_overlap(spark, d):
    rows = hours_of(spark, d).select("s_suppkey", "parsed")
    other = rows.select((F.col("s_suppkey") - 2).alias("s_suppkey"), F.col("parsed").alias("other"))
    return rows.join(other, "s_suppkey").select("s_suppkey", t.hours_overlap(F.col("parsed"), F.col("other")).alias("overlap"))


@query(f"SELECT s_suppkey, coalesce(closes >= 23 OR closes <= 3, false) AS late, coalesce(opens <= 9, false) AS early FROM {HOURS}")
def late_closer(spark, d):
    return hours_of(spark, d).select("s_suppkey", t.closes_late(F.col("parsed")).alias("late"), t.opens_early(F.col("parsed")).alias("early"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_extract(spark, d):
    return events(spark, d).select("event_id", F.try_element_at(F.from_json("props", "map<string,bigint>"), F.lit("k")).alias("k"))


@query("""SELECT p_partkey, CASE WHEN k IN (0, 1, 2) THEN true WHEN k IN (3, 4) THEN false END AS flag,
    CASE WHEN k = 5 THEN 3.7 WHEN k IN (1) THEN 1.0 WHEN k = 3 THEN 0.0 END::DOUBLE AS number, CASE WHEN k = 5 THEN 3 WHEN k = 1 THEN 1 WHEN k = 3 THEN 0 END::BIGINT AS whole
    FROM (SELECT p_partkey, p_partkey % 8 AS k FROM part)""")
def loose_values(spark, d):
    given = F.array(*[F.lit(x) for x in ("Yes", "1", " t ", "0", "no", "3.7", "maybe", "")])
    rows = table(spark, d, "part").select("p_partkey", F.element_at(given, (F.col("p_partkey") % 8 + 1).cast("int")).alias("v"))
    v = F.col("v")
    return rows.select("p_partkey", lists.loose_bool(v).alias("flag"), lists.loose_double(v).alias("number"), lists.loose_long(v).alias("whole"))


@query()
def bucket_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", lists.bucket_of(F.col("c_name")).alias("bucket"))


@query("""SELECT user_id, src_event_id, (hour(dst_ts) - hour(src_ts))::INT AS hour_diff, round(dst_value - src_value, 6) AS rating_diff, dst_value > src_value AS is_rating_upgrade,
    round(power(dst_value - src_value, 2), 4) AS rating_diff_squared, round(dst_value / (src_value + 0.1), 4) AS rating_ratio, round(delta_hours * delta_hours, 4) AS delta_hours_squared
    FROM (SELECT *, date_sub('second', src_ts, dst_ts) / 3600.0 AS delta_hours FROM (SELECT user_id, event_id AS src_event_id, ts AS src_ts, lead(ts) OVER w AS dst_ts, value AS src_value,
        lead(value) OVER w AS dst_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) WHERE delta_hours > 0 AND delta_hours <= 168""")
def interaction_features(spark, d):
    rows = pairs(spark, d).withColumnsRenamed({"src_value": "src_rating", "dst_value": "dst_rating"})
    out = features.pair_features(rows.select("user_id", "src_event_id", "src_ts", "dst_ts", "delta_hours", "src_rating", "dst_rating"))
    return out.select(
        "user_id", "src_event_id", (F.col("dst_hour") - F.col("src_hour")).alias("hour_diff"), F.round("rating_diff", 6).alias("rating_diff"), "is_rating_upgrade",
        F.round("rating_diff_squared", 4).alias("rating_diff_squared"), F.round("rating_ratio", 4).alias("rating_ratio"), F.round("delta_hours_squared", 4).alias("delta_hours_squared"),
    )


@query(f"""SELECT id, round(balance2 - balance, 4) AS price_diff, balance2 > balance AS is_price_upgrade, balance2 = balance AS same_price_level, round({km('n', 'm')} * (balance2 - balance), 2) AS distance_x_diff,
    (id % 2 = 0) = (id % 3 = 0) AS service_match, id % 2 <> 0 AND id % 3 = 0 AS dst_adds_delivery, abs(id % 10 / 10.0 - id % 7 / 10.0) < 0.2 AS near_topic
    FROM (SELECT *, struct_pack(lat, lon) AS n, struct_pack(lat := lat2, lon := lon2) AS m FROM {NEXT})""")
def pair_features(spark, d):
    k = F.col("id")
    rows = next_places(spark, d).select(
        "id", F.col("lat").alias("src_lat"), F.col("lon").alias("src_lon"), F.col("lat2").alias("dst_lat"), F.col("lon2").alias("dst_lon"),
        F.col("balance").alias("src_price"), F.col("balance2").alias("dst_price"), (k % 2 == 0).alias("src_has_delivery"), (k % 3 == 0).alias("dst_has_delivery"),
        (k % 5 == 0).alias("src_has_takeout"), (k % 5 == 0).alias("dst_has_takeout"), F.lit(False).alias("src_has_dinein"), F.lit(True).alias("dst_has_dinein"),
        F.lit(True).alias("src_accepts_reservations"), F.lit(True).alias("dst_accepts_reservations"),
        *[(k % 10 / 10.0).alias(f"src_mentions_{x}") for x in ("dessert", "drinks", "service", "atmosphere", "price")],
        *[(k % 7 / 10.0).alias(f"dst_mentions_{x}") for x in ("dessert", "drinks", "service", "atmosphere", "price")],
    )
    out = features.pair_features(rows)
    return out.select(
        "id", F.round("price_diff", 4).alias("price_diff"), "is_price_upgrade", "same_price_level", F.round(F.col("distance_km") * F.col("price_diff"), 2).alias("distance_x_diff"),
        "service_match", "dst_adds_delivery", (F.col("topic_similarity_count") == 5).alias("near_topic"),
    )


@query()
def hash_sample(spark, d):
    return sampling.hash_sample(places(spark, d), ["id"], 20)


@query()
def hybrid_negatives(spark, d):
    return sampling.hybrid_negatives(*sampled_pairs(spark, d))


VISITED = f"""(SELECT src_event_id AS pair_id, src_event_id % n AS src_id, dst_event_id % n AS dst_id FROM {PAIRS}, (SELECT count(*) AS n FROM supplier)
    WHERE delta_hours > 0 AND delta_hours <= 168 AND src_event_id % n <> dst_event_id % n)"""


@query(f"""WITH near AS (SELECT a.id AS src_id, b.id AS dst_id FROM {DENSE} a JOIN {DENSE} b ON a.id <> b.id AND {km('a', 'b')} <= 10),
    p AS (SELECT v.*, (SELECT count(*) FROM near n WHERE n.src_id = v.src_id) AS k, EXISTS (SELECT 1 FROM near n WHERE n.src_id = v.src_id AND n.dst_id = v.dst_id) AS hit FROM {VISITED} v)
    SELECT count(*) AS pairs, sum(least(2, k - hit::INT))::BIGINT AS near, true AS some_category, true AS some_related, 0::BIGINT AS repeated, 0::BIGINT AS destinations, 0::BIGINT AS sources,
        0::BIGINT AS far, 0::BIGINT AS unrelated, 0::BIGINT AS other_category, 0::BIGINT AS late FROM p""")
def negative_counts(spark, d):
    """What holds of hybrid_negatives, however they are drawn: numbers, and how many break a rule."""
    rows, p = sampled_pairs(spark, d)
    found = sampling.hybrid_negatives(rows, p).withColumnRenamed("dst_id", "neg_id")
    found = found.join(rows.select("pair_id", "dst_id", "src_ts"), "pair_id")
    for end in ("src", "neg"):
        found = found.join(p.select(*[F.col(c).alias(f"{end}_{c}") for c in p.columns]), f"{end}_id")
    dist = geo.haversine_km(F.col("src_lat"), F.col("src_lon"), F.col("neg_lat"), F.col("neg_lon"))
    near, related, same = (F.col("strategy") == x for x in ("near", "related", "category"))
    counts = found.agg(
        F.count_if(near).alias("near"), (F.count_if(same) > 0).alias("some_category"), (F.count_if(related) > 0).alias("some_related"),
        (F.count("*") - F.count_distinct("pair_id", "neg_id")).alias("repeated"), F.count_if(F.col("neg_id") == F.col("dst_id")).alias("destinations"),
        F.count_if(~related & (F.col("neg_id") == F.col("src_id"))).alias("sources"), F.count_if(near & (dist > 10)).alias("far"),
        F.count_if(related & ~F.array_contains(F.col("src_relative_results"), F.col("neg_id"))).alias("unrelated"),
        F.count_if(same & (F.col("src_category") != F.col("neg_category"))).alias("other_category"),
        F.count_if(~F.col("delta_hours").between(0.2, 168) | (t.hours_between(F.col("src_ts"), F.col("dst_ts")) > 168.01)).alias("late"),
    )
    return rows.agg(F.count("*").alias("pairs")).crossJoin(counts)


def sampled_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Consecutive events as pairs of the dense places, and these with a category and related places."""
    p = dense_places(spark, d)
    n = p.count()
    related = F.array(*[((F.col("id") * m + 7) % n).alias("x") for m in (3, 5, 11)])
    p = p.withColumns({"category": (F.col("id") % 5).cast("string"), "relative_results": related})
    rows = pairs(spark, d).select(F.col("src_event_id").alias("pair_id"), (F.col("src_event_id") % n).alias("src_id"), (F.col("dst_event_id") % n).alias("dst_id"), "src_ts")
    return rows.where("src_id <> dst_id"), p


@query()
def distance_matched(spark, d):
    rows, p = sampled_pairs(spark, d)
    return sampling.distance_matched(rows, p).withColumn("distance_km", F.round("distance_km", 4))


@query(f"""WITH near AS (SELECT a.id AS src, b.id AS item, row_number() OVER (PARTITION BY a.id ORDER BY pow(b.lat - a.lat, 2) + pow(b.lon - a.lon, 2), b.id) AS r, 0 AS p FROM {PLACES} a JOIN {PLACES} b
        ON a.id <> b.id AND pow(b.lat - a.lat, 2) + pow(b.lon - a.lon, 2) < 0.04),
    related AS (SELECT id AS src, i AS item, min(r) AS r, 1 AS p FROM (SELECT id, unnest([id * 3 % 40, id + 1, id * 5 % 40, id * 7 % 40]) AS i, unnest(range(1, 5)) AS r FROM {PLACES}) WHERE i <> id GROUP BY ALL),
    popular AS (SELECT a.id AS src, b.id AS item, row_number() OVER (PARTITION BY a.id ORDER BY -b.balance, b.id) AS r, 2 AS p FROM {PLACES} a JOIN (SELECT * FROM {PLACES} ORDER BY balance DESC, id LIMIT 11) b ON a.id <> b.id),
    u AS (SELECT src, item, min(p * 1000 + r) AS o FROM (SELECT * FROM near WHERE r <= 5 UNION ALL SELECT * FROM related QUALIFY row_number() OVER (PARTITION BY src ORDER BY r) <= 3 UNION ALL SELECT * FROM popular WHERE r <= 10) GROUP BY ALL)
    SELECT src, item, (o // 1000)::INT AS priority, row_number() OVER (PARTITION BY src ORDER BY o, item)::INT AS place FROM u QUALIFY place <= 10""")
def candidate_union(spark, d):
    """Near places, then the source's related list in its order, then popular ones."""
    p = places(spark, d)
    near = geo_join.nearest(p, p, "id", 5).select(F.col("src_id").alias("src"), F.col("dst_id").alias("item"), F.col("sq_deg").alias("o"))
    own = F.array(F.col("id") * 3 % 40, F.col("id") + 1, F.col("id") * 5 % 40, F.col("id") * 7 % 40)
    related = p.select(F.col("id").alias("src"), F.posexplode(own).alias("o", "item")).where("src <> item").groupBy("src", "item").agg(F.min("o").cast("double").alias("o"))
    top = p.orderBy(F.desc("balance"), "id").limit(11).select(F.col("id").alias("item"), (-F.col("balance")).alias("o"))
    popular = p.select(F.col("id").alias("src")).crossJoin(F.broadcast(top)).where("src <> item").select("src", "item", "o")
    return sampling.candidate_union([near, related, popular], "src", "item", "o", [5, 3, 10], 10)


@query(f"SELECT a.id AS src_id, b.id AS dst_id, b.balance AS dst_balance, TIMESTAMP '2024-01-01 02:00:00' AS dst_ts FROM {PLACES} a JOIN {PLACES} b ON b.id = a.id + 1")
def synthetic_pairs(spark, d):
    p = places(spark, d).select("id", "balance")
    given = p.select(F.col("id").alias("src_id"), (F.col("id") + 1).alias("dst_id"))
    out = sampling.synthetic_pairs(given, p, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return out.select("src_id", "dst_id", "dst_balance", "dst_ts")
