"""Queries on visits: sequences, pairs, profiles, time, splits, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.functions import time as t
from tripline.operators import profiles, relational, sequences, splits, vocab
from tripline.sources.readers import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that it equals."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def item_visits(spark: SparkSession, d: str) -> DataFrame:
    """Line items with their order's customer and date."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


ITEM_VISITS = "(SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
PAIRS = """(SELECT *, date_sub('second', src_ts, dst_ts) / 3600.0 AS delta_hours FROM (
    SELECT user_id, event_id AS src_event_id, lead(event_id) OVER w AS dst_event_id, ts AS src_ts, lead(ts) OVER w AS dst_ts,
        event_type AS src_event_type, lead(event_type) OVER w AS dst_event_type, value AS src_value, lead(value) OVER w AS dst_value
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""


def pairs(spark: SparkSession, d: str, above: float = 0.0) -> DataFrame:
    return sequences.consecutive_pairs(events(spark, d), "user_id", "ts", ["event_id"], ["event_id", "event_type", "value"], above)


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS seq_idx FROM events")
def seq_index(spark, d):
    return sequences.sequence(events(spark, d), "user_id", "ts", ["event_id"]).select("user_id", "event_id", "seq_idx")


@query(f"SELECT user_id, src_event_id, dst_event_id, round(delta_hours, 6) AS delta_hours FROM {PAIRS} WHERE delta_hours > 0 AND delta_hours <= 168")
def consecutive_pairs(spark, d):
    return pairs(spark, d).select("user_id", "src_event_id", "dst_event_id", F.round("delta_hours", 6).alias("delta_hours"))


@query(f"SELECT user_id, src_event_id, dst_event_id FROM {PAIRS} WHERE delta_hours > 0.2 AND delta_hours <= 168")
def quality_pairs(spark, d):
    return pairs(spark, d, 0.2).select("user_id", "src_event_id", "dst_event_id")


@query(f"""SELECT src_event_type, dst_event_type, count(*) AS n FROM {PAIRS} WHERE delta_hours > 0 AND delta_hours <= 168
    GROUP BY ALL ORDER BY n DESC, src_event_type, dst_event_type LIMIT 10""")
def pair_transitions_topn(spark, d):
    return relational.top_groups(pairs(spark, d), ["src_event_type", "dst_event_type"], 10)


@query(f"""SELECT src_event_type, dst_event_type, n, round(n / sum(n) OVER (PARTITION BY src_event_type), 6) AS probability FROM (
    SELECT src_event_type, dst_event_type, count(*) AS n FROM {PAIRS} WHERE delta_hours > 0 AND delta_hours <= 168 GROUP BY ALL)""")
def markov_transitions(spark, d):
    found = sequences.transitions(pairs(spark, d), "src_event_type", "dst_event_type")
    return found.withColumn("probability", F.round("probability", 6))


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 12")
def min_visit_filter(spark, d):
    return sequences.frequent_users(table(spark, d, "orders"), "o_custkey", 12).select("o_orderkey", "o_custkey")


@query(f"""SELECT count(*) FILTER (x < 1) AS bin_0, count(*) FILTER (x >= 1 AND x < 6) AS bin_1, count(*) FILTER (x >= 6 AND x < 24) AS bin_2,
    count(*) FILTER (x >= 24 AND x < 72) AS bin_3, count(*) FILTER (x >= 72) AS bin_4
    FROM (SELECT delta_hours AS x FROM {PAIRS} WHERE delta_hours > 0 AND delta_hours <= 168)""")
def delta_histogram(spark, d):
    return relational.histogram(pairs(spark, d), F.col("delta_hours"), [1, 6, 24, 72])


@query("""SELECT user_id, round(avg(value) + 1e-9, 6) AS avg_rating, round(stddev_samp(value) + 1e-9, 6) AS rating_std, count(value) AS total_reviews,
    count(DISTINCT event_type) AS unique_items, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(length(event_type)) + 1e-9, 6) AS avg_length
    FROM events GROUP BY user_id""")
def user_basic_stats(spark, d):
    found = events(spark, d).groupBy("user_id").agg(*profiles.rating_stats("user_id", "value", "event_type", "ts", "event_type"))
    return found.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("avg_rating", "rating_std", "avg_length")})


@query("""SELECT user_id, days, round(CASE WHEN days > 0 THEN n * 30.0 / days ELSE n END, 6) AS visit_frequency FROM (
    SELECT user_id, count(value) AS n, date_sub('second', min(ts), max(ts)) // 86400 AS days FROM events GROUP BY user_id)""")
def visit_frequency(spark, d):
    stats = events(spark, d).groupBy("user_id").agg(*profiles.rating_stats("user_id", "value", "event_type", "ts"))
    return profiles.visit_frequency(stats).select("user_id", "days", F.round("visit_frequency", 6).alias("visit_frequency"))


@query("""SELECT user_id, round(avg((r = 5)::INT), 6) AS pct_5_star, round(avg((r = 1)::INT), 6) AS pct_1_star, round(avg((r >= 4)::INT), 6) AS pct_positive,
    round(avg((r <= 2)::INT), 6) AS pct_negative, coalesce(stddev_samp(r) < 1, false) AS is_consistent
    FROM (SELECT user_id, 1 + floor(value)::BIGINT % 5 AS r FROM events) GROUP BY user_id""")
def rating_shares(spark, d):
    rows = events(spark, d).select("user_id", (1 + F.floor("value") % 5).alias("r"))
    found = rows.groupBy("user_id").agg(*profiles.rating_shares("r"))
    return found.withColumns({c: F.round(c, 6) for c in found.columns if c.startswith("pct_")})


@query("""SELECT user_id, event_type AS mode_category, n_types FROM (
    SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r,
        count(*) OVER (PARTITION BY user_id) AS n_types FROM events GROUP BY user_id, event_type) WHERE r = 1""")
def user_mode_category(spark, d):
    rows = events(spark, d).groupBy("user_id").agg(F.mode("event_type", True).alias("mode_category"), profiles.distinct_with_null("event_type").alias("n_types"))
    return rows.withColumn("n_types", F.col("n_types").cast("long"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY r) AS top_values, string_agg(n::VARCHAR, ',' ORDER BY r) AS top_counts FROM (
    SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r
    FROM events GROUP BY user_id, event_type) WHERE r <= 3 GROUP BY user_id""")
def user_top_categories(spark, d):
    found = profiles.top_values(events(spark, d), "user_id", "event_type", 3)
    return found.select("user_id", F.array_join("top_values", ",").alias("top_values"), F.array_join(F.col("top_counts").cast("array<string>"), ",").alias("top_counts"))


@query(f"""SELECT o_custkey, round(avg((n > 1)::INT), 6) AS loyalty_score FROM (
    SELECT o_custkey, l_suppkey, count(*) AS n FROM {ITEM_VISITS} GROUP BY ALL) GROUP BY o_custkey""")
def loyalty_share(spark, d):
    found = profiles.loyalty(item_visits(spark, d), "o_custkey", "l_suppkey")
    return found.withColumn("loyalty_score", F.round("loyalty_score", 6))


@query("""WITH u AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS k, count(DISTINCT floor(value)) AS v FROM events GROUP BY user_id),
    m AS (SELECT median(n) AS mn, median(k) AS mk, median(v) AS mv FROM u)
    SELECT user_id, n > mn AS is_frequent, k > mk AS is_diverse, v > mv AS is_explorer,
        CASE WHEN n < 0.5 * mn THEN 'low' WHEN n > 2 * mn THEN 'high' ELSE 'medium' END AS frequency_bucket FROM u, m""")
def median_flags(spark, d):
    users = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("k"), F.count_distinct(F.floor("value")).alias("v"))
    flags = {"is_frequent": "n", "is_diverse": "k", "is_explorer": "v"}
    return profiles.median_flags(users, flags, "n").select("user_id", *flags, "frequency_bucket")


@query(f"""SELECT l_partkey, l_orderkey, l_linenumber FROM {ITEM_VISITS}
    QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey, l_linenumber) <= 5""")
def latest_n_per_key(spark, d):
    order = [F.desc("o_orderdate"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return sequences.latest_per_key(item_visits(spark, d), "l_partkey", order, 5).select("l_partkey", "l_orderkey", "l_linenumber")


@query("""SELECT event_id, hour(ts)::INT AS hour, isodow(ts)::INT AS weekday, isodow(ts) >= 6 AS is_weekend, isodow(ts) >= 5 AS is_weekend_legacy,
    dayname(ts + INTERVAL 0 DAY).lower() AS day_name FROM events""")
def time_parts(spark, d):
    ts = F.col("ts")
    return events(spark, d).select(
        "event_id", F.hour(ts).alias("hour"), t.iso_weekday(ts).alias("weekday"), t.is_weekend(ts).alias("is_weekend"),
        t.is_weekend(ts, legacy=True).alias("is_weekend_legacy"), t.weekday_name(ts).alias("day_name"),
    )


@query("""SELECT event_id, h >= 6 AND h < 10 AS breakfast, h >= 11 AND h < 14 AS lunch, h >= 17 AND h < 21 AS dinner,
    CASE WHEN h >= 6 AND h < 10 THEN 'breakfast' WHEN h >= 11 AND h < 14 THEN 'lunch' WHEN h >= 17 AND h < 21 THEN 'dinner' ELSE 'other' END AS meal_type
    FROM (SELECT event_id, hour(ts) AS h FROM events)""")
def meal_flags(spark, d):
    flags = [c.alias(name) for name, c in t.meal_flags(F.col("ts")).items()]
    return events(spark, d).select("event_id", *flags, t.meal_type(F.col("ts")).alias("meal_type"))


@query(f"""SELECT src_event_id, CASE WHEN delta_hours < 3 THEN '0-3h' WHEN delta_hours < 6 THEN '3-6h' WHEN delta_hours < 12 THEN '6-12h'
    WHEN delta_hours < 24 THEN '12-24h' WHEN delta_hours < 72 THEN '1-3d' ELSE '3-7d' END AS bucket
    FROM {PAIRS} WHERE delta_hours > 0 AND delta_hours <= 168""")
def delta_bucket(spark, d):
    return pairs(spark, d).select("src_event_id", t.delta_bucket(F.col("delta_hours")).alias("bucket"))


@query("SELECT o_orderkey, date_sub('second', TIMESTAMP '1992-01-01 12:00:00', o_orderdate) // 86400 AS days FROM orders WHERE o_orderdate >= TIMESTAMP '1992-01-02'")
def elapsed_days(spark, d):
    start = F.lit("1992-01-01 12:00:00").cast("timestamp_ntz")
    rows = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1992-01-02").cast("timestamp_ntz"))
    return rows.select("o_orderkey", t.days_between(start, F.col("o_orderdate")).alias("days"))


@query("SELECT event_id, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS back FROM events WHERE ts BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2030-01-01'")
def epoch_ms(spark, d):
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    rows = events(spark, d).select("event_id", (F.timestamp_diff("MICROSECOND", zero, F.col("ts")) / 1000).cast("bigint").alias("ms"))
    rows = rows.select("event_id", t.from_epoch_ms(F.col("ms")).alias("back"))
    return rows.where(F.col("back").between(F.lit("2000-01-01").cast("timestamp_ntz"), F.lit("2030-01-01").cast("timestamp_ntz")))


@query("""SELECT event_id, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM (
    SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)""")
def split_rows_temporal(spark, d):
    return splits.rows_by_time(events(spark, d), ["ts", "event_id"]).select("event_id", "split")


@query("""SELECT e.event_id, split FROM events e JOIN (
    SELECT user_id, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM (
        SELECT user_id, row_number() OVER (ORDER BY max(ts), user_id) - 1 AS i, count(*) OVER () AS n FROM events GROUP BY user_id)) USING (user_id)""")
def split_users_temporal(spark, d):
    return splits.users_by_time(events(spark, d), "user_id", "ts").select("event_id", "split")


@query("""SELECT o_orderkey, split FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'test' WHEN i < floor(n * 0.7 / 0.85 + 1e-6) THEN 'train'
        ELSE 'val' END AS split FROM (
    SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey) - 1 AS i,
        count(*) OVER (PARTITION BY o_orderstatus = 'F') AS n FROM orders))""")
def split_rows_geo(spark, d):
    rows = table(spark, d, "orders")
    return splits.rows_by_place(rows, F.col("o_orderstatus") == "F", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "split")


@query("""WITH u AS (SELECT o_custkey, max((o_totalprice > 350000)::INT) AS inside, max(o_orderdate) AS last FROM orders GROUP BY o_custkey),
    s AS (SELECT o_custkey, CASE WHEN inside = 1 THEN 'test' WHEN i < floor(n * 0.85) THEN 'train' ELSE 'val' END AS split FROM (
        SELECT *, row_number() OVER (PARTITION BY inside ORDER BY last, o_custkey) - 1 AS i, count(*) OVER (PARTITION BY inside) AS n FROM u))
    SELECT o_orderkey, split FROM orders JOIN s USING (o_custkey)""")
def split_users_geo(spark, d):
    rows = table(spark, d, "orders")
    return splits.users_by_place(rows, "o_custkey", "o_orderdate", F.col("o_totalprice") > 350000).select("o_orderkey", "split")


@query("""SELECT split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (value > 50) AS positives FROM (
    SELECT ts, value, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM (
        SELECT ts, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)) GROUP BY split""")
def split_report(spark, d):
    return splits.report(splits.rows_by_time(events(spark, d), ["ts", "event_id"]), "ts", F.col("value") > 50)


@query("SELECT o_custkey, max(o_orderdate) AS last_ts FROM orders GROUP BY o_custkey")
def last_visit(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_ts"))


@query("""SELECT l_suppkey AS token, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, l_suppkey) + 1)::BIGINT AS idx
    FROM lineitem GROUP BY l_suppkey QUALIFY idx <= 51""")
def vocab_topk(spark, d):
    return vocab.frequent(table(spark, d, "lineitem"), "l_suppkey", 50)


@query("SELECT event_type AS token, (row_number() OVER (ORDER BY event_type) + 1)::BIGINT AS idx FROM (SELECT DISTINCT event_type FROM events)")
def vocab_sorted(spark, d):
    return vocab.sorted_values(events(spark, d), "event_type")


VOCAB = "(SELECT l_suppkey AS token, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) + 1 AS idx FROM lineitem GROUP BY l_suppkey QUALIFY idx <= 51)"


@query(f"SELECT l_orderkey, l_linenumber, coalesce(idx, 1)::BIGINT AS idx FROM lineitem LEFT JOIN {VOCAB} v ON token = l_suppkey")
def vocab_encode(spark, d):
    rows = table(spark, d, "lineitem")
    return vocab.encode(rows, "l_suppkey", vocab.frequent(rows, "l_suppkey", 50)).select("l_orderkey", "l_linenumber", "idx")


@query(f"SELECT l_orderkey, l_linenumber, token FROM lineitem LEFT JOIN {VOCAB} v ON idx = l_linenumber")
def vocab_decode(spark, d):
    rows = table(spark, d, "lineitem")
    found = vocab.decode(rows.withColumn("idx", F.col("l_linenumber").cast("long")), "idx", vocab.frequent(rows, "l_suppkey", 50))
    return found.select("l_orderkey", "l_linenumber", "token")


@query(f"SELECT count(idx) AS covered, count(*) AS total, round(100.0 * count(idx) / count(*), 6) AS coverage_pct FROM lineitem LEFT JOIN {VOCAB} v ON token = l_suppkey")
def vocab_coverage(spark, d):
    rows = table(spark, d, "lineitem")
    found = vocab.coverage(rows, "l_suppkey", vocab.frequent(rows, "l_suppkey", 50))
    return found.withColumn("coverage_pct", F.round("coverage_pct", 6))


@query("""WITH v AS (SELECT event_type AS token, row_number() OVER (ORDER BY event_type) + 1 AS idx FROM (SELECT DISTINCT event_type FROM events)),
    c AS (SELECT idx, count(*) AS n FROM events JOIN v ON token = event_type GROUP BY idx)
    SELECT idx::BIGINT AS idx, round((SELECT sum(n) FROM c) / ((SELECT count(*) + 2 FROM v) * n), 6) AS weight FROM c
    UNION ALL SELECT 0, 0.0 UNION ALL SELECT 1, 1.0""")
def class_weights(spark, d):
    rows = events(spark, d)
    words = vocab.sorted_values(rows, "event_type")
    found = vocab.class_weights(vocab.encode(rows, "event_type", words), "idx", words)
    return found.withColumn("weight", F.round("weight", 6))


@query("""WITH v AS (SELECT event_type AS token, row_number() OVER (ORDER BY event_type) + 1 AS idx FROM (SELECT DISTINCT event_type FROM events)),
    s AS (SELECT user_id, ts, event_id, idx FROM events JOIN v ON token = event_type)
    SELECT user_id, event_id, repeat('0,', 20 - len(p)) || array_to_string(p, ',') AS input_seq, idx::BIGINT AS target, len(p)::INT AS seq_len FROM (
        SELECT *, list(idx) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS p FROM s) WHERE len(p) > 0""")
def array_windows(spark, d):
    rows = vocab.encode(events(spark, d), "event_type", vocab.sorted_values(events(spark, d), "event_type"))
    found = sequences.trailing_windows(rows, "user_id", ["ts", "event_id"], "idx", keep=("event_id",))
    return found.withColumn("input_seq", F.array_join(F.col("input_seq").cast("array<string>"), ","))
