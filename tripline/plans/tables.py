"""Queries on tables: joins, sets, reshaping, ranking, metrics, exports, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.functions import lists
from tripline.operators import export, profiles, ranking, relational, vocab
from tripline.plans.visits import events, query
from tripline.sources import readers, writers
from tripline.sources.readers import table
from tripline.sources.storage import scratch


def nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def inner_dim_join(spark, d):
    return table(spark, d, "customer").join(nations(spark, d), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("""SELECT c_custkey, s_suppkey, a.n_name AS src_n_name, b.n_name AS dst_n_name FROM customer JOIN supplier ON s_suppkey = c_custkey
    LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) a ON a.n_nationkey = c_nationkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) b ON b.n_nationkey = s_nationkey""")
def left_two_sided_join(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("c_custkey"))
    dim = nations(spark, d).where("n_regionkey < 3")
    return relational.two_sided(rows, dim, "n_nationkey", "c_nationkey", "s_nationkey", ["n_name"]).select("c_custkey", "s_suppkey", "src_n_name", "dst_n_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_ids(spark, d):
    ids = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return relational.only_ids(table(spark, d, "orders"), ids, "o_custkey", "c_custkey").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def anti_join_ids(spark, d):
    ids = table(spark, d, "orders").where("o_totalprice > 100000")
    return relational.without_ids(table(spark, d, "customer"), ids, "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT DISTINCT n_regionkey FROM nation")
def dedup_subset(spark, d):
    return relational.dedup(nations(spark, d), ["n_regionkey"], [F.col("n_nationkey")]).select("n_regionkey")


@query("SELECT n_regionkey, min(n_nationkey)::INT AS n_nationkey, min_by(n_name, n_nationkey) AS n_name FROM nation GROUP BY n_regionkey")
def dedup_first_row(spark, d):
    return relational.dedup(nations(spark, d).select("n_regionkey", "n_nationkey", "n_name"), ["n_regionkey"], [F.col("n_nationkey")])


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(spark, d):
    return export.venues(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query("SELECT c_custkey::BIGINT AS id, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_aligned(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("extra"))
    return relational.aligned_union(a, b)


@query("SELECT c_nationkey AS id FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 10")
def id_difference(spark, d):
    ids = table(spark, d, "customer").select(F.col("c_nationkey").alias("id")).distinct()
    return relational.without_ids(ids, table(spark, d, "supplier").where("s_nationkey < 10"), "id", "s_nationkey")


@query("SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier")
def two_column_ids(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("c_custkey"), "full")
    return relational.ids_of_both(rows, "c_nationkey", "s_nationkey").where("id is not null")


@query("""SELECT event_id, replace(array_to_string(list_transform((SELECT list_sort(list(DISTINCT event_type)) FROM events WHERE value < 100 AND event_type <> 'view'), lambda t: (t = event_type)::INT::VARCHAR), ''), ' ', '') AS flags FROM events""")
def one_hot(spark, d):
    train = events(spark, d).where("value < 100 and event_type <> 'view'")
    seen = relational.seen_values(train, "event_type")
    rows = relational.one_hot(events(spark, d), "event_type", seen)
    return rows.select("event_id", F.concat(*[F.col(f"event_type_{v}").cast("string") for v in seen]).alias("flags"))


@query("SELECT o_orderkey AS id, floor(o_totalprice)::INT AS price, o_orderstatus AS status, 1 AS label FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 200000 AND o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('P')")
def project_rename_cast(spark, d):
    rows = table(spark, d, "orders").where((F.col("o_totalprice") > 1000) & (F.col("o_totalprice") <= 200000))
    rows = rows.where(F.col("o_orderstatus").isNotNull() & ~F.col("o_orderstatus").isin("P"))
    out = rows.withColumnsRenamed({"o_orderkey": "id", "o_orderstatus": "status"}).withColumns({"price": F.floor("o_totalprice").cast("int"), "label": F.lit(1)})
    return relational.known_first(out.drop("o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"), ["id", "price", "status"])


@query("SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic, quality IS NOT NULL AS has_label FROM documents LEFT JOIN labels USING (doc_id)")
def fill_constants(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.withColumn("has_label", F.col("quality").isNotNull()).fillna({"quality": -1, "toxic": 0})


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders")
def row_index(spark, d):
    return relational.row_index(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_index")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders) WHERE i >= 100 AND i < 250")
def row_slice(spark, d):
    rows = relational.row_index(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    return rows.where("row_index >= 100 and row_index < 250").select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sorted_topk(spark, d):
    return table(spark, d, "orders").orderBy(*relational.key_order(["o_totalprice", "o_orderkey"], ("o_totalprice",))).limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderpriority, o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 40")
def mixed_sort_topk(spark, d):
    order = relational.key_order(["o_orderpriority", "o_totalprice", "o_orderkey"], ("o_totalprice",))
    return table(spark, d, "orders").orderBy(*order).limit(40).select("o_orderpriority", "o_orderkey")


@query("SELECT l_suppkey, n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)")
def percent_of_total(spark, d):
    return relational.percent_of_total(table(spark, d, "lineitem"), "l_suppkey").withColumn("pct", F.round("pct", 6))


@query("""SELECT count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, round(median(value), 6) AS med, min(value) AS lo, max(value) AS hi,
    count(*) FILTER (value > 50) AS above FROM events""")
def scalar_summary(spark, d):
    return events(spark, d).agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("med"),
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(F.col("value") > 50).alias("above"),
    )


@query("SELECT user_id, event_type, list_contains(l, event_type) AS in_list FROM events JOIN (SELECT user_id % 7 AS k, list_sort(list_distinct(list(event_type))) AS l FROM events WHERE value > 150 GROUP BY k) ON k = user_id % 7")
def array_member_join(spark, d):
    rows = events(spark, d).withColumn("k", F.col("user_id") % 7)
    side = rows.where("value > 150").groupBy("k").agg(F.sort_array(F.collect_set("event_type")).alias("l"))
    return rows.join(side, "k").select("user_id", "event_type", lists.member(F.col("l"), F.col("event_type")).alias("in_list"))


@query("""SELECT event_id, round(avg_value + 1e-9, 6) AS avg_value, round(value - avg_value + 1e-9, 6) AS diff FROM events JOIN (SELECT user_id, avg(value) AS avg_value FROM events GROUP BY user_id) USING (user_id)""")
def profile_join(spark, d):
    profile = events(spark, d).groupBy("user_id").agg(F.avg("value").alias("avg_value"))
    rows = events(spark, d).join(profile, "user_id", "left")
    return rows.select("event_id", F.round(F.col("avg_value") + 1e-9, 6).alias("avg_value"), F.round(F.col("value") - F.col("avg_value") + 1e-9, 6).alias("diff"))


@query("SELECT * FROM nation WHERE n_nationkey = 7")
def lookup_one(spark, d):
    return relational.lookup_one(nations(spark, d), "n_nationkey", 7)


@query("SELECT c_custkey, coalesce(n_name, 'none') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON n_nationkey = c_nationkey")
def lookup_default(spark, d):
    names = nations(spark, d).where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return relational.lookup(table(spark, d, "customer"), names, "c_nationkey", "n_name", "none").select("c_custkey", "n_name")


@query("SELECT doc_id, quality IS NOT NULL AS source_has_metadata, toxic IS NOT NULL AS dest_has_metadata, doc_id % 3 = 0 AS is_self_prediction FROM documents LEFT JOIN labels USING (doc_id)")
def provenance_flags(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", F.lit(0).alias("source_id"), (F.col("doc_id") % 3).alias("dest_id"), F.col("quality").alias("source_name"), F.col("toxic").alias("dest_name"))
    return rows.withColumns(export.provenance()).select("doc_id", "source_has_metadata", "dest_has_metadata", "is_self_prediction")


@query("""WITH u AS (SELECT user_id, avg(value) AS v, count(*) AS n, max(value) > 250 AS f, avg(value) FILTER (event_type = 'error' AND value > 60) AS s FROM events GROUP BY user_id)
    SELECT a.user_id, round((1 - abs(a.v - b.v) / (abs(a.v) + abs(b.v) + 1e-6) + 1 - abs(a.n - b.n) / (a.n + b.n + 1e-6) + (a.f = b.f)::INT
        + coalesce(1 - abs(a.s - b.s) / (abs(a.s) + abs(b.s) + 1e-6), 0)) / (3 + (a.s IS NOT NULL AND b.s IS NOT NULL)::INT), 6) AS similarity
    FROM u a JOIN u b ON b.user_id = a.user_id + 1""")
def user_similarity(spark, d):
    users = events(spark, d).groupBy("user_id").agg(F.avg("value").alias("v"), F.count("*").alias("n"), (F.max("value") > 250).alias("f"),
        F.avg(F.when((F.col("event_type") == "error") & (F.col("value") > 60), F.col("value"))).alias("s"))
    other = users.select((F.col("user_id") - 1).alias("user_id"), *[F.col(c).alias(f"o_{c}") for c in "vnfs"])
    both = users.join(other, "user_id")
    value = profiles.user_similarity({c: F.col(c) for c in "vnfs"}, {c: F.col(f"o_{c}") for c in "vnfs"}, ["v", "n", "s"], ["f"])
    return both.select("user_id", F.round(value, 6).alias("similarity"))


# Line items as a ranking frame: the order is the query, the price the score, a returned item the positive.
RANKED = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank, (l_returnflag = 'R')::INT AS label FROM lineitem)"


def ranking_frame(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return ranking.ranked(rows, ["l_orderkey"], "l_extendedprice", ["l_linenumber"])


@query(f"SELECT l_orderkey, l_linenumber, rank::INT AS rank FROM {RANKED} WHERE rank <= 3")
def rank_topk(spark, d):
    return ranking_frame(spark, d).where("rank <= 3").select("l_orderkey", "l_linenumber", "rank")


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity / sum(l_quantity) OVER w, 6) AS score_share, round(CASE WHEN stddev_samp(l_quantity) OVER w > 0 THEN (l_quantity - avg(l_quantity) OVER w) / stddev_samp(l_quantity) OVER w END, 6) AS score_z
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def share_z(spark, d):
    rows = table(spark, d, "lineitem").withColumns(ranking.shares("l_orderkey", "l_quantity"))
    return rows.select("l_orderkey", "l_linenumber", F.round("score_share", 6).alias("score_share"), F.round("score_z", 6).alias("score_z"))


@query("SELECT s_suppkey, dense_rank() OVER (ORDER BY s_nationkey)::BIGINT - 1 AS idx FROM supplier")
def dense_index(spark, d):
    rows = table(spark, d, "supplier")
    return rows.join(relational.row_index(rows.select("s_nationkey").distinct(), ["s_nationkey"], "idx"), "s_nationkey").select("s_suppkey", "idx")


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN sum(abs(s)) OVER w > 0 THEN abs(s) / sum(abs(s)) OVER w END, 6) AS abs_share, round(rank / count(*) OVER w, 6) AS rank_share FROM (
    SELECT l_orderkey, l_linenumber, l_quantity - 20 AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS rank FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey)""")
def abs_share(spark, d):
    rows = ranking.ranked(table(spark, d, "lineitem").withColumn("score", F.col("l_quantity") - 20), ["l_orderkey"], "l_quantity", ["l_linenumber"])
    out = rows.withColumns(export.absolute_shares("l_orderkey"))
    return out.select("l_orderkey", "l_linenumber", F.round("abs_share", 6).alias("abs_share"), F.round("rank_share", 6).alias("rank_share"))


@query(f"""WITH q AS (SELECT l_orderkey, min(rank) FILTER (label = 1) AS f, sum(CASE WHEN label = 1 THEN 1.0 / rank END) AS rr, count(*) FILTER (label = 1) AS h FROM {RANKED} GROUP BY l_orderkey)
    SELECT count(*) AS n_queries, round(count(*) FILTER (f <= 1) / count(*), 6) AS recall_at_1, round(count(*) FILTER (f <= 5) / count(*), 6) AS recall_at_5, round(count(*) FILTER (f <= 10) / count(*), 6) AS recall_at_10,
        round(sum(rr) / sum(h), 6) AS mrr, round(sum(coalesce(1.0 / f, 0)) / count(*), 6) AS mrr_all FROM q""")
def recall_mrr(spark, d):
    found = ranking.recall_mrr(ranking_frame(spark, d), "l_orderkey", "label")
    return found.select("n_queries", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY label DESC, rank) AS ideal FROM {RANKED} WHERE rank <= 5),
    q AS (SELECT sum(label / log2(rank + 1)) AS dcg, sum(label / log2(ideal + 1)) AS idcg FROM r GROUP BY l_orderkey)
    SELECT round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS ndcg_at_5, count(*) AS n_queries FROM q""")
def ndcg(spark, d):
    return ranking.ndcg(ranking_frame(spark, d), "l_orderkey", "label", 5).withColumn("ndcg_at_5", F.round("ndcg_at_5", 6))


PREDICTED = "(SELECT vec_id, label, list_transform(list_slice(list_sort(list_zip(list_transform(embedding, lambda x: -x), range(64))), 1, 10), lambda p: p[2] % 10) AS p FROM embeddings)"


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as predictions: the places of the ten largest components, modulo ten, as classes."""
    order = F.slice(F.sort_array(F.transform("embedding", lambda x, i: F.struct((-x).alias("s"), i.alias("i")))), 1, 10)
    rows = table(spark, d, "embeddings").select("vec_id", "label", order.alias("_o"))
    return rows.select("vec_id", "label", F.transform("_o", lambda p: p["i"] % 10).alias("p"))


@query(f"SELECT round(avg((label = p[1])::INT), 6) AS accuracy_at_1, round(avg(list_contains(p[1:5], label)::INT), 6) AS accuracy_at_5, round(avg(list_contains(p, label)::INT), 6) AS accuracy_at_10 FROM {PREDICTED}")
def topk_accuracy(spark, d):
    found = ranking.top_k_accuracy(predicted(spark, d), "p", "label")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query(f"""WITH r AS (SELECT label AS t, p[1] AS g FROM {PREDICTED} WHERE label NOT IN (0, 1)), c AS (SELECT t AS class FROM r UNION SELECT g FROM r)
    SELECT class::INT AS class, s AS support, round(CASE WHEN g > 0 THEN tp / g ELSE 0 END, 6) AS precision, round(CASE WHEN s > 0 THEN tp / s ELSE 0 END, 6) AS recall, round(2 * tp / (g + s), 6) AS f1 FROM (
        SELECT class, (SELECT count(*) FROM r WHERE t = class) AS s, (SELECT count(*) FROM r WHERE g = class) AS g, (SELECT count(*) FROM r WHERE t = class AND g = class) AS tp FROM c)""")
def per_class_metrics(spark, d):
    found = ranking.per_class(predicted(spark, d).withColumn("g", F.col("p")[0]), "label", "g")
    return found.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""SELECT grp, count(*) AS n, round(sum(score), 4) AS total FROM (SELECT p_retailprice AS score, ['spatial','quality','temporal','price','spatial','user_behavior','topics','service_options',
    'category','review_sentiment','user_behavior','temporal','temporal','cuisine_complementarity','operating_hours','review_sentiment','spatial','relationship','price','quality','spatial','user_behavior'][p_partkey % 22 + 1] AS grp
    FROM part) GROUP BY grp""")
def importance_groups(spark, d):
    names = [
        "distance_km", "distance_x_dst_rating", "src_hour", "price_diff", "rating_ratio", "user_loyalty_score", "topic_similarity_count", "dst_has_takeout",
        "cuisine_pair_type", "dst_avg_review_length", "user_is_explorer", "is_meal_progression", "hours_overlap", "is_progression", "dst_is_24hr", "sentiment_match_score",
        "unknown_thing", "is_in_relative_results", "price_x_rating", "dst_is_highly_rated", "same_cat_x_distance", "user_pref_x_dst_rating",
    ]
    scores = table(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey") % 22).alias("feature"), F.col("p_retailprice").alias("score"))
    found = ranking.group_importance(ranking.named_importance(scores, names))
    return found.select("grp", "n", F.round("total", 4).alias("total"))


@query("""SELECT CASE WHEN p_partkey % 3 = 0 THEN 'f9' ELSE ['distance_km', 'price_diff'][p_partkey % 3] END AS feature, p_retailprice AS score FROM part ORDER BY score DESC, feature LIMIT 20""")
def top_features(spark, d):
    part = F.when(F.col("p_partkey") % 3 == 0, 9).otherwise(F.col("p_partkey") % 3 - 1)
    scores = table(spark, d, "part").select(F.concat(F.lit("f"), part).alias("feature"), F.col("p_retailprice").alias("score"))
    named = ranking.named_importance(scores, ["distance_km", "price_diff"])
    return ranking.top_features(named).select("feature", "score")


EXPLODED = "(SELECT vec_id, label, unnest(range(1, 65))::INT AS rank, unnest(range(64)) AS item, unnest(embedding)::DOUBLE AS score FROM embeddings)"


def exploded(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("items", F.sequence(F.lit(0), F.size("embedding") - 1))
    return export.exploded(rows, ["vec_id", "label"], "items", "embedding")


@query(f"SELECT vec_id, rank, item::INT AS item, round(score, 6) AS score FROM {EXPLODED}")
def explode_parallel(spark, d):
    return exploded(spark, d).select("vec_id", "rank", "item", F.round("score", 6).alias("score"))


POSITIVE = f"(SELECT vec_id, rank, item, score + 100 AS score FROM {EXPLODED})"
STATS = f"""(SELECT vec_id, rank, score, round(score / sum(score) OVER w, 9) AS share, round(sum(score / t) OVER (PARTITION BY vec_id ORDER BY rank), 9) AS cum_share,
    round((score - avg(score) OVER w) / stddev_pop(score) OVER w, 6) AS z FROM (SELECT *, sum(score) OVER (PARTITION BY vec_id) AS t FROM {POSITIVE}) WINDOW w AS (PARTITION BY vec_id))"""


@query(f"SELECT vec_id, rank, round(share + 1e-10, 6) AS share, round(cum_share + 1e-10, 6) AS cum_share, round(z + 1e-8, 4) AS z FROM {STATS} WHERE rank <= 10")
def export_stats(spark, d):
    rows = exploded(spark, d).withColumn("score", F.col("score") + 100)
    out = export.score_stats(rows, "vec_id", top_k=10)
    return out.select("vec_id", "rank", F.round(F.col("share") + 1e-10, 6).alias("share"), F.round(F.col("cum_share") + 1e-10, 6).alias("cum_share"), F.round(F.col("z") + 1e-8, 4).alias("z"))


@query(f"""SELECT vec_id, row_number() OVER o ::INT AS rank, round(round(score / sum(score) OVER w, 9) + 1e-10, 6) AS share, round(round(sum(share) OVER o, 9) + 1e-10, 6) AS cum_share,
    round(round((score - avg(score) OVER w) / stddev_pop(score) OVER w, 6) + 1e-8, 4) AS z FROM {STATS} WHERE rank <= 10 AND rank % 2 = 0 WINDOW w AS (PARTITION BY vec_id), o AS (PARTITION BY vec_id ORDER BY rank)""")
def export_restated(spark, d):
    rows = export.score_stats(exploded(spark, d).withColumn("score", F.col("score") + 100), "vec_id", top_k=10)
    out = export.restated(rows.where("rank % 2 = 0"), "vec_id")
    return out.select("vec_id", "rank", F.round(F.col("share") + 1e-10, 6).alias("share"), F.round(F.col("cum_share") + 1e-10, 6).alias("cum_share"), F.round(F.col("z") + 1e-8, 4).alias("z"))


@query(f"""SELECT l_orderkey, l_linenumber, round(exp(s - max(s) OVER w) / sum(exp(s - m)) OVER w, 6) AS share FROM (
    SELECT *, l_discount * 10 AS s, max(l_discount * 10) OVER (PARTITION BY l_orderkey) AS m FROM {RANKED} WHERE rank <= 5) WINDOW w AS (PARTITION BY l_orderkey)""")
def softmax_topk(spark, d):
    rows = ranking_frame(spark, d).where("rank <= 5").withColumn("score", F.col("l_discount") * 10)
    return rows.select("l_orderkey", "l_linenumber", F.round(export.softmax("l_orderkey"), 6).alias("share"))


@query("SELECT DISTINCT l_suppkey AS source_id, s_name AS source_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def venues(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return export.venues(rows.select(F.col("l_suppkey").alias("source_id"), F.col("s_name").alias("source_name")), ["source_id", "source_name"])


@query(f"""WITH t AS (SELECT l_suppkey AS source_id, l_partkey AS dest_id, rank, l_discount * 10 AS s, l_orderkey * 10 + l_linenumber AS prediction_id FROM {RANKED} WHERE l_suppkey = 5 ORDER BY rank, prediction_id LIMIT 10)
    SELECT prediction_id, dest_id, rank::INT AS rank, round(exp(s) / sum(exp(s)) OVER (), 6) AS share, round(sum(exp(s)) OVER (ORDER BY rank, prediction_id) / sum(exp(s)) OVER (), 6) AS cum_share FROM t""")
def venue_predictions(spark, d):
    rows = ranking_frame(spark, d).select(
        F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("dest_id"), "rank", (F.col("l_discount") * 10).alias("score"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("prediction_id"),
    )
    out = export.predictions(rows, "source_id", 5)
    return out.select("prediction_id", "dest_id", "rank", F.round("share", 6).alias("share"), F.round("cum_share", 6).alias("cum_share"))


@query("""WITH ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT l_suppkey AS id FROM lineitem UNION SELECT l_partkey FROM lineitem)),
    e AS (SELECT l_suppkey AS a, l_partkey AS b, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT x.idx AS "row", y.idx AS col, n AS value FROM e JOIN ids x ON x.id = a JOIN ids y ON y.id = b""")
def coo_matrix(spark, d):
    edges = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return export.coo_matrix(edges, "l_suppkey", "l_partkey", "n")[0]


@query(f"""SELECT l_orderkey, '[' || string_agg('{{"rank":' || rank || ',"l_partkey":' || l_partkey || '}}', ',' ORDER BY rank) || ']' AS items FROM {RANKED} WHERE rank <= 3 GROUP BY l_orderkey""")
def nested_topk_json(spark, d):
    return export.nested_top_k(ranking_frame(spark, d).where("rank <= 3"), "l_orderkey", ["l_partkey"])


@query(f"""SELECT l_suppkey AS src_id, l_partkey AS dst_id, round(s, 6) AS transition_probability, rank::INT AS rank FROM (SELECT l_suppkey, l_partkey, s,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY s DESC, l_partkey) AS rank FROM (SELECT l_suppkey, l_partkey, count(*)::DOUBLE AS s FROM lineitem GROUP BY ALL)) WHERE rank <= 10""")
def transition_matrix(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src_id"), F.col("l_partkey").alias("dst_id")).agg(F.count("*").cast("double").alias("n"))
    out = export.transition_matrix(rows, F.col("n"), 10)
    return out.select("src_id", "dst_id", F.round("transition_probability", 6).alias("transition_probability"), "rank")


@query("""SELECT source_idx, dest_idx, round(link_distance_km, 3) AS link_distance_km, same_main_category, is_self_prediction, category_pair_key FROM (SELECT a.s_suppkey AS source_idx, b.s_suppkey AS dest_idx,
    a.s_nationkey = b.s_nationkey AS same_main_category, a.s_suppkey = b.s_suppkey AS is_self_prediction, a.s_nationkey || '→' || b.s_nationkey AS category_pair_key,
    2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians((b.s_nationkey - a.s_nationkey) / 2.0)), 2)))) AS link_distance_km
    FROM supplier a JOIN supplier b ON b.s_suppkey IN (a.s_suppkey, a.s_suppkey + 1))""")
def export_with_places(spark, d):
    place = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("idx"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"),
        F.col("s_nationkey").cast("string").alias("category"),
    )
    rows = place.select(F.col("idx").alias("source_idx"), F.explode(F.array(F.col("idx"), F.col("idx") + 1)).alias("dest_idx"))
    out = export.with_places(rows.join(place.select(F.col("idx").alias("dest_idx")), "dest_idx", "left_semi"), place)
    return out.select("source_idx", "dest_idx", F.round("link_distance_km", 3).alias("link_distance_km"), "same_main_category", "is_self_prediction", "category_pair_key")


@query("SELECT * FROM nation")
def ndjson_roundtrip(spark, d):
    rows = nations(spark, d)
    return readers.ndjson(spark, writers.json_lines(rows, scratch(spark, "ndjson")), rows.schema)


@query("SELECT * FROM part")
def csv_roundtrip(spark, d):
    rows = table(spark, d, "part")
    return readers.csv(spark, writers.csv(rows, scratch(spark, "csv")), rows.schema)


@query("SELECT * FROM part")
def csv_gzip_roundtrip(spark, d):
    rows = table(spark, d, "part")
    return readers.csv(spark, writers.csv(rows, scratch(spark, "csv-gz"), "gzip"), rows.schema)


@query("SELECT * FROM part")
def parquet_roundtrip(spark, d):
    return spark.read.parquet(writers.parquet(table(spark, d, "part"), scratch(spark, "parquet")))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 5 NOT IN (0, 1)")
def bad_json_lines(spark, d):
    key = F.col("n_nationkey")
    good = F.to_json(F.struct("n_nationkey", "n_name"))
    line = F.when(key % 5 == 0, F.lit('{"broken')).when(key % 5 == 1, F.to_json(F.struct("n_name"))).otherwise(good)
    path = scratch(spark, "bad-json")
    nations(spark, d).select(line.alias("value")).write.text(path)
    return readers.tolerant_ndjson(spark, path, "n_nationkey int, n_name string", "n_nationkey")


@query("""SELECT * FROM (SELECT event_type AS token, (row_number() OVER (ORDER BY event_type) + 1)::BIGINT AS idx FROM (SELECT DISTINCT event_type FROM events))
    UNION ALL SELECT '<PAD>', 0 UNION ALL SELECT '<UNK>', 1""")
def json_vocab_load(spark, d):
    path = writers.text_value(vocab.as_json(vocab.sorted_values(events(spark, d), "event_type")), scratch(spark, "vocab"))
    return readers.vocabulary(spark, path)


@query("""SELECT '{"n":' || count(*) || ',"users":' || count(DISTINCT user_id) || ',"top":[' || (SELECT string_agg('{"event_type":"' || event_type || '","n":' || n || '}', ',' ORDER BY n DESC, event_type)
    FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3)) || ']}' AS value FROM events""")
def summary_json(spark, d):
    rows = events(spark, d)
    top = relational.top_groups(rows, ["event_type"], 3)
    return writers.summary_json(rows, {"n": F.count("*"), "users": F.count_distinct("user_id")}, top)


@query()
def ranker_scores(spark, d):
    rows = table(spark, d, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    model = ranking.fit_pairwise(rows, "l_orderkey", "label", ["l_quantity", "l_discount", "l_tax"])
    out = ranking.ranked(ranking.scored(model, rows), ["l_orderkey"], "score", ["l_linenumber"], 10)
    return out.select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"), "rank")
