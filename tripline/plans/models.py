"""Queries on models and what is stored for serving: rankers, next items, metrics, sparse matrices, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.functions import geo
from tripline.operators import csr, ranking, recurrent, sampling, sequences, tree_ranker, vocab
from tripline.plans.places import sampled_pairs
from tripline.plans.tables import RANKED, ranking_frame
from tripline.plans.visits import events, query
from tripline.sources import serving
from tripline.sources.readers import table
from tripline.sources.storage import scratch, stored


def _ndcg_sql(k: int) -> str:
    return f"""(SELECT avg(CASE WHEN i > 0 THEN g / i ELSE 0 END) FROM (SELECT sum(label / log2(rank + 1)) AS g, sum(label / log2(ideal + 1)) AS i
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY label DESC, rank) AS ideal FROM {RANKED} WHERE rank <= {k}) GROUP BY l_orderkey))"""


@query(f"""WITH q AS (SELECT l_orderkey, min(rank) FILTER (label = 1) AS f, sum(CASE WHEN label = 1 THEN 1.0 / rank END) AS rr, count(*) FILTER (label = 1) AS h FROM {RANKED} GROUP BY l_orderkey)
    SELECT count(*) AS n_queries, {', '.join(f'round(count(*) FILTER (f <= {k}) / count(*), 6) AS recall_at_{k}' for k in (1, 5, 10))},
        round(sum(rr) / sum(h), 6) AS mrr, round(sum(coalesce(1.0 / f, 0)) / count(*), 6) AS mrr_all, {', '.join(f'round({_ndcg_sql(k)}, 6) AS ndcg_at_{k}' for k in (1, 5, 10))} FROM q""")
def ranking_metrics(spark, d):
    """Recall, reciprocal ranks and nDCG at each k from one aggregate."""
    found = ranking.evaluate(ranking_frame(spark, d), "l_orderkey", "label")
    return found.select("n_queries", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


MATRIX = """(WITH ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT l_suppkey AS id FROM lineitem UNION SELECT l_partkey FROM lineitem)),
    e AS (SELECT l_suppkey AS a, l_partkey AS b, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT a, x.idx AS "row", y.idx AS col, n AS value FROM e JOIN ids x ON x.id = a JOIN ids y ON y.id = b)"""


def matrix(spark: SparkSession, d: str) -> csr.CsrMatrix:
    edges = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return csr.write_csr(edges, "l_suppkey", "l_partkey", "n", scratch(spark, "csr"))


@query(f'SELECT "row", col, value FROM {MATRIX}')
def csr_roundtrip(spark, d):
    return matrix(spark, d).coo()


@query(f"SELECT col, value FROM {MATRIX} WHERE a = 7")
def csr_row(spark, d):
    return matrix(spark, d).row(7)


@query(f'SELECT "row", sum(value * (col % 10))::BIGINT AS value FROM {MATRIX} GROUP BY "row"')
def csr_product(spark, d):
    found = matrix(spark, d)
    return found.times(found.ids().select("idx", (F.col("idx") % 10).alias("value")))


SERVED = f"""(SELECT 'by_price' AS model, l_suppkey AS source_id, l_partkey AS dest_id, rank::INT AS rank, l_orderkey * 10 + l_linenumber AS prediction_id FROM {RANKED}
    UNION ALL SELECT 'by_quantity', l_suppkey, l_partkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber))::INT, l_orderkey * 10 + l_linenumber FROM lineitem)"""


def served(spark: SparkSession, d: str) -> serving.Serving:
    """Two models' predictions, laid out for lookups."""
    path = scratch(spark, "serving")
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"))
    for model, score in (("by_price", "l_extendedprice"), ("by_quantity", "l_quantity")):
        rows = ranking.ranked(table(spark, d, "lineitem"), ["l_orderkey"], score, ["l_linenumber"])
        rows = rows.select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("dest_id"), "rank", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("prediction_id"))
        serving.save_predictions(rows.join(names, "source_id"), model, path, "source_id", ["source_name"], 16)
    return serving.Serving(spark, path)


@query(f"""SELECT model, source_id, s_name AS source_name, dest_id, rank, prediction_id FROM {SERVED} JOIN supplier ON s_suppkey = source_id WHERE source_id IN (3, 5)
    QUALIFY row_number() OVER (PARTITION BY model, source_id ORDER BY rank, prediction_id) <= 10""")
def serving_lookup(spark, d):
    """The first predictions of two venues by either model."""
    found, out = served(spark, d), None
    for model in found.models():
        for source in (3, 5):
            rows = found.predictions(model, source).select("model", "source_id", "source_name", "dest_id", "rank", "prediction_id")
            out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT DISTINCT l_suppkey AS source_id, s_name AS source_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def serving_venues(spark, d):
    return served(spark, d).venues("by_quantity")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs' destinations (label 1) among their negatives, with features x, the pair as query; every fourth query for validation, and every
    fourth held out."""
    rows, p = sampled_pairs(spark, d)
    negatives = sampling.hybrid_negatives(rows, p).select("pair_id", "src_id", "dst_id", F.lit(0).alias("label"))
    both = rows.select("pair_id", "src_id", "dst_id", F.lit(1).alias("label")).unionByName(negatives)
    for end in ("src", "dst"):
        both = both.join(p.select(*[F.col(c).alias(f"{end}_{c}") for c in ("id", "lat", "lon", "category", "balance")]), f"{end}_id")
    km = geo.haversine_km(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))
    x = F.array(km, (F.col("src_category") == F.col("dst_category")).cast("double"), F.col("dst_balance").cast("double"), (F.col("dst_balance") - F.col("src_balance")).cast("double"))
    part = F.pmod(F.xxhash64("pair_id"), F.lit(4))
    return both.select("pair_id", "dst_id", "label", F.transform(x, lambda v: F.coalesce(v, F.lit(0.0))).alias("x"), (part == 1).alias("valid"), (part == 3).alias("held"))


@query()
def tree_ranker_metrics(spark, d):
    """Metrics on all held-out queries of the boosted trees and of the linear ranker."""
    rows = stored(candidates(spark, d), "candidates")
    held = rows.where("held")
    trees = tree_ranker.fit_trees(rows.where("not held"), ["pair_id"], rounds=3, depth=4, rate=0.3, patience=2, feature_share=1.0)
    flat = rows.select("pair_id", "dst_id", "label", "held", *[F.col("x")[i].alias(f"f{i}") for i in range(4)])
    linear = ranking.fit_pairwise(flat.where("not held").drop("held"), "pair_id", "label", [f"f{i}" for i in range(4)])
    out = None
    for name, scored in (("trees", trees.scored(held)), ("linear", ranking.scored(linear, flat.where("held")))):
        found = ranking.evaluate(ranking.ranked(scored, ["pair_id"], "score", ["dst_id"]), "pair_id", "label")
        found = found.select(F.lit(name).alias("model"), *[F.round(c, 6).alias(c) if c != "n_queries" else c for c in found.columns])
        out = found if out is None else out.unionByName(found)
    return out


@query()
def next_item_lstm(spark, d):
    """The three most likely next kinds of events of a fifth of the users, by a model of the others' sequences."""
    words = vocab.sorted_values(events(spark, d), "event_type")
    rows = vocab.encode(events(spark, d), "event_type", words)
    windows = stored(sequences.trailing_windows(rows, "user_id", ["ts", "event_id"], "idx", 10, keep=("event_id",)), "windows")
    part = F.pmod(F.xxhash64("user_id"), F.lit(5))
    weights = {r.idx: r.weight for r in vocab.class_weights(windows.where(part > 1), "target", words).collect()}
    shape = recurrent.Shape(words.count() + 2, 8, 16, 1)
    model = recurrent.fit_sequences(windows.where(part > 1), windows.where(part == 1), shape, weights, epochs=3, batch=4096, most_steps=8, rate=0.02, dropout=0.1)
    return model.top_k(windows.where(part == 0).select("user_id", "event_id", "input_seq", "target"), 3)
