"""What holds of draws, buckets and similarities however they come out: numbers, and how many rows break a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripline.functions import geo, lists, text
from tripline.operators import sampling
from tripline.operators.geo_join import distance_band
from tripline.plans.places import VISITED, sampled_pairs
from tripline.plans.visits import events, query
from tripline.sources.readers import table
from tripline.sources.storage import stored


@query("""SELECT least(20, count(*))::BIGINT AS n, least(20, count(*))::BIGINT AS different, 0::BIGINT AS strangers, 0::BIGINT AS changed FROM customer""")
def sample_rules(spark, d):
    """A sample without replacement is as large as asked, of the table's rows, and the same however the table is dealt out."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    one, other = (sampling.hash_sample(x, ["c_custkey"], 20) for x in (rows, rows.repartition(7, "c_name")))
    strangers = one.join(rows, ["c_custkey", "c_name"], "left_anti").agg(F.count("*").alias("strangers"))
    changed = one.join(other, "c_custkey", "left_anti").agg(F.count("*").alias("changed"))
    return one.agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("different")).crossJoin(strangers).crossJoin(changed)


@query("SELECT event_type, least(3, count(*))::BIGINT AS n, least(3, count(*))::BIGINT AS different, 0::BIGINT AS strangers FROM events GROUP BY event_type")
def group_sample_rules(spark, d):
    rows = events(spark, d).select("event_type", "event_id")
    drawn = sampling.hash_sample_per(rows, ["event_type"], ["event_id"], 3)
    known = rows.withColumn("known", F.lit(1))
    return drawn.join(known, ["event_type", "event_id"], "left").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("event_id").alias("different"), F.count_if(F.col("known").isNull()).alias("strangers")
    )


@query("""SELECT count(*) AS n, 0::BIGINT AS outside, 0::BIGINT AS torn, 0::BIGINT AS uneven FROM customer""")
def bucket_rules(spark, d):
    """Buckets lie in their range, equal values share one, and none of eight is far from its share."""
    rows = table(spark, d, "customer").select("c_name", lists.bucket_of(F.col("c_name"), 8).alias("b"), lists.bucket_of(F.concat("c_name", F.lit(""))).alias("whole"))
    torn = rows.groupBy("c_name").agg(F.count_distinct("b", "whole").alias("k")).agg(F.count_if(F.col("k") > 1).alias("torn"))
    sizes = rows.groupBy("b").agg(F.count("*").alias("k"))
    uneven = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("k").alias("all")))).agg(F.count_if(F.abs(F.col("k") - F.col("all") / 8) > 6 * F.sqrt(F.col("all") / 8)).alias("uneven"))
    outside = ~F.col("b").between(0, 7) | ~F.col("whole").between(0, 2**31 - 2)
    return rows.agg(F.count("*").alias("n"), F.count_if(outside).alias("outside")).crossJoin(torn).crossJoin(uneven)


@query(f"SELECT count(*) AS pairs, 0::BIGINT AS lost, 0::BIGINT AS ends, 0::BIGINT AS unfit, 0::BIGINT AS wrong_km, true AS some_matched FROM {VISITED}")
def matched_rules(spark, d):
    """Distance-matched negatives: every pair has one, which is neither end; a matched one's distance is right and fits the destination's."""
    rows, p = sampled_pairs(spark, d)
    found = stored(sampling.distance_matched(rows, p), "matched")
    spots = p.select("id", "lat", "lon")
    whole = rows.join(found, "pair_id", "left")
    for end in ("src", "dst", "neg"):
        whole = whole.join(spots.select(*[F.col(c).alias(f"{end}_{c}") for c in spots.columns]), f"{end}_id", "left")
    away = {end: geo.haversine_km(F.col("src_lat"), F.col("src_lon"), F.col(f"{end}_lat"), F.col(f"{end}_lon")) for end in ("dst", "neg")}
    matched = F.col("matched")
    return whole.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("neg_id").isNull()).alias("lost"), F.count_if(F.col("neg_id").isin(F.col("src_id"), F.col("dst_id"))).alias("ends"),
        F.count_if(matched & ~distance_band(away["dst"], away["neg"])).alias("unfit"),
        F.count_if(F.abs(F.col("distance_km") - F.when(matched, away["neg"]).otherwise(0.0)) > 1e-9).alias("wrong_km"), F.max("matched").alias("some_matched"),
    )


@query("SELECT count(*) AS n, 0::BIGINT AS outside, 0::BIGINT AS unlike_itself, 0::BIGINT AS one_sided FROM documents")
def similarity_rules(spark, d):
    """TF-IDF cosines lie between 0 and 1, are 1 (or 0 without known words) for equal texts, and the same either way round."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    both = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id", "left")
    there, back = (text.tfidf_cosine(both, *sides).select("doc_id", F.col("tfidf_cosine").alias(name)) for sides, name in ((("text", "other"), "there"), (("other", "text"), "back")))
    itself = text.tfidf_cosine(docs.withColumn("other", F.col("text")), "text", "other").select("doc_id", F.col("tfidf_cosine").alias("same"))
    return there.join(back, "doc_id").join(itself, "doc_id").agg(
        F.count("*").alias("n"), F.count_if(~F.col("there").between(0, 1 + 1e-9)).alias("outside"),
        F.count_if((F.col("same") != 0) & (F.abs(F.col("same") - 1) > 1e-9)).alias("unlike_itself"), F.count_if(F.abs(F.col("there") - F.col("back")) > 1e-9).alias("one_sided"),
    )
