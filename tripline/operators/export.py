"""Prediction exports and what is served from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripline.functions.geo import haversine_km
from tripline.functions.lists import named
from tripline.operators.relational import lookup_one
from tripline.sources.storage import stored


def exploded(df: DataFrame, key: list[str], items: str, scores: str) -> DataFrame:
    """A row for each element of two parallel lists: key, rank (from 1), item, score."""
    rows = df.select(*key, F.posexplode(F.arrays_zip(F.col(items).alias("i"), F.col(scores).alias("s"))).alias("pos", "_z"))
    return rows.select(*key, (F.col("pos") + 1).alias("rank"), F.col("_z.i").alias("item"), F.col("_z.s").cast("double").alias("score"))


def _share(score: Column, total: Column) -> Column:
    return F.when(total > 0, score / total).otherwise(0.0)


def score_stats(rows: DataFrame, key: str, top_k: int = 0, min_score: float = 0.0) -> DataFrame:
    """share (9 digits), cum_share (9) and z (6, population deviation) over all of a prediction's rows; cut to top_k and min_score
    afterwards, where they are above 0."""
    w = Window.partitionBy(key)
    total, mean, sd = F.sum("score").over(w), F.avg("score").over(w), F.stddev_pop("score").over(w)
    out = rows.withColumns({"_total": total, "_mean": mean, "_sd": sd})
    out = out.withColumn("_share", _share(F.col("score"), F.col("_total")))
    running = F.sum("_share").over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    z = F.when(F.col("_sd") > 0, (F.col("score") - F.col("_mean")) / F.col("_sd"))
    out = out.withColumns({"share": F.round("_share", 9), "cum_share": F.round(running, 9), "z": F.round(z, 6)})
    out = out.where(F.col("rank") <= top_k) if top_k > 0 else out
    out = out.where(F.col("score") >= min_score) if min_score > 0 else out
    return out.drop("_total", "_mean", "_sd", "_share")


def restated(rows: DataFrame, key: str) -> DataFrame:
    """rank, share and z over the rows that are left; cum_share sums up the shares as they were before."""
    w = Window.partitionBy(key)
    total, sd = F.sum("score").over(w), F.stddev_pop("score").over(w)
    running = F.sum("share").over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns(
        {
            "rank": F.row_number().over(w.orderBy("rank")),
            "cum_share": F.round(running, 9),
            "share": F.round(_share(F.col("score"), total), 9),
            "z": F.round(F.when(sd > 0, (F.col("score") - F.avg("score").over(w)) / sd), 6),
        }
    )


def absolute_shares(key: str) -> dict[str, Column]:
    """|score| over the sum of |scores|, and rank over the number of rows."""
    w = Window.partitionBy(key)
    total = F.sum(F.abs("score")).over(w)
    return {"abs_share": F.when(total > 0, F.abs("score") / total), "rank_share": F.col("rank") / F.count("*").over(w)}


def softmax(key: str, score: str = "score") -> Column:
    """Softmax within the key, shifted by the maximum; null scores stay null and count for nothing."""
    w = Window.partitionBy(key)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return e / F.sum(e).over(w)


def provenance(src: str = "source_id", dst: str = "dest_id", src_meta: str = "source_name", dst_meta: str = "dest_name") -> dict[str, Column]:
    return {
        "source_has_metadata": F.col(src_meta).isNotNull(),
        "dest_has_metadata": F.col(dst_meta).isNotNull(),
        "is_self_prediction": F.coalesce(F.col(src) == F.col(dst), F.lit(False)),
    }


# Tokens that are no place, and the columns of an export in their order, with ranks first or with the source first.
SPECIAL = ("<PAD>", "<UNK>")
PLACE_COLUMNS = ("business_idx", "gmap_id", "name", "lat", "lon", "category_main", "category_all", "avg_rating", "num_reviews", "price_bucket", "is_closed")
SCORES = ("score_raw", "score_share", "score_cum_share", "score_z")
RANK_FIRST = (
    "prediction_id", "rank", *SCORES, *(f"source_{c}" for c in PLACE_COLUMNS), *(f"dest_{c}" for c in PLACE_COLUMNS), "link_distance_km",
    "same_main_category", "is_self_prediction", "source_has_metadata", "dest_has_metadata", "category_pair_key",
)
SOURCE_FIRST = (
    "prediction_id", *(f"source_{c}" for c in PLACE_COLUMNS), "rank", *SCORES, *(f"dest_{c}" for c in PLACE_COLUMNS), "link_distance_km", "same_main_category",
)


def laid_out(rows: DataFrame, layout: tuple[str, ...], only: bool = False) -> DataFrame:
    """The layout's columns that exist, in its order, then the others unless only the layout's are asked for."""
    return rows.select(*[c for c in layout if c in rows.columns], *([] if only else [c for c in rows.columns if c not in layout]))


def predictions_with_places(rows: DataFrame, vocabulary: DataFrame, places: DataFrame, include_unknown: bool = False) -> DataFrame:
    """Predictions (prediction_id, source_business_idx, dest_business_idx, rank, score_raw) as an export with all columns of RANK_FIRST.

    Indices are looked up in the vocabulary (business_idx, gmap_id), ids in the places; what has no place keeps its row, with nulls. Destinations
    that the vocabulary lacks, or that are special tokens, are dropped; sources too unless they are included. Ranks, shares and z-scores are
    over the rows that are left.
    """
    for end in ("source", "dest"):
        words = vocabulary.select(F.col("business_idx").alias(f"{end}_business_idx"), F.col("gmap_id").alias(f"{end}_gmap_id"))
        rows = rows.join(words, f"{end}_business_idx", "left")
        if end == "dest" or not include_unknown:
            rows = rows.where(F.col(f"{end}_gmap_id").isNotNull() & ~F.col(f"{end}_gmap_id").isin(*SPECIAL))
        rows = rows.join(places.select(*[F.col(c).alias(f"{end}_{c}") for c in places.columns]), f"{end}_gmap_id", "left")
    w = Window.partitionBy("prediction_id")
    total, sd, score = F.sum("score_raw").over(w), F.stddev_pop("score_raw").over(w), F.col("score_raw")
    share, order = _share(score, total), w.orderBy("rank")
    rows = rows.withColumns({"_share": share, "score_z": F.round(F.when(sd > 0, (score - F.avg("score_raw").over(w)) / sd), 6), "_rank": F.row_number().over(order)})
    # Rows that share a rank, as an id that several places have makes them, share its running sum: their order is open.
    running = F.sum("_share").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"score_cum_share": F.round(running, 9), "score_share": F.round("_share", 9), "rank": F.col("_rank")}).drop("_share", "_rank")
    src, dst = F.col("source_category_main"), F.col("dest_category_main")
    km = haversine_km(F.col("source_lat"), F.col("source_lon"), F.col("dest_lat"), F.col("dest_lon"))
    flags = provenance("source_business_idx", "dest_business_idx") | {"link_distance_km": km, "same_main_category": F.coalesce(src == dst, F.lit(False)), "category_pair_key": named(src, dst)}
    return laid_out(rows.withColumns(flags), RANK_FIRST)


def with_places(rows: DataFrame, places: DataFrame, keep_unknown: bool = True) -> DataFrame:
    """Rows (source_idx, dest_idx, ...) with the places' columns (idx, id, name, lat, lon, category, ...) at both ends, the distance and
    flags. What is no place keeps its row, with nulls, unless unknown places are to be dropped."""
    for end in ("source", "dest"):
        side = places.select(*[F.col(c).alias(f"{end}_{c}") for c in places.columns])
        rows = rows.join(side, f"{end}_idx", "left" if keep_unknown else "inner")
    km = haversine_km(F.col("source_lat"), F.col("source_lon"), F.col("dest_lat"), F.col("dest_lon"))
    same = F.coalesce(F.col("source_category") == F.col("dest_category"), F.lit(False))
    key = named(F.col("source_category"), F.col("dest_category"))
    return rows.withColumns(provenance() | {"link_distance_km": km, "same_main_category": same, "category_pair_key": key})


def venues(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct sources of an export."""
    return rows.select(*columns).distinct()


def venue(rows: DataFrame, key: str, value: object) -> DataFrame:
    return lookup_one(rows, key, value)


def predictions(rows: DataFrame, key: str, value: object, limit: int = 10, tie: str = "prediction_id") -> DataFrame:
    """The first rows of a source by rank, softmax as share, and its running sum."""
    top = rows.where(F.col(key) == F.lit(value)).orderBy("rank", tie).limit(limit)
    out = top.withColumn("share", softmax(key))
    running = Window.partitionBy(key).orderBy("rank", tie).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cum_share", F.sum("share").over(running))


def coo_matrix(edges: DataFrame, src: str, dst: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(row, col, value) and the index of ids (id, idx from 0 in the order of the ids). Edges and index are written once, as several jobs read them."""
    from tripline.operators.relational import ids_of_both, row_index

    edges = stored(edges.select(src, dst, value), "edges")
    ids = stored(row_index(stored(ids_of_both(edges, src, dst), "ends"), ["id"], "idx"), "ids")
    out = edges.join(ids.select(F.col("id").alias(src), F.col("idx").alias("row")), src)
    out = out.join(ids.select(F.col("id").alias(dst), F.col("idx").alias("col")), dst)
    return out.select("row", "col", F.col(value).alias("value")), ids


def nested_top_k(rows: DataFrame, src: str, columns: list[str]) -> DataFrame:
    """src and items: a JSON array of the rows' columns in the order of rank."""
    lists = rows.groupBy(src).agg(F.sort_array(F.collect_list(F.struct("rank", *columns))).alias("_l"))
    return lists.select(src, F.to_json("_l").alias("items"))


def transition_matrix(candidates: DataFrame, score: Column, k: int = 10) -> DataFrame:
    """Candidates (src_id, dst_id and features) with the k best of each source: transition_probability (the score as it is) and rank."""
    out = candidates.withColumn("transition_probability", score)
    w = Window.partitionBy("src_id").orderBy(F.desc("transition_probability"), "dst_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
