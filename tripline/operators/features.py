"""Features of pairs, as dictionaries of columns to be added in one projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions import geo, lists, time


def _c(name: str) -> Column:
    return F.col(name)


def spatial() -> dict[str, Column]:
    km = geo.haversine_km(_c("src_lat"), _c("src_lon"), _c("dst_lat"), _c("dst_lon"))
    return {
        "distance_km": km,
        "distance_bucket": geo.distance_bucket(km),
        "same_neighborhood": km <= 2,
        "direction": geo.bearing8(_c("src_lat"), _c("src_lon"), _c("dst_lat"), _c("dst_lon")),
    }


def temporal(src: str = "src_ts", dst: str = "dst_ts", legacy: bool = False) -> dict[str, Column]:
    out = {"delta_hours_bucket": time.delta_bucket(_c("delta_hours")), "dst_meal_type": time.meal_type(_c(dst))}
    for end, ts in (("src", _c(src)), ("dst", _c(dst))):
        out |= {f"{end}_hour": F.hour(ts), f"{end}_day_of_week": time.iso_weekday(ts), f"{end}_is_weekend": time.is_weekend(ts, legacy)}
        out |= {f"{end}_is_{meal}": flag for meal, flag in time.meal_flags(ts).items()}
    return out


def rating() -> dict[str, Column]:
    d = _c("dst_rating") - _c("src_rating")
    return {
        "rating_diff": d,
        "is_rating_upgrade": d > 0,
        "is_rating_downgrade": d < 0,
        "src_is_highly_rated": _c("src_rating") >= 4.5,
        "dst_is_highly_rated": _c("dst_rating") >= 4.5,
    }


def price() -> dict[str, Column]:
    d = _c("dst_price") - _c("src_price")
    return {"price_diff": d, "is_price_upgrade": d > 0, "is_price_downgrade": d < 0, "same_price_level": d == 0}


def category() -> dict[str, Column]:
    a, b = _c("src_category"), _c("dst_category")
    return {
        "same_category": a == b,
        "cuisine_pair_type": lists.pair_type(a, b),
        "is_dessert_followup": lists.dessert_follows(a, b),
        "is_meal_progression": lists.meal_progresses(a, b),
    }


def relationship() -> dict[str, Column]:
    return {
        "is_in_relative_results": lists.member(_c("src_relative_results"), _c("dst_id")),
        "relative_results_rank": lists.place_in(_c("src_relative_results"), _c("dst_id")),
    }


def sentiment() -> dict[str, Column]:
    a, b = _c("src_sentiment_score"), _c("dst_sentiment_score")
    return {
        "sentiment_transition": b - a,
        "is_sentiment_upgrade": b > a,
        "sentiment_similarity": 1 - F.abs(b - a) / 2,
        "both_positive_sentiment": (a > 0.2) & (b > 0.2),
        "review_length_diff": _c("dst_avg_review_length") - _c("src_avg_review_length"),
    }


def preference() -> dict[str, Column]:
    return {
        "rating_vs_user_preference": _c("dst_rating") - _c("user_avg_rating"),
        "price_vs_user_preference": _c("dst_price") - _c("user_price_preference"),
    }


def opening_times(legacy: bool = False) -> dict[str, Column]:
    """From both ends' parsed opening hours (src_hours, dst_hours)."""
    out = {}
    for end in ("src", "dst"):
        ts, hours = _c(f"{end}_ts"), _c(f"{end}_hours")
        out[f"{end}_is_open_at_time"] = time.open_at(hours, time.weekday_name(ts, legacy), F.hour(ts))
        out[f"{end}_opens_early"] = time.opens_early(hours)
    return out | {"hours_overlap": time.hours_overlap(_c("src_hours"), _c("dst_hours"))}


def opening() -> dict[str, Column]:
    return {
        "is_late_night_transition": _c("src_has_late_night") & _c("dst_has_late_night"),
        "is_early_morning_transition": _c("src_opens_early") & _c("dst_opens_early"),
        "involves_24hr_restaurant": _c("src_is_24hr") | _c("dst_is_24hr"),
    }


def topics(names: tuple[str, ...] = ("dessert", "drinks", "service", "atmosphere", "price")) -> dict[str, Column]:
    out = {f"topic_transition_{t}": (_c(f"src_mentions_{t}") < 0.3) & (_c(f"dst_mentions_{t}") > 0.3) for t in names[:2]}
    count = F.lit(0)
    for t in names:
        near = F.abs(_c(f"src_mentions_{t}") - _c(f"dst_mentions_{t}")) < 0.2
        count = count + F.coalesce(near.cast("int"), F.lit(0))
    return out | {"topic_similarity_count": count}


def services() -> dict[str, Column]:
    def same(x: str) -> Column:
        return _c(f"src_has_{x}") == _c(f"dst_has_{x}")

    return {
        "service_match": same("delivery") & same("takeout"),
        "dst_adds_delivery": ~_c("src_has_delivery") & _c("dst_has_delivery"),
        "dst_adds_takeout": ~_c("src_has_takeout") & _c("dst_has_takeout"),
        "both_accept_reservations": _c("src_accepts_reservations") & _c("dst_accepts_reservations"),
    }


def interactions(df: DataFrame) -> DataFrame:
    """The interaction features whose inputs the frame has."""

    def flag(x: str) -> Column:
        return _c(x).cast("double")

    table = {
        "distance_x_dst_rating": (("distance_km", "dst_rating"), lambda: _c("distance_km") * _c("dst_rating")),
        "distance_x_rating_diff": (("distance_km", "rating_diff"), lambda: _c("distance_km") * _c("rating_diff")),
        "price_x_rating": (("dst_price", "dst_rating"), lambda: _c("dst_price") * _c("dst_rating")),
        "time_x_distance": (("delta_hours", "distance_km"), lambda: _c("delta_hours") * _c("distance_km")),
        "user_pref_x_dst_rating": (("user_avg_rating", "dst_rating"), lambda: _c("user_avg_rating") * _c("dst_rating")),
        "user_price_pref_x_dst_price": (("user_price_preference", "dst_price"), lambda: _c("user_price_preference") * _c("dst_price")),
        "sentiment_match_score": (("src_sentiment_score", "dst_sentiment_score"), lambda: _c("src_sentiment_score") * _c("dst_sentiment_score")),
        "same_cat_x_distance": (("same_category", "distance_km"), lambda: flag("same_category") * _c("distance_km")),
        "rating_upgrade_x_distance": (("is_rating_upgrade", "distance_km"), lambda: flag("is_rating_upgrade") * _c("distance_km")),
        "diversity_x_different_cat": (("user_cuisine_diversity", "same_category"), lambda: _c("user_cuisine_diversity") * (1 - flag("same_category"))),
        "service_match_x_time": (("service_match", "delta_hours"), lambda: flag("service_match") * _c("delta_hours")),
        "relative_results_proximity": (("is_in_relative_results", "distance_km"), lambda: flag("is_in_relative_results") / (_c("distance_km") + 0.1)),
        "distance_km_squared": (("distance_km",), lambda: _c("distance_km") * _c("distance_km")),
        "delta_hours_squared": (("delta_hours",), lambda: _c("delta_hours") * _c("delta_hours")),
        "rating_diff_squared": (("rating_diff",), lambda: _c("rating_diff") * _c("rating_diff")),
        "rating_ratio": (("dst_rating", "src_rating"), lambda: _c("dst_rating") / (_c("src_rating") + 0.1)),
        "price_ratio": (("dst_price", "src_price"), lambda: _c("dst_price") / (_c("src_price") + 0.1)),
    }
    return df.withColumns({k: make() for k, (needs, make) in table.items() if set(needs) <= set(df.columns)})


def pair_features(pairs: DataFrame, legacy_weekday: bool = False, mixed: bool = True) -> DataFrame:
    """All feature groups whose inputs the frame has, and, if mixed, the interactions. Both ends' columns come from one wide place table joined twice, users' from one."""
    groups = [
        (("src_lat", "src_lon", "dst_lat", "dst_lon"), spatial),
        (("src_ts", "dst_ts", "delta_hours"), lambda: temporal(legacy=legacy_weekday)),
        (("src_rating", "dst_rating"), rating),
        (("src_price", "dst_price"), price),
        (("src_category", "dst_category"), category),
        (("src_relative_results", "dst_id"), relationship),
        (("src_sentiment_score", "dst_sentiment_score", "src_avg_review_length", "dst_avg_review_length"), sentiment),
        (("user_avg_rating", "user_price_preference", "dst_rating", "dst_price"), preference),
        (("src_hours", "dst_hours", "src_ts", "dst_ts"), lambda: opening_times(legacy_weekday)),
        (("src_has_late_night", "dst_has_late_night", "src_opens_early", "dst_opens_early", "src_is_24hr", "dst_is_24hr"), opening),
        (("src_mentions_dessert", "dst_mentions_price"), topics),
        (("src_has_delivery", "dst_has_delivery", "src_accepts_reservations", "dst_accepts_reservations"), services),
    ]
    for needs, group in groups:
        if set(needs) <= set(pairs.columns):
            pairs = pairs.withColumns(group())
    return interactions(pairs) if mixed else pairs


TOPIC_NAMES = ("dessert", "drinks", "service", "atmosphere", "price")
# What stands for unknown inputs before anything is derived from them, and for unknown features afterwards.
FILLS_BEFORE = {f"{end}_{c}": 0.0 for end in ("src", "dst") for c in (*(f"mentions_{t}" for t in TOPIC_NAMES), "price")}
FILLS_AFTER = {
    **{
        f"{end}_{c}": v
        for end in ("src", "dst")
        for c, v in (
            ("sentiment_score", 0.0), ("sentiment_std", 0.0), ("positive_review_pct", 0.5), ("avg_review_length", 50.0), ("is_open_at_time", True),
            ("has_late_night", False), ("is_24hr", False), ("has_delivery", False), ("has_takeout", False), ("has_dinein", False),
            ("accepts_reservations", False),
        )
    },
    "sentiment_transition": 0.0, "is_sentiment_upgrade": False, "sentiment_similarity": 1.0, "both_positive_sentiment": False, "review_length_diff": 0.0,
    "user_avg_rating": 3.5, "user_rating_std": 1.0, "user_total_reviews": 1, "user_unique_restaurants": 1, "user_avg_review_length": 50.0,
    "user_visit_frequency": 1.0, "user_cuisine_diversity": 1, "user_price_preference": 2.0, "user_price_std": 1.0, "user_loyalty_score": 0.0,
    "user_is_explorer": False, "user_is_frequent": False, "user_is_diverse_eater": False, "user_has_high_standards": False,
    "user_is_price_sensitive": False, "user_visit_frequency_bucket": "low", "rating_vs_user_preference": 0.0, "price_vs_user_preference": 0.0,
    "topic_transition_dessert": False, "topic_transition_drinks": False, "topic_similarity_count": 0, "hours_overlap": True,
    "is_late_night_transition": False, "is_early_morning_transition": False, "involves_24hr_restaurant": False, "service_match": True,
    "dst_adds_delivery": False, "dst_adds_takeout": False, "both_accept_reservations": False,
}


def filled(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.fillna({c: v for c, v in values.items() if c in df.columns})


def all_features(
    pairs: DataFrame,
    places: DataFrame,
    sentiment: DataFrame | None = None,
    topics: DataFrame | None = None,
    profiles: DataFrame | None = None,
    legacy_weekday: bool = False,
) -> DataFrame:
    """Pairs (user_id, src_id, dst_id, and of both ends ts, category, lat, lon, rating; delta_hours) with all features, nulls filled.

    places has id, price_bucket, relative_results, hours (parsed), has_late_night, is_24hr and the services. What reviews tell joins
    the places first (sentiment and topics by id), so that the pairs are joined with one wide table for each end, and with the users' profiles.
    """
    wide = places.select(
        "id", F.col("price_bucket").cast("double").alias("price"), "relative_results", "hours", "has_late_night", "is_24hr",
        "has_delivery", "has_takeout", "has_dinein", "accepts_reservations",
    )
    if sentiment is not None:
        told = sentiment.select("id", F.col("avg_sentiment").alias("sentiment_score"), "sentiment_std", "positive_review_pct", "avg_review_length")
        wide = wide.join(told, "id", "left")
    if topics is not None:
        wide = wide.join(topics.select("id", *[f"mentions_{t}" for t in TOPIC_NAMES]), "id", "left")
    out = pairs
    for end in ("src", "dst"):
        out = out.join(wide.select(*[F.col(c).alias(f"{end}_{c}") for c in wide.columns]), f"{end}_id", "left")
    if profiles is not None:
        out = out.join(profiles, "user_id", "left")
    out = filled(pair_features(filled(out, FILLS_BEFORE), legacy_weekday, mixed=False), FILLS_AFTER)
    gone = [f"{end}_{c}" for end in ("src", "dst") for c in ("hours", "relative_results", "opens_early")]
    return interactions(out.drop(*gone)).withColumn("label", F.lit(1))
