"""Per-user and per-place aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripline.functions.text import TOPICS, polarity, topic_flags
from tripline.functions.time import days_between
from tripline.operators.ordering import medians
from tripline.sources.storage import stored


def rating_stats(user: str, rating: str, item: str, ts: str, text: str | None = None) -> list[Column]:
    """Mean, sample deviation, number, distinct items, first and last time, and mean text length."""
    out = [
        F.avg(rating).alias("avg_rating"),
        F.stddev_samp(rating).alias("rating_std"),
        F.count(rating).alias("total_reviews"),
        F.count_distinct(item).alias("unique_items"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    ]
    return out + ([F.avg(F.char_length(text)).alias("avg_length")] if text else [])


def visit_frequency(stats: DataFrame) -> DataFrame:
    """Visits in 30 days: total * 30 / whole days between first and last, or the total itself within one day."""
    days = days_between(F.col("first_ts"), F.col("last_ts"))
    value = F.when(days > 0, F.col("total_reviews") * 30.0 / days).otherwise(F.col("total_reviews").cast("double"))
    return stats.withColumns({"days": days, "visit_frequency": value})


def rating_shares(rating: str) -> list[Column]:
    r = F.col(rating)
    shares = {"pct_5_star": r == 5, "pct_1_star": r == 1, "pct_positive": r >= 4, "pct_negative": r <= 2}
    return [F.avg(x.cast("double")).alias(k) for k, x in shares.items()] + [
        F.coalesce(F.stddev_samp(rating) < 1, F.lit(False)).alias("is_consistent")
    ]


def distinct_with_null(column: str) -> Column:
    """Distinct values, null being one of them."""
    return F.count_distinct(column) + F.max(F.col(column).isNull().cast("int"))


def mode_of(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """The most frequent value of each key, the least one at a tie."""
    return df.groupBy(key).agg(F.mode(column, True).alias(name))


def top_values(df: DataFrame, key: str, column: str, n: int = 3) -> DataFrame:
    """The n most frequent values of each key with their counts, as two parallel lists."""
    counts = df.groupBy(key, column).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), column)
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    lists = top.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", column, "n"))).alias("_l"))
    return lists.select(key, F.col(f"_l.{column}").alias("top_values"), F.col("_l.n").alias("top_counts"))


def loyalty(visits: DataFrame, user: str, item: str) -> DataFrame:
    """The share of a user's items visited more than once."""
    counts = visits.groupBy(user, item).agg(F.count("*").alias("_n"))
    return counts.groupBy(user).agg(F.avg((F.col("_n") > 1).cast("double")).alias("loyalty_score"))


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row, median: the middle value, or the mean of both."""
    return df.sparkSession.createDataFrame([(medians(df, [column])[column],)], "median double")


def median_flags(users: DataFrame, columns: dict[str, str], frequency: str | None = None) -> DataFrame:
    """Flags (name -> column) whether a user is above the median of all users, and a low, medium or high frequency bucket (below half,
    above twice the median). The users are stored, so that they are made once for all medians and the result."""
    wanted = list(dict.fromkeys([*columns.values(), *([frequency] if frequency else [])]))
    users = stored(users, "users")
    middle = {c: F.lit(m) for c, m in medians(users, wanted).items()}
    out = users.withColumns({name: F.coalesce(F.col(c) > middle[c], F.lit(False)) for name, c in columns.items()})
    if frequency:
        f, m = F.col(frequency), middle[frequency]
        out = out.withColumn("frequency_bucket", F.when(f < 0.5 * m, "low").when(f > 2 * m, "high").otherwise("medium"))
    return out


def sentiment(reviews: DataFrame, key: str, text: str = "text", score: Column | None = None) -> DataFrame:
    """Of each place: mean, deviation, shares above 0.2 and below -0.2, mean length and number of its reviews' polarities."""
    rows = reviews.select(key, (polarity(F.col(text)) if score is None else score).alias("_s"), F.char_length(text).alias("_l"))
    return rows.groupBy(key).agg(
        F.avg("_s").alias("avg_sentiment"),
        F.stddev_samp("_s").alias("sentiment_std"),
        F.avg((F.col("_s") > 0.2).cast("double")).alias("positive_review_pct"),
        F.avg((F.col("_s") < -0.2).cast("double")).alias("negative_review_pct"),
        F.avg("_l").alias("avg_review_length"),
        F.count("_s").alias("review_count"),
    )


def topic_shares(reviews: DataFrame, key: str, text: str = "text", topics: dict[str, list[str]] = TOPICS) -> DataFrame:
    rows = reviews.select(key, F.when(F.col(text).isNotNull(), topic_flags(F.col(text), topics)).alias("_t"))
    return rows.groupBy(key).agg(*[F.avg(F.col(f"_t.{t}").cast("double")).alias(f"mentions_{t}") for t in topics])


def user_similarity(a: dict[str, Column], b: dict[str, Column], numeric: list[str], flags: list[str]) -> Column:
    """The mean of relative closeness of the numbers that both have, 1 - |a - b| / (|a| + |b| + 1e-6), and of equal flags."""
    parts = [1 - F.abs(a[c] - b[c]) / (F.abs(a[c]) + F.abs(b[c]) + 1e-6) for c in numeric]
    parts += [a[c].eqNullSafe(b[c]).cast("double") for c in flags]
    total, count = F.lit(0.0), F.lit(0)
    for p in parts:
        total, count = total + F.coalesce(p, F.lit(0.0)), count + p.isNotNull().cast("int")
    return F.when(count > 0, total / count).otherwise(0.0)


# What stands for what is unknown of a user.
PROFILE_FILLS = {
    "user_avg_rating": 3.5, "user_rating_std": 1.0, "user_avg_review_length": 50.0, "user_visit_frequency": 1.0, "user_cuisine_diversity": 1,
    "user_price_preference": 2.0, "user_price_std": 1.0, "user_loyalty_score": 0.0, "user_favorite_cuisine": "american", "user_pct_5_star": 0.2,
    "user_pct_1_star": 0.1, "user_pct_positive": 0.6, "user_pct_negative": 0.2, "user_is_consistent_rater": False, "user_is_explorer": False,
    "user_is_frequent": False, "user_is_diverse_eater": False, "user_has_high_standards": False, "user_is_price_sensitive": False,
    "user_visit_frequency_bucket": "low",
}


def user_profiles(reviews: DataFrame, places: DataFrame) -> DataFrame:
    """A row for each user of the reviews (user_id, item, rating, ts, text), with what their places (id, category, price_bucket) tell: ratings,
    frequency, tastes, habits and flags, nulls filled. All but repeat visits and medians is one aggregate."""
    rows = reviews.join(places.select(F.col("id").alias("item"), "category", "price_bucket"), "item", "left")
    users = rows.groupBy("user_id").agg(
        *rating_stats("user_id", "rating", "item", "ts", "text"), *rating_shares("rating"), distinct_with_null("category").alias("cuisines"),
        F.avg("price_bucket").alias("price_mean"), F.stddev_samp("price_bucket").alias("price_std"), F.mode("category", True).alias("favorite"),
    )
    users = visit_frequency(users).join(loyalty(reviews, "user_id", "item"), "user_id", "left")
    flags = {"user_is_explorer": "unique_items", "user_is_frequent": "visit_frequency", "user_is_diverse_eater": "cuisines"}
    users = median_flags(users, flags, "visit_frequency")
    out = users.select(
        "user_id", F.col("avg_rating").alias("user_avg_rating"), F.col("rating_std").alias("user_rating_std"), F.col("total_reviews").alias("user_total_reviews"),
        F.col("unique_items").alias("user_unique_restaurants"), F.col("avg_length").alias("user_avg_review_length"),
        F.col("visit_frequency").alias("user_visit_frequency"), F.col("cuisines").cast("long").alias("user_cuisine_diversity"),
        F.col("price_mean").alias("user_price_preference"), F.col("price_std").alias("user_price_std"), F.col("favorite").alias("user_favorite_cuisine"),
        F.col("loyalty_score").alias("user_loyalty_score"), *[F.col(c).alias(f"user_{c}") for c in ("pct_5_star", "pct_1_star", "pct_positive", "pct_negative")],
        *flags, (F.col("avg_rating") > 4).alias("user_has_high_standards"),
        ((F.col("price_mean") <= 2) & (F.col("price_std") <= 0.5)).alias("user_is_price_sensitive"), F.col("is_consistent").alias("user_is_consistent_rater"),
        F.col("frequency_bucket").alias("user_visit_frequency_bucket"),
    )
    return out.fillna(PROFILE_FILLS)
