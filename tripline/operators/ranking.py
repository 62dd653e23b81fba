"""Ranking frames: ranks, metrics, importance groups, scorers."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# By which parts of a feature's name its group is told, in this order; interactions first.
INTERACTION_MARKS = ("_x_", "_squared", "_ratio", "_proximity", "_match_score")
INTERACTIONS = (
    ("quality", ("distance", "rating")), ("spatial", ("distance", "time")), ("price", ("price", "rating")),
    ("user_behavior", ("user",)), ("review_sentiment", ("sentiment",)), ("service_options", ("service",)),
    ("relationship", ("relative_results",)),
)
GROUPS = (
    ("spatial", ("distance", "neighborhood", "direction")), ("temporal", ("hour", "day_of_week", "weekend", "delta", "meal")),
    ("quality", ("rating", "highly_rated")), ("price", ("price", "upgrade", "downgrade")),
    ("category", ("category", "same_category", "cuisine", "dessert", "meal_progression")),
    ("relationship", ("relative_results", "is_in_relative")), ("review_sentiment", ("sentiment", "review_length", "positive_review")),
    ("user_behavior", ("user_", "explorer", "frequent", "diverse", "standards", "consistent")),
    ("cuisine_complementarity", ("cuisine_pair", "complementarity", "followup", "progression")),
    ("operating_hours", ("open_at_time", "hours_overlap", "late_night", "early_morning", "24hr")),
    ("topics", ("mentions_", "topic_")), ("service_options", ("delivery", "takeout", "dinein", "reservations", "service")),
)
DEFAULT_GROUP = "spatial"

# The inputs of the ranker.
CATEGORICAL = ("distance_bucket", "direction", "delta_hours_bucket", "dst_meal_type", "cuisine_pair_type", "user_visit_frequency_bucket")
NUMERICAL = (
    "distance_km", "delta_hours", "src_hour", "dst_hour", "src_day_of_week", "dst_day_of_week", "src_rating", "dst_rating", "rating_diff",
    "src_price", "dst_price", "price_diff", "relative_results_rank", "src_sentiment_score", "dst_sentiment_score", "sentiment_transition",
    "sentiment_similarity", "src_avg_review_length", "dst_avg_review_length", "review_length_diff", "src_positive_review_pct",
    "dst_positive_review_pct", "user_avg_rating", "user_rating_std", "user_total_reviews", "user_unique_restaurants", "user_visit_frequency",
    "user_cuisine_diversity", "user_price_preference", "user_price_std", "user_loyalty_score", "user_pct_5_star", "user_pct_1_star",
    "user_pct_positive", "user_pct_negative", "rating_vs_user_preference", "price_vs_user_preference", "src_mentions_dessert",
    "dst_mentions_dessert", "src_mentions_drinks", "dst_mentions_drinks", "src_mentions_service", "dst_mentions_service",
    "src_mentions_atmosphere", "dst_mentions_atmosphere", "src_mentions_price", "dst_mentions_price", "topic_similarity_count",
)
BOOLEAN = (
    "same_neighborhood", "src_is_weekend", "dst_is_weekend", "src_is_breakfast", "dst_is_breakfast", "src_is_lunch", "dst_is_lunch",
    "src_is_dinner", "dst_is_dinner", "is_rating_upgrade", "is_rating_downgrade", "src_is_highly_rated", "dst_is_highly_rated",
    "is_price_upgrade", "is_price_downgrade", "same_price_level", "same_category", "is_in_relative_results", "is_sentiment_upgrade",
    "both_positive_sentiment", "user_is_explorer", "user_is_frequent", "user_is_diverse_eater", "user_has_high_standards",
    "user_is_price_sensitive", "user_is_consistent_rater", "is_dessert_followup", "is_meal_progression", "src_is_open_at_time",
    "dst_is_open_at_time", "hours_overlap", "is_late_night_transition", "is_early_morning_transition", "involves_24hr_restaurant",
    "src_has_late_night", "dst_has_late_night", "src_is_24hr", "dst_is_24hr", "topic_transition_dessert", "topic_transition_drinks",
    "src_has_delivery", "dst_has_delivery", "src_has_takeout", "dst_has_takeout", "src_has_dinein", "dst_has_dinein",
    "src_accepts_reservations", "dst_accepts_reservations", "service_match", "dst_adds_delivery", "dst_adds_takeout",
    "both_accept_reservations",
)


def ranked(df: DataFrame, query: list[str], score: str, tie: list[str], k: int | None = None) -> DataFrame:
    """rank (1 for the best score) within each query, the first k if asked for."""
    w = Window.partitionBy(*query).orderBy(F.desc(score), *tie)
    out = df.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def shares(query: str, score: str) -> dict[str, Column]:
    """Share of the query's total and z-score with the sample deviation."""
    w = Window.partitionBy(query)
    s, sd = F.col(score), F.stddev_samp(score).over(w)
    total = F.sum(score).over(w)
    return {
        "score_share": F.when(total != 0, s / total),
        "score_z": F.when(sd > 0, (s - F.avg(score).over(w)) / sd),
    }


def recall_mrr(df: DataFrame, query: str, label: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: recall@k over all queries, mrr over positives that the frame holds, mrr_all over all queries."""
    hit = F.col(label) == 1
    per_query = df.groupBy(query).agg(F.min(F.when(hit, F.col("rank"))).alias("_first"), F.sum(F.when(hit, 1.0 / F.col("rank"))).alias("_rr"), F.count_if(hit).alias("_hits"))
    n = F.count("*")
    recalls = [(F.count_if(F.col("_first") <= k) / n).alias(f"recall_at_{k}") for k in ks]
    return per_query.agg(
        n.alias("n_queries"), *recalls, F.try_divide(F.sum("_rr"), F.sum("_hits")).alias("mrr"), (F.sum(F.coalesce(1.0 / F.col("_first"), F.lit(0.0))) / n).alias("mrr_all")
    )


def ndcg(df: DataFrame, query: str, label: str, k: int = 10) -> DataFrame:
    """One row: the mean over queries of DCG@k over the ideal DCG of the same rows, 0 for a query without positives."""
    ideal = Window.partitionBy(query).orderBy(F.desc(label), "rank")
    rows = df.where(F.col("rank") <= k).withColumn("_ideal", F.row_number().over(ideal))

    def gain(at: str) -> Column:
        return F.sum(F.col(label) / F.log2(F.col(at) + 1))

    each = rows.groupBy(query).agg(gain("rank").alias("_dcg"), gain("_ideal").alias("_idcg"))
    value = F.when(F.col("_idcg") > 0, F.col("_dcg") / F.col("_idcg")).otherwise(0.0)
    return each.agg(F.avg(value).alias(f"ndcg_at_{k}"), F.count("*").alias("n_queries"))


def top_k_accuracy(df: DataFrame, predicted: str, target: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    return df.agg(*[F.avg(F.array_contains(F.slice(predicted, 1, k), F.col(target)).cast("double")).alias(f"accuracy_at_{k}") for k in ks])


def per_class(df: DataFrame, target: str, predicted: str, ignore: tuple[int, ...] = (0, 1)) -> DataFrame:
    """class, support, precision, recall, f1; rows whose target is to be ignored are left out."""
    pairs = df.where(~F.col(target).isin(*ignore)).groupBy(target, predicted).agg(F.count("*").alias("n"))
    both = pairs.select(F.col(target).alias("class"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(F.col(target) == F.col(predicted), F.col("n")).otherwise(0).alias("tp"))
    both = both.unionByName(pairs.select(F.col(predicted).alias("class"), F.lit(0).alias("t"), F.col("n").alias("p"), F.lit(0).alias("tp")))
    sums = both.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("t", "p", "tp")])
    precision, recall = (F.coalesce(F.try_divide("tp", c), F.lit(0.0)) for c in ("p", "t"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("p") + F.col("t")), F.lit(0.0))
    return sums.select("class", F.col("t").alias("support"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def importance_group(name: Column) -> Column:
    """The group of a feature by its name."""

    def has_all(words: tuple[str, ...]) -> Column:
        out = F.lit(True)
        for w in words:
            out = out & F.contains(name, F.lit(w))
        return out

    def has_any(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(name, F.lit(w))
        return out

    mixed = has_any(INTERACTION_MARKS)
    out = F.when(mixed & has_all(INTERACTIONS[0][1]), INTERACTIONS[0][0])
    for group, words in INTERACTIONS[1:]:
        out = out.when(mixed & has_all(words), group)
    out = out.when(mixed, "spatial")
    for group, words in GROUPS:
        out = out.when(has_any(words), group)
    return out.otherwise(DEFAULT_GROUP)


def named_importance(scores: DataFrame, names: list[str]) -> DataFrame:
    """Importance rows (feature, score) whose internal names f0, f1, ... are replaced by the real ones, if there are so many, with their groups."""
    real = F.get(F.array(*[F.lit(n) for n in names]), F.regexp_extract("feature", r"^f(\d+)$", 1).try_cast("int"))
    name = F.coalesce(F.when(F.col("feature").rlike(r"^f\d+$"), real), F.col("feature"))
    return scores.select(name.alias("feature"), "score", importance_group(name).alias("grp"))


def group_importance(importance: DataFrame) -> DataFrame:
    """Of each group of named_importance: total, mean and number of its scores."""
    return importance.groupBy("grp").agg(F.sum("score").alias("total"), F.avg("score").alias("mean"), F.count("*").alias("n"))


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("score"), "feature").limit(n)


def ranking_data(df: DataFrame, query: list[str], categories: DataFrame, label: str = "label", tie: str = "dst_id") -> tuple[DataFrame, list[str]]:
    """The rows as a ranker's input, and the features' names: the query's columns, label, group_size (rows of the query; the frame's own, if it
    has that column, so that wide rows need no shuffle) and x, an array of
    doubles (null and NaN are 0) in the order of the names: numbers, flags, interactions, and a 0 or 1 for each of the categories'
    values, which are those that fit_categories has found in training."""
    from tripline.operators.features import interactions
    from tripline.operators.relational import category_values

    wide, values = interactions(df), category_values(categories, list(CATEGORICAL))
    mixed = [c for c in wide.columns if any(m in c for m in INTERACTION_MARKS)]
    numbers = [*NUMERICAL, *BOOLEAN, *mixed]
    x = [F.array(*[F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)) for c in numbers])]

    def flags(column: str, seen: list[str]) -> Column:
        """One expression for a column, however many values it has."""
        return F.transform(F.array(*[F.lit(v) for v in seen]), lambda v: F.coalesce((v == F.col(column).cast("string")).cast("double"), F.lit(0.0)))

    x += [flags(c, seen) for c, seen in values.items() if seen]
    size = F.col("group_size") if "group_size" in df.columns else F.count("*").over(Window.partitionBy(*query))
    names = [*numbers, *(f"{c}_{v}" for c, seen in values.items() for v in seen)]
    return wide.select(*query, tie, label, size.alias("group_size"), F.concat(*x).alias("x")), names


def evaluate(ranked_rows: DataFrame, query: str, label: str, ks: tuple[int, ...] = (1, 5, 10), queries: int | None = None, seed: int = 42) -> DataFrame:
    """One row: recall_mrr and the nDCG at each k, all of one aggregate: a query keeps its first hit, its sums and its first max(ks) labels, and
    each k's gains are expressions over these.

    With ``queries``, the nDCG is that of so many queries, drawn by the hash of their keys.
    """
    hit, most = F.col(label) == 1, max(ks)
    told = F.col("rank") <= most
    if queries is not None:
        # Only queries that are drawn keep labels and have gains.
        least = ranked_rows.select(query).distinct().select(F.col(query).alias("_q"), F.xxhash64(query, F.lit(seed)).alias("_drawn")).orderBy("_drawn", "_q").limit(queries).select("_q")
        ranked_rows = ranked_rows.join(F.broadcast(least) if queries <= 100_000 else least, ranked_rows[query] == F.col("_q"), "left")
        told = told & F.col("_q").isNotNull()
    top = F.collect_list(F.when(told, F.struct("rank", F.col(label).cast("double").alias("y"))))
    drawn = F.lit(True) if queries is None else F.max(F.col("_q").isNotNull())
    each = ranked_rows.groupBy(query).agg(
        F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when(hit, 1.0 / F.col("rank"))).alias("rr"), F.count_if(hit).alias("hits"), F.sort_array(top).alias("top"), drawn.alias("drawn")
    )

    def summed(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)

    def ndcg_at(k: int) -> Column:
        rows = F.filter("top", lambda r: r["rank"] <= k)
        gain = summed(F.transform(rows, lambda r: r["y"] / F.log2(r["rank"] + 1)))
        ideal = summed(F.transform(F.sort_array(F.transform(rows, lambda r: r["y"]), False), lambda y, i: y / F.log2(i + 2)))
        return F.when(ideal > 0, gain / ideal).otherwise(0.0)

    n = F.count("*")
    recalls = [(F.count_if(F.col("first") <= k) / n).alias(f"recall_at_{k}") for k in ks]
    gains = [F.avg(F.when(F.col("drawn"), ndcg_at(k))).alias(f"ndcg_at_{k}") for k in ks]
    mrr = [F.try_divide(F.sum("rr"), F.sum("hits")).alias("mrr"), (F.sum(F.coalesce(1.0 / F.col("first"), F.lit(0.0))) / n).alias("mrr_all")]
    return each.agg(n.alias("n_queries"), *recalls, *mrr, *gains)


def fit_pairwise(df: DataFrame, query: str, label: str, features: list[str], most_negatives: int = 8) -> PipelineModel:
    """A linear pairwise ranker: logistic regression on differences between a query's positives and at most so many of its
    negatives (by hash)."""
    x = F.array(*[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features])
    rows = df.select(query, label, x.alias("_x"))
    w = Window.partitionBy(query).orderBy(F.xxhash64("_x"))
    negatives = rows.where(F.col(label) == 0).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most_negatives)
    both = rows.where(F.col(label) == 1).select(query, F.col("_x").alias("_a")).join(negatives.select(query, F.col("_x").alias("_b")), query)
    up = F.zip_with("_a", "_b", lambda a, b: a - b)
    down = F.zip_with("_a", "_b", lambda a, b: b - a)
    pairs = both.select(array_to_vector(up).alias("features"), F.lit(1.0).alias("y"))
    pairs = pairs.unionByName(both.select(array_to_vector(down).alias("features"), F.lit(0.0).alias("y")))
    model = LogisticRegression(featuresCol="features", labelCol="y", fitIntercept=False, regParam=1e-3).fit(pairs)
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    return PipelineModel([assembler, model])


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The rows with score, the linear ranker's margin."""
    out = model.transform(df)
    return out.withColumn("score", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction")


def save(model: PipelineModel, predictions: DataFrame, metrics: DataFrame, path: str) -> None:
    """The model, the predictions as Parquet and the metrics as JSON below the path."""
    model.write().overwrite().save(f"{path}/model")
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
