"""Visit sequences, consecutive pairs, transitions and trailing windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripline.functions.time import hours_between
from tripline.operators.relational import at_least


def sequence(visits: DataFrame, user: str, ts: str, tie: list[str]) -> DataFrame:
    """The visits with seq_idx, their 1-based place among the user's."""
    return visits.withColumn("seq_idx", F.row_number().over(Window.partitionBy(user).orderBy(ts, *tie)))


def consecutive_pairs(
    visits: DataFrame, user: str, ts: str, tie: list[str], columns: list[str], above: float = 0.0, until: float = 168.0
) -> DataFrame:
    """Each visit with the user's next one: src_ and dst_ columns, and delta_hours in (above, until].

    All leads share one window, so there is one shuffle and one sort.
    """
    w = Window.partitionBy(user).orderBy(ts, *tie)
    wanted = list(dict.fromkeys([ts, *columns]))
    pairs = visits.select(
        F.col(user), *[F.col(c).alias(f"src_{c}") for c in wanted], *[F.lead(c, 1).over(w).alias(f"dst_{c}") for c in wanted]
    )
    delta = hours_between(F.col(f"src_{ts}"), F.col(f"dst_{ts}"))
    pairs = pairs.withColumn("delta_hours", delta)
    return pairs.where((F.col("delta_hours") > above) & (F.col("delta_hours") <= until))


def user_sequences(reviews: DataFrame, places: DataFrame) -> DataFrame:
    """The reviews (user_id, item, ts, rating, tie) of known places (id, category, lat, lon) as visits in the users' order."""
    rows = reviews.join(places.select(F.col("id").alias("item"), "category", "lat", "lon"), "item")
    return sequence(rows, "user_id", "ts", ["tie"]).select("user_id", "seq_idx", "item", "ts", "category", "lat", "lon", "rating", "tie")


def retention(before: DataFrame, after: DataFrame, user: str | None = None) -> DataFrame:
    """One row: how many rows (and users) there were, are left and are gone, and the share left in percent."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(f"n_{name}"), *([F.count_distinct(user).alias(f"users_{name}")] if user else []))

    out = counts(before, "before").crossJoin(F.broadcast(counts(after, "after")))
    return out.withColumns({"n_removed": F.col("n_before") - F.col("n_after"), "pct_left": F.try_divide(100.0 * F.col("n_after"), F.col("n_before"))})


def transitions(pairs: DataFrame, src: str, dst: str) -> DataFrame:
    """How often src is followed by dst, and that count's share of src's (a first-order next-item scorer)."""
    counts = pairs.groupBy(src, dst).agg(F.count("*").alias("n"))
    totals = counts.groupBy(src).agg(F.sum("n").alias("_total"))
    return counts.join(totals, src).withColumn("probability", F.col("n") / F.col("_total")).drop("_total")


def frequent_users(visits: DataFrame, user: str, least: int = 5) -> DataFrame:
    return at_least(visits, user, least)


def trailing_windows(
    tokens: DataFrame, user: str, order: list[str], token: str, length: int = 20, keep: tuple[str, ...] = ()
) -> DataFrame:
    """For every item but a user's first: the up to ``length`` items before it, padded with 0 at the left, the item itself as target,
    and seq_len, how many items are real. Tokens must not be null: unknown ones are 1."""
    w = Window.partitionBy(user).orderBy(*order)
    past = F.collect_list(F.col(token).cast("long")).over(w.rowsBetween(-length, -1))
    rows = tokens.select(user, *keep, past.alias("_past"), F.col(token).cast("long").alias("target")).where(F.size("_past") > 0)
    pad = F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("_past"))
    return rows.select(user, *keep, F.concat(pad, "_past").alias("input_seq"), "target", F.size("_past").alias("seq_len"))


def latest_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the order; Spark limits the groups before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")
