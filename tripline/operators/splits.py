"""Splits by time, by user and by place. No single task orders all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.operators.ordering import numbered


def _named(index: Column, n: Column, shares: tuple[float, ...], names: tuple[str, ...]) -> Column:
    total, out = 0.0, None
    for share, name in zip(shares, names, strict=False):
        total += share
        inside = index < F.floor(n * F.lit(round(total, 9)) + 1e-9)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(names[-1])


def rows_by_time(
    df: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.70, 0.15), names: tuple[str, ...] = ("train", "val", "test")
) -> DataFrame:
    """The rows with split: the first shares in the order of the keys (time, then tiebreakers), the rest the last name."""
    rows, n = numbered(df, keys, "_i")
    return rows.withColumn("split", _named(F.col("_i"), F.lit(n), shares, names)).drop("_i")


def users_by_time(
    df: DataFrame, user: str, ts: str, shares: tuple[float, ...] = (0.70, 0.15), names: tuple[str, ...] = ("train", "val", "test")
) -> DataFrame:
    """All rows of a user share the split that the user's last visit has among all users'."""
    last = df.groupBy(user).agg(F.max(ts).alias("_last"))
    return df.join(rows_by_time(last, ["_last", user], shares, names).select(user, "split"), user)


def rows_by_place(df: DataFrame, inside: Column, keys: list[str], shares: tuple[float, float] = (0.70, 0.15)) -> DataFrame:
    """Rows that the box holds are test, and no others. The rest is split by time in train and val, in the proportion of the shares."""
    here = F.coalesce(inside, F.lit(False))
    rest = rows_by_time(df.where(~here), keys, (shares[0] / sum(shares),), ("train", "val"))
    return rest.unionByName(df.where(here).withColumn("split", F.lit("test")))


def users_by_place(df: DataFrame, user: str, ts: str, inside: Column, share: float = 0.85) -> DataFrame:
    """Users with any visit in the box are test; the others are split in train and val by their last visit."""
    flagged = df.groupBy(user).agg(F.max(F.coalesce(inside, F.lit(False)).cast("int")).alias("_in"), F.max(ts).alias("_last"))
    out = rows_by_time(flagged.where("_in = 0"), ["_last", user], (share,), ("train", "val")).select(user, "split")
    out = out.unionByName(flagged.where("_in = 1").select(user, F.lit("test").alias("split")))
    return df.join(out, user)


def report(df: DataFrame, ts: str, label: Column | None = None) -> DataFrame:
    """Rows, first and last time, and positive rows of each split."""
    extra = [F.count_if(label).alias("positives")] if label is not None else []
    return df.groupBy("split").agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), *extra)
