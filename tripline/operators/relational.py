"""Small generic helpers over built-in relational operators. Every choice among rows has a tiebreaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripline.operators.ordering import numbered


def key_order(keys: list[str], descending: tuple[str, ...] = ()) -> list[Column]:
    return [F.desc(k) if k in descending else F.asc(k) for k in keys]


def two_sided(pairs: DataFrame, dim: DataFrame, key: str, left: str, right: str, columns: list[str]) -> DataFrame:
    """Left-joins the dimension's columns to both ends of the pairs, prefixed src_ and dst_."""
    for end, name in (("src", left), ("dst", right)):
        side = dim.select(F.col(key).alias(name), *[F.col(c).alias(f"{end}_{c}") for c in columns])
        pairs = pairs.join(side, name, "left")
    return pairs


def only_ids(df: DataFrame, ids: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows whose key is among the ids."""
    return df.join(ids.select(F.col(other or key).alias("_id")), F.col(key) == F.col("_id"), "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows whose key is not among the ids; rows with a null key stay."""
    return df.join(ids.select(F.col(other or key).alias("_id")), F.col(key) == F.col("_id"), "left_anti")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: object = None) -> DataFrame:
    """The table's value for the key, or the default."""
    found = df.join(table.select(key, value), key, "left")
    return found if default is None else found.withColumn(value, F.coalesce(value, F.lit(default)))


def lookup_one(df: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key; LookupError if there are none."""
    found = df.where(F.col(key) == F.lit(value))
    if found.isEmpty():
        raise LookupError(f"no row with {key} = {value!r}")
    return found


def at_least(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of keys that have at least so many rows: counts are aggregated before the join, so a hot key is no hot task."""
    enough = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return df.join(enough.select(key), key, "left_semi")


def histogram(df: DataFrame, value: Column, bounds: list[float]) -> DataFrame:
    """One row: counts of value < bounds[0], in [bounds[i], bounds[i + 1]), and >= the last."""
    edges = [None, *bounds, None]
    out = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = (F.lit(True) if lo is None else value >= lo) & (F.lit(True) if hi is None else value < hi)
        out.append(F.count_if(inside & value.isNotNull()).alias(f"bin_{i}"))
    return df.agg(*out)


def top_groups(df: DataFrame, keys: list[str], n: int, name: str = "n") -> DataFrame:
    """The n largest groups by count."""
    return df.groupBy(*keys).agg(F.count("*").alias(name)).orderBy(F.desc(name), *keys).limit(n)


def percent_of_total(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", (100.0 * F.col("n") / F.col("_total")).alias("pct"))


def dedup(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order, by an aggregate, not a window: it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    named = [F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *rest)]
    first = df.groupBy(*keys).agg(F.min(named[0]).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def row_index(df: DataFrame, keys: list[str], name: str = "row_index") -> DataFrame:
    """Dense numbers from 0 in the order of the keys; see :mod:`tripline.operators.ordering`."""
    return numbered(df, keys, name)[0]


def aligned_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both frames' rows with a's columns and types; columns that b lacks are null, those that a lacks are dropped."""
    kinds = dict(b.dtypes)
    return a.unionByName(b.select(*[(F.col(c).cast(k) if c in kinds else F.lit(None).cast(k)).alias(c) for c, k in a.dtypes]))


def known_first(df: DataFrame, order: list[str]) -> DataFrame:
    """The columns of the order that exist, then the others."""
    return df.select(*[c for c in order if c in df.columns], *[c for c in df.columns if c not in order])


def ids_of_both(df: DataFrame, a: str, b: str, name: str = "id") -> DataFrame:
    return df.select(F.col(a).alias(name)).union(df.select(F.col(b))).distinct()


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    """An int column column_value for each value; the values are those seen in training."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in values})


def seen_values(df: DataFrame, column: str, most: int = 1000) -> list:
    """The sorted distinct values of a training column; ValueError beyond ``most``."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(found)


def fit_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (as text) and place (from 0, in the order of the values): the values of all columns that a training table holds, by one
    distinct over the unpivoted columns. Nulls are no values."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    values = df.select(each.alias("x")).select("x.column", "x.value").where("value is not null").distinct()
    return values.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1)


def category_values(model: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """The values of a table made by fit_categories, by column."""
    found: dict[str, list[str]] = {c: [] for c in columns}
    for column, value in model.orderBy("column", "place").select("column", "value").collect():
        found[column].append(value)
    return found
