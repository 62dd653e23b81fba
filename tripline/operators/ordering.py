"""Order over whole tables without a sort of them in one task: dense numbers by stated ranges, and exact order statistics by
counting.

Dense numbers: bounds of key ranges, taken once from a random sample, stand in the plan as literals. A row's range is its keys'
position among them, the ranges' counts give each range's first number, and a window numbers the rows within a range. All of this depends on
keys and literals alone, so that it stays right whatever other columns are pruned and however partitions are dealt.

Order statistics: values are counted in cells between the least and the largest one; the cell that holds the wanted rank is
divided again, until few values are left, which are then fetched. Rows are neither sorted nor shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import inf, nan

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType, TimestampType

#: Sampled rows for each range; cells of a pass; values of a column that are fetched at most.
SAMPLED, CELLS, FETCHED = 32, 4096, 4096


def _told(column: str, kind: DataType) -> Column:
    """The column in a form that a literal gives back exactly."""
    if isinstance(kind, TimestampType):
        return F.unix_micros(column)
    return F.col(column).cast("string") if isinstance(kind, TimestampNTZType) else F.col(column)


def _literal(value: object, kind: DataType) -> Column:
    if isinstance(kind, TimestampType) and value is not None:
        return F.timestamp_micros(F.lit(value))
    return F.lit(value).cast(kind)


def range_bounds(df: DataFrame, keys: list[str], ranges: int) -> list[Column]:
    """At most ranges - 1 ascending key structs that divide the rows about evenly; one pass over the keys."""
    kinds = [df.schema[k].dataType for k in keys]
    sample = df.select(*keys).orderBy(F.rand(7)).limit(SAMPLED * ranges).orderBy(*keys)
    rows = sample.select(*[_told(k, t).alias(k) for k, t in zip(keys, kinds, strict=True)]).collect()
    picked = dict.fromkeys(tuple(r) for r in rows[SAMPLED::SAMPLED])
    return [F.struct(*[_literal(v, t).alias(k) for v, t, k in zip(r, kinds, keys, strict=True)]) for r in picked]


def position(keys: list[str], bounds: list[Column]) -> Column:
    """How many of the ascending bounds are below the keys, by binary search; nulls are the least."""
    if not bounds:
        return F.lit(0)
    table, key = F.array(*bounds), F.struct(*keys)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    below = lambda at: F.coalesce(F.get(table, at - 1) < key, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(below(at + step), at + step).otherwise(at))


def numbered(df: DataFrame, keys: list[str], name: str = "row_index") -> tuple[DataFrame, int]:
    """The rows with dense numbers from 0 in the order of the keys, and how many there are. Two passes over the keys come before."""
    ranges = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = position(keys, range_bounds(df, keys, ranges))
    counts = dict(df.select(*keys).groupBy(at.alias("_at")).agg(F.count("*")).collect())
    first, total = {}, 0
    for i in sorted(counts):
        first[i], total = total, total + counts[i]
    starts = F.array(*[F.lit(first.get(i, 0)).cast("long") for i in range(max(first, default=0) + 1)])
    within = F.row_number().over(Window.partitionBy("_at").orderBy(*keys))
    out = df.withColumn("_at", at).withColumn(name, within + F.get(starts, F.col("_at")) - 1)
    return out.drop("_at"), total


@dataclass
class _Span:
    """Values of a column from lo to hi, ``count`` of them, with ``before`` lower ones; and the wanted ranks among them."""

    column: int
    lo: float
    hi: float
    before: int
    count: int
    ranks: list[int]


def _scaled(v: Column, log: bool) -> Column:
    """A number that never falls as v rises, finite for all v."""
    if not log:
        return v / 4
    return F.when(v == inf, 1000.0).when(v == -inf, -1000.0).otherwise(F.signum(v) * F.log1p(F.abs(v)))


def _cells(df: DataFrame, columns: list[str], spans: list[_Span], log: bool) -> list[_Span]:
    """The cells of the spans that hold wanted ranks."""
    each = []
    for i, s in enumerate(spans):
        v = F.col(columns[s.column]).cast("double")
        lo, hi = _scaled(F.lit(s.lo), log), _scaled(F.lit(s.hi), log)
        cell = F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor((_scaled(v, log) - lo) / (hi - lo) * CELLS).cast("int")))
        each.append(F.when((v >= s.lo) & (v <= s.hi), F.struct(F.lit(i).alias("i"), cell.alias("cell"), v.alias("v"))))
    rows = df.select(F.explode(F.array_compact(F.array(*each))).alias("x")).groupBy("x.i", "x.cell")
    found = rows.agg(F.count("*").alias("n"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi")).orderBy("i", "cell").collect()
    out, now, before = [], -1, 0
    for i, _, n, lo, hi in found:
        if i != now:
            now, before = i, spans[i].before
        if ranks := [r for r in spans[i].ranks if before <= r < before + n]:
            out.append(_Span(spans[i].column, lo, hi, before, n, ranks))
        before += n
    return out


def order_statistics(df: DataFrame, columns: list[str], ranks: Callable[[int], list[int]]) -> dict[str, list[float]]:
    """Of each column the values (as doubles) at the ranks, counted from 0, that ranks gives for the number of values; nulls are none, NaN is
    the largest. All columns are counted in the same passes: one for the extremes, one for the last few values, and mostly none or one between."""
    v = [F.col(c).cast("double") for c in columns]
    ends = df.agg(*[f(F.when(~F.isnan(x), x)) for x in v for f in (F.count, F.min, F.max)], *[F.count(x) for x in v]).first()
    wanted, found, spans = [], {}, []
    for i in range(len(columns)):
        n, lo, hi = ends[3 * i : 3 * i + 3]
        wanted.append(ranks(ends[3 * len(columns) + i]))
        found |= {(i, r): nan for r in wanted[i] if r >= n}
        if real := sorted({r for r in wanted[i] if r < n}):
            spans.append(_Span(i, lo, hi, 0, n, real))
    last, log = [], True
    while spans:
        for s in spans:
            if s.lo == s.hi:
                found |= {(s.column, r): s.lo for r in s.ranks}
        last += [s for s in spans if s.lo < s.hi and s.count <= FETCHED]
        spans = [s for s in spans if s.lo < s.hi and s.count > FETCHED]
        if spans:
            spans, log = _cells(df, columns, spans, log or any(abs(x) == inf for s in spans for x in (s.lo, s.hi))), not log
    if last:
        each = [F.when((v[s.column] >= s.lo) & (v[s.column] <= s.hi), F.struct(F.lit(i).alias("i"), v[s.column].alias("v"))) for i, s in enumerate(last)]
        values: list[list[float]] = [[] for _ in last]
        for i, x in df.select(F.inline(F.array_compact(F.array(*each)))).collect():
            values[i].append(x)
        for s, xs in zip(last, values, strict=True):
            xs.sort()
            found |= {(s.column, r): xs[r - s.before] for r in s.ranks}
    return {c: [found[i, r] for r in wanted[i]] for i, c in enumerate(columns)}


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The middle value of each column, or the mean of both; None where all is null."""
    found = order_statistics(df, columns, lambda n: [(n - 1) // 2, n // 2] if n else [])
    return {c: (x[0] + x[1]) / 2 if x else None for c, x in found.items()}
