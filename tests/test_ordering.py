"""Numbers in the order of keys, and order statistics, on more rows than a range sampler holds, with columns pruned."""

import datetime as dt
import random
import statistics
from math import inf, isnan, nan

import pytest
from pyspark.sql import functions as F

from tripline.operators import ordering, relational, splits

EVENTS = "/root/testdata/sf0.01/events.parquet"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(EVENTS)


def test_split_counts_hold_whatever_is_pruned(spark, events):
    rows = splits.rows_by_time(events, ["ts", "event_id"])
    n = events.count()
    cuts = [int(n * 0.7), int(n * 0.85)]
    expected = {"train": cuts[0], "val": cuts[1] - cuts[0], "test": n - cuts[1]}
    for columns in (["split"], ["split", "event_id"], ["split", "ts", "value"], rows.columns):
        assert dict(rows.select(*columns).groupBy("split").count().collect()) == expected
    report = splits.report(rows, "ts", F.col("value") > 50)
    assert {r.split: r.n for r in report.collect()} == expected


def test_numbers_follow_the_keys(spark, events):
    rows = relational.row_index(events, ["ts", "event_id"])
    found = [r.event_id for r in rows.select("event_id", "row_index").orderBy("row_index").collect()]
    assert found == [r.event_id for r in events.orderBy("ts", "event_id").select("event_id").collect()]
    assert rows.agg(F.count_distinct("row_index")).first()[0] == rows.agg(F.max("row_index")).first()[0] + 1 == len(found)


def test_plan_has_one_exchange_and_no_join(spark, events):
    found = relational.row_index(events, ["ts", "event_id"]).select("row_index")._jdf.queryExecution().executedPlan().toString()
    assert found.count("Exchange hashpartitioning") == 1 and "Join" not in found and "rangepartitioning" not in found


@pytest.mark.parametrize("kind", ["long", "string", "timestamp", "timestamp_ntz", "date", "decimal(9,2)", "float", "binary"])
def test_keys_of_all_kinds_with_nulls_and_ties(spark, kind):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 7 != 0, F.timestamp_micros(F.col("id") % 40 * 86_400_000_123)).alias("t"), F.col("id") % 40 - 20, "id"
    ).toDF("t", "k", "id")
    key = {"timestamp": F.col("t"), "timestamp_ntz": F.col("t").cast("timestamp_ntz"), "date": F.col("t").cast("date")}.get(kind)
    key = F.when(F.col("t").isNotNull(), F.col("k").cast("string").cast(kind)) if key is None else key
    rows = rows.select(key.alias("k"), "id")
    found = [r.id for r in relational.row_index(rows, ["k", "id"]).orderBy("row_index").collect()]
    assert found == [r.id for r in rows.orderBy("k", "id").collect()]


def test_equal_rows_and_empty_tables(spark):
    same = spark.range(2500).select(F.lit(1).alias("k"))
    assert sorted(r.row_index for r in relational.row_index(same, ["k"]).collect()) == list(range(2500))
    assert relational.row_index(same.where("k > 1"), ["k"]).count() == 0
    assert splits.rows_by_time(same.where("k > 1"), ["k"]).count() == 0


def test_order_statistics_of_hard_columns(spark, monkeypatch):
    monkeypatch.setattr(ordering, "FETCHED", 16)
    monkeypatch.setattr(ordering, "CELLS", 32)
    draw = random.Random(5)
    columns = {
        "even": [draw.random() for _ in range(3000)],
        "far": [draw.choice((1e-300, 1e300, -1e300, 1.0)) * draw.random() for _ in range(3000)],
        "ties": [float(draw.choice((1, 1, 1, 2, 5))) for _ in range(3000)],
        "close": [1 + draw.randrange(500) * 2**-52 for _ in range(3000)],
        "endless": [draw.choice((inf, -inf, draw.gauss(0, 1))) for _ in range(3000)],
        "huge": [draw.uniform(-1.7e308, 1.7e308) for _ in range(3000)],
        "nulls": [draw.gauss(0, 1) if i % 3 else None for i in range(3000)],
        "none": [None] * 3000,
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns))
    found = ordering.order_statistics(df, list(columns), lambda n: [0, (n - 1) // 2, n // 2, n - 1] if n else [])
    for c, values in columns.items():
        v = sorted(x for x in values if x is not None)
        n = len(v)
        assert found[c] == ([v[0], v[(n - 1) // 2], v[n // 2], v[-1]] if n else [])
    assert ordering.medians(df, ["ties", "even"]) == {"ties": 1.0, "even": statistics.median(columns["even"])}


def test_nan_is_the_largest(spark):
    df = spark.createDataFrame([(x,) for x in (nan, 1.0, nan, 2.0, nan)], "v double")
    low, middle = ordering.order_statistics(df, ["v"], lambda n: [0, n // 2])["v"]
    assert low == 1.0 and isnan(middle)


def test_dates_of_literals(spark):
    bounds = ordering.range_bounds(spark.range(5000).select(F.expr("date_add(date'2024-01-01', cast(id as int))").alias("d")), ["d"], 4)
    assert 1 <= len(bounds) <= 3
    some = spark.range(1).select(*[b.getField("d").alias(f"b{i}") for i, b in enumerate(bounds)]).first()
    assert list(some) == sorted(some) and isinstance(some[0], dt.date)
