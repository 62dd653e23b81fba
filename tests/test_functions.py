"""Golden rows for the column functions and invariants of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tripline.functions import geo, lists, text
from tripline.functions import time as t
from tripline.operators import export, ranking, relational, sampling, sequences, splits


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def hours(*pairs):
    return F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in pairs]) if pairs else F.lit(None).cast("array<array<string>>")


@pytest.mark.parametrize(
    ("given", "parsed", "days", "avg", "late", "whole", "weekend"),
    [
        ((), None, None, None, False, False, False),
        ((("Monday", "8:30AM–9:30PM"),), {"monday": [8.5, 21.5]}, 1, 13.0, False, False, False),
        ((("Saturday", "6PM–2AM"),), {"saturday": [18.0, 26.0]}, 1, 8.0, True, False, True),
        ((("Monday", "Open 24 hours"),), {"monday": [0.0, 24.0]}, 1, 24.0, False, True, False),
        ((("Monday", "11AM–12AM"),), {"monday": [11.0, 24.0]}, 1, 13.0, True, False, False),
        ((("Sunday", "Closed"),), {"sunday": None}, 0, 0.0, False, False, True),
        ((("Monday", "8–10PM"),), None, None, None, False, False, False),
        ((("Monday", "8AM–9AM"), ("Monday", "10AM–12PM")), {"monday": [10.0, 12.0]}, 2, 1.5, False, False, False),
    ],
)
def test_parse_hours(spark, given, parsed, days, avg, late, whole, weekend):
    h = one(spark, t.parse_hours(hours(*given)))
    assert (h["parsed"], h["days_open"], h["avg_hours"]) == (parsed, days, avg)
    assert (h["late_night"], h["open_24h"], h["weekend_only"]) == (late, whole, weekend)


@pytest.mark.parametrize(
    ("given", "hour", "open_"),
    [((), 3, True), ((("Monday", "9AM-5PM"),), 3, True), ((("Sunday", "Closed"),), 12, False), ((("Sunday", "8:30AM–9:30PM"),), 8, False),
     ((("Sunday", "8:30AM–9:30PM"),), 21, True), ((("Sunday", "6PM–2AM"),), 1, True), ((("Sunday", "6PM–2AM"),), 3, False)],
)
def test_open_at(spark, given, hour, open_):
    assert one(spark, t.open_at(t.parse_hours(hours(*given))["parsed"], F.lit("sunday"), F.lit(hour))) is open_


@pytest.mark.parametrize(
    ("a", "b", "both"),
    [("8AM–12PM", "12PM–8PM", False), ("8AM–1PM", "12PM–8PM", True), ("Closed", "8AM–9AM", False)],
)
def test_hours_overlap(spark, a, b, both):
    x, y = (t.parse_hours(hours(("Monday", v)))["parsed"] for v in (a, b))
    assert one(spark, t.hours_overlap(x, y)) is both


@pytest.mark.parametrize(
    ("point", "name"), [((1, 0), "N"), ((0, 1), "E"), ((-1, 0), "S"), ((0, -1), "W"), ((0.01, 0.01), "NE"), ((0, 0), "N")]
)
def test_bearing(spark, point, name):
    assert one(spark, geo.bearing8(F.lit(0.0), F.lit(0.0), *[F.lit(float(x)) for x in point])) == name


def test_distance(spark):
    assert one(spark, geo.haversine_km(*[F.lit(float(x)) for x in (0, 0, 0, 1)])) == pytest.approx(111.195, abs=1e-3)
    assert one(spark, geo.haversine_km(F.lit(None).cast("double"), *[F.lit(1.0)] * 3)) is None


@pytest.mark.parametrize(
    ("raw", "families", "main"),
    [(["Restaurant", "Sushi restaurant"], ["restaurant", "sushi"], "sushi"), (["Hair salon"], ["other"], None),
     (["Donut shop", "Bakery"], ["dessert", "bakery"], "bakery"), (None, [], None)],
)
def test_families(spark, raw, families, main):
    found = text.category_families(F.lit(None).cast("array<string>") if raw is None else F.array(*[F.lit(x) for x in raw]))
    assert one(spark, found) == families
    assert one(spark, text.main_family(found)) == main


@pytest.mark.parametrize(
    ("name", "group"),
    [("Tony's Pizza", "pizza"), ("Pancake House", "breakfast"), ("Main Street Grill", "bar"), ("Magpie Diner", "pizza"), ("Zzz", "other")],
)
def test_name_groups(spark, name, group):
    assert one(spark, text.first_keyword_group(F.lit(name))) == group


def test_polarity_and_topics(spark):
    assert one(spark, text.polarity(F.lit("Good good food, bad service and great wine"))) == pytest.approx(1 / 3)
    assert one(spark, text.polarity(F.lit(None).cast("string"))) is None
    assert one(spark, text.topic_flags(F.lit("cheap wine"))).asDict() == {
        "dessert": False, "drinks": True, "service": False, "atmosphere": False, "price": True,
    }


def test_loose_values(spark):
    assert [one(spark, lists.loose_bool(F.lit(x))) for x in ("Yes", "1", " t ", "0", "no", "maybe")] == [True, True, True, False, False, None]
    assert [one(spark, lists.loose_long(F.lit(x))) for x in ("3.9", "-3.9", "", "x")] == [3, -3, None, None]


def test_pairs_and_windows(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, "A"), (1, at + dt.timedelta(minutes=6), "B"), (1, at + dt.timedelta(hours=10), "C"), (1, at + dt.timedelta(days=9), "D"), (2, at, "A"), (2, at, "B")]
    visits = spark.createDataFrame(rows, "user long, ts timestamp_ntz, item string")

    def found(above):
        return {(r.src_item, r.dst_item) for r in sequences.consecutive_pairs(visits, "user", "ts", ["item"], ["item"], above).collect()}

    assert found(0.0) == {("A", "B"), ("B", "C")}
    assert found(0.2) == {("B", "C")}
    tokens = spark.createDataFrame([(1, i, x) for i, x in enumerate([5, 6, 1, 7, 8])] + [(2, 0, 9)], "user long, at int, token int")
    windows = sequences.trailing_windows(tokens, "user", ["at"], "token", 3).collect()
    assert sorted((r.input_seq, r.target, r.seq_len) for r in windows) == [([0, 0, 5], 6, 1), ([0, 5, 6], 1, 2), ([5, 6, 1], 7, 3), ([6, 1, 7], 8, 3)]


def test_score_stats(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.3), (1, 3, 0.2)], "key int, rank int, score double")
    out = export.score_stats(rows, "key", top_k=2).orderBy("rank").collect()
    assert [(r.share, r.cum_share, r.z) for r in out] == [(0.5, 0.5, 1.336306), (0.3, 0.8, -0.267261)]
    again = export.restated(export.score_stats(rows, "key", top_k=2), "key").orderBy("rank").collect()
    assert [(r.share, r.cum_share) for r in again] == [(0.625, 0.5), (0.375, 0.8)]


def test_softmax(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, None), (1, 1.0)], "key int, score double")
    out = rows.select("score", export.softmax("key").alias("p")).collect()
    assert {r.score: r.p and round(r.p, 6) for r in out} == {2.0: 0.731059, None: None, 1.0: 0.268941}


def test_ranking_metrics(spark):
    rows = [("q1", 1, 1), ("q1", 2, 0), ("q2", 1, 0), ("q2", 4, 1), ("q3", 1, 0)]
    m = ranking.recall_mrr(spark.createDataFrame(rows, "q string, rank int, label int"), "q", "label").first()
    assert (round(m.recall_at_1, 6), round(m.recall_at_5, 6), m.mrr) == (0.333333, 0.666667, 0.625)


def test_splits_do_not_depend_on_partitions(spark):
    rows = spark.range(0, 1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("ts"))
    whole = {r.id: r.split for r in splits.rows_by_time(rows, ["ts", "id"]).collect()}
    assert {r.id: r.split for r in splits.rows_by_time(rows.repartition(7), ["ts", "id"]).collect()} == whole
    assert [sum(v == s for v in whole.values()) for s in ("train", "val", "test")] == [700, 150, 150]


def test_sampling_is_stable(spark):
    rows = spark.range(0, 500)
    first = {r.id for r in sampling.hash_sample(rows, ["id"], 50).collect()}
    assert first == {r.id for r in sampling.hash_sample(rows.repartition(9), ["id"], 50).collect()}
    assert len(first) == 50


def test_row_index_is_dense(spark):
    rows = spark.range(0, 777).repartition(5)
    out = relational.row_index(rows, ["id"]).collect()
    assert all(r.id == r.row_index for r in out) and len(out) == 777


def test_lookup_error(spark):
    with pytest.raises(LookupError):
        relational.lookup_one(spark.range(3), "id", 9)
