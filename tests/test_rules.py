"""Golden rows, worked out by hand, of rules that SQL of the same hand could repeat wrongly, and of what has no SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tripline.functions import geo, lists, text
from tripline.operators import export, features, profiles, ranking, relational, sampling, sequences, splits
from tripline.plans import journeys, places, registry, tables
from tripline.sources import writers

DATA = "/root/testdata/sf0.001"


def test_rows_outside_the_box_are_never_test(spark):
    rows = spark.createDataFrame([(i, i % 5 == 0) for i in range(25)], "t int, inside boolean")
    found = {r.t: r.split for r in splits.rows_by_place(rows, F.col("inside"), ["t"]).collect()}
    outside = [found[i] for i in range(25) if i % 5]
    assert {found[i] for i in range(0, 25, 5)} == {"test"} and outside == ["train"] * 16 + ["val"] * 4  # 20 * 0.70 / 0.85 = 16.47


def test_services_match_if_both_flags_are_equal(spark):
    cases = [(True, True, False, False, True), (False, False, True, True, True), (True, False, True, True, False), (None, True, True, True, None), (None, True, True, False, False)]
    rows = spark.createDataFrame(
        [(a, b, c, d, False, True, i) for i, (a, b, c, d, _) in enumerate(cases)],
        "src_has_delivery boolean, dst_has_delivery boolean, src_has_takeout boolean, dst_has_takeout boolean, src_accepts_reservations boolean, dst_accepts_reservations boolean, i int",
    )
    found = features.filled(rows.withColumns(features.services()), {}).orderBy("i").collect()
    assert [r.service_match for r in found] == [c[-1] for c in cases]
    filled = features.filled(rows.withColumns(features.services()), features.FILLS_AFTER).orderBy("i").collect()
    assert filled[3].service_match is True and filled[3].dst_adds_delivery is False


def test_ndcg_counts_queries_without_positives(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 2, 0)], "q int, rank int, label int")
    r = ranking.ndcg(rows, "q", "label", 2).first()
    assert r.ndcg_at_2 == pytest.approx(0.6309297535714575 / 2) and r.n_queries == 2
    both = ranking.evaluate(rows, "q", "label", (1, 2)).first()
    assert both.recall_at_2 == 0.5 and both.mrr == 0.5 and both.ndcg_at_2 == pytest.approx(r.ndcg_at_2)


def test_groups_of_features(spark):
    expected = {
        "distance_km": "spatial", "hours_overlap": "temporal", "dst_meal_type": "temporal", "rating_diff": "quality", "is_price_upgrade": "price", "cuisine_pair_type": "category",
        "is_in_relative_results": "relationship", "dst_avg_review_length": "review_sentiment", "user_is_explorer": "user_behavior", "is_progression": "cuisine_complementarity",
        "src_is_24hr": "operating_hours", "dst_mentions_drinks": "topics", "dst_has_dinein": "service_options", "nothing": "spatial", "distance_x_dst_rating": "quality",
        "time_x_distance": "spatial", "price_x_rating": "price", "user_pref_x_dst_rating": "user_behavior", "service_match_x_time": "service_options", "relative_results_proximity": "relationship",
        "rating_ratio": "spatial", "f99": "spatial",
    }
    scores = spark.createDataFrame([(k, 1.0) for k in expected] + [("f0", 9.0)], "feature string, score double")
    found = {r.feature: r.grp for r in ranking.named_importance(scores, ["dst_price"]).collect()}
    assert found == expected | {"dst_price": "price"}
    assert ranking.top_features(ranking.named_importance(scores, ["dst_price"]), 1).first().feature == "dst_price"
    assert (len(ranking.CATEGORICAL), len(ranking.NUMERICAL), len(ranking.BOOLEAN), len(ranking.INTERACTION_MARKS)) == (6, 48, 52, 5)


def test_similarity_leaves_unknown_numbers_out(spark):
    row = spark.createDataFrame([(2.0, 4.0, None, 1.0, True, None)], "a double, b double, c double, d double, f boolean, g boolean")
    col = {c: F.col(c) for c in "abcdfg"}
    value = profiles.user_similarity({"x": col["a"], "y": col["c"], "f": col["f"], "g": col["g"]}, {"x": col["b"], "y": col["d"], "f": col["f"], "g": col["g"]}, ["x", "y"], ["f", "g"])
    assert row.select(value.alias("v")).first().v == pytest.approx((1 - 2 / 6.000001 + 2) / 3)


def test_medians_are_exact(spark):
    for values, median in (([3.0, 1.0, 2.0], 2.0), ([4.0, 1.0, 2.0, 3.0, None], 2.5), ([5.0], 5.0), ([], None)):
        assert profiles.exact_median(spark.createDataFrame([(x,) for x in values], "v double"), "v").first().median == median


def test_negatives_come_in_their_shares(spark):
    spots = [(i, 33 + i / 1000, -85.0, "ab"[i % 2], [i + 1, 90, 91, 500]) for i in range(100)] + [(i, 60.0 + i, 10.0, None, None) for i in range(200, 205)]
    p = spark.createDataFrame(spots, "id long, lat double, lon double, category string, relative_results array<long>")
    pairs = spark.createDataFrame([(k, k % 100, (k + 1) % 100) for k in range(300)] + [(1000, 200, 1)], "pair_id long, src_id long, dst_id long").withColumn("src_ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    found = sampling.hybrid_negatives(pairs, p, n=10).collect()
    by = {}
    for r in found:
        by.setdefault((r.pair_id, r.strategy), []).append(r.dst_id)
    place = {s[0]: s for s in spots}
    for k in range(300):
        src, dst = k % 100, (k + 1) % 100
        near, related, same = (by.get((k, s), []) for s in ("near", "related", "category"))
        assert len(near) == 5 and len(same) == 2 and len({*near, *related, *same}) == len(near) + len(related) + len(same)
        known = [x for x in (src + 1, 90, 91) if x != dst and x not in near and x in place]
        assert len(related) == min(3, len(known)) and set(related) <= set(known)
        assert dst not in {*near, *related, *same} and src not in {*near, *same}
        assert all(abs(place[x][1] - place[src][1]) * 111.2 <= 10.1 for x in near) and all(place[x][3] == place[src][3] for x in same)
    assert not [r for r in found if r.pair_id == 1000]  # nothing near, no list, no category
    assert len({tuple(by[k, "near"]) for k in range(0, 300, 100)}) > 1  # pairs of one source draw anew
    again = sampling.hybrid_negatives(pairs.repartition(7), p.repartition(5), n=10).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_matched_distances(spark):
    p = spark.createDataFrame([(i, 33 + i / 100, -85.0) for i in range(100)], "id long, lat double, lon double")
    pairs = spark.createDataFrame([(k, k, k + 1) for k in range(50)] + [(100 + k, k, k + 30) for k in range(50)], "pair_id long, src_id long, dst_id long")
    found = {r.pair_id: r for r in sampling.distance_matched(pairs, p).collect()}
    assert len(found) == 100 and sum(r.matched for r in found.values()) >= 95
    for k, r in found.items():
        src, dst = k % 100, (k % 100 + 1 if k < 100 else k % 100 + 30)
        assert r.neg_id not in (src, dst)
        if r.matched:
            assert r.distance_km == pytest.approx(abs(r.neg_id - src) * 1.112, rel=0.01) and (r.distance_km <= 10 if k < 100 else 10 <= r.distance_km <= 100)
        else:
            assert r.distance_km == 0.0


def test_exports_keep_places_without_metadata(spark):
    rows = spark.createDataFrame([(1, 2, 3, 1, 6.0), (1, 2, 0, 2, 5.0), (1, 2, 4, 3, 2.0), (1, 2, 9, 4, 1.0), (2, 1, 3, 1, 1.0)], "prediction_id long, source_business_idx long, dest_business_idx long, rank int, score_raw double")
    words = spark.createDataFrame([(0, "<PAD>"), (1, "<UNK>"), (2, "a"), (3, "b"), (4, "c")], "business_idx long, gmap_id string")
    spots = spark.createDataFrame([("a", "A", 33.0, -85.0, "pizza", ["pizza"], 4.0, 10, 2, False), ("b", "B", 33.0, -85.0, "pizza", ["pizza"], 4.0, 10, 2, False)],
        "gmap_id string, name string, lat double, lon double, category_main string, category_all array<string>, avg_rating double, num_reviews int, price_bucket int, is_closed boolean")
    out = export.predictions_with_places(rows, words, spots)
    assert tuple(out.columns) == export.RANK_FIRST and len(out.columns) == 34
    assert [(r.rank, r.dest_gmap_id, r.score_share, r.dest_has_metadata, r.category_pair_key) for r in out.orderBy("rank").collect()] == [(1, "b", 0.75, True, "pizza→pizza"), (2, "c", 0.25, False, "pizza→unknown")]
    assert export.predictions_with_places(rows, words, spots, include_unknown=True).where("prediction_id = 2").count() == 1
    assert tuple(export.laid_out(out, export.SOURCE_FIRST, only=True).columns) == export.SOURCE_FIRST and len(export.SOURCE_FIRST) == 30


def test_exports_of_an_id_with_several_places_equal_the_sql(spark, tmp_path):
    """A supplier's key that two rows have makes rows of equal rank."""
    for t in ("lineitem", "supplier"):
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        df = df.unionByName(df.where("s_suppkey = 1")) if t == "supplier" else df.limit(2000)
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = con.execute(registry.SQL["export_rank_first"])
    names = [c[0] for c in found.description]
    told = lambda rows: sorted(str([f"{v:.6f}" if isinstance(v, float) else v for v in r]) for r in rows)
    expected = found.fetchall()
    assert any(r[6] == 3 for r in expected)  # of the supplier that is there twice
    assert told(journeys.export_rank_first(spark, str(tmp_path)).select(*names).collect()) == told(expected)


def test_the_cache_tells_plans_and_rewritten_files_apart(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(10).write.parquet(path)

    def cached(limit):
        df = spark.read.parquet(path).where(F.col("id") < limit)
        return writers.cached(lambda: df.select("id"), str(tmp_path / "cache"), [df]).count()

    assert (cached(3), cached(7), cached(3)) == (3, 7, 3)
    spark.range(2, 12).write.mode("overwrite").parquet(path)
    assert cached(3) == 1


def test_hours_are_kept_for_the_features(spark):
    rows = journeys.venues(spark, DATA).where("hours is not null").select("hours", "is_24hr", "has_late_night").collect()
    assert any(r.hours.get("friday") == [18.0, 26.0] and r.hours["sunday"] is None and r.has_late_night for r in rows) and any(r.is_24hr for r in rows)


def test_full_features_are_all_there_and_filled(spark):
    found = journeys.full(spark, DATA)
    assert set(ranking.NUMERICAL) | set(ranking.BOOLEAN) | set(ranking.CATEGORICAL) <= set(found.columns)
    assert found.where(F.col("service_match").isNull() | F.col("user_avg_rating").isNull() | F.col("src_is_open_at_time").isNull() | F.col("topic_similarity_count").isNull()).count() == 0


def test_ranking_input(spark):
    pairs = journeys.full(spark, DATA)
    model = relational.fit_categories(pairs, list(ranking.CATEGORICAL))
    seen = relational.category_values(model, list(ranking.CATEGORICAL))
    rows, names = ranking.ranking_data(pairs, ["src_id", "src_ts"], model)
    first = rows.first()
    assert len(first.x) == len(names) == len(set(names)) == 48 + 52 + 17 + sum(map(len, seen.values())) and all(isinstance(v, float) for v in first.x)
    assert all(v and v == sorted(v) for v in seen.values()) and sum(first.x[117:]) == 6


def test_categories_of_training_apply_elsewhere(spark):
    train = spark.createDataFrame([("a", 3, None), ("b", 1, None), ("a", None, None)], "x string, y int, z string")
    model = relational.fit_categories(train, ["x", "y", "z"])
    assert relational.category_values(model, ["x", "y", "z"]) == {"x": ["a", "b"], "y": ["1", "3"], "z": []}
    plan = model._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 1 and plan.count("Exchange") == 2  # one distinct, and the numbering of its few rows


def test_retention(spark):
    before = spark.createDataFrame([(1,), (1,), (2,)], "u int")
    r = sequences.retention(before, before.where("u = 1"), "u").first()
    assert (r.n_before, r.n_after, r.n_removed, r.users_before, r.users_after, round(r.pct_left, 3)) == (3, 2, 1, 2, 1, 66.667)


def test_radius_join_finds_something(spark):
    assert places.radius_join(spark, "/root/testdata/sf0.01").count() > 100


def test_samples_and_buckets_depend_on_keys_alone(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    one, other = (sorted(r.k for r in sampling.hash_sample(df, ["k"], 20).collect()) for df in (rows, rows.repartition(7)))
    assert one == other and len(set(one)) == 20
    buckets = rows.select(lists.bucket_of(F.col("k").cast("string")).alias("b")).distinct().count()
    assert 1 < buckets <= 500
    draws = [r.d for r in rows.select(sampling.draw(F.col("k")).alias("d")).collect()]
    assert all(0 <= x < 1 for x in draws) and 0.4 < sum(draws) / 500 < 0.6


def test_cosine_of_equal_and_unlike_texts(spark):
    rows = spark.createDataFrame([("red fox runs", "red fox runs"), ("red fox runs", "blue whale swims")], "a string, b string")
    found = [r.tfidf_cosine for r in text.tfidf_cosine(rows, "a", "b").orderBy(F.desc("b")).collect()]
    assert found == pytest.approx([1.0, 0.0])


def test_cosine_takes_no_row_numbers_and_breaks_ties_by_words(spark):
    """Row numbers that a frame gives anew in each branch of a plan mixed up rows; equally frequent words were taken by chance."""
    words = ["w%02d" % i for i in range(40)]
    rows = spark.createDataFrame([(" ".join(words[::-1]), " ".join(words[:10]))], "a string, b string")
    rows = rows.union(spark.createDataFrame([("", None), ("zzz", "zzz")], "a string, b string"))
    for sides in (("a", "b"), ("b", "a")):
        found = text.tfidf_cosine(rows, *sides, features=10)
        assert "monotonically" not in found._jdf.queryExecution().optimizedPlan().toString()
        # Ten words (an empty one of two empty texts, and the first nine) are features; "zzz" is none.
        assert sorted(r.tfidf_cosine for r in found.collect()) == pytest.approx([0.0, 1.0, 1.0])


def test_ranker_prefers_what_positives_have(spark):
    rows = spark.createDataFrame([(q, int(i == 0), float(i == 0) + q / 100, 1.0) for q in range(20) for i in range(4)], "q int, label int, good double, same double")
    model = ranking.fit_pairwise(rows, "q", "label", ["good", "same"])
    best = ranking.ranked(ranking.scored(model, rows), ["q"], "score", ["good"], 1)
    assert best.where("label = 1").count() == 20


def test_distance_is_that_of_the_sphere(spark):
    km = spark.range(1).select(geo.haversine_km(F.lit(33.0), F.lit(-85.0), F.lit(34.0), F.lit(-85.0)).alias("km")).first().km
    assert km == pytest.approx(111.195, abs=0.01)


def test_percent_of_total_adds_up(spark):
    total = tables.percent_of_total(spark, DATA).agg(F.sum("pct")).first()[0]
    assert total == pytest.approx(100, abs=1e-3)
