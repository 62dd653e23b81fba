"""Places drawn around a source, and places of a fitting distance, against brute force on dense and sparse cells."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tripline.operators import sampling
from tripline.operators.geo_join import distance_band


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


@pytest.fixture(scope="module")
def spots():
    """A dense spot just beyond the circle of a lone place, a cluster, far places, one beyond the latitudes' cosine, and places without position."""
    draw = random.Random(1)
    out = [(0, 33.0, -85.0), (1, 33.05, -85.0)]
    out += [(10 + i, 33.0 + draw.uniform(-0.005, 0.005), -84.885 + draw.uniform(0, 0.004)) for i in range(600)]
    out += [(1000 + i, 40.0 + draw.gauss(0, 0.05), -90.0 + draw.gauss(0, 0.05)) for i in range(150)]
    out += [(2000 + i, draw.uniform(-50, 50), draw.uniform(-170, 170)) for i in range(40)]
    return [*out, (3000, 59.0, 10.0), (3001, 59.0, 10.17), (3002, 59.08, 10.0)]


@pytest.mark.parametrize("waves", [(8, 32, 100), (1,), (2, 5)])
def test_near_draws_are_whole(spark, spots, waves):
    places = spark.createDataFrame([*spots, (4000, None, None)], "id long, lat double, lon double")
    draw = random.Random(2)
    ids = [s[0] for s in spots]
    rows = [(i, src, draw.choice(ids)) for i, src in enumerate([0, 1, 0, 3000, 3001, *draw.choices(ids, k=150)])]
    at = {s[0]: s for s in spots}
    pairs = spark.createDataFrame([(p, s, d, at[s][1], at[s][2]) for p, s, d in rows], "pair_id long, src_id long, dst_id long, src_lat double, src_lon double")
    found = {r.pair_id: r for r in sampling.near_draws(pairs, places, 3, 10.0, waves=waves).collect()}
    assert len(found) == len(rows)
    for p, s, d in rows:
        fit = {x for x in ids if x not in (s, d) and km(at[s], at[x]) <= 10}
        got = found[p].drawn
        assert len(got) == len(set(got)) == min(3, len(fit)) and set(got) <= fit


def test_draws_are_even(spark):
    places = spark.createDataFrame([(i, 33.0 + i % 5 / 100, -85.0 + i // 5 / 100) for i in range(20)], "id long, lat double, lon double")
    pairs = spark.range(4000).select(F.col("id").alias("pair_id"), F.lit(0).cast("long").alias("src_id"), F.lit(1).cast("long").alias("dst_id"), F.lit(33.0).alias("src_lat"), F.lit(-85.0).alias("src_lon"))
    counts = dict(sampling.near_draws(pairs, places, 2, 10.0).select(F.explode("drawn").alias("x")).groupBy("x").count().collect())
    assert set(counts) == set(range(2, 20)) and max(counts.values()) < 1.3 * min(counts.values())


def test_matched_distances(spark, spots):
    at = {s[0]: s for s in spots}
    places = spark.createDataFrame(spots, "id long, lat double, lon double")
    draw = random.Random(3)
    rows = [(i, *draw.sample(sorted(at), 2)) for i in range(120)]
    pairs = spark.createDataFrame(rows, "pair_id long, src_id long, dst_id long")
    found = {r.pair_id: r for r in sampling.distance_matched(pairs, places, attempts=40).collect()}
    assert len(found) == len(rows)
    one_wave = {r.pair_id: r for r in sampling.distance_matched(pairs, places, attempts=40, waves=()).collect()}
    assert found == one_wave
    for p, s, d in rows:
        r = found[p]
        assert r.neg_id not in (s, d)
        if r.matched:
            assert r.distance_km == pytest.approx(km(at[s], at[r.neg_id]))
    fits = spark.createDataFrame([(km(at[s], at[d]), found[p].distance_km) for p, s, d in rows if found[p].matched], "a double, b double")
    assert fits.where(~distance_band(F.col("a"), F.col("b"))).count() == 0
    assert sum(r.matched for r in found.values()) > 20
