"""Places that share their coordinates: joins take a distance once for two spots, and lose no pair of their rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tripline.operators import geo_join, sampling
from tripline.plans import journeys, places

SCHEMA = "id long, lat double, lon double, kind string"


def joined_rows(df):
    """The rows that the joins of a collected frame gave out, all together."""
    df.collect()

    def total(node):
        if node.getClass().getSimpleName().startswith("AdaptiveSparkPlan"):
            return total(node.executedPlan())
        own = node.metrics().apply("numOutputRows").value() if "Join" in node.nodeName() else 0
        below = node.plan() if "QueryStage" in node.getClass().getSimpleName() else None
        children = node.children()
        return own + (total(below) if below is not None else sum(total(children.apply(i)) for i in range(children.size())))

    return total(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def rows():
    """Three spots of many rows, near each other in part, single places around them, and some without position."""
    draw = random.Random(3)
    out = [(i, 33.0 + i % 3 * 0.06, -85.0, "spot") for i in range(150)]
    out += [(500 + i, 33.0 + draw.uniform(-0.3, 0.3), -85.0 + draw.uniform(-0.3, 0.3), None) for i in range(60)]
    return [*out, (900, None, -85.0, "x"), (901, 33.0, None, "x")]


@pytest.mark.parametrize("block", [7, 1024])
def test_joins_tell_every_pair(spark, rows, monkeypatch, block):
    monkeypatch.setattr(geo_join, "BLOCK", block)
    a = spark.createDataFrame(rows, SCHEMA)
    b = a.where("id % 4 > 0").select("id", "lon", "kind", "lat")
    both = a.select(*[F.col(c).alias(f"src_{c}") for c in a.columns]).crossJoin(b.select(*[F.col(c).alias(f"dst_{c}") for c in b.columns])).where("src_id <> dst_id")
    km = geo_join.haversine_km(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))
    expected = both.withColumn("distance_km", km).where("distance_km <= 10")
    found = geo_join.radius_join(a, b, "id", 10.0)
    assert found.columns == expected.columns and sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    squared = F.pow(F.col("dst_lat") - F.col("src_lat"), 2) + F.pow(F.col("dst_lon") - F.col("src_lon"), 2)
    expected = both.withColumn("sq_deg", squared).where("sq_deg < 0.01")
    assert sorted(map(str, geo_join.degree_join(a, b, "id", 0.01).collect())) == sorted(map(str, expected.collect()))


@pytest.mark.parametrize("join", [lambda p: geo_join.radius_join(p, p, "id", 10.0), lambda p: geo_join.degree_join(p, p, "id")])
def test_a_spot_is_joined_as_one(spark, join):
    p = spark.range(300).select("id", F.lit(33.0).alias("lat"), F.lit(-85.0).alias("lon"))
    found = join(p)
    assert joined_rows(found) < 1000 and found.count() == 300 * 299


def test_nearest_are_those_of_all_pairs(spark, rows):
    a = spark.createDataFrame(rows, SCHEMA)
    w = Window.partitionBy("src_id").orderBy("sq_deg", "dst_id")
    expected = geo_join.degree_join(a, a, "id", 0.01).withColumn("r", F.row_number().over(w)).where("r <= 4").select("src_id", "dst_id", "sq_deg")
    assert sorted(geo_join.nearest(a, a, "id", 4, 0.01).collect()) == sorted(expected.collect())


def test_candidates_list_no_spot(spark, tmp_path):
    """4,000 suppliers at 200 spots: joins give out rows in their number, not in that of their pairs (510,000)."""
    spark.range(4000).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name"), (F.col("id") % 97).cast("double").alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    assert joined_rows(places.candidate_union(spark, str(tmp_path))) < 200_000


@pytest.mark.parametrize("rounded", [0.001, 0.5])
def test_contenders_hold_the_best_of_any_list(spark, rounded):
    draw = random.Random(4)
    held = [(i, draw.choice(["a", "b", None]), draw.choice([1.0, 2.0, 2.0 + rounded / 3, 3.0, None])) for i in range(300)]
    rows = spark.createDataFrame(held, "id long, g string, v double")
    kept = {r.id for r in sampling.contenders(rows, ["g"], "v", "id", 4, rounded).collect()}
    for g in ("a", "b", None):
        own = [r for r in held if r[1] == g]
        for digits in (1, rounded):
            best = sorted(own, key=lambda r: (r[2] is None, -round((r[2] or 0) / digits) if digits == rounded else -(r[2] or 0), r[0]))[:4]
            assert {r[0] for r in best} <= kept
    assert len(kept) < 60


def test_scored_transitions_share_lists(spark, tmp_path, monkeypatch):
    """Copies of suppliers that the score does not tell apart: the pairs that are scored don't grow with the square of the suppliers."""
    seen = []
    whole = sampling.synthetic_pairs
    monkeypatch.setattr(sampling, "synthetic_pairs", lambda given, *rest: seen.append(given) or whole(given, *rest))
    for n, copies in ((1, 1), (2, 12)):
        rows = spark.range(60).join(spark.range(copies).withColumnRenamed("id", "copy"))
        rows.select((F.col("id") + 4200 * 11 * 41 * F.col("copy")).alias("s_suppkey"), F.lit("s").alias("s_name")).write.parquet(f"{tmp_path}/{n}/supplier.parquet")
        assert journeys.transition_matrix_scored(spark, f"{tmp_path}/{n}").count() > 0
    one, twelve = (x.count() for x in seen)
    assert twelve <= 7 * one
