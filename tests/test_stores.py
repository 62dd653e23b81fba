"""What is stored: compressed rows, the serving layout, the cache, and the choice of an input."""

import gzip
import random
import threading

import pytest
from pyspark.sql import functions as F

from tripline.operators import csr, export
from tripline.sources import readers, serving, writers


@pytest.fixture
def edges(spark):
    draw = random.Random(4)
    found = {(f"s{draw.randrange(40)}", f"d{draw.randrange(60)}"): draw.random() for _ in range(500)} | {("hot", f"d{i}"): float(i) for i in range(60)} | {("s1", "only dst"): 2.0}
    return spark.createDataFrame([(a, b, v) for (a, b), v in found.items()], "a string, b string, v double")


def test_compressed_rows(spark, edges, tmp_path, monkeypatch):
    monkeypatch.setattr(csr, "CHUNK", 16)
    monkeypatch.setattr(csr, "BLOCK", 8)
    matrix = csr.write_csr(edges, "a", "b", "v", f"file://{tmp_path}/m")
    coo, ids = export.coo_matrix(edges, "a", "b", "v")
    want = sorted(map(tuple, coo.collect()))
    again = csr.CsrMatrix.open(spark, f"file://{tmp_path}/m")
    assert sorted(map(tuple, again.coo().collect())) == want and (matrix.rows, matrix.entries) == (ids.count(), len(want))
    index = dict(map(tuple, again.ids().collect()))
    assert index == dict(map(tuple, ids.collect()))
    pointers = sorted(map(tuple, again.pointers().collect()))
    assert [p[0] for p in pointers] == list(range(len(index))) and all(a[2] == b[1] for a, b in zip(pointers, pointers[1:], strict=False)) and pointers[-1][2] == len(want)
    for source in ("hot", "s1", "only dst"):
        assert sorted(map(tuple, again.row(source).collect())) == [(c, v) for r, c, v in want if r == index[source]]
    with pytest.raises(LookupError):
        again.row("nowhere")
    product = dict(map(tuple, again.times(spark.createDataFrame([(i, float(i % 3)) for i in range(0, len(index), 2)], "idx long, value double")).collect()))
    expected = {}
    for r, c, v in want:
        if c % 2 == 0:
            expected[r] = expected.get(r, 0.0) + v * (c % 3)
    assert product == pytest.approx(expected)
    empty = csr.write_csr(edges.limit(0), "a", "b", "v", f"file://{tmp_path}/none")
    assert empty.coo().count() == empty.pointers().count() == empty.entries == 0


def test_serving_reads_one_bucket(spark, tmp_path):
    path = f"file://{tmp_path}/serving"
    for model, sign in (("up", 1), ("down", -1)):
        rows = spark.range(400).select((F.col("id") % 20).alias("s"), (F.col("id") * sign).alias("dest"), F.expr("cast(id div 20 + 1 as int)").alias("rank"), F.col("id").alias("prediction_id"), F.concat(F.lit(model), F.col("id") % 20).alias("name"))
        serving.save_predictions(rows, model, path, "s", ["name"], 8)
    found = serving.Serving(spark, path)
    assert found.models() == ["down", "up"]
    assert [r.dest for r in found.predictions("down", 7).collect()] == [-(7 + 20 * i) for i in range(10)]
    assert [r.name for r in found.venues("up").collect()] == [f"up{i}" for i in range(20)] and found.venue("up", 3).first().name == "up3"
    rows = found.predictions("up", 7)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "model" in filters and "bucket" in filters
    assert len({r.f for r in found._at("predictions", "up", 7).select(F.input_file_name().alias("f")).collect()}) == 1
    serving.save_predictions(spark.createDataFrame([(7, 1, 1, 1, "new")], "s long, dest long, rank int, prediction_id long, name string"), "up", path, "s", ["name"], 8)
    assert [r.dest for r in found.predictions("up", 7).collect()] == [1] and found.predictions("down", 7).count() == 10
    for model, source in (("up", 99), ("sideways", 1)):
        with pytest.raises(LookupError):
            found.predictions(model, source)


def test_cache_is_published_whole(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    given, place = spark.read.parquet(f"{tmp_path}/in"), f"file://{tmp_path}/cache"

    def broken():
        raise RuntimeError("no")

    half = given.select(F.when(F.col("id") == 3, F.raise_error(F.lit("late"))).otherwise(F.col("id")).alias("x"))
    for build in (broken, lambda: half):
        with pytest.raises(Exception, match="no|late"):
            writers.cached(build, place, [given])
        assert writers.published(spark, place, writers.manifest([given])) is None
    assert not [p for p in (tmp_path / "cache").iterdir() if "building" in p.name]
    assert writers.cached(lambda: given, place, [given]).count() == 5
    assert writers.cached(broken, place, [given]).count() == 5
    assert writers.cached(lambda: given.limit(2), place, [given], refresh=True).count() == 2
    assert writers.cached(broken, place, [given]).count() == 2
    assert writers.cached(lambda: given.limit(1), place, [given.where("id > 1")]).count() == 1


def test_two_builders_agree(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    given, place, both, seen = spark.read.parquet(f"{tmp_path}/in"), f"file://{tmp_path}/cache", threading.Barrier(2), []

    def build(n):
        both.wait(60)  # both find nothing and build
        return given.limit(n)

    each = [threading.Thread(target=lambda n=n: seen.append(writers.cached(lambda: build(n), place, [given]).count())) for n in (2, 3)]
    for t in each:
        t.start()
    for t in each:
        t.join()
    assert len(seen) == 2 and len(set(seen)) == 1 and seen[0] in (2, 3)


def test_gz_or_plain(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(b"{}"))
    (tmp_path / "b.json").write_text("{}")
    names = [readers.gz_or_plain(spark, f"{tmp_path}/{x}.json").removeprefix(f"{tmp_path}/") for x in "abc"]
    assert names == ["a.json", "b.json.gz", "c.json.gz"]
