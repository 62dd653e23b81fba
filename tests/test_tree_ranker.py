"""The tree ranker: gradients against brute force, and what it learns that a linear ranker can't."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripline.operators import ranking, tree_ranker
from tripline.plans import models


def by_hand(items):
    """Gradients and curvatures of (y, s) items, and nDCG@2."""
    order = sorted(range(len(items)), key=lambda i: (-items[i][1], i))
    at = {i: p + 1 for p, i in enumerate(order)}
    gain = lambda ys: sum(y / math.log2(p + 2) for p, y in enumerate(ys))
    ideal = gain(sorted((y for y, _ in items), reverse=True))
    out = []
    for i, (y, s) in enumerate(items):
        g = h = 0.0
        for j, (z, t) in enumerate(items):
            if y != z:
                w = abs(y - z) * abs(1 / math.log2(at[i] + 1) - 1 / math.log2(at[j] + 1)) / ideal
                up = 1 if y > z else -1
                p = 1 / (1 + math.exp(up * (s - t)))
                g, h = g + up * p * w, h + p * (1 - p) * w
        out.append((g, h))
    best = gain(sorted((y for y, _ in items), reverse=True)[:2])
    return out, gain([items[i][0] for i in order][:2]) / best if best else 0.0


def test_gradients_and_ndcg(spark):
    draw = random.Random(3)
    lists = [[(float(draw.choice((0, 0, 1, 2))), draw.choice((0.0, 1.0, draw.gauss(0, 2)))) for _ in range(draw.randrange(2, 9))] for _ in range(40)]
    lists = [x for x in lists if any(y for y, _ in x)] + [[(0.0, 1.0), (0.0, 2.0)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "q long, items array<struct<y: double, s: double>>")
    found = df.select("q", tree_ranker.lambdas(F.col("items")).alias("l"), tree_ranker.query_ndcg(F.col("items"), 2).alias("n")).collect()
    for r in found:
        if r.q == len(lists) - 1:
            assert r.n == 0 and all(x.g == 0 and x.h == 0 for x in r.l)
            continue
        want, ndcg = by_hand(lists[r.q])
        assert r.n == pytest.approx(ndcg)
        assert [x for p in r.l for x in p] == pytest.approx([x for p in want for x in p])


@pytest.fixture(scope="module")
def planted(spark):
    """Queries of six candidates; the right one is of middling distance if open, which no linear score tells."""
    draw = random.Random(8)
    rows = []
    for q in range(600):
        each = [(draw.random(), float(draw.random() < 0.5), draw.random()) for _ in range(6)]
        worth = [-abs(a - 0.5) * (3 if b else 1) + 0.3 * b + draw.gauss(0, 0.03) for a, b, _ in each]
        best = worth.index(max(worth))
        rows += [(q, i, int(i == best), list(x), q % 4 == 1, q % 4 == 3) for i, x in enumerate(each)]
    return spark.createDataFrame(rows, "q long, i int, label int, x array<double>, valid boolean, held boolean").cache()


def test_beats_the_linear_ranker(spark, planted):
    model = tree_ranker.fit_trees(planted.where("not held"), ["q"], rounds=14, depth=4, rate=0.3, patience=4, feature_share=1.0)
    held = planted.where("held")
    flat = lambda df: df.select("q", "i", "label", *[F.col("x")[i].alias(f"f{i}") for i in range(3)])
    linear = ranking.fit_pairwise(flat(planted.where("not held")), "q", "label", ["f0", "f1", "f2"])
    ours, theirs = (
        ranking.evaluate(ranking.ranked(df, ["q"], "score", ["i"]), "q", "label").first() for df in (model.scored(held), ranking.scored(linear, flat(held)))
    )
    assert ours.ndcg_at_5 > theirs.ndcg_at_5 + 0.1 and ours.recall_at_1 > 0.6
    assert model.best_round == model.history.index(max(model.history)) + 1
    again = tree_ranker.TreeRanker.from_json(model.to_json())
    x = [r.x for r in held.limit(20).collect()]
    one = model.scored(spark.createDataFrame([(v,) for v in x], "x array<double>")).collect()
    two = again.scored(spark.createDataFrame([(v,) for v in x], "x array<double>")).collect()
    assert one == two
    by_expression = held.limit(20).select(tree_ranker._with_trees(F.array(F.struct(F.lit(0.0).alias("y"), F.lit(0.0).alias("s"), "x")), model.trees, model.rate)[0]["s"].alias("s"))
    assert sorted(r.s for r in by_expression.collect()) == pytest.approx(sorted(r.score for r in model.scored(held.limit(20)).collect()))


def test_stops_early(spark, planted):
    noise = planted.withColumn("x", F.array(F.rand(1), F.rand(2)))
    model = tree_ranker.fit_trees(noise.where("q < 80"), ["q"], rounds=9, depth=2, rate=0.5, patience=2, feature_share=1.0)
    assert len(model.history) <= 9 and len(model.history) - model.best_round <= 2


def test_one_pass_metrics(spark, planted):
    rows = ranking.ranked(planted.withColumn("s", F.col("x")[0]), ["q"], "s", ["i"])
    got = ranking.evaluate(rows, "q", "label", (1, 3))
    want = ranking.recall_mrr(rows, "q", "label", (1, 3)).first()
    row = got.first()
    assert all(row[c] == pytest.approx(want[c]) for c in want.__fields__)
    for k in (1, 3):
        assert row[f"ndcg_at_{k}"] == pytest.approx(ranking.ndcg(rows, "q", "label", k).first()[0])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(q") == plan.count("Window ") == 1  # the ranks' own
    whole = ranking.evaluate(rows, "q", "label", (3,), queries=10_000).first()
    assert whole.ndcg_at_3 == pytest.approx(row.ndcg_at_3)
    assert ranking.evaluate(rows, "q", "label", (3,), queries=7).first().n_queries == 600


def test_batches_have_the_expressions_gradients_and_ndcg(spark, monkeypatch):
    monkeypatch.setattr(tree_ranker, "PAIRS", 50)
    draw = random.Random(5)
    lists = [[(float(draw.choice((0, 0, 1, 2))), draw.choice((0.0, 1.0, draw.gauss(0, 2))), [draw.random(), draw.random()]) for _ in range(draw.randrange(0, 7))] for _ in range(60)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "q long, items array<struct<y: double, s: double, x: array<double>>>")
    sizes, flat = np.array([len(x) for x in lists]), [item for x in lists for item in x]
    y, s = (np.array([item[i] for item in flat]) for i in range(2))
    found = df.orderBy("q").select(tree_ranker.lambdas(F.col("items")).alias("l"), tree_ranker.query_ndcg(F.col("items"), 2).alias("n")).collect()
    g, h = tree_ranker.batch_lambdas(sizes, y, s)
    assert [v for r in found for p in r.l for v in p] == pytest.approx([v for p in zip(g, h, strict=True) for v in p])
    assert [r.n for r in found] == pytest.approx(list(tree_ranker.batch_ndcg(sizes, y, s, 2)))
    tree = tree_ranker.Tree([0, -1, -1], [0.5, 0.0, 0.0], [1, -1, -1], [2, -1, -1], [0.0, 1.0, -1.0])
    steps = tree_ranker._steps(df, [tree], 0.5).collect()
    x = np.array([item[2] for item in flat])
    g, h = tree_ranker.batch_lambdas(sizes, y, s + 0.5 * tree.values(x))
    want = sorted((*v, a / b, b) for v, a, b in zip(x, g, h, strict=True) if b > 1e-12)
    assert [v for r in sorted((*r.features, r.step, r.weight) for r in steps) for v in r] == pytest.approx([v for r in want for v in r])


def test_only_drawn_queries_keep_labels(spark, planted):
    rows = ranking.ranked(planted.withColumn("s", F.col("x")[0]), ["q"], "s", ["i"])
    drawn = rows.select("q").distinct().orderBy(F.xxhash64("q", F.lit(42)), "q").limit(7)
    got = ranking.evaluate(rows, "q", "label", (3,), queries=7)
    assert got.first().ndcg_at_3 == pytest.approx(ranking.ndcg(rows.join(drawn, "q", "left_semi"), "q", "label", 3).first()[0])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("collect_list") < plan.index("Join LeftOuter")  # the draw lies below the lists


def test_metrics_are_those_of_all_held_out_queries(spark, tmp_path, monkeypatch):
    """With one positive a query, nDCG@1 over all queries is recall@1; over some of them it isn't."""
    n = 10_400
    pairs = spark.range(n + 150).select(F.col("id").alias("pair_id"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("dst_id"))
    near = F.pmod(F.xxhash64("pair_id", "dst_id"), F.lit(1000)) / 1000
    right = (F.pmod(F.xxhash64("pair_id"), F.lit(3)) == F.col("dst_id")).cast("int")
    x = F.array(near + 0.3 * right, F.lit(0.0), F.lit(0.0), F.lit(0.0))
    rows = pairs.select("pair_id", "dst_id", right.alias("label"), x.alias("x"), F.col("pair_id").between(n, n + 49).alias("valid"), (F.col("pair_id") < n).alias("held"))
    monkeypatch.setattr(models, "candidates", lambda spark, d: rows)
    for r in models.tree_ranker_metrics(spark, str(tmp_path)).collect():
        assert r.n_queries == n and 0.4 < r.recall_at_1 < 0.95
        assert r.ndcg_at_1 == r.recall_at_1
