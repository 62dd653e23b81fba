"""The next-item model: gradients against finite differences, and an order that single transitions don't tell."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripline.operators import ranking, recurrent, sequences
from tripline.operators.recurrent import Shape


def test_gradient_is_that_of_finite_differences():
    shape, draw = Shape(7, 4, 5, 2), np.random.default_rng(1)
    seq, target = draw.integers(0, 7, (6, 4)), draw.integers(0, 7, 6)
    seq[:, 0] = 0
    flat, weights = shape.start(3), draw.random(7) + 0.5
    loss, weight, gradient = recurrent.loss_and_gradient(flat, shape, seq, target, weights)
    assert weight == pytest.approx(sum(weights[t] for t in target if t)) and loss > 0
    for i in draw.choice(len(flat), 150, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (recurrent.loss_and_gradient(up, shape, seq, target, weights)[0] - recurrent.loss_and_gradient(down, shape, seq, target, weights)[0]) / 2e-5
        expected = 0.0 if i < shape.embed else slope  # the padding's embedding stays
        assert gradient[i] == pytest.approx(expected, abs=1e-6)


def test_tasks_sums_are_those_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(recurrent, "RANGE", 50)
    shape, draw = Shape(6, 3, 4, 1), np.random.default_rng(2)
    seq, target = draw.integers(0, 6, (90, 3)), draw.integers(0, 6, 90)
    df = spark.createDataFrame([(s.tolist(), int(t)) for s, t in zip(seq, target, strict=True)], "input_seq array<long>, target long")
    flat, weights = shape.start(5), np.arange(6) + 1.0
    want = recurrent.loss_and_gradient(flat, shape, seq, target, weights)
    for parts in (1, 4):
        loss, weight, gradient = recurrent._summed(df.repartition(parts), flat, shape, weights, 0.0, 1)
        assert (loss, weight) == pytest.approx(want[:2]) and np.allclose(gradient, want[2])
    assert recurrent._loss(df, flat, shape, weights) == pytest.approx(want[0] / want[1])
    assert recurrent._summed(df.where("target > 90"), flat, shape, weights, 0.0, 1)[1] == 0


def test_learns_an_order_that_pairs_dont_tell(spark, tmp_path):
    """Every second item repeats the one two before it; which follows which is even."""
    draw, rows = random.Random(4), []
    for user in range(300):
        items = [draw.randrange(2, 7), draw.randrange(2, 7)]
        while len(items) < 9:
            items.append(items[-2])
        rows += [(user, i, x) for i, x in enumerate(items)]
    visits = spark.createDataFrame(rows, "user_id long, at int, token long")
    windows = sequences.trailing_windows(visits, "user_id", ["at"], "token", 4).where("seq_len > 1").cache()
    held = windows.where("user_id % 5 = 0")
    model = recurrent.fit_sequences(windows.where("user_id % 5 > 1"), windows.where("user_id % 5 = 1"), Shape(7, 8, 16, 1), epochs=30, patience=5, batch=700, rate=0.05, dropout=0.0)
    ours = ranking.top_k_accuracy(model.top_k(held, 3), "predicted", "target", (1, 3)).first()
    pairs = windows.where("user_id % 5 > 0").select(F.element_at("input_seq", -1).alias("src"), F.col("target").alias("dst"))
    first = sequences.transitions(pairs, "src", "dst").groupBy("src").agg(F.max_by("dst", "n").alias("guess"))
    theirs = held.select(F.element_at("input_seq", -1).alias("src"), "target").join(first, "src").agg(F.avg((F.col("guess") == F.col("target")).cast("double"))).first()[0]
    assert ours.accuracy_at_1 > 0.9 > theirs + 0.3
    assert model.history[-1] < model.history[0]
    found = model.top_k(held, 10).first()
    assert len(found.predicted) == 6 and 0 not in found.predicted and list(found.scores) == sorted(found.scores, reverse=True)
    model.save(spark, f"file://{tmp_path}/model")
    again = recurrent.SequenceModel.load(spark, f"file://{tmp_path}/model")
    assert again.shape == model.shape and np.array_equal(again.flat, model.flat) and again.history == model.history


def test_class_weights_and_patience(spark):
    rows = spark.range(400).select(F.array(F.lit(0).cast("long"), F.lit(2).cast("long")).alias("input_seq"), F.when(F.col("id") % 10 == 0, 3).otherwise(2).cast("long").alias("target"))
    fit = lambda w: recurrent.fit_sequences(rows, rows, Shape(4, 4, 6, 1), w, epochs=12, batch=400, rate=0.2, dropout=0.0)
    plain, heavy = (fit(w).top_k(rows.limit(1), 1).first().predicted[0] for w in (None, {3: 50.0}))
    assert (plain, heavy) == (2, 3)
    stopped = recurrent.fit_sequences(rows, rows.where("target = 3"), Shape(4, 4, 6, 1), epochs=12, patience=2, batch=400, rate=0.2, dropout=0.0)
    assert len(stopped.history) < 12


def test_rows_that_begin_alike_share_states():
    draw = np.random.default_rng(6)
    seq, target = draw.integers(0, 3, (500, 6)), draw.integers(0, 4, 500)
    tree = recurrent.Prefixes(seq)
    assert [len(x) for x in tree.items] == [len({tuple(r) for r in seq[:, : t + 1].tolist()}) for t in range(6)]
    assert all((tree.items[t][tree.at[t]] == seq[:, t]).all() for t in range(6))
    for layers in (1, 2):
        shape, weights = Shape(5, 3, 4, layers), draw.random(5) + 0.5
        flat = shape.start(2)
        loss, weight, gradient = recurrent.loss_and_gradient(flat, shape, seq, target, weights)
        each = [recurrent.loss_and_gradient(flat, shape, seq[i : i + 1], target[i : i + 1], weights) for i in range(500)]
        assert (loss, weight) == pytest.approx((sum(x[0] for x in each), sum(x[1] for x in each)))
        assert np.allclose(gradient, sum(x[2] for x in each))
