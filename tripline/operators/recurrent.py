"""A next-item model: embeddings, stacked LSTM layers, and a score for every item of the vocabulary.

Rows that begin alike share the first layer's states up to where they part (``Prefixes``), so that its work grows with the distinct beginnings, not with the rows.
For that, a step's rows are stored in the order of their sequences.

Training is synchronous: in every step the tasks work out the gradients of their rows of the step's batch, Spark sums them up by ranges of
parameters, and the driver, which holds the model, takes an Adam step. Batches are dealt by hash once and stored
apart, so that a step reads its own rows only. Training stops when the validation loss has not fallen for some epochs.

Sequences are those of :func:`tripline.operators.sequences.trailing_windows`: padded with 0 at the left, all of one length. Targets of 0 don't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tripline.sources.storage import remove, scratch

#: Sequences that a task works on at a time, at least, and numbers of a hidden state for which there may be more; parameters whose gradients are summed up together.
SLICE, HELD, RANGE = 256, 1 << 17, 1 << 16


@dataclass(frozen=True)
class Shape:
    vocab: int
    embed: int = 128
    hidden: int = 256
    layers: int = 2

    def parts(self) -> list[tuple[str, tuple[int, ...]]]:
        """Names and sizes of the parameters, in the order in which they stand in one vector."""
        out: list[tuple[str, tuple[int, ...]]] = [("embed", (self.vocab, self.embed))]
        for i in range(self.layers):
            out += [(f"in{i}", (self.hidden if i else self.embed, 4 * self.hidden)), (f"back{i}", (self.hidden, 4 * self.hidden)), (f"bias{i}", (4 * self.hidden,))]
        return [*out, ("out", (self.hidden, self.vocab)), ("out_bias", (self.vocab,))]

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, dims in self.parts():
            size = int(np.prod(dims))
            out[name], at = flat[at : at + size].reshape(dims), at + size
        return out

    def start(self, seed: int) -> np.ndarray:
        draw, bound = np.random.default_rng(seed), self.hidden**-0.5
        flat = draw.uniform(-bound, bound, sum(int(np.prod(d)) for _, d in self.parts()))
        embed = self.views(flat)["embed"]
        embed[:] = draw.normal(size=embed.shape)
        embed[0] = 0
        return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _layer(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Outputs (rows, steps, hidden), and what the way back needs."""
    rows, steps, hidden = len(x), x.shape[1], len(u)
    into = x @ w + b
    h, c = np.zeros((rows, hidden)), np.zeros((rows, hidden))
    outs, cells, gates = np.empty((rows, steps, hidden)), np.empty((rows, steps + 1, hidden)), np.empty((rows, steps, 4 * hidden))
    cells[:, 0] = c
    for t in range(steps):
        z = into[:, t] + h @ u
        z[:, : 3 * hidden], z[:, 3 * hidden :] = _sigmoid(z[:, : 3 * hidden]), np.tanh(z[:, 3 * hidden :])
        take, keep, show, new = np.split(z, 4, axis=1)
        c = keep * c + take * new
        h = show * np.tanh(c)
        gates[:, t], cells[:, t + 1], outs[:, t] = z, c, h
    return outs, (x, outs, cells, gates)


def _layer_back(d_outs: np.ndarray, kept: tuple, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the inputs, and of the layer's three parameters."""
    x, outs, cells, gates = kept
    rows, steps, hidden = outs.shape
    d_z = np.empty_like(gates)
    d_h, d_c = np.zeros((rows, hidden)), np.zeros((rows, hidden))
    for t in reversed(range(steps)):
        take, keep, show, new = np.split(gates[:, t], 4, axis=1)
        high = np.tanh(cells[:, t + 1])
        d_h = d_h + d_outs[:, t]
        d_c = d_c + d_h * show * (1 - high**2)
        each = (d_c * new * take * (1 - take), d_c * cells[:, t] * keep * (1 - keep), d_h * high * show * (1 - show), d_c * take * (1 - new**2))
        d_z[:, t] = np.concatenate(each, axis=1)
        d_h, d_c = d_z[:, t] @ u.T, d_c * keep
    before = np.concatenate([np.zeros((rows, 1, hidden)), outs[:, :-1]], axis=1)
    flat = d_z.reshape(-1, 4 * hidden)
    return d_z @ w.T, x.reshape(-1, x.shape[2]).T @ flat, before.reshape(-1, hidden).T @ flat, flat.sum(0)


class Prefixes:
    """The distinct beginnings of sequences: of every length the items they end with, the places of the beginnings that they prolong, and
    each sequence's place among them."""

    def __init__(self, seq: np.ndarray) -> None:
        order = np.lexsort(seq.T[::-1])
        rows, back = seq[order], np.empty(len(seq), np.int64)
        back[order] = np.arange(len(seq))
        new = np.zeros(len(seq), bool)
        new[:1] = True
        before, self.items, self.parents, self.at = np.zeros(len(seq), np.int64), [], [], []
        for t in range(seq.shape[1]):
            new[1:] |= rows[1:, t] != rows[:-1, t]
            place, first = np.cumsum(new) - 1, np.flatnonzero(new)
            self.items.append(rows[first, t])
            self.parents.append(before[first])
            self.at.append(place[back])
            before = place

    def added(self, values: np.ndarray, t: int, out: np.ndarray) -> np.ndarray:
        """The values of the beginnings at t added up by what they prolong; these stand together and lack none."""
        if len(values):
            out[:] = np.add.reduceat(values, np.flatnonzero(np.diff(self.parents[t], prepend=-1)), axis=0)
        return out


def _first_layer(tree: Prefixes, embed: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> list[tuple]:
    """Of every length: outputs, cells and gates of the beginnings, those of what they prolong, and the inputs."""
    hidden, kept = len(u), []
    h = c = np.zeros((1, hidden))
    for items, parents in zip(tree.items, tree.parents, strict=True):
        x, old_h, old_c = embed[items], h[parents], c[parents]
        z = x @ w + b + old_h @ u
        z[:, : 3 * hidden], z[:, 3 * hidden :] = _sigmoid(z[:, : 3 * hidden]), np.tanh(z[:, 3 * hidden :])
        take, keep, show, new = np.split(z, 4, axis=1)
        c = keep * old_c + take * new
        high = np.tanh(c)
        h = show * high
        kept.append((h, high, z, old_h, old_c, x))
    return kept


def _first_layer_back(d_outs: list[np.ndarray], tree: Prefixes, kept: list[tuple], w: np.ndarray, u: np.ndarray, g: dict[str, np.ndarray]) -> None:
    """Adds to the gradients; d_outs has, of every length, the outputs' gradients added up by beginning."""
    d_h, d_c = np.zeros_like(d_outs[-1]), np.zeros_like(d_outs[-1])
    for t in reversed(range(len(kept))):
        _, high, z, old_h, old_c, x = kept[t]
        take, keep, show, new = np.split(z, 4, axis=1)
        d_h = d_h + d_outs[t]
        d_c = d_c + d_h * show * (1 - high**2)
        each = (d_c * new * take * (1 - take), d_c * old_c * keep * (1 - keep), d_h * high * show * (1 - show), d_c * take * (1 - new**2))
        d_z = np.concatenate(each, axis=1)
        g["in0"] += x.T @ d_z
        g["back0"] += old_h.T @ d_z
        g["bias0"] += d_z.sum(0)
        np.add.at(g["embed"], tree.items[t], d_z @ w.T)
        if t:
            less = np.zeros_like(d_outs[t - 1])
            d_h, d_c = tree.added(d_z @ u.T, t, less), tree.added(d_c * keep, t, less.copy())


def logits(p: dict[str, np.ndarray], shape: Shape, seq: np.ndarray, dropout: float = 0.0, draw: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
    """Scores of all items after each sequence, and what the way back needs. Dropout is applied if draw is given."""
    tree, trail, x = Prefixes(seq), [], None
    for i in range(shape.layers):
        if i:
            x, kept = _layer(x, p[f"in{i}"], p[f"back{i}"], p[f"bias{i}"])
        else:
            states = _first_layer(tree, p["embed"], p["in0"], p["back0"], p["bias0"])
            # Only a further layer needs outputs before the last.
            steps = range(len(states)) if shape.layers > 1 else [len(states) - 1]
            x, kept = np.stack([states[t][0][tree.at[t]] for t in steps], axis=1), (tree, states, steps)
        mask = (draw.random(x.shape) >= dropout) / (1 - dropout) if draw is not None and dropout else None
        x = x if mask is None else x * mask
        trail.append((kept, mask))
    last = x[:, -1]
    return last @ p["out"] + p["out_bias"], [*trail, last]


def loss_and_gradient(
    flat: np.ndarray, shape: Shape, seq: np.ndarray, target: np.ndarray, weights: np.ndarray, dropout: float = 0.0, draw: np.random.Generator | None = None
) -> tuple[float, float, np.ndarray]:
    """The weighted sum of the cross entropies, the sum of the weights, and the former's gradient. weights is by class."""
    p, gradient = shape.views(flat), np.zeros_like(flat)
    g = shape.views(gradient)
    score, trail = logits(p, shape, seq, dropout, draw)
    score -= score.max(1, keepdims=True)
    chance = np.exp(score)
    total = chance.sum(1, keepdims=True)
    weight = np.where(target > 0, weights[target], 0.0)
    rows = np.arange(len(seq))
    loss = float((weight * (np.log(total[:, 0]) - score[rows, target])).sum())
    d = chance / total
    d[rows, target] -= 1
    d *= weight[:, None]
    g["out"][:], g["out_bias"][:] = trail[-1].T @ d, d.sum(0)
    d_last = d @ p["out"].T
    d_outs = np.zeros((len(seq), seq.shape[1] if shape.layers > 1 else 1, shape.hidden))
    d_outs[:, -1] = d_last
    for i in reversed(range(shape.layers)):
        kept, mask = trail[i]
        d_outs = d_outs if mask is None else d_outs * mask
        if i:
            d_outs, g[f"in{i}"][:], g[f"back{i}"][:], g[f"bias{i}"][:] = _layer_back(d_outs, kept, p[f"in{i}"], p[f"back{i}"])
    tree, states, steps = trail[0][0]
    by_start = [np.zeros_like(s[0]) for s in states]
    for n, t in enumerate(steps):
        np.add.at(by_start[t], tree.at[t], d_outs[:, n])
    _first_layer_back(by_start, tree, states, p["in0"], p["back0"], g)
    g["embed"][0] = 0
    return loss, float(weight.sum()), gradient


def _slices(frames: Iterator[pd.DataFrame], shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = max(SLICE, HELD // shape.hidden)
    for frame in frames:
        for a in range(0, len(frame), size):
            part = frame.iloc[a : a + size]
            yield np.stack(part["input_seq"].to_numpy()).astype(np.int64), part["target"].to_numpy(np.int64)


def _summed(rows: DataFrame, flat: np.ndarray, shape: Shape, weights: np.ndarray, dropout: float, seed: int) -> tuple[float, float, np.ndarray]:
    """Loss, weight and gradient of all rows, summed over the tasks by ranges of parameters."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        draw = np.random.default_rng([seed, TaskContext.get().partitionId()])
        loss, weight, gradient = 0.0, 0.0, None
        for seq, target in _slices(frames, shape):
            one, its, g = loss_and_gradient(flat, shape, seq, target, weights, dropout, draw)
            loss, weight, gradient = loss + one, weight + its, g if gradient is None else gradient + g
        if gradient is not None:
            told = [np.array([loss, weight]).tobytes(), *(gradient[a : a + RANGE].tobytes() for a in range(0, len(gradient), RANGE))]
            yield pd.DataFrame({"part": range(-1, len(told) - 1), "sums": told})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": frame["part"].iloc[:1], "sums": [sum(np.frombuffer(x) for x in frame["sums"]).tobytes()]})

    told = rows.select("input_seq", "target").mapInPandas(work, "part int, sums binary")
    parts = {r.part: np.frombuffer(r.sums) for r in told.groupBy("part").applyInPandas(added, "part int, sums binary").collect()}
    if not parts:
        return 0.0, 0.0, np.zeros_like(flat)
    loss, weight = parts.pop(-1)
    return float(loss), float(weight), np.concatenate([parts[i] for i in sorted(parts)])


def _loss(rows: DataFrame, flat: np.ndarray, shape: Shape, weights: np.ndarray) -> float:
    """The mean weighted loss without dropout; infinite without rows."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shape.views(flat)
        for seq, target in _slices(frames, shape):
            score, _ = logits(p, shape, seq)
            top = score.max(1)
            each = np.log(np.exp(score - top[:, None]).sum(1)) + top - score[np.arange(len(seq)), target]
            weight = np.where(target > 0, weights[target], 0.0)
            yield pd.DataFrame({"loss": [float((weight * each).sum())], "weight": [float(weight.sum())]})

    loss, weight = rows.select("input_seq", "target").mapInPandas(work, "loss double, weight double").agg(F.sum("loss"), F.sum("weight")).first()
    return loss / weight if weight else float("inf")


@dataclass
class SequenceModel:
    shape: Shape
    flat: np.ndarray
    history: list[float] = field(default_factory=list)  #: validation loss of each epoch

    def top_k(self, rows: DataFrame, k: int = 10) -> DataFrame:
        """The rows (with input_seq) with predicted, the k most likely items, and scores, their softmax shares. Padding is never predicted; ties
        go to the lesser item."""
        shape, flat = self.shape, self.flat
        out = StructType([*rows.schema.fields, StructField("predicted", ArrayType(LongType())), StructField("scores", ArrayType(DoubleType()))])

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p, least = shape.views(flat), min(k, shape.vocab - 1)
            size = max(SLICE, HELD // shape.hidden)
            for frame in frames:
                for a in range(0, len(frame), size):
                    part = frame.iloc[a : a + size].copy()
                    score, _ = logits(p, shape, np.stack(part["input_seq"].to_numpy()).astype(np.int64))
                    score = np.exp(score - score.max(1, keepdims=True))
                    share = score / score.sum(1, keepdims=True)
                    best = np.argsort(-share[:, 1:], axis=1, kind="stable")[:, :least] + 1
                    part["predicted"], part["scores"] = list(best), list(np.take_along_axis(share, best, axis=1))
                    yield part

        return rows.mapInPandas(work, out)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, a, self.flat[a : a + RANGE].tobytes()) for i, a in enumerate(range(0, len(self.flat), RANGE))]
        about = spark.createDataFrame([(self.shape.vocab, self.shape.embed, self.shape.hidden, self.shape.layers, self.history)], "vocab int, embed int, hidden int, layers int, history array<double>")
        about.write.mode("overwrite").json(f"{path}/shape")
        spark.createDataFrame(rows, "part int, first long, numbers binary").write.mode("overwrite").parquet(f"{path}/parameters")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SequenceModel:
        r = spark.read.json(f"{path}/shape").first()
        parts = spark.read.parquet(f"{path}/parameters").orderBy("part").collect()
        return cls(Shape(r.vocab, r.embed, r.hidden, r.layers), np.concatenate([np.frombuffer(x.numbers) for x in parts]), list(r.history))


def fit_sequences(
    train: DataFrame,
    valid: DataFrame,
    shape: Shape,
    weights: dict[int, float] | None = None,
    epochs: int = 50,
    patience: int = 5,
    batch: int = 4096,
    most_steps: int = 1000,
    rate: float = 1e-3,
    dropout: float = 0.3,
    seed: int = 42,
) -> SequenceModel:
    """The model of the epoch with the least validation loss. train and valid have input_seq and target; weights by class, 1 where none is given.

    An epoch has most_steps steps at most: with more rows the batches grow, not the number of jobs.
    """
    spark, n = train.sparkSession, train.count()
    steps = max(1, min(-(-n // batch), most_steps))
    by_class = np.ones(shape.vocab)
    for c, w in (weights or {}).items():
        by_class[c] = w
    path = scratch(spark, "sequences")
    dealt = train.select("input_seq", "target").withColumn("batch", F.pmod(F.xxhash64("input_seq", "target", F.lit(seed)) + F.monotonically_increasing_id(), F.lit(steps)))
    tasks = min(spark.sparkContext.defaultParallelism, max(1, -(-n // steps // SLICE)))
    # A step's rows lie in as many files as it has tasks, each a range of sequences; the hash parts equal ones.
    spread = dealt.withColumn("_h", F.xxhash64("target", F.monotonically_increasing_id()))
    spread = spread.repartitionByRange(steps * tasks, "batch", "input_seq", "_h").sortWithinPartitions("batch", "input_seq").drop("_h")
    spread.write.partitionBy("batch").parquet(path)
    stored = spark.read.parquet(path)
    flat, mean, square = shape.start(seed), 0.0, 0.0
    best, model, number = float("inf"), None, 0
    history: list[float] = []
    for epoch in range(epochs):
        for step in np.random.default_rng([seed, epoch]).permutation(steps):
            rows = stored.where(F.col("batch") == int(step))
            _, weight, g = _summed(rows, flat, shape, by_class, dropout, seed + number)
            if not weight:
                continue
            number, g = number + 1, g / weight
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            flat = flat - rate * (mean / (1 - 0.9**number)) / (np.sqrt(square / (1 - 0.999**number)) + 1e-8)
        history.append(_loss(valid, flat, shape, by_class))
        if model is None or history[-1] < best:
            best, model, since = history[-1], flat.copy(), 0
        else:
            since += 1
            if since >= patience:
                break
    remove(spark, path)
    return SequenceModel(shape, model if model is not None else flat, history)
