"""A pairwise ranker of gradient-boosted trees: LambdaRank gradients, trees by MLlib, early stopping on validation nDCG.

The training table has one row for each query, with its candidates' labels, features and scores as an array, so that a round's
gradients and metric need no shuffle: ``lambdas`` and ``query_ndcg`` state them as expressions over one row, and the tasks work them out in
numpy for many queries at a time (``batch_lambdas``, ``batch_ndcg``). A round fits one regression tree to the candidates' Newton
steps (gradient over curvature, weighted by the curvature) and adds it to the scores as an expression. The scores are
written down anew every few rounds. A query's candidates stand in one row, so a query is to be as small as candidate lists are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.sources.storage import remove, scratch

#: Rounds between two writes of the scores.
WRITE_EVERY = 8
#: Pairs of items that a task compares at a time.
PAIRS = 1 << 20


@dataclass
class Tree:
    """Nodes in parallel lists: the feature and threshold of a split (left: at most the threshold) and its children, or -1 and a value."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    @classmethod
    def of(cls, root: object) -> Tree:
        """From the root node of an MLlib tree with continuous features."""
        out = cls()

        def add(node: object) -> int:
            at, leaf = len(out.feature), node.subtreeDepth() == 0
            out.feature.append(-1 if leaf else node.split().featureIndex())
            out.threshold.append(0.0 if leaf else node.split().threshold())
            out.value.append(node.prediction())
            out.left.append(-1)
            out.right.append(-1)
            if not leaf:
                out.left[at], out.right[at] = add(node.leftChild()), add(node.rightChild())
            return at

        add(root)
        return out

    def column(self, x: Column, at: int = 0) -> Column:
        """The tree's value for an array of features."""
        if self.feature[at] < 0:
            return F.lit(self.value[at])
        low = F.get(x, F.lit(self.feature[at])) <= F.lit(self.threshold[at])
        return F.when(low, self.column(x, self.left[at])).otherwise(self.column(x, self.right[at]))

    def values(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right = (np.array(a) for a in (self.feature, self.threshold, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(feature[at] >= 0)).size:
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])
        return np.array(self.value)[at]


@dataclass
class TreeRanker:
    """The trees up to the best round, and of all rounds the validation metric."""

    trees: list[Tree]
    rate: float
    history: list[float]

    @property
    def best_round(self) -> int:
        return len(self.trees)

    def scored(self, df: DataFrame, x: str = "x") -> DataFrame:
        """The rows with score; x is the column of features."""
        trees, rate = self.trees, self.rate

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for column in batches:
                rows = np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))
                yield pd.Series(rate * sum((t.values(rows) for t in trees), np.zeros(len(rows))))

        return df.withColumn("score", score(F.col(x)))

    def importance(self, names: list[str]) -> dict[str, int]:
        """How many splits use each feature."""
        used = [f for t in self.trees for f in t.feature if f >= 0]
        return {names[f]: used.count(f) for f in sorted(set(used))}

    def to_json(self) -> str:
        return json.dumps({"rate": self.rate, "history": self.history, "trees": [vars(t) for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> TreeRanker:
        given = json.loads(text)
        return cls([Tree(**t) for t in given["trees"]], given["rate"], given["history"])


def _by_score(items: Column) -> Column:
    """The items with their place (from 1) by descending score, ties in their order."""
    order = F.array_sort(F.transform(items, lambda r, i: F.struct((-r["s"]).alias("minus"), i.alias("i"))))
    places = F.transform(order, lambda o: o["i"])
    return F.transform(items, lambda r, i: F.struct(r["y"].alias("y"), r["s"].alias("s"), F.array_position(places, i).alias("at")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def discounted(labels: Column, k: int | None = None) -> Column:
    """The discounted gain of an array of labels in rank order."""
    labels = labels if k is None else F.slice(labels, 1, k)
    return _total(F.transform(labels, lambda y, i: y / F.log2(i + 2)))


def query_ndcg(items: Column, k: int) -> Column:
    """nDCG@k of a query's items (y, s), the ideal being that of all its items; 0 without a positive."""
    order = F.array_sort(F.transform(items, lambda r, i: F.struct((-r["s"]).alias("minus"), i.alias("i"), r["y"].alias("y"))))
    ideal = discounted(F.sort_array(F.transform(items, lambda r: r["y"]), False), k)
    return F.when(ideal > 0, discounted(F.transform(order, lambda o: o["y"]), k) / ideal).otherwise(0.0)


def lambdas(items: Column) -> Column:
    """Of each item (y, s) the gradient g and curvature h: over all items of another label, the logistic loss of the pair's scores weighted
    by what swapping both would change of the nDCG."""
    ranked = _by_score(items)
    ideal = discounted(F.sort_array(F.transform(items, lambda r: r["y"]), False))

    def pair(r: Column, o: Column) -> Column:
        up = F.signum(r["y"] - o["y"])
        weight = F.abs(r["y"] - o["y"]) * F.abs(1 / F.log2(r["at"] + 1) - 1 / F.log2(o["at"] + 1)) / ideal
        chance = 1 / (1 + F.exp(up * (r["s"] - o["s"])))
        return F.struct((up * chance * weight).alias("g"), (chance * (1 - chance) * weight).alias("h"))

    def summed(r: Column) -> Column:
        pairs = F.transform(F.filter(ranked, lambda o: o["y"] != r["y"]), lambda o: pair(r, o))
        return F.struct(_total(F.transform(pairs, lambda p: p["g"])).alias("g"), _total(F.transform(pairs, lambda p: p["h"])).alias("h"))

    return F.transform(ranked, summed)


def _alike(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """For queries of equal size, as many as their pairs allow: the places of their items, a row for a query."""
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes[sizes > 0]):
        of_size, step = starts[sizes == n], max(1, PAIRS // int(n) ** 2)
        for a in range(0, len(of_size), step):
            yield of_size[a : a + step, None] + np.arange(n)


def batch_lambdas(sizes: np.ndarray, y: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lambdas of many queries, whose items stand one after another; a query that lacks a label has NaN."""
    g, h = np.zeros(len(y)), np.zeros(len(y))
    for items in _alike(sizes):
        labels, scores = y[items], s[items]
        discount = 1 / np.log2(np.arange(items.shape[1]) + 2)
        ideal = (-np.sort(-labels, axis=1) * discount).sum(1)[:, None, None]
        at = np.argsort(np.argsort(-scores, axis=1, kind="stable"), axis=1)
        up = np.sign(labels[:, :, None] - labels[:, None, :])
        gap = np.abs(labels[:, :, None] - labels[:, None, :]) * np.abs(discount[at][:, :, None] - discount[at][:, None, :])
        weight = gap / np.where(ideal == 0, 1.0, ideal)
        with np.errstate(over="ignore"):
            chance = 1 / (1 + np.exp(up * (scores[:, :, None] - scores[:, None, :])))
        g[items], h[items] = (up * chance * weight).sum(2), (chance * (1 - chance) * weight).sum(2)
    return g, h


def batch_ndcg(sizes: np.ndarray, y: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """query_ndcg of many queries, whose items stand one after another."""
    out, first = np.zeros(len(sizes)), {int(a): i for i, a in enumerate(np.cumsum(sizes) - sizes) if sizes[i]}
    for items in _alike(sizes):
        labels = y[items]
        discount = 1 / np.log2(np.arange(min(k, items.shape[1])) + 2)
        found = np.take_along_axis(labels, np.argsort(-s[items], axis=1, kind="stable")[:, :k], axis=1) @ discount
        ideal = -np.sort(-labels, axis=1)[:, :k] @ discount
        out[[first[int(a)] for a in items[:, 0]]] = np.where(ideal > 0, found / np.where(ideal > 0, ideal, 1.0), 0.0)
    return out


def _opened(items: pa.ListArray, trees: list[Tree], rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the queries, and their items' labels, scores with the trees' values added, and features (a row for an item)."""
    sizes, each = np.diff(items.offsets.to_numpy()), items.flatten()
    y, s = (each.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "s"))
    x = each.field("x").flatten().to_numpy(zero_copy_only=False)
    x = x.reshape(len(y), -1) if len(y) else np.zeros((0, 1))
    for t in trees:
        s = s + rate * t.values(x)
    return sizes, y, s, x


def _steps(queries: DataFrame, trees: list[Tree], rate: float) -> DataFrame:
    """Features, Newton steps and weights of the queries' items, with the trees' values in their scores."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, y, s, x = _opened(batch.column(0), trees, rate)
            g, h = batch_lambdas(sizes, y, s)
            kept = h > 1e-12
            x, g, h = x[kept], g[kept], h[kept]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([lists, pa.array(g / h), pa.array(h)], names=["x", "step", "weight"])

    found = queries.select("items").mapInArrow(work, "x array<double>, step double, weight double")
    return found.select(array_to_vector("x").alias("features"), "step", "weight")


def _mean_ndcg(queries: DataFrame, trees: list[Tree], rate: float, k: int) -> float:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, y, s, _ = _opened(batch.column(0), trees, rate)
            yield pa.RecordBatch.from_arrays([pa.array([float(batch_ndcg(sizes, y, s, k).sum())]), pa.array([len(sizes)])], names=["v", "n"])

    total, n = queries.select("items").mapInArrow(work, "v double, n long").agg(F.sum("v"), F.sum("n")).first()
    return total / n if n else 0.0


def fit_trees(
    rows: DataFrame,
    query: list[str],
    label: str = "label",
    x: str = "x",
    valid: str = "valid",
    rounds: int = 500,
    depth: int = 8,
    rate: float = 0.05,
    patience: int = 20,
    k: int = 10,
    row_share: float = 0.7,
    feature_share: float = 0.7,
    least_rows: int = 3,
    seed: int = 42,
) -> TreeRanker:
    """Fits trees to the rows whose ``valid`` is false, and stops when the others' mean nDCG@k has not risen for ``patience`` rounds.

    rows has the query's columns, a label of at least 0, and x, an array of doubles without nulls. Every round takes that share of the rows, and every
    split that share of the features.
    """
    spark = rows.sparkSession
    item = F.struct(F.col(label).cast("double").alias("y"), F.lit(0.0).alias("s"), F.col(x).alias("x"))
    # The order of a query's items, which decides ties, is that of their features.
    grouped = rows.groupBy(*query).agg(F.array_sort(F.collect_list(item)).alias("items"), F.max(valid).alias("valid"))
    path, tasks = scratch(spark, "ranker"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out evenly: the work of a row is much more than its bytes tell.
    grouped.select("valid", "items").repartition(tasks).write.parquet(path)
    base, pending, trees, history, best = spark.read.parquet(path), [], [], [], -1
    for number in range(rounds):
        forest = RandomForestRegressor(
            labelCol="step", weightCol="weight", numTrees=1, maxDepth=depth, minInstancesPerNode=least_rows, maxBins=64, subsamplingRate=row_share,
            featureSubsetStrategy=str(feature_share) if feature_share < 1 else "all", seed=seed + number, bootstrap=False,
        )
        round_path = scratch(spark, "steps")
        _steps(base.where("not valid"), pending, rate).write.parquet(round_path)  # a fit goes over them several times
        tree = Tree.of(forest.fit(spark.read.parquet(round_path)).trees[0]._call_java("rootNode"))
        remove(spark, round_path)
        trees.append(tree)
        pending.append(tree)
        if len(pending) == WRITE_EVERY:
            new = scratch(spark, "ranker")
            base.withColumn("items", _with_trees(F.col("items"), pending, rate)).write.parquet(new)
            remove(spark, path)
            path, base, pending = new, spark.read.parquet(new), []
        history.append(_mean_ndcg(base.where("valid"), pending, rate, k))
        if best < 0 or history[number] > history[best]:
            best = number
        elif number - best >= patience:
            break
    remove(spark, path)
    return TreeRanker(trees[: best + 1], rate, history)


def _with_trees(items: Column, trees: list[Tree], rate: float) -> Column:
    """The items with the trees' values added to their scores."""
    if not trees:
        return items

    def added(r: Column) -> Column:
        s = r["s"]
        for t in trees:
            s = s + rate * t.column(r["x"])
        return F.struct(r["y"].alias("y"), s.alias("s"), r["x"].alias("x"))

    return F.transform(items, added)
