"""Toxicity of documents by gradient-boosted trees over dense features.

The features are the densities of two lexicons, how often their words stand near a second person, the shares of capitals,
punctuation and disguised words, and the length. The lexicons (whole words, and word beginnings of four to eight bytes) are learned: they
hold what is much likelier in the toxic documents of the sample, weighted by the logarithm of how much. A row's features come from lexicons that
the other folds' rows give, so that trees learn how far a lexicon can be trusted on new texts. The trees' probability is calibrated by isotonic
regression on all rows of the sample, each scored by trees of the other folds (where a fold's complement lacks a label, by all trees).

Defined results: a null or empty text has the features of an empty text and gets a score like any other; without labels
of both kinds every score is the labels' mean (0.0 without any); rows that repeat a doc_id are scored each; a null doc_id is scored
and never learned from; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.llm.common import Joined, batches, numbered, restored, set_aside, small_batches, stored, table, text_bytes, with_made, word_hashes
from tripline.llm.supervised import as_vector, calibrated, calibration, remainder, training_sample

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
#: Second-person words of the languages at hand.
SECOND_PERSON = "you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta vous votre vos tú ti usted vos vosotros".split()
STEMS = (4, 5, 6, 7, 8)
#: Weights from here on (odds of twenty) are strong.
STRONG = 3.0
#: Rows of a fold are described by lexicons, and for the calibration scored by trees, that come from the other folds.
FOLDS = 3


class Words:
    """The words of several texts with the hashes of the words and of their beginnings (0 where a word is shorter)."""

    def __init__(self, texts: list[str | None]) -> None:
        self.joined = Joined([text_bytes(t) for t in texts])
        self.start, self.end, words, self.first = self.joined.words(IS_WORD)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.first))
        number, distinct = numbered(words), list(dict.fromkeys(words))
        self.hash = word_hashes(distinct)[number]
        self.terms = [self.hash]
        for n in STEMS:
            begin = word_hashes([b"%d " % n + w[:n] for w in distinct])
            begin[[len(w) < n for w in distinct]] = 0
            self.terms.append(begin[number])


Lexicon = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def lexicons(sample: DataFrame, most: int = 400, least: int = 4, odds: float = 5.0) -> list[Lexicon]:
    """For each fold what the rows of the other folds tell, and last what all rows tell: hashes and weights of words, hashes and weights of word
    beginnings. They hold the strongest ``most`` of each that are ``odds`` times likelier in toxic documents; the weight is the ratio's logarithm."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches(frames):
            words, y, fold = Words(part["text"].tolist()), part["y"].to_numpy(), part["fold"].to_numpy()
            for kind, terms in enumerate(words.terms):
                order = np.lexsort((words.owner, terms))
                t, o = terms[order], words.owner[order]
                new = np.concatenate([[True], (t[1:] != t[:-1]) | (o[1:] != o[:-1])]) if len(t) else np.zeros(0, bool)
                t, o = t[new], o[new]
                for k in np.unique(fold):
                    at_fold = fold[o] == k
                    found, at = np.unique(t[at_fold], return_inverse=True)
                    toxic = y[o[at_fold]]
                    bad, good = np.bincount(at, toxic, len(found)), np.bincount(at, 1 - toxic, len(found))
                    rows = pd.DataFrame({"fold": k, "stem": kind > 0, "term": found.view(np.int64), "bad": bad, "good": good})
                    yield rows[found != 0]

    def but(column: str, fold: int) -> F.Column:
        return F.sum(F.when(F.col("fold") != fold, F.col(column)).otherwise(0.0))

    everything = [*range(FOLDS), -1]
    totals = sample.select("fold", F.col("y").alias("bad"), (1 - F.col("y")).alias("good"))
    totals = totals.agg(*[but(c, k).alias(f"{c}{k}") for k in everything for c in ("bad", "good")]).first()
    counts = sample.mapInPandas(count, "fold int, stem boolean, term long, bad double, good double").groupBy("stem", "term")
    counts = counts.agg(*[but(c, k).alias(f"{c}{k}") for k in everything for c in ("bad", "good")])
    counts = stored(counts.where(F.col("bad-1") >= least), "lexicon")
    out = []
    for k in everything:
        bad, good = F.col(f"bad{k}"), F.col(f"good{k}")
        ratio = ((bad + 0.5) / (totals[f"bad{k}"] + 1)) / ((good + 0.5) / (totals[f"good{k}"] + 1))
        strong = counts.where(bad >= least).select("stem", "term", F.log(ratio).alias("weight")).where(ratio >= odds)
        found: list[np.ndarray] = []
        for stem in (False, True):
            rows = strong.where(F.col("stem") == stem).orderBy(F.desc("weight"), "term").limit(most).collect()
            terms = np.array([r["term"] for r in rows], np.int64).view(np.uint64)
            order = np.argsort(terms)
            found += [terms[order], np.array([r["weight"] for r in rows], float)[order]]
        out.append(tuple(found))
    return out


def member(sorted_set: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x


def weights(terms: np.ndarray, each: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The weight of each x, 0 where it is no term."""
    if not len(terms):
        return np.zeros(len(x))
    at = np.minimum(np.searchsorted(terms, x), len(terms) - 1)
    return np.where(terms[at] == x, each[at], 0.0)


def features(texts: list[str | None], word_terms: np.ndarray, word_weights: np.ndarray, stem_terms: np.ndarray, stem_weights: np.ndarray) -> np.ndarray:
    words, n = Words(texts), len(texts)
    data, joined = words.joined.data, words.joined

    def total(mark: np.ndarray) -> np.ndarray:
        """Of marked bytes in each text."""
        sums = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
        return sums[joined.end] - sums[joined.start]

    def by_doc(mark: np.ndarray) -> np.ndarray:
        return np.bincount(words.owner[mark], minlength=n).astype(float)

    n_words, n_bytes = np.diff(words.first).astype(float), (joined.end - joined.start).astype(float)
    hit_weight = weights(word_terms, word_weights, words.terms[0])
    stem_weight = np.maximum.reduce([weights(stem_terms, stem_weights, t) for t in words.terms[1:]])
    hit, stem, strongest = hit_weight > 0, stem_weight > 0, np.maximum(hit_weight, stem_weight)
    either = hit | stem
    told = np.bincount(words.owner, strongest, n)
    second = member(np.sort(word_hashes([w.encode() for w in SECOND_PERSON])), words.hash)
    near = second.copy()
    for d in range(1, 4):
        same = words.owner[d:] == words.owner[:-d]
        near[d:] |= second[:-d] & same
        near[:-d] |= second[d:] & same
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, blank, wide = (data >= 48) & (data <= 57), np.isin(data, [9, 10, 11, 12, 13, 32]), data >= 128
    mark = ~(upper | lower | digit | blank | wide)
    letter = upper | lower | wide
    between = np.zeros(len(data), bool)  # a mark or digit between letters disguises a word
    between[1:-1] = letter[:-2] & letter[2:] & (mark | digit)[1:-1] & ~np.isin(data[1:-1], [39, 45, 46])
    ups = np.concatenate([[0], np.cumsum(upper, dtype=np.int64)])
    shouted = (ups[words.end] - ups[words.start] == words.end - words.start) & (words.end - words.start > 1)
    per_word, per_byte = 1 / np.maximum(n_words, 1), 1 / np.maximum(n_bytes, 1)
    return np.stack(
        [
            by_doc(hit) * per_word, np.log1p(by_doc(hit)), by_doc(stem) * per_word, np.log1p(by_doc(stem)),
            by_doc(either) * per_word, np.log1p(by_doc(either)), told * per_word, np.log1p(told),
            by_doc(strongest >= STRONG) * per_word, np.log1p(by_doc(strongest >= STRONG)), by_doc(either & near) * per_word, by_doc(second) * per_word,
            total(upper) * per_byte, by_doc(shouted) * per_word, total(mark) * per_byte, total(data == 33) * per_byte,
            total(between) * per_word, total(digit) * per_byte, total(wide) * per_byte, np.log1p(n_words),
        ],
        axis=1,
    )


def with_features(docs: DataFrame, lexicon: Lexicon, keep_text: bool = False) -> DataFrame:
    """The rows with the array x, in place of their text unless that is to be kept."""
    made = {"x": ("array<double>", pa.list_(pa.float64()))}
    return with_made(docs, lambda texts: {"x": list(features(texts, *lexicon))}, made, keep_text)


def toxicity(
    docs: DataFrame, labels: DataFrame, allowed: F.Column, bound: int = 12_000, trees: int = 20, keep_columns: bool = False
) -> DataFrame:
    """doc_id (or all columns) and score (0 to 1) of every document; learned from at most about ``bound`` labelled ones that
    allowed marks. A column named score is replaced."""
    small_batches(docs.sparkSession)
    sample = training_sample(docs, labels, "toxic", allowed, bound).withColumn("fold", F.pmod("fold", F.lit(FOLDS)).cast("int"))
    sample = stored(sample, "sample")
    docs, names = set_aside(docs, "doc_id", "text")
    names = {c: n for c, n in names.items() if c == "doc_id" or keep_columns and c != "score"} | {"score": "score"}
    kept = [n for n in names.values() if n != "score"]
    kinds = {(r["fold"], r["y"]) for r in sample.select("fold", "y").distinct().collect()}
    if len({y for _, y in kinds}) < 2:
        mean = sample.agg(F.avg("y")).first()[0] or 0.0
        return restored(docs.withColumn("score", F.lit(float(mean))), names)
    *others, everything = lexicons(sample)
    learning = with_features(sample.where("fold = 0"), others[0])
    for k in range(1, FOLDS):
        learning = learning.unionByName(with_features(sample.where(F.col("fold") == k), others[k]))
    learning = stored(learning.withColumn("v", as_vector("x")), "features")
    trainer = GBTClassifier(featuresCol="v", labelCol="y", maxIter=trees, maxDepth=3, stepSize=0.3, seed=7)

    def raw(model, df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("raw", vector_to_array("probability")[1])

    parts = [learning]
    if all(len({y for f, y in kinds if f != k}) == 2 for k in range(FOLDS)):
        parts += [learning.where(F.col("fold") != k) for k in range(FOLDS)]
    with ThreadPool(len(parts)) as pool:  # each fit is many small jobs
        model, *fold_models = pool.map(lambda part: trainer.copy().fit(part.coalesce(2)), parts)
    crossed = [raw(m, learning.where(F.col("fold") == k)) for k, m in enumerate(fold_models)] or [raw(model, learning)]
    isotonic = calibration(reduce(DataFrame.unionByName, [part.select("raw", "y") for part in crossed]))
    scored = with_features(docs.select(*dict.fromkeys([*kept, "text"])), everything, keep_text="text" in kept)
    scored = raw(model, scored.withColumn("v", as_vector("x")))
    return restored(calibrated(scored.select(*kept, "raw"), isotonic), names)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, x) for x in ("documents", "labels"))
    scored = toxicity(docs, labels, remainder(3) != 1)
    return scored.select(
        "doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


QUERIES = {"op7_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
