"""Quality of documents by a linear-chain conditional random field over their lines.

Each line has features of its own and those of the lines before and after it. The field labels every line good or bad. Only whole
documents are labelled, so the lines' labels are latent: training begins with the documents' labels and goes on by expectation and
maximisation, with a document's label as evidence for each of its lines. A document's raw quality is the mean of its lines' marginal probabilities of being good
(forward-backward), weighted with the lines' lengths; isotonic regression on a fifth of the sample that the field has not
seen turns it into the score.

The field is trained on the driver from the lines' features of a bounded sample; the sample leaves documents of more than
``most_lines`` lines out. Scoring takes whole texts, however long.

Defined results: a null or empty text has one empty line; without labels of both kinds every score is the labels'
mean (0.0 without any); rows that repeat a doc_id are scored each; a null doc_id is scored and never learned from; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.llm.common import Joined, batches, numbered, small_batches, stored, table, text_bytes, with_made
from tripline.llm.supervised import calibrated, calibration, remainder, training_sample

IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of the texts: features with those of both neighbours, lengths in bytes with the line's end, and owners."""
    joined = Joined([text_bytes(t) for t in texts])
    data = joined.data
    end = np.flatnonzero(data == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    owner = np.searchsorted(joined.end, end)
    size = (end - start).astype(float)

    def total(mark: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
        return (sums[end] - sums[start]).astype(float)

    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, wide, blank = (data >= 48) & (data <= 57), data >= 128, ~IS_WORD[data]
    mark = ~(upper | lower | digit | wide | blank)
    plain = np.isin(data, [39, 44, 46, 45])  # ' , . -
    word_start, word_end, words, _ = joined.words(IS_WORD)
    words = numbered(words)
    line = np.searchsorted(end, word_start)
    repeat = np.zeros(len(words), bool)  # as the word before, or the one before that
    for d in (1, 2):
        repeat[d:] |= (words[d:] == words[:-d]) & (line[d:] == line[:-d])

    def of_words(x: np.ndarray) -> np.ndarray:
        return np.bincount(line, x, len(end)).astype(float)

    n_words = of_words(np.ones(len(words)))
    order = np.lexsort((words, line))
    distinct = np.ones(len(words), bool)
    distinct[order[1:]] = (words[order][1:] != words[order][:-1]) | (line[order][1:] != line[order][:-1])
    marks = np.concatenate([[0], np.cumsum(mark & ~plain, dtype=np.int64)])
    odd = marks[word_end] - marks[word_start]
    line_text = numbered(data.tobytes().split(b"\n")[:-1])
    order = np.lexsort((np.arange(len(end)), line_text, owner))
    again = np.zeros(len(end))
    again[order[1:]] = (line_text[order][1:] == line_text[order][:-1]) & (owner[order][1:] == owner[order][:-1]) & (size[order][1:] > 0)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(n_words, 1)
    own = np.stack(
        [
            total(upper) * per_byte, total(lower | wide) * per_byte, total(digit) * per_byte, total(mark & plain) * per_byte,
            total(mark & ~plain) * per_byte, of_words(odd >= 2) * per_word, of_words(odd >= 1) * per_word,
            of_words(word_end - word_start == 1) * per_word, of_words(repeat) * per_word, of_words(distinct) * per_word,
            size * per_word / 10, np.log1p(size), again, size == 0,
        ],
        axis=1,
    )
    same = owner[1:] == owner[:-1]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    edges = np.stack([np.append(False, same), np.append(same, False)], axis=1).astype(float)
    return np.concatenate([own, before, after, edges], axis=1), size + 1, owner


class Field:
    """Weights of the good label's features, and scores of the first label and of label pairs (0 bad, 1 good)."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray) -> None:
        self.mean, self.deviation = mean, deviation
        self.w, self.b, self.first, self.pair = np.zeros(len(mean)), 0.0, np.zeros(2), np.zeros((2, 2))

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.deviation, -8, 8) @ self.w + self.b

    def marginals(self, e: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of every line, expected first labels and pairs (by document, by line but a document's first).

        All documents advance line by line together, longest first, so that those that have ended fall off the end.
        """
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        sizes = np.diff(np.append(starts, len(owner)))
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
        scores = np.stack([np.zeros_like(e), e], axis=1)
        alpha, beta = np.zeros((len(e), 2)), np.zeros((len(e), 2))
        alpha[starts] = scores[starts] + self.first
        for t in range(1, sizes[0]):
            at = starts[: live[t]] + t
            alpha[at] = np.logaddexp.reduce(alpha[at - 1][:, :, None] + self.pair, axis=1) + scores[at]
        for t in range(sizes[0] - 2, -1, -1):
            at = starts[: live[t + 1]] + t
            beta[at] = np.logaddexp.reduce(self.pair + (scores[at + 1] + beta[at + 1])[:, None, :], axis=2)
        both = alpha + beta
        norm = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - norm)
        later = np.ones(len(e), bool)
        later[starts] = False
        at = np.flatnonzero(later)
        pairs = np.exp(
            alpha[at - 1][:, :, None] + self.pair + (scores[at] + beta[at])[:, None, :] - norm[at][:, None, None]
        )
        return good, np.stack([1 - good[starts], good[starts]], axis=1), pairs

    def climb(self, z: np.ndarray, owner: np.ndarray, want: np.ndarray, first: np.ndarray, pair: np.ndarray, steps: int, rate: float = 0.05, decay: float = 1e-3) -> None:
        """Adam on the log likelihood of (expected) line labels, given with those of first lines and of pairs as means, with weight decay."""
        theta = np.concatenate([self.w, [self.b], self.first, self.pair.ravel()])
        m, v, k = np.zeros_like(theta), np.zeros_like(theta), len(self.w)
        for step in range(1, steps + 1):
            good, firsts, pairs = self.marginals(z @ self.w + self.b, owner)
            gap = (want - good) / len(want)
            slope = np.concatenate([gap @ z, [gap.sum()], first - firsts.mean(0), (pair - pairs.sum(0) / len(want)).ravel()])
            slope -= decay * theta
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
            self.w, self.b, self.first, self.pair = theta[:k], theta[k], theta[k + 1 : k + 3], theta[k + 3 :].reshape(2, 2)

    def fit(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, rounds: int = 2, evidence: float = 2.0) -> None:
        """Learns from the labels y of the lines' documents. The lines' own labels are latent: first each is its document's; then, in rounds of
        expectation and maximisation, the field's own view of the lines with ``evidence`` (in log odds for each line) for the document's label."""
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        later = np.flatnonzero(~first)
        want_first = np.array([np.mean(y[first] == k) for k in (0, 1)])
        want_pair = np.array([[np.sum((y[later - 1] == i) & (y[later] == j)) for j in (0, 1)] for i in (0, 1)]) / len(y)
        self.climb(z, owner, y, want_first, want_pair, 150)
        for _ in range(rounds):
            good, firsts, pairs = self.marginals(z @ self.w + self.b + evidence * (2 * y - 1), owner)
            self.climb(z, owner, good, firsts.mean(0), pairs.sum(0) / len(y), 50)

    def quality(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's length-weighted mean marginal; the marginals, lengths and owners of the lines."""
        x, size, owner = line_features(texts)
        good, _, _ = self.marginals(self.emissions(x), owner)
        return np.bincount(owner, good * size, len(texts)) / np.bincount(owner, size, len(texts)), good, size, owner


def learned(sample: DataFrame, most_lines: int) -> Field:
    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches(frames):
            x, _, owner = line_features(part["text"].tolist())
            yield pd.DataFrame({"doc": part["doc_id"].to_numpy()[owner], "y": part["y"].to_numpy()[owner], "x": list(x.astype(np.float32))})

    short = F.size(F.split(F.coalesce("text", F.lit("")), "\n")) <= most_lines
    rows = sample.where(short).mapInPandas(lines, "doc long, y double, x array<float>").toPandas()
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, 1))
    field = Field(x.mean(0), x.std(0) + 1e-6)
    doc = rows["doc"].to_numpy()
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    field.fit(x, np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(doc)))), rows["y"].to_numpy())
    return field


def with_quality(docs: DataFrame, field: Field) -> DataFrame:
    """The rows with raw (length-weighted mean marginal) in place of their text."""
    return with_made(docs, lambda texts: {"raw": field.quality(texts)[0]}, {"raw": ("double", pa.float64())}, keep_text=False)


def line_labels(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, line (from 0), p_good and good of every line."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches(frames):
            _, good, _, owner = field.quality(part["text"].tolist())
            first = np.searchsorted(owner, owner)
            yield pd.DataFrame(
                {"doc_id": part["doc_id"].to_numpy()[owner], "line": np.arange(len(owner)) - first, "p_good": good, "good": good >= 0.5}
            )

    return docs.select("doc_id", "text").mapInPandas(work, "doc_id long, line long, p_good double, good boolean")


def quality(docs: DataFrame, labels: DataFrame, allowed: F.Column, bound: int = 8_000, most_lines: int = 200) -> DataFrame:
    """doc_id and score (0 to 1) of every document; learned from at most about ``bound`` labelled ones that allowed marks."""
    small_batches(docs.sparkSession)
    sample = stored(training_sample(docs, labels, "quality", allowed, bound), "sample")
    if sample.where("fold > 0").select("y").distinct().count() < 2:
        mean = sample.agg(F.avg("y")).first()[0] or 0.0
        return docs.select("doc_id", F.lit(float(mean)).alias("score"))
    field = learned(sample.where("fold > 0"), most_lines)
    isotonic = calibration(with_quality(sample.where("fold = 0"), field))
    return calibrated(with_quality(docs.select("doc_id", "text"), field), isotonic)


def op6_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, x) for x in ("documents", "labels"))
    scored = quality(docs, labels, remainder(4) != 2)
    return scored.select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


QUERIES = {"op6_line_field": op6_line_field}
SQL: dict[str, str] = {}
