"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found by comparing tiles of code-point matrices.

Words are counted in the documents' tasks, and added up by Spark. Two words of a single edit share all code points before it and
after it. The words are therefore grouped by what they share if the edit falls in a given span of their positions: for the shorter word's
length s and the span [a, b), by its first a and last s - b code points. The first spans are the two halves; the span of a group of more than
``most`` words is halved again, until the groups are small or a span is a single position, where a group can't be larger than the alphabet
allows. So no group grows with the data, none is dropped, and every pair is found in exactly one span.

Groups lie one after the other in a task's rows. Blocks of rows are held against each other as matrices of code points, padded at the end (for common
prefixes) and at the front (for common suffixes): words whose lengths differ by one at most are near if common prefix and suffix together reach
the longer one's length minus one.

Defined results: null texts have no words; a null doc_id stands as an empty text in the hash; rows that repeat a doc_id are documents of
their own; a very long run is a word like others; empty tables, and those without words, give no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.llm.common import batches, drop, kept, small_batches, stored, table

RUN, NO_RUN = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Elements that a comparison of two blocks holds at most, unless a block has one row, and rows of a block.
CELLS, BLOCK = 1 << 22, 64
GROUP = ["s", "a", "b", "shared"]


def slices(text: str, most: int = 1_000_000) -> Iterator[str]:
    """The text in slices of about ``most`` characters that cut no run."""
    at = 0
    while len(text) - at > most:
        cut = NO_RUN.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def runs_of(text: str) -> Counter:
    """The counts of the runs, A-Z in lower case."""
    found: Counter = Counter()
    for part in slices(text):
        for run, n in Counter(RUN.findall(part)).items():
            found[run.lower() if run.isascii() else run.translate(LOWER)] += n
    return found


def varied(run: str, crc: int, one_in: int) -> str:
    """The run, or, if one_in divides its hash, the run without one code point."""
    h = zlib.crc32(run.encode(), crc)
    at = h % len(run)
    return run if h % one_in else run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, one_in: int = 97, keep: int = 300_000) -> DataFrame:
    """word and n of the documents' (doc_id, text) words. A task adds up at most ``keep`` words before it hands them on."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for group in batches(frames):
            for doc_id, text in zip(group["doc_id"], group["text"], strict=True):
                crc = zlib.crc32(b":" if pd.isna(doc_id) else b"%d:" % int(doc_id))
                for run, n in runs_of(text or "").items():
                    if len(run) >= least_length:
                        word = varied(run, crc, one_in)
                        if len(word) >= least_length:
                            held[word] += n
            if len(held) > keep:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held = Counter()
        yield pd.DataFrame({"word": list(held), "n": list(held.values())}).astype({"word": object, "n": np.int64})

    small_batches(docs.sparkSession)
    counts = docs.select("doc_id", "text").mapInPandas(work, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def spans(words: DataFrame, edges: list) -> DataFrame:
    """A row for each span (start, end): word, n and GROUP. words has word, n and s; start and end are SQL over s (and a and b)."""
    each = F.explode(F.array(*[F.struct(F.expr(x).cast("int").alias("a"), F.expr(y).cast("int").alias("b")) for x, y in edges]))
    rows = words.withColumn("_e", each).withColumn("a", F.col("_e.a")).withColumn("b", F.col("_e.b")).drop("_e")
    shared = F.expr("concat(substring(word, 1, a), substring(word, char_length(word) - (s - b) + 1, s - b))")
    return rows.withColumn("shared", shared).select("word", "n", *GROUP)


def groups(words: DataFrame, least_length: int, most: int) -> DataFrame:
    """word, n and GROUP: the rows of all groups that hold a pair, none of them larger than ``most`` or than the alphabet allows."""
    lengths = F.explode(F.array(F.char_length("word"), F.char_length("word") - 1))
    now = spans(words.withColumn("s", lengths).where(F.col("s") >= least_length), [("0", "s div 2"), ("s div 2", "s")])
    out, path = None, None
    while True:
        now, new = kept(now, "spans")
        if path:
            drop(words.sparkSession, path)
        sizes = now.groupBy(*GROUP).agg(F.count("*").alias("size")).where("size > 1")
        sizes, path = stored(sizes, "sizes").repartition(*GROUP), new
        large = (F.col("size") > most) & (F.col("b") - F.col("a") > 1)
        fit = kept(now.join(sizes.where(~large).drop("size"), GROUP, "left_semi"), "groups")[0]
        out = fit if out is None else out.unionByName(fit)
        rest = now.join(sizes.where(large).drop("size"), GROUP, "left_semi")
        if sizes.where(large).isEmpty():
            return out
        now = spans(rest.drop("shared"), [("a", "(a + b) div 2"), ("(a + b) div 2", "b")])


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and code points padded with zeros at the end and at the front."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    points = points.astype(np.uint8 if len(points) == 0 or points.max() < 256 else np.uint32)
    width = int(size.max(initial=0))
    row, at = np.repeat(np.arange(len(words)), size), np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
    left, right = np.zeros((2, len(words), width), points.dtype)
    left[row, at] = points
    right[row, at + width - size[row]] = points
    return size, left, right


def run_length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a with each of b: how many columns from the first on are equal."""
    differs = a[:, None, :] != b[None, :, :]
    return np.where(differs.any(2), differs.argmax(2), a.shape[1])


def near_pairs(words: list[str], group: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near pairs within equal numbers of group, which are in ascending order. Only the pairs whose edit falls in the group's span are told."""
    found = [np.zeros((0, 2), np.int64)]
    size, left, right = matrices(words)
    step = max(1, min(BLOCK, isqrt(CELLS // max(1, left.shape[1]))))
    starts = range(0, len(words), step)
    for x in starts:
        for y in range(x, len(words), step):
            if group[y] > group[min(x + step, len(words)) - 1]:
                break
            i, j = slice(x, x + step), slice(y, y + step)
            long, short = np.maximum(size[i, None], size[j]), np.minimum(size[i, None], size[j])
            prefix = np.minimum(run_length(left[i], left[j]), short)
            suffix = np.minimum(run_length(right[i, ::-1], right[j, ::-1]), short)
            near = (prefix + suffix >= long - 1) & (long - short <= 1) & (group[i, None] == group[j]) & (short == s[i, None])
            near &= (prefix >= a[i, None]) & ((prefix < b[i, None]) | (b[i, None] == s[i, None]))
            p, q = np.nonzero(near)
            p, q = p + x, q + y
            found.append(np.stack([p[p < q], q[p < q]], axis=1))
    pairs = np.concatenate(found)
    return pairs[:, 0], pairs[:, 1]


def near_words(words: DataFrame, least_length: int = 5, most: int = 2048, batch: int = 1 << 14) -> DataFrame:
    """word, n, other and other_n: every near pair of words (word, n), once in each direction."""
    small_batches(words.sparkSession)
    grouped = groups(words, least_length, most).repartition(*GROUP).sortWithinPartitions(*GROUP, "word")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def compared(part: pd.DataFrame) -> pd.DataFrame:
            number = part.groupby(GROUP, sort=False).ngroup().to_numpy()
            i, j = near_pairs(part["word"].tolist(), number, *(part[c].to_numpy() for c in ("s", "a", "b")))
            word, n = part["word"].to_numpy(), part["n"].to_numpy()
            i, j = np.concatenate([i, j]), np.concatenate([j, i])
            return pd.DataFrame({"word": word[i], "n": n[i], "other": word[j], "other_n": n[j]})

        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) < batch:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = (whole[GROUP] == whole[GROUP].iloc[-1]).all(axis=1).to_numpy()
            if not last.all():  # the last group may go on
                yield compared(whole[~last])
            held = [whole[last]]
        if held:
            yield compared(pd.concat(held, ignore_index=True))

    return grouped.mapInPandas(work, "word string, n long, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root: forms (word, form) followed to their ends, in steps that double."""
    now, path = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        both = now.join(ahead, F.col("root") == F.col("_w"), "left")
        new, new_path = kept(both.select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        drop(forms.sparkSession, path)
        now, path = new.drop("moved"), new_path
        if new.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, one_in: int = 97, most: int = 2048) -> DataFrame:
    """word, n, n_near, form, form_n and root of the words of the documents (doc_id, text)."""
    words = stored(vocabulary(docs, least_length, least_count, one_in), "words")
    near = near_words(words, least_length, most)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("first"))
    form_n = -F.col("first.minus")
    told = words.join(best, "word", "left").withColumn("is_form", F.coalesce(form_n >= 2 * F.col("n"), F.lit(False)))
    told = stored(
        told.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("is_form"), F.col("first.other")).alias("form"),
            F.when(F.col("is_form"), form_n).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
SQL: dict[str, str] = {}
