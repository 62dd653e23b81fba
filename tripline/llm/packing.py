"""Packing documents into sequences of a fixed number of tokens, by bounded-space best fit.

A document's ids are those of a tokenizer, and an end id. Only documents longer than a sequence are cut; their whole pieces are
sequences of their own. What is left is dealt out evenly, whatever the ids and sources; a task takes its pieces in windows, the
longest first, and puts each in the open bin with the least room that holds it. Open bins are counted by
their free space in a bitset, so that the best bin is one shift and the lowest bit. If as many bins as may be are open, the fullest closes before a
new one opens. At the end of a task, bins with much room left are taken apart, and their pieces are packed again by fewer tasks,
until one is left: a task hands on its open bins at most, which are few, so no task gets more than a bounded number of pieces.

Defined results: a null or empty text is the end id alone; a null doc_id is a document like others; rows that repeat a doc_id are
documents of their own, with the same doc_id; an empty table gives no rows; other columns are not read. A text that holds
the tokenizer's added tokens is encoded as the library does by default.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.llm.common import batches, drop, kept, shared_dir, small_batches, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, `offset` long"

#: In texts of these characters, words of Latin letters (with apostrophes inside) and runs of other printable ASCII are never joined by the
#: tokenizer, which lower-cases them as Python does.
PLAIN = re.compile("[ -~\nÀ-ÖØ-öø-ÿ]*")
UNIT = re.compile(r"[a-zß-öø-ÿ]+(?:'[a-zß-öø-ÿ]+)*|[!-@\[-`{-~]+")
WORD = re.compile("[a-zß-öø-ÿ]+")
#: But where an apostrophe may begin a short form.
SHORT = re.compile("(?:^|[ \n0-9])'")
#: The units of texts without apostrophes.
SIMPLE = re.compile(r"[a-zß-öø-ÿ]+|[!-@\[-`{-~]+")
BLANK = re.compile("[ \n]")


def units(text: str) -> list[str]:
    """Strings whose ids, one after the other, are the text's: words and the like of a plain text, else what stands between blanks."""
    if PLAIN.fullmatch(text) and "<|" not in text:
        if "'" not in text:
            return SIMPLE.findall(text.lower())
        if not SHORT.search(text):
            return UNIT.findall(text.lower())
    return text.replace("\n", " ").split(" ")


class UnitEncoder:
    """Encodes texts with a lower-casing tokenizer that drops white space; what a unit encodes to is kept.

    At most about ``keep`` units, of 16 million characters, are kept; then it begins anew.
    """

    def __init__(self, path: str, keep: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}  # of each unit in start and size
        self.held = 0
        self.start = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, new: list[str]) -> None:
        """Words are encoded together, other units alone."""
        words, others = [], []
        for x in new:
            (words if WORD.fullmatch(x) else others).append(x)
        for a in range(0, len(words), 4096):
            some = words[a : a + 4096]
            whole = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            self._keep(some, np.bincount(np.array(whole.word_ids, np.int64), minlength=len(some)), whole.ids)
        found = [x.ids for x in self.tokenizer.encode_batch(others, add_special_tokens=False)]
        self._keep(others, np.fromiter(map(len, found), np.int64, len(found)), list(chain.from_iterable(found)))

    def _keep(self, new: list[str], size: np.ndarray, ids: list[int]) -> None:
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.array(ids, np.uint32)])
        self.held += sum(map(len, new))

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        split = [units(t) for t in texts]
        each = list(chain.from_iterable(split))
        mine = np.fromiter(map(self.place.get, each, repeat(-1)), np.int64, len(each))
        unknown = np.flatnonzero(mine < 0).tolist()
        if unknown:
            new = dict.fromkeys(each[i] for i in unknown)
            if len(self.place) + len(new) > self.keep or self.held > 16_000_000:
                self.clear()
                unknown, new = range(len(each)), dict.fromkeys(each)
            self.learn(list(new))
            mine[unknown] = [self.place[each[i]] for i in unknown]
        size = self.size[mine]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.arange(total[-1]) + np.repeat(self.start[mine] - total[:-1], size)]
        return np.split(flat, total[np.cumsum([len(s) for s in split])[:-1]])

    def encode(self, texts: list[str | None], most: int = 1_000_000) -> list[np.ndarray]:
        """The ids of each text; texts of more than ``most`` characters are encoded piece by piece, cut at blanks."""
        pieces, owner = [], []
        for i, text in enumerate(texts):
            at, text = 0, text or ""
            while True:
                cut = BLANK.search(text, at + most) if len(text) - at > most else None
                pieces.append(text[at : cut.start() if cut else len(text)])
                owner.append(i)
                if not cut:
                    break
                at = cut.end()
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for a in range(0, len(pieces), 256):
            for i, ids in zip(owner[a:], self.encode_many(pieces[a : a + 256]), strict=False):
                out[i].append(ids)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


@cache
def encoder_of(path: str) -> UnitEncoder:
    return UnitEncoder(path)


class OpenBins:
    """At most ``most`` open bins of a capacity; bit f of ``free`` is set while a bin with f places left is open."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most, self.count, self.free = capacity, most, 0, 0
        self.bins: dict[int, list[list]] = {}  # by free space: stacks of bins, each a list of rows

    def _take(self, room: int) -> list:
        stack = self.bins[room]
        rows = stack.pop()
        if not stack:
            del self.bins[room]
            self.free ^= 1 << room
        self.count -= 1
        return rows

    def add(self, row: tuple, length: int) -> Iterator[list]:
        """Puts a row in the open bin that it fills best; yields the bins that close."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            rows = self._take(room)
        else:
            if self.count >= self.most:
                yield self._take((self.free & -self.free).bit_length() - 1)
            room, rows = self.capacity, []
        rows.append(row)
        room -= length
        if room:
            self.bins.setdefault(room, []).append(rows)
            self.free |= 1 << room
            self.count += 1
        else:
            yield rows

    def left(self) -> Iterator[tuple[int, list]]:
        """Free space and rows of the bins that are still open, the fullest first."""
        for room in sorted(self.bins):
            for rows in self.bins[room]:
                yield room, rows


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """PIECES of every document: its ids with the end id, cut where they exceed the capacity."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = encoder_of(tokenizer), np.array([end_id], np.uint32)
        for group in batches(frames):
            rows = []
            for doc_id, ids in zip(group["doc_id"], encoder.encode(group["text"].tolist()), strict=True):
                ids = np.concatenate([ids, end]).astype("<u4")
                for i, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    rows.append((None if pd.isna(doc_id) else int(doc_id), i, a, len(part), zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(work, PIECES)


def placed(bins: Iterable[list], first: int) -> pd.DataFrame:
    """PLACED rows of bins, whose sequences are numbered from ``first``."""
    rows = []
    for n, held in enumerate(bins):
        at = 0
        for row in held:
            rows.append((*row, first + n, at))
            at += row[3]
    out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return out.astype({"doc_id": "Int64"})


def pack_level(pieces: DataFrame, level: int, tasks: int, capacity: int, open_bins: int, last: bool) -> DataFrame:
    """PLACED rows; those that the next level takes have no sequence. Every task packs its share of the pieces."""
    windows = F.pmod(F.xxhash64(*pieces.columns), F.lit(max(1, -(-pieces.count() // (tasks * open_bins)))))
    dealt = pieces.repartition(tasks).withColumn("window", windows)
    ordered = dealt.sortWithinPartitions("window", F.desc("length"), "doc_id", "piece", "ids_crc32").drop("window")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, bins = (level << 56) + (TaskContext.get().partitionId() << 32), OpenBins(capacity, open_bins)
        for frame in frames:
            doc_ids = [None if pd.isna(x) else int(x) for x in frame["doc_id"]]
            rest = [frame[c].tolist() for c in ("piece", "start", "length", "ids_crc32")]
            closed = [b for row in zip(doc_ids, *rest, strict=True) for b in bins.add(row, row[3])]
            yield placed(closed, number)
            number += len(closed)
        ends = list(bins.left())
        yield placed([rows for room, rows in ends if last or room * 64 < capacity], number)
        again = placed([rows for room, rows in ends if not last and room * 64 >= capacity], 0)
        again["sequence_id"] = pd.array([None] * len(again), "Int64")
        yield again

    return ordered.mapInPandas(work, PLACED)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, open_bins: int = 4096, task_pieces: int = 1 << 17) -> DataFrame:
    """PLACED: every piece of the documents (doc_id, text) in a sequence of at most ``capacity`` tokens.

    A task has ``open_bins`` bins open at most, and packs about ``task_pieces`` pieces. The order of arrival within it is by windows of as many
    pieces as bins, the longest first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces, path = kept(pieces_of(docs, tokenizer, capacity, end_id), "pieces")
    whole = pieces.where(F.col("length") == capacity)
    out = [whole.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    now, folder, level = pieces.where(F.col("length") < capacity), None, 0
    n = now.count()
    wanted = min(-(-n // open_bins), int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = max(1, wanted, -(-n // task_pieces))
    while True:
        level += 1
        done, to = kept(pack_level(now, level, tasks, capacity, open_bins, tasks == 1), "packed")
        if folder:
            drop(spark, folder)
        out.append(done.where("sequence_id is not null"))
        if tasks == 1:
            break
        now, folder = kept(done.where("sequence_id is null").drop("sequence_id", "offset"), "again")
        tasks = max(1, tasks // 16)
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op12_best_fit": op12_best_fit}
SQL: dict[str, str] = {}
