"""Benchmark decontamination with an FM-index for each shard of the training documents.

Words are runs of digits, lower-cased letters and non-ASCII characters. A test phrase (window) is ten consecutive words of an
item, or all words of a shorter one. A task takes documents until a shard is full; the shard's words become symbols of the
benchmark's vocabulary (any other word separates), their suffix array gives the Burrows-Wheeler transform, and a wavelet
matrix answers how often a symbol stands before a place. Backward search finds the suffixes that begin with each phrase, all
phrases at a time; sampled suffix positions locate the occurrences; overlapping ones merge into removal spans.

The benchmark is read from the shared folder in blocks of ``block_bytes``, never collected by the driver; a shard is indexed and searched
for each block. Documents are not shuffled.

Defined results: null or empty texts have no words, items without words have no phrase; rows that repeat a doc_id are
documents of their own; items that repeat an item_id count once; a null item_id is never named but its phrases count
as hits; empty tables give no rows, or documents without hits; columns with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.llm.common import Joined, shared_dir, small_batches, table, text_bytes, with_made

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
#: So many blocks of phrases a worker keeps from shard to shard; of more, it reads each again for every shard.
KEPT_BLOCKS = 4


class Phrases:
    """The distinct phrases of one block of items, as symbols (from 1) of the block's vocabulary, grouped by length.

    A group has the length, a row of symbols for each phrase, and the item ids of phrase i at ids[cut[i] : cut[i + 1]].
    """

    def __init__(self, item_ids: list[int | None], texts: list[str | None], window: int) -> None:
        start, _, words, first = Joined([text_bytes(t) for t in texts]).words(IS_WORD)
        self.vocabulary: dict[bytes, int] = {}
        symbol = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), np.int32, len(start))
        rows: dict[int, list] = {}
        for item, a, b in zip(range(len(texts)), first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b > a:
                found = np.lib.stride_tricks.sliding_window_view(symbol[a:b], min(b - a, window))
                rows.setdefault(found.shape[1], []).append((found, np.full(len(found), item)))
        self.least = min(rows, default=1)
        self.groups = []
        known = np.array([i is not None for i in item_ids], bool)
        number = np.array([0 if i is None else i for i in item_ids], np.int64)
        for n, parts in sorted(rows.items()):
            distinct, which = np.unique(np.concatenate([x for x, _ in parts]), axis=0, return_inverse=True)
            owner = np.concatenate([x for _, x in parts])
            pairs = np.unique(np.stack([which.ravel(), owner])[:, known[owner]], axis=1)
            self.groups.append((n, distinct.astype(np.int64), np.searchsorted(pairs[0], np.arange(len(distinct) + 1)), number[pairs[1]]))

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """Of each word; 0 for words that no phrase has."""
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of symbols where every 0 differs from the others and the earlier is less; by doubling the sorted prefix.

    Only suffixes that still tie with another are sorted again.
    """
    n = len(text)
    zeros = np.flatnonzero(text == 0)
    rank = text + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    order = np.argsort(rank, kind="stable")
    span, tied = 1, np.arange(n)
    while True:
        key = rank[order]
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        if span == 1:  # dense ranks: the place of each class's first suffix
            rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        alone = starts & np.concatenate([starts[1:], [True]])
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order
        mine = order[tied]
        follow = np.where(mine + span < n, rank[np.minimum(mine + span, n - 1)], -1)
        by = np.lexsort((follow, rank[mine]))
        mine, follow = mine[by], follow[by]
        order[tied] = mine
        same = np.concatenate([[False], (rank[mine][1:] == rank[mine][:-1]) & (follow[1:] == follow[:-1])])
        rank[mine] = np.maximum.accumulate(np.where(same, 0, tied))
        span *= 2


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[np.minimum(at, len(self.words) - 1)] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class FmIndex:
    """Counts and locates phrases of symbols above 0 in a text whose zeros separate; the text ends with a zero."""

    def __init__(self, text: np.ndarray, sample: int = 8) -> None:
        order = suffix_array(text)
        bwt = text[order - 1]  # before the first symbol stands the last, a zero
        size = int(text.max()) + 1
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.levels, self.zeros = [], []
        left = bwt
        for bit in range(max(size - 1, 1).bit_length() - 1, -1, -1):
            ones = (left >> bit) & 1
            self.levels.append((bit, Bits(ones)))
            self.zeros.append(len(left) - int(ones.sum()))
            left = np.concatenate([left[ones == 0], left[ones == 1]])
        # Walking back from any suffix meets a sampled one before it would have to pass a separator.
        marked = (order % sample == 0) | (bwt == 0)
        self.marked, self.positions = Bits(marked), order[marked]

    def before(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        start = np.zeros_like(i)
        for (bit, ones), zeros in zip(self.levels, self.zeros, strict=True):
            up = (symbol >> bit) & 1 == 1
            a, b = ones.rank(start), ones.rank(i)
            start, i = np.where(up, zeros + a, start - a), np.where(up, zeros + b, i - b)
        return i - start

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for (bit, ones), zeros in zip(self.levels, self.zeros, strict=True):
            up, r = ones.get(i), ones.rank(i)
            out |= up.astype(np.int64) << bit
            i = np.where(up, zeros + r, i - r)
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the phrases (a row each) that occur: which, and from where to where their suffixes are sorted."""
        live = np.flatnonzero((phrases < len(self.less) - 1).all(1))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.less[-1])
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            lo, hi = self.less[c] + self.before(c, lo), self.less[c] + self.before(c, hi)
            some = hi > lo
            live, lo, hi = live[some], lo[some], hi[some]
        return live, lo, hi

    def locate(self, i: np.ndarray) -> np.ndarray:
        """The text positions of sorted suffixes."""
        out, steps, todo = np.zeros_like(i), 0, np.arange(len(i))
        while len(todo):
            there = self.marked.get(i)
            out[todo[there]] = self.positions[self.marked.rank(i[there])] + steps
            todo, i = todo[~there], i[~there]
            c = self.symbol(i)
            i, steps = self.less[c] + self.before(c, i), steps + 1
        return out


def occurrences(index_text: np.ndarray, phrases: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By phrase length: the positions where phrases occur, which phrase each is, and the phrases' items (cut and ids)."""
    inside = index_text > 0
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= phrases.least
    starts, ends = starts[long], ends[long]  # shorter runs of known words hold no phrase, and are left out
    if not len(starts):
        return
    sizes = ends - starts + 1
    total = np.cumsum(sizes)
    at = np.arange(total[-1]) + np.repeat(starts - total + sizes, sizes)
    text = np.where(np.arange(total[-1]) == np.repeat(total - 1, sizes), 0, index_text[np.minimum(at, len(index_text) - 1)])
    index = FmIndex(text)
    for n, rows, cut, ids in phrases.groups:
        which, lo, hi = index.search(rows)
        count = hi - lo
        if len(which):
            end = np.cumsum(count)
            suffix = np.arange(end[-1]) + np.repeat(lo - end + count, count)
            yield n, at[index.locate(suffix)], np.repeat(which, count), cut, ids


def read_phrases(folder: str, window: int, block_bytes: int) -> Iterator[Phrases]:
    """The benchmark in blocks of about ``block_bytes`` of texts or of one item."""
    fs, path = pafs.FileSystem.from_uri(folder)
    ids, texts, held = [], [], 0
    for file in sorted(x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.endswith(".parquet")):
        with fs.open_input_file(file) as source:
            for part in pq.ParquetFile(source).iter_batches(64, columns=["item_id", "text"]):
                for i, text in zip(part["item_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    ids.append(i)
                    texts.append(text)
                    held += len(text_bytes(text))
                    if held >= block_bytes:
                        yield Phrases(ids, texts, window)
                        ids, texts, held = [], [], 0
    if ids:
        yield Phrases(ids, texts, window)


@lru_cache(maxsize=1)
def few_blocks(folder: str, window: int, block_bytes: int) -> list[Phrases] | None:
    """All blocks, if they are few enough for a worker to keep them."""
    blocks = list(islice(read_phrases(folder, window, block_bytes), KEPT_BLOCKS + 1))
    return blocks if len(blocks) <= KEPT_BLOCKS else None


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, shard_bytes: int = 1 << 20, block_bytes: int = 1 << 20
) -> DataFrame:
    """The documents with n_words, n_hit (words inside phrases), items (ids, in order of their strings), spans (start and
    end of what is to be removed, in characters) and clean_text (the text without the spans).
    """
    small_batches(docs.sparkSession)
    folder = shared_dir(docs.sparkSession, "phrases")
    items.select(F.col("item_id").cast("long"), "text").write.parquet(folder)
    longs, place = pa.list_(pa.int64()), pa.struct([("start", pa.int64()), ("end", pa.int64())])
    made = {
        "n_words": ("long", pa.int64()),
        "n_hit": ("long", pa.int64()),
        "items": ("array<long>", longs),
        "spans": ("array<struct<start: long, end: long>>", pa.list_(place)),
        "clean_text": ("string", pa.string()),
    }

    def shard(texts: list[str | None]) -> dict[str, list]:
        joined = Joined([text_bytes(t) for t in texts])
        start, end, each, first = joined.words(IS_WORD)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        apart = np.arange(len(start)) + owner  # where each word stands in a text with a separator after each document
        back = np.full(len(start) + len(texts) + 1, -1)
        back[apart] = np.arange(len(start))
        cover = np.zeros(len(start) + 1, np.int64)
        found: list[set] = [set() for _ in texts]
        blocks = few_blocks(folder, window, block_bytes)
        for phrases in read_phrases(folder, window, block_bytes) if blocks is None else blocks:
            if not phrases.groups:
                continue
            symbols = np.zeros(len(start) + len(texts) + 1, np.int64)
            symbols[apart] = phrases.symbols(each)
            for n, at, which, cut, ids in occurrences(symbols, phrases):
                words = back[at]
                np.add.at(cover, words, 1)
                np.add.at(cover, words + n, -1)
                for d, p in np.unique(np.stack([owner[words], which]), axis=1).T.tolist():
                    found[d].update(ids[cut[p] : cut[p + 1]].tolist())
        hit = np.cumsum(cover[:-1]) > 0
        # A span runs from the first to the last of neighbouring hit words of one document.
        follows = hit[1:] & hit[:-1] & (owner[1:] == owner[:-1])
        opens = np.flatnonzero(hit & ~np.concatenate([[False], follows]))
        closes = np.flatnonzero(hit & ~np.concatenate([follows, [False]]))
        spans: list[list] = [[] for _ in texts]
        for d, a, b in zip(owner[opens].tolist(), start[opens].tolist(), end[closes].tolist(), strict=True):
            spans[d].append((a - int(joined.start[d]), b - int(joined.start[d])))
        out: dict[str, list] = {c: [] for c in made}
        out["n_words"] = np.diff(first).tolist()
        out["n_hit"] = np.bincount(owner[hit], minlength=len(texts)).tolist()
        out["items"] = [[int(x) for x in sorted(map(str, f))] for f in found]
        for text, cuts in zip(texts, spans, strict=True):
            if not cuts:
                out["spans"].append([])
                out["clean_text"].append(text)
                continue
            raw, at, parts, places, chars = text_bytes(text), 0, [], [], 0
            for a, b in cuts:
                parts.append(raw[at:a].decode())
                chars += len(parts[-1])
                size = len(raw[a:b].decode())
                places.append({"start": chars, "end": chars + size})
                chars, at = chars + size, b
            out["spans"].append(places)
            out["clean_text"].append("".join(parts) + raw[at:].decode())
        return out

    return with_made(docs, shard, made, most=shard_bytes)


def op8_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.transform("items", lambda x: x.cast("string")), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op8_fm_index": op8_fm_index}
SQL: dict[str, str] = {}
