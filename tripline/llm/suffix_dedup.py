"""Exact removal of repeated byte strings with suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts in a document of a smaller doc_id. Texts are taken as
UTF-8 bytes; strings never cross documents and are judged on the input.

1. Documents are gathered into shards, which are written as files in the shared folder. Every string has an anchor, its
   substring of ``GRAM`` bytes of the least hash, so equal strings have equal anchors at equal places. Bits of the anchors' hashes are
   dealt out, and anchors that occur in one shard only are ruled out for what crosses shards.
2. Every shard gets a suffix array by Larsson-Sadakane refinement (only suffixes that still tie are sorted again, by the rank of what
   follows). The last refinement ends at ``length`` bytes, so that suffixes of one rank are one string, which decides all repeats
   within the shard. Of every anchor that other shards have too, the shard sends its distinct contexts (the bytes of all strings that
   have the anchor), in the order of its suffix array and with the least doc_id, to the anchor's bucket.
3. A bucket merges the shards' sorted contexts by binary search, comparing bytes. Contexts of one anchor that differ are put in a suffix
   array of their own, so that the strings they share get their least doc_id too.
4. The decisions go back to the shards, which mark the strings.

Hashes only rule out; that strings are equal is decided by suffix ranks and bytes. No text is shuffled but the
contexts of anchors that several shards have. Texts above ``shard_bytes`` are cut into pieces that overlap by length - 1
bytes, and put together again at the end.

Defined results: a null or empty text has no bytes; a null doc_id counts as greater than all others; rows that repeat a doc_id
don't remove from each other; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import io
import os
import zlib
from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.llm.common import Joined, batches, mixed, read_file, shared_dir, small_batches, stored, table, tasks_for, text_bytes, write_file

GRAM = 20
LAST = np.iinfo(np.int64).max
ALL = np.uint32(1 << 31)
#: Files of the shared folder hold shards of about so many bytes.
PACK_BYTES = 16 << 20


def sliding(f: np.ufunc, a: np.ndarray, width: int) -> np.ndarray:
    """f over a[i : i + width]; the last width - 1 places are over what is there."""
    out, span = a.copy(), 1
    while span < width:
        step = min(span, width - span)
        f(out[:-step], out[step:], out=out[:-step])
        span += step
    return out


def eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(len(data), np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : j + len(data)]
    return word


def gram_hashes(data: np.ndarray, word: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the GRAM bytes at each place where so many are left; never 0. word is eight(data), if that is at hand."""
    word = eight(data) if word is None or len(word) < len(data) else word
    n = len(data) - GRAM + 1
    h = mixed(word[:n])
    for at in (8, GRAM - 8):
        h = mixed((h ^ word[at : at + n]) * np.uint64(0x9E3779B97F4A7C15))
    return h | np.uint64(1)


class Anchors:
    """The anchors of a shard: place, hash, and the bytes from ``start`` to ``end`` that their strings cover."""

    def __init__(self, joined: Joined, length: int, word: np.ndarray | None = None) -> None:
        data, width = joined.data, length - GRAM + 1
        if len(data) < GRAM:
            data = np.concatenate([data, np.zeros(GRAM, np.uint8)])
        h = gram_hashes(data, word)
        n = len(h)
        least = sliding(np.minimum, h, width)
        for a, b in zip(joined.start.tolist(), (joined.end + 1).tolist(), strict=True):
            least[max(a, b - length) : b] = 0  # no string starts here
        least[len(joined.data) :] = 0
        top = sliding(np.maximum, least[::-1], width)[::-1]
        self.place = np.flatnonzero(top == h)
        self.hash = h[self.place]
        # The strings of an anchor start from the first to the last place in reach where it is the least. These follow each other: a lesser hash
        # between them would be in the reach of one. So they are a run of equal least hashes, the last one at or before the anchor that has its hash.
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        run = np.searchsorted(first, self.place, side="right") - 1
        value, left = least[first], np.arange(len(run))
        while len(left := left[value[run[left]] != self.hash[left]]):
            run[left] -= 1
        self.start = np.maximum(first[run], self.place - width + 1)
        self.end = np.minimum(np.append(first[1:], n)[run] - 1, self.place) + length


def refined(data: np.ndarray, depth: int, exact: bool, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes sorted by their first bytes, ``depth`` of them if exact, else so many at least; zeros follow the end. Also the rank of each place
    (one past the end too), which sorted suffixes tie still, and which did so before the last round.

    What ties on ``span`` bytes is sorted again by the rank of what follows them; if exact, the last time by that of the last ``span`` bytes of ``depth``.
    """
    n = len(data)
    word = eight(data) if word is None else word
    order = np.argsort(word).astype(np.int32)
    key = word[order]
    starts = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n, dtype=np.int32), 0))
    del word, key
    span, tied = 8, np.flatnonzero(~(starts & np.concatenate([starts[1:], [True]])))
    close = tied
    while span < depth and len(tied):
        close = tied
        step = min(span, depth - span) if exact else span
        mine = order[tied]
        both = (rank[mine].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(mine + step, n)] + 1).astype(np.uint64)
        by = np.argsort(both)
        both, mine = both[by], mine[by]
        order[tied] = mine
        new = np.concatenate([[True], both[1:] != both[:-1]])
        rank[mine] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
        span += step
    return order, rank, tied, close


def suffix_array(data: np.ndarray, depth: int, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of the bytes by their first ``depth`` bytes at least, ties by place; zeros follow the end. Also which of the sorted
    suffixes may share ``depth`` bytes with another, as they tie in the last round of refinement."""
    order, rank, tied, close = refined(data, depth, False, word)
    mine = order[tied]  # what ties still is put in the order of the text
    order[tied] = mine[np.argsort((rank[mine].astype(np.uint64) << np.uint64(32)) | mine.astype(np.uint64))]
    several = np.zeros(len(data), bool)
    several[close] = True
    return order, several


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, most: int, several: np.ndarray | None = None) -> np.ndarray:
    """Kasai: how many bytes, up to ``most`` (255 at most), each suffix shares with the one sorted before it (0 for the first).

    What the suffix at p shares, that at p + 1 shares but for one byte; as order ends at some depth, that is only taken for
    granted below ``most``, or if the same neighbours follow. The runs of text from each of ``starts`` to the next are followed
    side by side, each beginning anew. Sorted suffixes that several leaves out share less than ``most`` bytes with others; 0 stands for them.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(most, np.uint8)])
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1] if several is None else np.where(several[1:] & several[:-1], order[:-1], -1)
    out, at, stop = np.zeros(n, np.uint8), starts.astype(np.int32), np.append(starts[1:], n).astype(np.int32)
    h = np.zeros(len(starts), np.int32)
    while len(at):
        q = before[at]
        h[q < 0] = 0
        grow = np.flatnonzero((q >= 0) & (h < most))
        while len(grow):
            p = at[grow] + h[grow]
            same = padded[p] == padded[q[grow] + h[grow]]
            grow = grow[same]
            h[grow] += 1
            grow = grow[h[grow] < most]
        out[at] = h
        go = at + 1 < stop
        at, h, stop, q = at[go] + 1, h[go], stop[go], q[go]
        h = np.where((h == most) & (before[at] != q + 1), 0, np.maximum(h - 1, 0))
    return out


def string_classes(data: np.ndarray, length: int, word: np.ndarray | None = None) -> np.ndarray:
    """Of each place the rank of the ``length`` bytes (eight at least) that start there: equal ranks, equal bytes, else their order. It is the
    place in the suffix array of the first suffix that begins so."""
    return refined(data, length, True, word)[1][:-1]


def least_by(group: np.ndarray, n: int, ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least known id of each group (LAST if there is none), and whether there is one."""
    least, some = np.full(n, LAST), np.zeros(n, bool)
    np.minimum.at(least, group[known], ids[known])
    some[group[known]] = True
    return least, some


def earlier(least: np.ndarray, some: np.ndarray, ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether the least id is under the other one, where an unknown one is above all."""
    return some & (~known | (least < ids))


class Contexts:
    """Sorted distinct contexts: keys (size and bytes), anchors, and least ids."""

    def __init__(self, anchor: np.ndarray, data: np.ndarray, size: np.ndarray, least: np.ndarray, some: np.ndarray, width: int) -> None:
        row = np.zeros((len(size), width + 1), np.uint8)
        row[:, 0] = size
        row[:, 1:][np.arange(width) < size[:, None]] = data
        self.key, self.anchor, self.least, self.some = row.view(f"S{width + 1}").ravel(), anchor, least, some

    def merge(self, other: Contexts) -> Contexts:
        """Takes what the other one has; each of its keys is found by binary search."""
        at = np.searchsorted(self.key, other.key)
        same = self.key[np.minimum(at, len(self.key) - 1)] == other.key
        mine = at[same]
        self.least, self.some = self.least.copy(), self.some.copy()
        self.least[mine] = np.minimum(self.least[mine], other.least[same])
        self.some[mine] |= other.some[same]
        new = ~same
        for name in ("key", "anchor", "least", "some"):
            setattr(self, name, np.insert(getattr(self, name), at[new], getattr(other, name)[new]))
        return self


def decide(blocks: list[tuple[np.ndarray, ...]], length: int) -> list[np.ndarray]:
    """For the contexts of each shard (anchor, bytes of all, size, least id, whether there is one; sorted by size and bytes): which of
    their strings start in a document before that least one, as bits; ALL if the context itself is in an earlier one."""
    width = 2 * length - GRAM
    given = [Contexts(*b, width) for b in blocks]
    merged = [copy(x) for x in given]
    while len(merged) > 1:
        merged = [x.merge(y[0]) if y else x for x, y in ((merged[i], merged[i + 1 : i + 2]) for i in range(0, len(merged), 2))]
    found = merged[0]
    mask = np.zeros(len(found.key), np.uint32)
    _, group, members = np.unique(found.anchor, return_inverse=True, return_counts=True)
    some = np.flatnonzero(members[group] > 1)  # contexts of anchors that have several
    if len(some):
        rows = found.key[some].view(np.uint8).reshape(len(some), width + 1)
        sizes = rows[:, 0].astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        text = rows[:, 1:][np.arange(width) < sizes[:, None]]
        place = string_classes(text, length)
        windows = sizes - length + 1
        wend = np.cumsum(windows)
        within = np.arange(wend[-1]) - np.repeat(wend - windows, windows)
        owner = np.repeat(np.arange(len(some)), windows)
        cls = place[starts[owner] + within]
        ids, known = found.least[some][owner], found.some[some][owner]
        least, any_known = least_by(cls, int(cls.max()) + 1, ids, known)
        bits = np.where(earlier(least[cls], any_known[cls], ids, known), np.uint32(1) << within.astype(np.uint32), np.uint32(0))
        mask[some] = np.bitwise_or.reduceat(bits, wend - windows)
    out = []
    for x in given:
        at = np.searchsorted(found.key, x.key)
        out.append(np.where(earlier(found.least[at], found.some[at], x.least, x.some), ALL, mask[at]))
    return out


class Pack:
    """Byte strings gathered into files of the shared folder; each has a name of its own at once."""

    def __init__(self, folder: str) -> None:
        self.folder, self.parts, self.held = folder, [], 0
        self.begin()

    def begin(self) -> None:
        self.uri = f"{self.folder}/{os.urandom(12).hex()}.zst"

    def add(self, **arrays: np.ndarray) -> str:
        raw = io.BytesIO()
        np.savez(raw, **arrays)
        data = zstandard.ZstdCompressor(level=1).compress(raw.getvalue())
        name = f"{self.uri}#{self.held}#{len(data)}"
        self.parts.append(data)
        self.held += len(data)
        if self.held >= PACK_BYTES:
            self.flush()
        return name

    def flush(self) -> None:
        if self.parts:
            write_file(self.uri, b"".join(self.parts))
        self.parts, self.held = [], 0
        self.begin()


def get_arrays(name: str) -> dict[str, np.ndarray]:
    uri, start, size = name.rsplit("#", 2)
    raw = zstandard.ZstdDecompressor().decompress(read_file(uri, int(start), int(size)))
    return dict(np.load(io.BytesIO(raw)))


class Shard:
    """ids, known (whether the id is), whole (0, or a number that the pieces of one text share), at (where a piece starts), own
    (how many of its bytes are not the next piece's too) and the texts."""

    NAMES = ("ids", "known", "whole", "at", "own")

    def __init__(self, rows: list[tuple], texts: list[bytes]) -> None:
        for name, x, kind in zip(self.NAMES, zip(*rows, strict=True), (np.int64, bool, np.int64, np.int64, np.int64), strict=True):
            setattr(self, name, np.array(x, kind))
        self.joined = Joined(texts)

    def put(self, pack: Pack) -> str:
        joined = self.joined
        return pack.add(data=joined.data, sizes=joined.end - joined.start, **{n: getattr(self, n) for n in self.NAMES})

    @classmethod
    def get(cls, name: str) -> Shard:
        x = get_arrays(name)
        raw, cut = x["data"].tobytes(), np.cumsum(x["sizes"] + 1).tolist()
        texts = [raw[b - 1 - n : b - 1] for b, n in zip(cut, x["sizes"].tolist(), strict=True)]
        return cls(list(zip(*(x[n].tolist() for n in cls.NAMES), strict=True)), texts)


def removal(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, list[dict[str, int]], bytes]:
    """How many bytes the spans (sorted, possibly touching) remove, the maximal spans, and the rest."""
    runs: list[list[int]] = []
    for a, b in spans:
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    at, parts = 0, []
    for a, b in runs:
        parts.append(data[at:a])
        at = b
    rest = b"".join([*parts, data[at:]])
    return len(data) - len(rest), [{"start": a, "end": b} for a, b in runs], rest


def remove_repeats(
    docs: DataFrame, length: int = 50, shard_bytes: int = 1 << 20, keep_bytes: bool = False, anchors_per_bucket: int = 1 << 16
) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start and end of each removed run, in bytes) and kept_sha256 of every row; with
    keep_bytes also kept, the remaining bytes. length is GRAM to GRAM + 30, as a context's strings are told by 31 bits."""
    if not GRAM <= length <= GRAM + 30:
        raise ValueError(f"length is {GRAM} to {GRAM + 30}")
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark, "text-shards")
    log_buckets = max(8, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())

    def told_of(hashes: np.ndarray) -> np.ndarray:
        """What is told about an anchor in the first round: its bucket and 32 bits."""
        return hashes >> np.uint64(32 - log_buckets)

    def ranges(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Each bucket of the sorted ones, and from where to where it is."""
        each, first = np.unique(buckets, return_index=True)
        return zip(each.tolist(), first.tolist(), [*first[1:].tolist(), len(buckets)], strict=False)

    def to_shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = Pack(folder)
        for part in batches(frames, most=shard_bytes):
            rows, texts = [], []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                known, raw = not pd.isna(doc_id), text_bytes(text)
                doc_id = int(doc_id) if known else LAST
                if len(raw) <= shard_bytes:
                    rows.append((doc_id, known, 0, 0, len(raw)))
                    texts.append(raw)
                else:
                    whole = int.from_bytes(os.urandom(7)) + 1
                    for at in range(0, len(raw), shard_bytes):
                        rows.append((doc_id, known, whole, at, min(shard_bytes, len(raw) - at)))
                        texts.append(raw[at : at + shard_bytes + length - 1])
            apart = [(i, i + 1) for i in range(len(rows))] if any(r[2] for r in rows) else [(0, len(rows))]
            for a, b in apart:
                shard = Shard(rows[a:b], texts[a:b])
                name, told = shard.put(pack), np.unique(told_of(Anchors(shard.joined, length).hash))
                out = [(-1, name, b"")]
                out += [(k, name, told[i:j].astype(np.uint32).tobytes()) for k, i, j in ranges(told >> np.uint64(32))]
                yield pd.DataFrame(out, columns=["bucket", "shard", "told"])
        pack.flush()

    # In pandas a nullable integer would become a float.
    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    told = stored(source.mapInPandas(to_shards, "bucket int, shard string, told binary"), "anchors")

    # What a bucket holds must not grow with the corpus, so their number does.
    total = told.agg(F.sum(F.octet_length("told")) / 4, F.count_if(F.col("bucket") == -1)).first()
    log_contexts = max(8, int((total[0] or 0) // anchors_per_bucket).bit_length())
    tasks, spread = tasks_for(spark, -(-(total[1] or 0) // 4)), 1 << log_contexts

    def repeated(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.uint32) for x in frame["told"]]
        ends = np.cumsum([len(p) for p in parts])
        flat = np.concatenate(parts)
        order = np.argsort(flat)
        ranked = flat[order]
        same = ranked[1:] == ranked[:-1]
        several = np.zeros(len(flat), bool)
        several[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        bits = np.split(several, ends[:-1])
        return pd.DataFrame({"shard": frame["shard"], "bucket": frame["bucket"], "bits": [np.packbits(b).tobytes() for b in bits]})

    answers = told.where("bucket >= 0").groupBy("bucket").applyInPandas(repeated, "shard string, bucket int, bits binary")
    answers = answers.groupBy("shard").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    everything = told.where("bucket = -1").select("shard").repartition(tasks, "shard")

    def to_contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = Pack(folder)
        for frame in frames:
            for name, answer in zip(frame["shard"], frame["answers"], strict=True):
                shard = Shard.get(name)
                joined, owner = shard.joined, np.repeat(np.arange(len(shard.ids)), shard.joined.end - shard.joined.start + 1)
                word = eight(joined.data)
                cls = string_classes(joined.data, length, word)
                begins = np.flatnonzero(joined.end[owner] - np.arange(len(owner)) >= length)  # where strings start
                mine, ids, known = cls[begins], shard.ids[owner[begins]], shard.known[owner[begins]]
                least, some = least_by(mine, int(cls.max()) + 1, ids, known)
                starts = np.zeros(len(joined.data), bool)
                starts[begins] = earlier(least[mine], some[mine], ids, known)
                found = Anchors(joined, length, word)
                hashes = told_of(found.hash)
                told = np.unique(hashes)
                good, bits = np.zeros(len(told), bool), {x["bucket"]: x["bits"] for x in ([] if answer is None else answer)}
                for k, i, j in ranges(told >> np.uint64(32)):
                    good[i:j] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=j - i)
                use = np.flatnonzero(good[np.searchsorted(told, hashes)])
                start, end = found.start[use], found.end[use]
                # A context is told from others by its size and its first and last string.
                keys = np.stack([cls[end - length], cls[start], end - start, found.hash[use] >> np.uint64(64 - log_contexts)]).astype(np.int64)
                order = np.lexsort(keys)
                new = np.concatenate([[True], (keys[:, order[1:]] != keys[:, order[:-1]]).any(0)])[: len(order)]
                which = np.empty(len(use), np.int64)
                which[order] = np.cumsum(new) - 1
                one = order[new]
                doc = owner[found.place[use]]
                least, some = least_by(which, len(one), shard.ids[doc], shard.known[doc])
                side = pack.add(
                    starts=np.packbits(starts), start=start.astype(np.uint32), size=(end - start).astype(np.uint8), which=which.astype(np.uint32)
                )
                size, hashes, start = (end - start)[one], found.hash[use][one], start[one]
                total = np.cumsum(size)
                text = joined.data[np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + size, size)]
                at = np.concatenate([[0], total])
                # The shard itself is told by a row without contexts, in a bucket of its own kind.
                rows = [(-1 - zlib.crc32(name.encode()) % spread, name, side, b"", b"", b"", b"", b"")]
                for k, i, j in ranges(hashes >> np.uint64(64 - log_contexts)):
                    parts = hashes[i:j], text[at[i] : at[j]], size[i:j].astype(np.uint8), least[i:j], some[i:j]
                    rows.append((k, name, side, *(p.tobytes() for p in parts)))
                yield pd.DataFrame(rows, columns=["bucket", "shard", "side", "anchor", "data", "size", "least", "some"])
        pack.flush()

    context_schema = "bucket int, shard string, side string, anchor binary, data binary, size binary, least binary, some binary"
    contexts = everything.join(answers, "shard", "left").mapInPandas(to_contexts, context_schema)

    def decisions(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["bucket"].iloc[0] < 0:
            return frame[["shard", "bucket", "side"]].assign(masks=None)
        kinds = {"anchor": np.uint64, "data": np.uint8, "size": np.uint8, "least": np.int64, "some": bool}
        blocks = [[np.frombuffer(v, kind) for v, kind in zip(row, kinds.values(), strict=True)] for row in frame[list(kinds)].itertuples(index=False)]
        blocks = [(a, d, s.astype(np.int64), x, y) for a, d, s, x, y in blocks]
        masks = [m.tobytes() for m in decide(blocks, length)]
        return pd.DataFrame({"shard": frame["shard"], "bucket": frame["bucket"], "side": None, "masks": masks})

    decided = contexts.groupBy("bucket").applyInPandas(decisions, "shard string, bucket int, side string, masks binary")
    told_masks = F.when(F.col("masks").isNotNull(), F.struct("bucket", "masks"))
    sides = decided.repartition(tasks, "shard").groupBy("shard").agg(F.max("side").alias("side"), F.sort_array(F.collect_list(told_masks)).alias("masks"))

    def result(doc_id: int, known: bool, data: bytes, spans: list[tuple[int, int]]) -> tuple:
        removed, runs, rest = removal(data, spans)
        row = (int(doc_id) if known else None, len(data), removed, runs, hashlib.sha256(rest).hexdigest())
        return (*row, rest) if keep_bytes else row

    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"] + ["kept"] * keep_bytes

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, side, masks in zip(frame["shard"], frame["side"], frame["masks"], strict=True):
                shard, x = Shard.get(name), get_arrays(side)
                joined = shard.joined
                starts = np.unpackbits(x["starts"], count=len(joined.data)).view(bool)
                if len(masks):
                    mask = np.concatenate([np.frombuffer(m["masks"], np.uint32) for m in masks])[x["which"]]
                    begin, size = x["start"].astype(np.int64), x["size"].astype(np.int64)
                    for w in range(length - GRAM + 1):
                        hit = ((mask & ALL > 0) | ((mask >> np.uint32(w)) & 1 > 0)) & (w <= size - length)
                        starts[begin[hit] + w] = True
                at = np.flatnonzero(starts)
                ends = np.append(np.diff(at) > length, True)[: len(at)]  # runs of strings that overlap or touch
                opens, closes = at[np.concatenate([[True], ends[:-1]])[: len(at)]], at[ends] + length
                owner = np.searchsorted(joined.end, opens)
                cut = np.searchsorted(owner, np.arange(len(shard.ids) + 1))
                rows, pieces = [], []
                for d in range(len(shard.ids)):
                    first = int(joined.start[d]) - int(shard.at[d])
                    spans = [(int(p) - first, int(q) - first) for p, q in zip(opens[cut[d] : cut[d + 1]], closes[cut[d] : cut[d + 1]], strict=True)]
                    data = joined.data[joined.start[d] : joined.end[d]]
                    if shard.whole[d]:
                        pieces.append((int(shard.whole[d]), int(shard.at[d]), data[: shard.own[d]].tobytes(), [{"start": a, "end": b} for a, b in spans]))
                        rows.append((*result(shard.ids[d], shard.known[d], b"", []), *pieces[-1]))
                    else:
                        rows.append((*result(shard.ids[d], shard.known[d], data.tobytes(), spans), 0, 0, None, None))
                out = pd.DataFrame(rows, columns=[*names, "whole", "at", "piece", "parts"])
                yield out.assign(doc_id=pd.array(out["doc_id"].tolist(), "Int64"))

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        spans = [(x["start"], x["end"]) for parts in frame["parts"] for x in parts]
        doc_id = frame["doc_id"].iloc[0]
        row = result(0 if pd.isna(doc_id) else int(doc_id), not pd.isna(doc_id), b"".join(map(bytes, frame["piece"])), sorted(spans))
        out = pd.DataFrame([row], columns=names)
        return out.assign(doc_id=pd.array(out["doc_id"].tolist(), "Int64"))

    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string"
    schema += ", kept binary" * keep_bytes
    marked = sides.mapInPandas(mark, schema + ", whole long, at long, piece binary, parts array<struct<start: long, end: long>>")
    marked = stored(marked, "marked")
    long = marked.where("whole > 0").groupBy("whole").applyInPandas(together, schema)
    return marked.where("whole = 0").select(*names).unionByName(long)


def op2_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


QUERIES = {"op2_suffix_arrays": op2_suffix_arrays}
SQL: dict[str, str] = {}
