"""Token ids of documents in files of Simple-8b words.

A file holds the ids of consecutive documents in blocks of ``BLOCK`` ids. A block is a run of 64-bit words: the
top four bits select how many ids of how many bits the other 60 hold. Ids of more than 60 bits take an escape word and a
raw word. The file gives each block's first word, so blocks can be decoded apart and all words of a kind at once.

Defined results: a null or empty text has no ids but the end id; rows that repeat a doc_id are documents of their
own, in the order of their texts' hashes; a null doc_id comes first; an empty table gives no files and no rows;
other columns than doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripline.llm.common import batches, read_file, shared_dir, small_batches, stored, table, tasks_for, write_file

BLOCK = 1024
#: Fixed values of the code: by selector, how many ids a word holds and of how many bits.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
MAGIC = b"S8BT"
STRETCH = BLOCK << 8

#: Kinds of characters for the pretoken rules of byte-level BPE; END stands between texts, RARE is left to the library.
END, LETTER, NUMBER, OTHER, SPACE, BLANK, RARE = range(7)
#: No pretoken reaches over these places, so a long text may be cut there.
CUT = re.compile(r"(?<=[^\s\x1c-\x1f])(?= [A-Za-z])")


@cache
def kinds() -> np.ndarray:
    """The kind of every code point up to U+FFFF; RARE where Unicode has changed it since version 3.2, and above."""
    old, out = unicodedata.ucd_3_2_0, np.full(0x10001, RARE, np.uint8)
    groups = {"L": LETTER, "N": NUMBER}
    for i in range(0x10000):
        now, then = unicodedata.category(chr(i)), old.category(chr(i))
        if now[0] == then[0] and now not in ("Cn", "Cs") and not chr(i).isspace():
            out[i] = groups.get(now[0], OTHER)
    out[[9, 10, 11, 12, 13, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x3000]] = BLANK
    out[32] = SPACE
    return out


def pretokens(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where each pretoken begins: an optional space with a run of letters, of numbers or of other characters; the
    short forms 's 't 're 've 'm 'll 'd; and what blanks are left. END characters count as pretokens."""
    blank = kind >= SPACE
    before = np.concatenate([[np.uint8(END)], kind[:-1]])
    after = np.concatenate([kind[1:], [np.uint8(END)]])
    begin = ~blank & ((kind != before) | (kind == END)) & ((before != SPACE) | (kind == END))
    begin |= blank & (before < SPACE)  # a run of blanks begins
    begin |= blank & (after < SPACE) & (after != END)  # its last blank stands before a pretoken, or with it
    quote = np.flatnonzero(begin[:-1] & (points[:-1] == 39))
    if len(quote):
        padded = np.append(points, [0, 0])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(x) for x in "stmd"]) & (kind[quote + 1] == LETTER)
        long = ~short & np.isin(one * 65536 + two, [ord(x) * 65536 + ord(y) for x, y in ("re", "ve", "ll")])
        begin[quote[short | long] + 1] = False
        rest = np.concatenate([quote[short] + 2, quote[long] + 3])
        begin[rest[kind[np.minimum(rest, len(kind) - 1)] == LETTER]] = True
    return np.flatnonzero(begin)


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The words of the ids (unsigned 64-bit) and where each block's words begin, with the end."""
    n, blocks = len(ids), -(-len(ids) // block)
    padded = np.zeros((blocks, block + COUNTS[0]), np.uint64)
    whole = n // block
    padded[:whole, :block] = ids[: whole * block].reshape(whole, block)
    if n % block:
        padded[whole, : n % block] = ids[whole * block :]
    kind = np.searchsorted(np.array([1 << w for w in WIDTHS], np.uint64), padded.ravel(), side="right")
    kind = kind.astype(np.uint8).reshape(padded.shape)
    best = np.where(kind == len(WIDTHS), ESCAPE, len(WIDTHS) - 1).astype(np.uint8)
    top, span = kind, 1  # the largest kind among the next ``span`` ids
    for s in range(len(COUNTS) - 2, -1, -1):
        more = COUNTS[s] - span
        wider = top.copy()
        np.maximum(top[:, :-more], top[:, more:], out=wider[:, :-more])
        top, span = wider, COUNTS[s]
        best[:, :block][top[:, :block] <= s] = s
    step = np.array([*COUNTS, 0, 1], np.int64)
    size = np.full(blocks, block)
    size[blocks - 1 :] = n - block * (blocks - 1)
    active, cursor, taken = np.arange(blocks), np.zeros(blocks, np.int64), []
    while len(active):
        s = best[active, cursor]
        taken.append((active, cursor, s))
        cursor = cursor + step[s]
        go = cursor < size[active]
        active, cursor = active[go], cursor[go]
    if not taken:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    owner, at, sel = (np.concatenate(x) for x in zip(*taken, strict=True))
    order = np.argsort(owner, kind="stable")
    owner, at, sel = owner[order], at[order], sel[order]
    place = np.cumsum(1 + (sel == ESCAPE)) - (sel == ESCAPE) - 1
    words = np.zeros(len(sel) + int((sel == ESCAPE).sum()), np.uint64)
    flat, base = padded.ravel(), owner * padded.shape[1] + at
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            word = np.full(len(mine), s << 60, np.uint64)
            for j in range(count):
                word |= flat[base[mine] + j] << np.uint64(j * width)
            words[place[mine]] = word
    mine = np.flatnonzero(sel == ESCAPE)
    words[place[mine]] = ESCAPE << 60
    words[place[mine] + 1] = flat[base[mine]]
    used = np.bincount(owner, 1 + (sel == ESCAPE), blocks).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(used)])


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of the blocks whose words begin at the offsets."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    header = np.ones(len(words), bool)
    for i in np.flatnonzero(sel == ESCAPE):
        if header[i]:
            header[i + 1] = False
    count = np.where(header, np.array([*COUNTS, 0, 1])[sel], 0)
    before = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = before - before[offsets[:-1]][owner] + owner * block if len(words) else before
    limit = np.minimum((owner + 1) * block, n)
    out = np.zeros(n, np.uint64)
    for s, (k, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        mine = np.flatnonzero(header & (sel == s))
        for j in range(k):
            fits = mine[at[mine] + j < limit[mine]]
            out[at[fits] + j] = (words[fits] >> np.uint64(j * width)) & np.uint64((1 << width) - 1)
    mine = np.flatnonzero(header & (sel == ESCAPE))
    out[at[mine]] = words[mine + 1]
    return out


def to_file(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    # Blocks are packed a stretch at a time, which bounds the memory that it takes.
    packed = [pack(ids[a : a + STRETCH].astype(np.uint64)) for a in range(0, len(ids), STRETCH)]
    words = np.concatenate([np.zeros(0, np.uint64), *(w for w, _ in packed)])
    ends = np.cumsum([0, *(len(w) for w, _ in packed)])
    offsets = np.concatenate([[0], *(o[1:] + e for (_, o), e in zip(packed, ends, strict=False))])
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join(
        (
            MAGIC,
            struct.pack("<IQQQ", BLOCK, len(doc_ids), len(ids), len(words)),
            known.tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array(sizes, "<i8").tobytes(),
            offsets.astype("<i8").tobytes(),
            words.astype("<u8").tobytes(),
        )
    )


def from_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Doc ids, numbers of ids, and all ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    block, docs, n, n_words = struct.unpack_from("<IQQQ", data, 4)
    at = 4 + 28
    parts = []
    for kind, k in (("u1", docs), ("<i8", docs), ("<i8", docs), ("<i8", -(-n // block) + 1), ("<u8", n_words)):
        parts.append(np.frombuffer(data, kind, k, at))
        at += parts[-1].nbytes
    known, doc_ids, sizes, offsets, words = parts
    step = STRETCH // block if block < STRETCH else 1
    ids = [np.zeros(0, np.uint64)]
    for a in range(0, len(offsets) - 1, step):
        some = offsets[a : a + step + 1]
        ids.append(unpack(words[some[0] : some[-1]], some - some[0], min(n - a * block, step * block), block))
    return [int(d) if k else None for k, d in zip(known, doc_ids, strict=True)], sizes, np.concatenate(ids)


class Encoder:
    """Encodes texts with a tokenizer file; what a pretoken encodes to is kept, so that it is merged only once.

    At most about ``keep`` pretokens, and ``chars`` characters of them, are kept; when they are full, those that came up but once since
    the last time go, and if that is not half of them, the rarer half. With ``added``, the added tokens of the file are found in
    texts, as is the library's default; else they are text like any other.
    """

    def __init__(self, path: str, keep: int = 600_000, added: bool = False, chars: int = 8_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.added: list[str] = []
        if added:
            self.tokenizer = Tokenizer.from_file(path)
            self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep, self.chars = keep, chars
        self.place: dict[str, int] = {}  # of each pretoken in start, size and uses
        self.held = 0
        self.start = self.size = self.uses = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def forget(self) -> None:
        """Keeps at most half of the pretokens, those used most often since the last time and more than once."""
        good = np.flatnonzero(self.uses > 1)
        if len(good) > self.keep // 2:
            good = np.sort(good[np.argsort(-self.uses[good], kind="stable")[: self.keep // 2]])
        texts = list(self.place)
        texts = [texts[i] for i in good.tolist()]
        if sum(map(len, texts)) > self.chars // 2:  # few, but long
            good, texts = good[:0], []
        size, start = self.size[good], self.start[good]
        total = np.cumsum(size)
        self.ids = self.ids[np.arange(size.sum()) + np.repeat(start - total + size, size)]
        self.start, self.size, self.uses = total - size, size, np.zeros(len(good), np.int64)
        self.place, self.held = dict(zip(texts, range(len(texts)), strict=True)), sum(map(len, texts))

    def learn(self, texts: list[str]) -> None:
        """Spaced words are encoded together, the others alone."""
        together = [len(t) > 1 and t[0] == " " and t[1:].isalpha() for t in texts]
        spaced, alone = [t for t, x in zip(texts, together, strict=True) if x], [t for t, x in zip(texts, together, strict=True) if not x]
        ids, sizes = [self.ids], []
        for a in range(0, len(spaced), 4096):
            part = spaced[a : a + 4096]
            whole = self.plain.encode("".join(part), add_special_tokens=False)
            ids.append(np.array(whole.ids, np.uint32))
            sizes.append(np.bincount(np.array(whole.word_ids, np.int64), minlength=len(part)))
        found = [x.ids for x in self.plain.encode_batch(alone, add_special_tokens=False)]
        ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
        size = np.concatenate([*sizes, np.fromiter(map(len, found), np.int64, len(found))]).astype(np.int64)
        start = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate(ids)
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
        self.uses = np.concatenate([self.uses, np.zeros(len(texts), np.int64)])
        self.place.update(zip(chain(spaced, alone), range(len(self.place), len(self.place) + len(texts)), strict=True))
        self.held += sum(map(len, texts))

    def has_added(self, text: str) -> bool:
        return any(x in text for x in self.added)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        whole = "\0".join(texts) + "\0"
        points = np.frombuffer(whole.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kind = kinds()[np.minimum(points, 0x10000)]
        kind[ends] = END
        rare = np.unique([*np.searchsorted(ends, np.flatnonzero(kind == RARE)), *(i for i, t in enumerate(texts) if self.has_added(t))]).astype(int)
        begin = pretokens(points, np.minimum(kind, BLANK))
        stop = np.append(begin[1:], len(points))
        each = [whole[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        ending = kind[begin] == END
        mine = np.fromiter(map(self.place.get, each, repeat(-1)), np.int64, len(each))
        new = list(dict.fromkeys(each[i] for i in np.flatnonzero(mine < 0)))
        if new:
            if len(self.place) + len(new) > self.keep or self.held > self.chars:
                self.forget()
                new = [t for t in dict.fromkeys(each) if t not in self.place]
                missing = slice(None)
            else:
                missing = np.flatnonzero(mine < 0)
            self.learn(new)
            lost = each if isinstance(missing, slice) else [each[i] for i in missing]
            mine[missing] = np.fromiter(map(self.place.__getitem__, lost), np.int64, len(lost))
        self.uses += np.bincount(mine, minlength=len(self.uses))
        size = np.where(ending, 0, self.size[mine])
        total = np.cumsum(size)
        flat = self.ids[np.arange(total[-1]) + np.repeat(self.start[mine] - total + size, size)]
        out = np.split(flat, total[np.searchsorted(begin, ends)][:-1])
        for i in rare:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def encode(self, texts: list[str | None], most: int = 1_000_000) -> list[np.ndarray]:
        """The ids of each text. It works on pieces of about ``most`` characters; longer texts are cut where none is lost;
        those with added tokens are not cut."""
        pieces, owner, held, out = [], [], 0, [[] for _ in texts]

        def work() -> None:
            nonlocal pieces, owner, held
            for i, x in zip(owner, self.encode_many(pieces) if pieces else [], strict=True):
                out[i].append(x)
            pieces, owner, held = [], [], 0

        for i, text in enumerate(texts):
            at, whole = 0, bool(text) and self.has_added(text)
            while text and at < len(text):
                cut = CUT.search(text, at + most) if len(text) - at > 2 * most and not whole else None
                end = cut.start() if cut else len(text)
                pieces.append(text[at:end])
                owner.append(i)
                held, at = held + end - at, end
                if held >= most:
                    work()
        work()
        return [x[0] if len(x) == 1 else np.concatenate([*x, np.zeros(0, np.uint32)]) for x in out]


@cache
def encoder_of(path: str, added: bool = False) -> Encoder:
    """One for each Python worker, which keeps it from task to task."""
    return Encoder(path, added=added)


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int | None = 0, order: list[str] | None = None, file_ids: int = 4 << 20, added: bool = False
) -> DataFrame:
    """Writes the documents' token files in the order of the columns (default doc_id) and returns their list.

    docs has doc_id and text; the list has part, seq, path, n_docs, n_ids and start (ids of all files before).
    added is the Encoder's. One range shuffle of the texts; a task holds one file's ids. Files of attempts that failed are not in the list.
    """
    order = order or ["doc_id"]
    small_batches(docs.sparkSession)
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession, "token-files")
    keyed = docs.select(*dict.fromkeys([*order, "doc_id", "text"])).withColumn("_h", F.xxhash64("text"))
    placed = keyed.repartitionByRange(*order, "_h").sortWithinPartitions(*order, "_h").select("doc_id", "text")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), encoder_of(tokenizer, added)
        doc_ids, ids, held, seq = [], [], 0, 0
        end = np.array([] if end_id is None else [end_id], np.uint32)

        def flush() -> pd.DataFrame:
            nonlocal doc_ids, ids, held, seq
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            data = to_file(doc_ids, [len(x) for x in ids], flat)
            write_file(path := f"{folder}/{part:06d}-{seq:06d}-{os.urandom(6).hex()}.s8b", data)
            row = pd.DataFrame([(part, seq, path, len(doc_ids), len(flat))], columns=["part", "seq", "path", "n_docs", "n_ids"])
            doc_ids, ids, held, seq = [], [], 0, seq + 1
            return row

        for frame in frames:
            for group in batches([frame]):
                for doc_id, found in zip(group["doc_id"], encoder.encode(group["text"].tolist()), strict=True):
                    doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                    ids.append(np.concatenate([found, end]))
                    held += len(ids[-1])
                    if held >= file_ids:
                        yield flush()
        if doc_ids:
            yield flush()

    files = stored(placed.mapInPandas(write, "part int, seq int, path string, n_docs long, n_ids long"), "token-list")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the listed files."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start in zip(frame["path"], frame["start"], strict=True):
                doc_ids, sizes, ids = from_file(read_file(path))
                raw, ends = ids.astype("<u4"), np.cumsum(sizes)
                crc = [zlib.crc32(raw[e - k : e]) for e, k in zip(ends, sizes, strict=True)]
                yield pd.DataFrame(
                    {"doc_id": pd.array(doc_ids, "Int64"), "start": start + ends - sizes, "n_tokens": sizes, "ids_crc32": crc}
                )

    spread = files.select("path", "start").repartition(tasks_for(files.sparkSession, files.count()))
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_tokens(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True))


QUERIES = {"op4_token_files": op4_token_files}
SQL: dict[str, str] = {}
