"""Near-duplicate documents by b-bit MinHash.

A document's set holds the 64-bit hashes of its word shingles. Documents with equal sets form a class at once. Each class gets
N_HASHES minima; bands of them name buckets, and the low BITS of each mixed minimum are packed into a signature. Pairs that share a bucket
are first judged by their signatures: of m equal low bits in N_HASHES, a share of 2**-BITS is chance, so the similarity is
estimated as (m / N_HASHES - c) / (1 - c) with c = 2**-BITS. Pairs whose sizes allow a link, whose estimate is not DEVIATIONS too low and
whose sets' parities do not prove too many different elements are compared on their full sets.

Words are runs of other characters than ASCII white space, A-Z lower-cased, told apart by 64-bit XXH3 hashes.

Defined results: a document with fewer words than a shingle has its whole sequence as one; without words, or with a null
text, its set is empty, and it is linked with nothing; rows that repeat a
doc_id are documents of one component; documents without doc_id are linked with nothing, and each is kept; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.llm.common import batches, drop, kept, mixed, small_batches, stored, table, text_bytes, word_hashes
from tripline.llm.components import dealt, linked_groups

#: At a similarity of 0.85 a pair shares none of the 25 bands of five minima with a chance of 4e-7, at 0.8 of 5e-5.
N_HASHES, BANDS, ROWS, BITS = 256, 25, 5, 2
#: Pairs whose estimate is this many deviations too low are not compared; the README has the loss measured by set size.
DEVIATIONS = 6
PARITIES = 1024
_RANDOM = np.random.default_rng(20240607)
FACTORS = _RANDOM.integers(0, 2**63, N_HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RANDOM.integers(0, 2**63, N_HASHES, np.uint64)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [text_bytes(t).lower().split() for t in texts]
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    each = word_hashes([w for found in words for w in found])
    hashes = each[: max(len(each) - size + 1, 0)].copy()
    for j in range(1, size):
        hashes = mixed(hashes + each[j : j + len(hashes)] * FACTORS[j])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(hashes[a : b - size + 1]))
        else:
            whole = each[a : min(a + 1, b)].copy()
            for j in range(a + 1, b):
                whole = mixed(whole + each[j : j + 1] * FACTORS[j - a])
            out.append(whole + np.uint64(b - a))
    return out


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(N_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 2048):
        part = hashes[a : a + 2048] * FACTORS[:, None]
        part += TERMS[:, None]
        np.minimum(out, part.min(1), out=out)
    return out


def low_bits(m: np.ndarray) -> np.ndarray:
    """BITS bits of each minimum. Minima are mixed first: the low bits of FACTORS * h + TERMS depend on those of h alone."""
    return mixed(m) & np.uint64(2**BITS - 1)


def packed(low: np.ndarray) -> np.ndarray:
    """The signature's words: BITS bits of each minimum."""
    each = 64 // BITS
    shifts = np.arange(each, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(-1, each) << shifts, axis=1)


def parities(hashes: np.ndarray) -> np.ndarray:
    """PARITIES bits, packed: how many of the set's hashes fall on each bit, odd or even. What two sets do not share turns
    each bit in which they differ, so they differ in at least as many elements as bits."""
    at = (mixed(hashes) >> np.uint64(17)).astype(np.int64) % PARITIES
    return np.packbits((np.bincount(at, minlength=PARITIES) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of the set in two longs."""
    return tuple(np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64).tolist())


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (size of the set), h1 and h2 (digest of the set, null if empty), bands, signature and parity."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches(frames):
            rows = []
            for s in shingle_sets(part["text"].tolist(), size):
                if not len(s):
                    rows.append((0, None, None, None, None, None))
                    continue
                m = minima(s)
                bands = m[: BANDS * ROWS].reshape(BANDS, ROWS)
                key = bands[:, 0].copy()
                for j in range(1, ROWS):
                    key = mixed(key + bands[:, j] * FACTORS[j])
                rows.append((len(s), *digest(s), *(x.view(np.int64) for x in (key, packed(low_bits(m)), parities(s)))))
            n, h1, h2, bands, signs, parity = zip(*rows, strict=True)
            ids = {"h1": pd.array(h1, "Int64"), "h2": pd.array(h2, "Int64")}
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n": n, **ids, "bands": bands, "signature": signs, "parity": parity})

    schema = "doc_id long, n long, h1 long, h2 long, bands array<long>, signature array<long>, parity array<long>"
    return docs.select("doc_id", "text").mapInPandas(work, schema)


Mark = Callable[[str], F.Column]


def estimate(one: Mark, other: Mark) -> F.Column:
    """The corrected similarity of two signatures."""
    evens = F.lit(int("01" * 32, 2))
    unequal = F.lit(0)
    for i in range(N_HASHES * BITS // 64):
        x = one(f"s{i}").bitwiseXOR(other(f"s{i}"))
        unequal = unequal + F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(evens))
    chance = 2.0**-BITS
    return (1 - unequal / N_HASHES - chance) / (1 - chance)


def differing(one: Mark, other: Mark) -> F.Column:
    """In how many parities two sets differ."""
    out = F.lit(0)
    for i in range(PARITIES // 64):
        out = out + F.bit_count(one(f"p{i}").bitwiseXOR(other(f"p{i}")))
    return out


def near_duplicates(docs: DataFrame, size: int = 5, similarity: str = "0.8") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of what is linked) and kept (doc_id = component_id), a row for each row.

    Documents are linked if the shared part of their sets is at least ``similarity`` (exact decimal) of all of both.
    """
    small_batches(docs.sparkSession)
    share = Fraction(similarity)
    up, down, j = share.numerator, share.denominator, float(share)
    rows = stored(sketches(docs, size), "sketches")
    classes = rows.where("h1 is not null and doc_id is not null").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("id"), F.first("bands").alias("bands"),
        F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("parity").alias("parity"),
    )
    classes = stored(classes, "classes")
    keyed = classes.select("id", F.posexplode("bands").alias("band", "value"))
    keyed = keyed.select(F.xxhash64("band", "value").alias("bucket"), "id")
    shared = keyed.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("bucket")
    words = {"s": ("signature", N_HASHES * BITS // 64), "p": ("parity", PARITIES // 64)}
    marks = [F.col(c)[i].alias(f"{k}{i}") for k, (c, n) in words.items() for i in range(n)]
    members = keyed.join(shared, "bucket", "left_semi").join(classes.select("id", "n", *marks), "id")
    # The texts of one doc_id are one document.
    repeated = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    named = classes.select("h1", "h2", "id")
    own = rows.select("doc_id", "h1", "h2").join(dealt(repeated, "doc_id"), "doc_id", "left_semi").join(named, ["h1", "h2"])
    same = own.select(F.col("id").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct()

    def to_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches(frames):
            found = shingle_sets(part["text"].tolist(), size)
            yield pd.DataFrame({"id": part["doc_id"].to_numpy(), "hashes": [s.tobytes() for s in found]})

    # No estimate rules out below its mean by less than DEVIATIONS; no set differs in more bits than elements.
    mean = 2.0**-BITS + (1 - 2.0**-BITS) * j
    deviation = (mean * (1 - mean) / N_HASHES) ** 0.5 / (1 - 2.0**-BITS)

    def near(one: Mark, other: Mark) -> F.Column:
        n, m = one("n"), other("n")
        sizes = F.least(n, m) * down >= F.greatest(n, m) * up
        apart = differing(one, other) * (down + up) <= (n + m) * (down - up)
        return sizes & apart & (estimate(one, other) >= j - DEVIATIONS * deviation)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = []
            for x, y in zip(frame["ha"], frame["hb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(down * both >= up * (len(x) + len(y) - both))
            yield frame.loc[good, ["a", "b"]]

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = docs.select("doc_id", "text").join(dealt(wanted, "doc_id"), "doc_id", "left_semi")
        sets, path = kept(texts.mapInPandas(to_sets, "id long, hashes binary"), "sets")
        full = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a")
        full = full.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
        found = stored(full.mapInPandas(compare, "a long, b long"), "found")
        drop(docs.sparkSession, path)
        return found

    labels = linked_groups(members, near, verify, same)
    if labels is None:
        named = named.withColumn("component_id", F.col("id"))
    else:
        named = named.join(dealt(labels, "id"), "id", "left").select("h1", "h2", F.coalesce("label", "id").alias("component_id"))
    named = named.select("h1", "h2", "component_id").repartition(F.xxhash64("h1"))
    out = rows.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, "0.85")


QUERIES = {"op9_minhash": op9_minhash}
SQL: dict[str, str] = {}
