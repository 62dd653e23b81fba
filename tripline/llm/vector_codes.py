"""Product codes of integer vectors, with exact nearest entries by an integer Walsh-Hadamard transform.

Components become floor(scale * x). A vector is cut into equal parts, and every part position has a codebook: the parts of the rows of smallest
vec_id, moved to the floors of their parts' means in a few rounds. To find a part's nearest entry, parts and entries are
padded with zeros to a power of two, and transformed by the Walsh-Hadamard matrix in sequency order. It keeps squared distances but
for the factor of its size, and brings what differs most to the front: the squared differences are summed up coefficient by coefficient, and an
entry goes as soon as its sum exceeds the whole distance of the best one known. All of it is in integers: in 64 bits where no sum can exceed them,
else in Python's.

Every round is one pass over the rows; a task sums up its parts by entry, and Spark adds the sums. Only the codebooks go through the driver.

Defined results: vectors that are null, or hold null or non-finite components, are dropped; vectors of another number of
components have codebooks of their own; a number that the parts don't divide is filled up with zeros at the end; an empty vector has code 0
everywhere and no error; with fewer rows than entries the codebooks are smaller; rows that repeat a vec_id are rows of their own (in the order of
their vectors), null ids come last; an error beyond a long is null, and so is the sum of its label; an empty table gives no rows; other columns
are not read. The codebooks of all numbers of components are held by the driver and the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripline.llm.common import small_batches, stored, table

#: Sums of tasks are given to Spark in signed digits of so many bits.
DIGIT = 40
CODED = "vec_id long, label {label}, code string, error long, codebooks_sha256 string"

Books = dict[int, np.ndarray]  #: by number of components: parts x entries x components of a part


@cache
def walsh(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, its rows in the order of their sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")]


def transformed(x: np.ndarray) -> np.ndarray:
    """The rows' coefficients in sequency order, after filling up with zeros to a power of two."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    padded = np.zeros((len(x), size), x.dtype)
    padded[:, : x.shape[1]] = x
    return padded @ walsh(size)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest entry, ties to the lower index, and the squared distance. x and entries are integers."""
    a, c = transformed(x), transformed(entries)
    size, rows = a.shape[1], np.arange(len(a))
    sums = (a[:, :1] - c[:, 0]) ** 2
    guess = sums.argmin(1)
    best = ((a - c[guess]) ** 2).sum(1)
    row, entry = np.nonzero(sums <= best[:, None])
    sums = sums[row, entry]
    for j in range(1, size):
        sums = sums + (a[row, j] - c[entry, j]) ** 2
        first = np.searchsorted(row, rows)  # every row keeps an entry: that of its best distance
        if 2 * j == size:  # the best of the sums so far is likely the nearest: its distance lets others go
            least = np.minimum.reduceat(sums, first)
            at = np.flatnonzero(sums == least[row])
            some = at[np.searchsorted(row[at], rows)]
            best = np.minimum(best, ((a - c[entry[some]]) ** 2).sum(1))
        stays = sums <= best[row]
        row, entry, sums = row[stays], entry[stays], sums[stays]
    least = np.minimum.reduceat(sums, np.searchsorted(row, rows))
    at = np.flatnonzero(sums == least[row])
    some = at[np.searchsorted(row[at], rows)]
    return entry[some], sums[some] // size


def by_size(column: pa.Array, scale: int, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By number of components: places and integer rows (filled up to a multiple of parts) of the vectors that take part."""
    sizes = pc.list_value_length(column)
    values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    known, sizes = pc.is_valid(sizes).to_numpy(zero_copy_only=False), pc.fill_null(sizes, 0).to_numpy().astype(np.int64)
    start = np.cumsum(sizes) - sizes
    for n in np.unique(sizes[known]):
        at = np.flatnonzero(known & (sizes == n))
        x = values[start[at][:, None] + np.arange(n)]
        good = np.isfinite(x).all(1)
        at, x = at[good], x[good]
        if not len(at):
            continue
        if n and np.abs(x).max() * scale >= 2**62:
            whole = np.array([[int(Fraction(v) * scale // 1) for v in row] for row in x.tolist()], object)
        else:
            whole = np.floor(x * scale).astype(np.int64)
        out = np.zeros((len(at), -(-int(n) // parts) * parts), whole.dtype)
        out[:, : int(n)] = whole
        yield int(n), at, out


def safe(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in 64 bits if no scaled squared distance of a vector can exceed them, else as Python's integers."""
    most = max(int(abs(x).max()) if x.size else 0, int(abs(entries).max()) if entries.size else 0)
    if 16 * most * most * max(1, x.shape[1]) ** 2 < 2**62:
        return x.astype(np.int64), entries.astype(np.int64)
    return x.astype(object), entries.astype(object)


def assigned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of components: the entries of their parts, and the squared distances summed over the parts."""
    x, book = safe(x, book)
    width = book.shape[2]
    found = [nearest(x[:, p * width : (p + 1) * width], book[p]) for p in range(len(book))]
    return np.stack([e for e, _ in found], axis=1), sum(d for _, d in found)


def digits(value: int) -> Iterator[tuple[int, int]]:
    """Place and value of the signed digits of a whole number."""
    place = 0
    while abs(value) >> DIGIT:
        yield place, value & ((1 << DIGIT) - 1)
        value, place = value >> DIGIT, place + 1
    yield place, value


def first_books(rows: DataFrame, scale: int, parts: int, entries: int) -> Books:
    """The parts of the rows of smallest vec_id of each number of components."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    size = F.size("embedding")
    order = Window.partitionBy(size).orderBy(F.asc_nulls_last("vec_id"), "embedding")
    first = rows.where(finite).withColumn("at", F.row_number().over(order)).where(F.col("at") <= entries).orderBy(size, "at")
    out: Books = {}
    for n, _, x in by_size(first.select("embedding").toArrow().column(0).combine_chunks(), scale, parts):
        out[n] = x.reshape(len(x), parts, -1 if x.size else 0).transpose(1, 0, 2)
    return out


def moved(rows: DataFrame, books: Books, scale: int) -> Books:
    """The codebooks after a round: every entry is the floor of the mean of its parts, or as it was if it has none."""
    parts = len(next(iter(books.values())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # of each part and entry: the count and the sums of the components
        for batch in batches:
            for n, _, x in by_size(batch.column(0), scale, parts):
                book = books[n]
                codes, _ = assigned(x, book)
                sums = np.zeros((*book.shape[:2], book.shape[2] + 1), object)
                for p in range(parts):
                    width = book.shape[2]
                    some = np.zeros((book.shape[1], width), x.dtype)
                    np.add.at(some, codes[:, p], x[:, p * width : (p + 1) * width])
                    sums[p, :, 0] = np.bincount(codes[:, p], minlength=book.shape[1])
                    sums[p, :, 1:] = some
                held[n] = held[n] + sums if n in held else sums
        told = [(n, i, d, v) for n, s in held.items() for i, x in enumerate(s.ravel().tolist()) if x for d, v in digits(int(x))]
        columns = list(zip(*told, strict=True)) or [[]] * 4
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["n", "at", "digit", "value"])

    told = rows.select("embedding").mapInArrow(work, "n int, at long, digit int, value long")
    totals = {n: np.zeros((*b.shape[:2], b.shape[2] + 1), object) for n, b in books.items()}
    for n, at, digit, value in told.groupBy("n", "at", "digit").agg(F.sum("value")).collect():
        totals[n].reshape(-1)[at] += value << (DIGIT * digit)
    out = {}
    for n, total in totals.items():
        count = total[:, :, :1]
        mean = total[:, :, 1:] // np.where(count == 0, 1, count)
        out[n] = np.where(count == 0, books[n].astype(object), mean)
        if not out[n].size or abs(out[n]).max() < 2**62:
            out[n] = out[n].astype(np.int64)
    return out


def vector_codes(rows: DataFrame, scale: int = 256, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Books]:
    """vec_id, label, code, error and codebooks_sha256 of the rows (vec_id, embedding, label), and the codebooks.

    entries is 256 at most. The result is not stored.
    """
    small_batches(rows.sparkSession)
    rows = rows.select(F.col("vec_id").cast("long"), "embedding", "label")
    books = first_books(rows, scale, parts, entries)
    for _ in range(rounds if books else 0):
        books = moved(rows, books, scale)
    sha = {n: hashlib.sha256(",".join(map(str, b.ravel().tolist())).encode()).hexdigest() for n, b in books.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, at, x in by_size(batch.column("embedding"), scale, parts):
                codes, error = assigned(x, books[n])
                some = batch.take(pa.array(at))
                error = [int(e) if int(e) < 2**63 else None for e in error]
                code = [c.tobytes().hex() for c in codes.astype(np.uint8)]
                columns = [some.column("vec_id"), some.column("label"), pa.array(code), pa.array(error, pa.int64()), pa.array([sha[n]] * len(at))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return rows.mapInArrow(work, CODED.format(label=rows.schema["label"].dataType.simpleString())), books


def label_sums(coded: DataFrame) -> DataFrame:
    """The rows with label_error: the sum of error over the rows of their label.

    A label that has a thousandth of the rows or more is looked up in a broadcast table, which has a thousand rows at most; the
    others are joined by shuffle, where no label is hot.
    """
    whole = F.count("error") == F.count("*")
    sums, n = coded.groupBy("label").agg(F.when(whole, F.try_sum("error")).alias("label_error"), F.count("*").alias("n")), coded.count()
    sums = stored(sums, "label-sums")
    is_hot, hot = F.col("n") * 1000 >= n, F.broadcast(sums.where(F.col("n") * 1000 >= n).select(F.col("label").alias("hot"), F.lit(True).alias("found"), F.col("label_error").alias("hot_error")))
    rows = coded.join(hot, coded["label"].eqNullSafe(hot["hot"]), "left").drop("hot")
    cold = sums.where(~is_hot).select(F.col("label").alias("cold"), "label_error")
    common = rows.where("found").drop("found").withColumnRenamed("hot_error", "label_error")
    rest = rows.where("found is null").drop("found", "hot_error")
    return common.unionByName(rest.join(cold, rest["label"].eqNullSafe(cold["cold"])).drop("cold"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, _ = vector_codes(table(spark, sf_dir, "embeddings"))
    out = label_sums(stored(coded, "codes"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _assign(codebook: str) -> str:
    """SQL: every part's nearest entry in the codebook."""
    return f"""
        SELECT vec_id, label, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d
        FROM (SELECT a.vec_id, a.label, a.part, a.x, b.entry,
                list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))::BIGINT AS d
            FROM parts a JOIN {codebook} b USING (part))
        GROUP BY vec_id, label, part, x"""


def _moved(old: str, codes: str) -> str:
    """SQL: the codebook's entries moved to the floors of their parts' means."""
    return f"""
        SELECT o.part, o.entry, coalesce(m.x, o.x) AS x
        FROM {old} o LEFT JOIN (
            SELECT part, entry, list(v ORDER BY i) AS x FROM (
                SELECT part, entry, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS v
                FROM {codes}, range(1, (SELECT max(len(x)) FROM parts) + 1) r(i) GROUP BY part, entry, i)
            GROUP BY part, entry) m USING (part, entry)"""


QUERIES = {"op13_vector_codes": op13_vector_codes}
SQL = {
    "op13_vector_codes": f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS MATERIALIZED (
            SELECT vec_id, label, p AS part, e[p * (len(e) // 16) + 1 : (p + 1) * (len(e) // 16)] AS x FROM v, range(16) r(p)
        ), first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 64),
        b0 AS MATERIALIZED (SELECT part, entry, x FROM parts JOIN first USING (vec_id)),
        c0 AS MATERIALIZED ({_assign("b0")}), b1 AS MATERIALIZED ({_moved("b0", "c0")}),
        c1 AS MATERIALIZED ({_assign("b1")}), b2 AS MATERIALIZED ({_moved("b1", "c1")}),
        c2 AS MATERIALIZED ({_assign("b2")}),
        h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2),
        coded AS (
            SELECT vec_id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
            FROM c2 GROUP BY vec_id, label
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, h"""
}
