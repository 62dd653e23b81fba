"""Exact top-k search by inner product with a pivot table.

Components are taken as floor(scale * x), so all scores are integers. The pivots are rows far from each other in a bounded sample, and the
origin; the distances of all rows to them are computed once and stored. By the triangle inequality, a query and a row are at least as far apart as
their distances to any pivot differ. The largest of these lower bounds, with both norms, gives an upper bound of their score. A task
has its rows in the order of their distances to one pivot, so that a query cuts out a range of them; rows in it are held
against more and more pivots while their bound reaches the query's k-th best score so far. What is left is evaluated in the order of the bounds, until the
next one is under the k-th best score.

The queries are a stated set, written in blocks in the shared folder; every task holds its rows against all blocks, and none of them
goes through the driver. Every task returns k rows a query for each chunk, and Spark merges them.

Defined results: vectors that are null, or have null or non-finite components, take no part; vectors are only compared with
vectors of as many components; an empty vector scores 0 with other empty ones; a null id takes no part; rows that repeat an id
are candidates of their own (not for a query of that id), and repeated queries are a query each; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripline.llm.common import shared_dir, small_batches, stored, table


def integers(vectors: list, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of components: the places of the vectors that take part, and their integer rows."""
    sizes = np.array([-1 if v is None else len(v) for v in vectors])
    out = {}
    for n in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == n)
        x = np.array([vectors[i] for i in at], np.float64).reshape(len(at), n)
        good = np.isfinite(x).all(1)
        out[int(n)] = at[good], np.floor(scale * x[good])
    return out


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of integer rows held as doubles, exact while they are below 2**63."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    if np.abs(q).max() * np.abs(v).max() * q.shape[1] < 2**53:
        return (q @ v.T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in v] for x in q]
    return np.array(exact, object).astype(np.int64)  # OverflowError says that a score is no long


def pivots_of(v: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other, and from the origin: each is the farthest from those before it."""
    near = (v**2).sum(1)
    chosen: list[int] = []
    while len(chosen) < min(count, len(v)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((v - v[chosen[-1]]) ** 2).sum(1))
    return v[chosen]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


class Pivots:
    """Pivots, and the distances to them. The origin is the first."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = np.concatenate([np.zeros((1, rows.shape[1])), rows])

    def table(self, v: np.ndarray) -> np.ndarray:
        """Distances to the pivots of each row; the first is its norm."""
        return distances(v, self.rows)


def slack(q: np.ndarray, v: np.ndarray, width: int) -> float:
    """How far a difference of two distances in the tables of q and v can be above the true one.

    A squared distance is a sum of width + 2 terms or so, each below the square of the largest sum of two norms. While that is below 2**51, whole
    numbers are summed exactly and only the root is rounded, by 2**-53 of it; else the sum is off by 2**-52 of that square for each term, and
    the root by the root of that.
    """
    most = 2 * max(q.max(initial=0), v.max(initial=0))
    return most * (2.0**-51 if most * most < 2**51 else ((width + 8) * 2.0**-52) ** 0.5)


def upper_bounds(q: np.ndarray, v: np.ndarray, off: float) -> np.ndarray:
    """Of the inner products of a query and rows, from its and their rows of the table: never below the score. off is their slack."""
    lower = np.maximum(np.abs(q - v).max(1) - off, 0)
    # The few roundings here and in the norms are below 2**-48 of what they round.
    return ((q[0] ** 2 + v[:, 0] ** 2) * (1 + 2.0**-48) - lower**2 * (1 - 2.0**-48)) / 2


class Best:
    """A query's k best (score, id) so far, ties to the smaller id."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]

    def floor(self) -> float:
        return float(self.score[-1]) if len(self.score) == self.k else -np.inf


def evaluate(
    best: Best, q: np.ndarray, q_id: int, told: np.ndarray, v: np.ndarray, ids: np.ndarray, table: np.ndarray, off: float, floor: float = -np.inf, step: int = 128
) -> tuple[int, int]:
    """Takes the rows of v into account for a query until none can change its best, or reaches floor, which a score must. The rows
    are in the order of their distances to the table's last pivot. Returns how many differences of distances were taken, and how many rows were evaluated."""
    # A row further from the query than this scores less than the floor.
    square = (told[0] ** 2 + table[:, 0].max(initial=0) ** 2) * (1 + 2.0**-48) - 2 * floor
    if square < 0:
        return 0, 0
    reach = square**0.5 * (1 + 2.0**-48) + off
    first, end = (0, len(v)) if np.isinf(reach) else np.searchsorted(table[:, -1], [told[-1] - reach, told[-1] + reach * (1 + 2.0**-48)])
    rows, taken = np.arange(first, end), 0
    for upto in sorted({min(8, len(told)), len(told)}) if floor > -np.inf else (len(told),):
        taken += len(rows) * upto
        bound = upper_bounds(told[:upto], table[rows, :upto], off)
        stays = bound >= floor
        rows, bound = rows[stays], bound[stays]
    stays = ids[rows] != q_id
    rows, bound = rows[stays], bound[stays]
    order, done = np.argsort(-bound, kind="stable"), 0
    for a in range(0, len(order), step):
        if bound[order[a]] < max(best.floor(), floor):
            break
        some = rows[order[a : a + step]]
        best.add(scores(q[None], v[some])[0], ids[some])
        done += len(some)
    return taken, done


@lru_cache(maxsize=2)
def block_files(folder: str) -> tuple[str, ...]:
    fs, path = pafs.FileSystem.from_uri(folder)
    return tuple(sorted(x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.endswith(".parquet")))


def read_block(folder: str, file: str) -> pd.DataFrame:
    fs, _ = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(file) as source:
        return pq.read_table(source).to_pandas()


def unpacked(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), width) if width else np.zeros((len(column), 0))


TABLE = "vec_id long, asked boolean, at long, n int, x binary, distances binary"


def pivot_table(rows: DataFrame, is_query: str, scale: float, n_pivots: int, sample: int) -> tuple[DataFrame, dict[int, Pivots]]:
    """TABLE of the rows that take part (at numbers them), stored once, and the pivots by number of components."""
    usable = rows.where("vec_id is not null and embedding is not null").select("vec_id", "embedding", F.expr(is_query).alias("asked"))
    picked = usable.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    vectors = [np.array([np.nan if x is None else x for x in r[0]], np.float64) for r in picked]
    pivots = {n: Pivots(pivots_of(v, n_pivots)) for n, (_, v) in integers(vectors, scale).items() if len(v)}

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        for frame in frames:
            for n, (at, v) in integers(frame["embedding"].tolist(), scale).items():
                if len(at):
                    told = pivots.get(n, Pivots(np.zeros((0, n)))).table(v)
                    some = frame.iloc[at]
                    yield pd.DataFrame({"vec_id": some["vec_id"].to_numpy(np.int64), "asked": some["asked"].fillna(False).to_numpy(bool), "at": first + at, "n": n, "x": [x.tobytes() for x in v], "distances": [x.tobytes() for x in told]})
            first += len(frame)

    return stored(usable.mapInPandas(work, TABLE), "pivot-table"), pivots


def top_k(
    rows: DataFrame, is_query: str, k: int = 5, scale: float = 256.0, n_pivots: int = 48, block: int = 1024, sample: int = 4096, chunk: int = 16_384
) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows (vec_id, embedding) of highest score for every row that is_query (SQL) marks.

    Exact. The pivots are taken from a sample of so many rows, which only decides how soon a search stops. A task holds ``chunk`` rows of the
    table and reads the queries in blocks from the shared folder.
    """
    spark = rows.sparkSession
    small_batches(spark)
    table_, pivots = pivot_table(rows, is_query, scale, n_pivots, sample)
    folder = shared_dir(spark, "queries")
    table_.where("asked").write.option("maxRecordsPerFile", block).parquet(folder)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floors: dict[tuple[str, int], np.ndarray] = {}  # of a block's queries of so many components

        def against_all(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for n, mine in part.groupby("n"):
                width = len(pivots.get(n, Pivots(np.zeros((0, n)))).rows)
                ids, v, told = mine["vec_id"].to_numpy(), unpacked(mine["x"], n), unpacked(mine["distances"], width)
                order = np.argsort(told[:, -1], kind="stable")
                ids, v, told = ids[order], v[order], told[order]
                for file in block_files(folder):
                    asked = read_block(folder, file)
                    asked = asked[asked["n"] == n]
                    if not len(asked):
                        continue
                    q, q_ids, q_told = unpacked(asked["x"], n), asked["vec_id"].to_numpy(), unpacked(asked["distances"], width)
                    floor = floors.setdefault((file, n), np.full(len(asked), -np.inf))
                    off, best = slack(q_told[:, 0], told[:, 0], n), [Best(k) for _ in range(len(asked))]
                    for i, found in enumerate(best):
                        evaluate(found, q[i], q_ids[i], q_told[i], v, ids, told, off, floor[i])
                        floor[i] = max(floor[i], found.floor())
                    size = [len(b.id) for b in best]
                    yield pd.DataFrame({"q": np.repeat(asked["at"].to_numpy(), size), "query_id": np.repeat(q_ids, size), "vec_id": np.concatenate([b.id for b in best]), "score": np.concatenate([b.score for b in best])})

        held, count = [], 0
        for frame in frames:
            held.append(frame)
            count += len(frame)
            if count >= chunk:
                yield from against_all(pd.concat(held))
                held, count = [], 0
        if held:
            yield from against_all(pd.concat(held))

    found = table_.drop("at", "asked").mapInPandas(search, "q long, query_id long, vec_id long, score long")
    ranks = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


QUERIES = {"op3_pivot_search": op3_pivot_search}
SQL = {
    "op3_pivot_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
            FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e)
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM s QUALIFY rank <= 5"""
}
