"""What the operators share: the shared folder, its files, bounded batches, and byte-level word splitting in numpy.

Words are told apart by their bytes, or by 64-bit XXH3 hashes of them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of rows that Spark hands to a Python worker at a time (or one row), and bytes of text that an operator works on at a time.
ARROW_BYTES, WORK_BYTES = 4 << 20, 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds by bytes instead of rows; a smaller bound that the session has is left alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name, "64m")).lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    if not now.rstrip("kmg").isdigit() or int(now.rstrip("kmg")) * unit > ARROW_BYTES:
        spark.conf.set(name, ARROW_BYTES)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under ``spark.checkpoint.dir``; where that is unset (tests), under a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="tripline-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root:
        root = "file://" + root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, *uris: str) -> None:
    """Removes folders of the shared folder that no later step reads."""
    for uri in uris:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows written as Parquet in the shared folder and read again, and the folder: it cuts the lineage, and survives executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    return kept(df, name)[0]


def write_file(uri: str, data: bytes) -> None:
    """Writes one file of the shared folder from a task; it appears under its name only when it is complete."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, path)


def read_file(uri: str, start: int = 0, size: int | None = None) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as source:
        source.seek(start)
        return source.read(size)


def text_bytes(text: str | None) -> bytes:
    """UTF-8; null is empty. Lone surrogates, which Spark cannot hold, would be replaced."""
    return b"" if text is None else text.encode("utf-8", "replace")


def mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit hash with its bits spread over the whole word."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit XXH3 hashes of byte strings."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal byte strings get equal numbers, from 0 in order of appearance."""
    found: dict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(found.__getitem__, words), np.int64, len(words))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Joined:
    """The UTF-8 bytes of several texts in one array, each text followed by a line feed; ``start`` and ``end`` are their bounds."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Maximal runs of word bytes after lower-casing A-Z: starts, ends, the words, and each text's first word.

        is_word says for each byte value whether it belongs to words; a line feed must not.
        """
        low = LOWER[self.data]
        inside = is_word[low]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first = np.searchsorted(start, np.append(self.start, len(self.data)))
        low[~inside] = 32
        return start, end, low.tobytes().split(), first


def text_sizes(frame) -> np.ndarray:
    """Bytes of each text in UTF-8."""
    return np.fromiter((len(text_bytes(t)) for t in frame["text"]), np.int64, len(frame))


def cut_by_size(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows, each with a total size of about ``most`` or of one row."""
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist(), len(sizes)]
    return list(zip(cuts, cuts[1:], strict=False)) if len(sizes) else []


def batches(frames, size=text_sizes, most: int = WORK_BYTES):
    """Slices of the pandas frames by the total of size, which gives a frame's sizes."""
    for frame in frames:
        for a, b in cut_by_size(size(frame), most):
            yield frame.iloc[a:b]


def with_made(df: DataFrame, make, made: dict[str, tuple[str, pa.DataType]], keep_text: bool = True, most: int = WORK_BYTES) -> DataFrame:
    """The rows with the columns ``made`` (Spark and Arrow types), which make returns by name for a list of texts of about ``most``
    bytes. The other columns pass through as Arrow data, whatever their types; columns of the made names are replaced."""
    left = [c for c in df.columns if c not in made and (keep_text or c != "text")]
    schema = StructType([df.schema[c] for c in left] + [StructType.fromDDL(f"`{c}` {t}")[0] for c, (t, _) in made.items()])

    def work(parts):
        for part in parts:
            for a, b in cut_by_size(pc.fill_null(pc.binary_length(part.column("text")), 0).to_numpy(), most):
                rows = part.slice(a, b - a)
                found = make(rows.column("text").to_pylist())
                columns = [rows.column(c) for c in left] + [pa.array(found[c], t) for c, (_, t) in made.items()]
                yield pa.RecordBatch.from_arrays(columns, [*left, *made])

    return df.mapInArrow(work, schema)


def set_aside(df: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """The rows with all columns but the needed ones under names that no operator uses, and those names by the given ones."""
    names = {c: c if c in needed else f"__given_{i}" for i, c in enumerate(df.columns)}
    return df.select(*[df[f"`{c}`"].alias(n) for c, n in names.items()]), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[df[n].alias(c) for c, n in names.items()])


def tasks_for(spark: SparkSession, items: int) -> int:
    """In how many tasks to read files or shards: as many at most as the cluster has use for."""
    return max(1, min(items, max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def fitted(df: DataFrame, rows: int, each: int = 1 << 14) -> DataFrame:
    """The rows in as many tasks as so many rows have use for, where the session's number of shuffle partitions is larger: what
    small frames cost is their tasks. There are four at least, so that nothing meets in one task."""
    tasks = max(4, -(-rows // each))
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
