"""Web pages as WARC records: writing archives, and reading them back with segments put together again.

A record is a gzip member of its own. A response's block is an HTTP response whose body is in chunked transfer framing; a
block above ``segment_bytes`` is written as a first segment and continuation records, which name the first record as their
origin. A page whose payload equals an earlier page's is a revisit record without body.

Defined results: a null payload is empty; payloads under ``least`` bytes are never revisits; of rows that repeat the
smallest page_id of a payload, each is a response; a null page_id is no candidate for that smallest one unless all are
null; a null url is written as no header; an empty table gives no archives and no rows; other columns are not read.
On reading, a record whose segments, total length, digest or chunks don't fit has valid = false and no payload, digest or length;
those of a valid response are the decoded payload's. Records of other kinds are passed over, and an archive is read as far as it can be.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.llm.common import read_file, shared_dir, small_batches, stored, table, tasks_for, write_file

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORDS = """page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long,
origin string, segment int, total long, block binary, payload binary, valid boolean"""


def chunked(body: bytes, size: int = 8192) -> bytes:
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """The body of chunked framing; chunk extensions and trailers are skipped. ValueError if it is broken."""
    at, parts = 0, []
    while True:
        line = data.index(b"\r\n", at)
        size = int(data[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        part = data[line + 2 : line + 2 + size]
        if len(part) < size or data[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        parts.append(part)
        at = line + 4 + size


def body_of(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP header")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(headers: dict[str, object], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    head = f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, as far as it can be read: it ends where the archive is cut off,
    or at a record whose length is not known."""
    source = gzip.GzipFile(fileobj=io.BytesIO(data))
    try:
        while True:
            while (version := source.readline()) in (b"\r\n", b"\n"):
                pass
            if not version.startswith(b"WARC/"):
                return
            headers = {}
            while line := source.readline().decode("utf-8", "replace").rstrip("\r\n"):
                name, _, value = line.partition(":")
                headers[name.strip().lower()] = value.strip()
            size = number(headers.get("content-length"))
            block = b"" if size is None else source.read(size)
            if size is None or len(block) < size:
                return
            yield headers, block
    except (EOFError, OSError, zlib.error):
        return


def number(x: str | None) -> int | None:
    return int(x) if x and x.isascii() and x.isdigit() else None


def write_warc(
    pages: DataFrame, least: int = 100, segment_bytes: int = 1 << 16, archive_bytes: int = 32 << 20, date: str = "2024-01-01T00:00:00Z"
) -> DataFrame:
    """Writes the pages (page_id, url, html) as archives in the shared folder; returns their list: path, n_records.

    The rows are shuffled once, by payload digest, for a join that Spark can split where a digest is hot.
    """
    small_batches(pages.sparkSession)
    folder = shared_dir(pages.sparkSession, "warc")
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", body.alias("payload")).select(
        "*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes")
    )
    seen = rows.where(F.col("n_bytes") >= least).groupBy("digest")
    first = seen.agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n"))
    first = first.where("n > 1").drop("n").repartition(F.xxhash64("digest"))  # so that the join below has a shuffle on both sides
    joined = rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", "first_id", "first_url")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, parts, held, n, seq = TaskContext.get().partitionId(), [], 0, 0, 0

        def flush() -> pd.DataFrame:
            nonlocal parts, held, seq
            write_file(path := f"{folder}/{part:06d}-{seq:06d}-{os.urandom(6).hex()}.warc.gz", b"".join(parts))
            row = pd.DataFrame({"path": [path], "n_records": [len(parts)]})
            parts, held, seq = [], 0, seq + 1
            return row

        for frame in frames:
            for r in frame.itertuples(index=False):
                page, first_id = (None if pd.isna(x) else int(x) for x in (r.page_id, r.first_id))
                n += 1
                name = f"urn:page:{page}:{part}:{n}"
                common = {
                    "WARC-Record-ID": f"<{name}>",
                    "WARC-Date": date,
                    "WARC-Target-URI": None if r.url is None else quote(r.url, safe=":/?#[]@!$&'()*+,;=%"),
                    "WARC-Payload-Digest": f"sha256:{r.digest}",
                    "Content-Type": "application/http; msgtype=response",
                    "X-Page-Id": page,
                    "X-Payload-Length": len(r.payload),
                }
                if first_id is not None and page != first_id:
                    refers = {
                        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                        "WARC-Refers-To-Target-URI": None if r.first_url is None else quote(r.first_url, safe=":/?#[]@!$&'()*+,;=%"),
                        "X-Refers-To-Page": first_id,
                    }
                    new = [record({"WARC-Type": "revisit"} | common | refers, HTTP_HEAD)]
                else:
                    block = HTTP_HEAD + chunked(r.payload)
                    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                    if len(pieces) == 1:
                        new = [record({"WARC-Type": "response"} | common, block)]
                    else:
                        new = [record({"WARC-Type": "response"} | common | {"WARC-Segment-Number": 1}, pieces[0])]
                        for i, piece in enumerate(pieces[1:], 2):
                            more = {
                                "WARC-Type": "continuation",
                                "WARC-Record-ID": f"<{name}:{i}>",
                                "WARC-Date": date,
                                "WARC-Segment-Origin-ID": f"<{name}>",
                                "WARC-Segment-Number": i,
                                "WARC-Segment-Total-Length": len(block) if i == len(pieces) else None,
                            }
                            new.append(record(more, piece))
                parts += new
                held += sum(map(len, new))
                if held >= archive_bytes:
                    yield flush()
        if parts:
            yield flush()

    return stored(joined.mapInPandas(write, "path string, n_records long"), "warc-list")


def checked(digest: str | None, length: int | None, block: bytes) -> bytes | None:
    """The payload, if it has this digest and length."""
    try:
        body = body_of(block)
    except ValueError:
        return None
    good = length in (None, len(body)) and digest in (None, hashlib.sha256(body).hexdigest())
    return body if good else None


def told(payload: bytes | None) -> tuple[str | None, int | None]:
    """Digest and length of a payload as it was decoded; nulls where it could not be."""
    return (None, None) if payload is None else (hashlib.sha256(payload).hexdigest(), len(payload))


def read_warc(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The pages of the listed archives (path), segments put together: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, valid, and payload if asked for (null for revisits)."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORDS.replace("\n", " ").split(",")]
        for frame in frames:
            for path in frame["path"]:
                out, held = [], 0
                for h, block in records(read_file(path)):
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    length, segment, kind = number(h.get("x-payload-length")), number(h.get("warc-segment-number")), h.get("warc-type")
                    payload, origin = None, None
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    if segment:
                        origin = h.get("warc-segment-origin-id", h.get("warc-record-id"))
                    elif kind == "response":
                        payload, block = checked(digest, length, block), None
                        digest, length = told(payload)
                    else:
                        block = None
                    total = number(h.get("warc-segment-total-length"))
                    valid = kind == "revisit" or payload is not None
                    row = (number(h.get("x-page-id")), h.get("warc-target-uri"), kind, number(h.get("x-refers-to-page")), digest, length)
                    out.append((*row, origin, segment, total, block, payload if payloads else None, valid))
                    held += len(block or b"") + len(payload or b"") * payloads
                    if held > 16 << 20:
                        yield pd.DataFrame(out, columns=names, dtype=object)
                        out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names, dtype=object)

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                numbers = [s["segment"] for s in r.segments]
                block = b"".join(bytes(s["block"]) for s in r.segments)
                fits = numbers == list(range(1, len(numbers) + 1)) and r.total == len(block)
                length = None if pd.isna(r.payload_bytes) else int(r.payload_bytes)
                payload = checked(r.payload_digest, length, block) if fits else None
                out.append(payload)
            frame = frame.drop(columns=["segments", "total"])
            frame["payload_digest"] = [told(p)[0] for p in out]
            frame["payload_bytes"] = pd.array([told(p)[1] for p in out], "Int64")
            frame["valid"] = [p is not None for p in out]
            frame["payload"] = out if payloads else None
            yield frame

    spread = archives.select("path").repartition(tasks_for(archives.sparkSession, archives.count()))
    found = stored(spread.mapInPandas(read, RECORDS), "warc-records")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    parts = found.where("origin is not null").groupBy("origin").agg(
        *[F.max(c).alias(c) for c in columns if c != "record_type"],
        F.lit("response").alias("record_type"),
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("segments"),
    )
    kinds = dict(found.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*columns, "valid", "payload"])
    joined = parts.select(*columns, "total", "segments").mapInPandas(whole, schema)
    out = found.where("origin is null").select(*columns, "valid", "payload").unionByName(joined)
    return out if payloads else out.drop("payload")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_warc(write_warc(table(spark, sf_dir, "pages")), payloads=False)
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


QUERIES = {"op1_warc": op1_warc}
SQL = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
            CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first_id <> page_id THEN first_id END AS refers_to, true AS valid
        FROM p LEFT JOIN f USING (payload_digest)"""
}
