"""Deterministic sharded WARC writer, and its reader.

Records are sorted by (page id, payload digest, url) in ranges whose number and bounds follow from the rows alone: from
their bytes, and from the keys of those rows that a hash picks. Each range is written by one task, which rolls files by
compressed size and names them by range, so that archives are equal byte by byte whatever the partitions. A task
writes under a temporary name with its attempt's number and renames the file when it is complete; a repeated attempt
replaces a file by an equal one. The manifest, written by Spark after all tasks, commits the archive: the reader opens
only the files that it names. Headers and digests are made anew.

Equal payloads of at least min_bytes bytes are stored once: the record with the smallest page id is the response,
the others revisit it. Digests are compared, not payloads; only digests that occur more than once are joined back.

Cases: null html is an empty payload, a null url an empty one. A page id that repeats with the response's payload
is a response each time; record ids of repeated rows are told apart by their number. Null ids sort first and are
never the smallest: with none but null ids, equal payloads are all responses. Extra columns are never read. An empty
table gives an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.llm import _common

#: Compressed bytes after which a file is closed.
ROLL_BYTES = 32 << 20
#: Payload bytes of a range at most and, while there are few ranges, at least.
RANGE_BYTES, LEAST_RANGE, FEW = 256 << 20, 4 << 20, 64
#: Rows whose keys the bounds of the ranges are taken from, about.
SAMPLE = 20_000
#: WARC-Date of all records, so that archives are equal from run to run.
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, first long, last long, records long, bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122


def _base32(data: bytes) -> str:
    return base64.b32encode(data).decode("ascii")


def _record_id(page_id: int | None, digest: str, again: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}/{again}')}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, n: int, refers: int | None, revisit: bool, again: int) -> bytes:
    """One record, uncompressed; again: how many rows of this id and payload come before."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest, again)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {n}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers, digest)}", f"X-Refers-To-Page-Id: {refers}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _planned(pages: DataFrame, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """pages (page_id, url, html) as records, and their keys (page_id, digest, n), which are written once: what is found out about all
    records before they are written is read from the keys, not from the payloads again."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    keys, _ = _common.written(rows.select("page_id", "digest", "n"), "warc-keys")
    again = keys.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    again, _ = _common.written(again, "warc-again")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("n") >= min_bytes)
    rows = rows.join(again, "digest", "left").withColumn("revisit", revisit)
    records = rows.select("page_id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "digest", "n", "revisit", F.when(F.col("revisit"), F.col("first")).alias("refers_to"))
    return records, keys


def plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) as records: page_id, url, payload, digest (hex), n, revisit, refers_to."""
    return _planned(pages, min_bytes)[0]


def _bounds(rows: DataFrame) -> np.ndarray:
    """The first keys (page id, digest) of all ranges but the first; rows: page_id, digest, n."""
    size = rows.agg(F.sum("n").alias("bytes"), F.count("*").alias("rows")).first()
    many = max(-(-(size.bytes or 0) // RANGE_BYTES), min(FEW, (size.bytes or 0) // LEAST_RANGE))
    if many < 2:
        return np.array([], "S28")
    # a bounded number of keys, chosen by hash: it only sets where ranges end
    every = max(1, size.rows // SAMPLE)
    some = rows.filter(F.pmod(F.xxhash64("page_id", "digest"), F.lit(every)) == 0).select("page_id", "digest").distinct().limit(8 * SAMPLE).toArrow()
    keys = np.sort(_keys(some.column(0), some.column(1)))
    return np.unique(keys[np.linspace(0, len(keys), many + 1).astype(int)[1:-1]]) if len(keys) else keys


def _keys(page: pa.Array, digest: pa.Array) -> np.ndarray:
    """Keys as bytes that sort as (page id, digest) do, null ids first."""
    made = [((-1 if p is None else p + (1 << 63)) + 1).to_bytes(9, "big")[-9:] + bytes.fromhex(d)[:19] for p, d in zip(page.to_pylist(), digest.to_pylist(), strict=True)]
    return np.array(made, "S28")


def write(pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archive into folder (a URI that driver and executors share); its manifest comes back."""
    spark = pages.sparkSession
    _common.prepare(spark)
    records, keys = _planned(pages, min_bytes)
    bounds = spark.sparkContext.broadcast(_bounds(keys))

    @F.arrow_udf("int")
    def place(page: pa.Array, digest: pa.Array) -> pa.Array:
        # keys alone go to Python, payloads stay where they are
        return pa.array(np.searchsorted(bounds.value, _keys(page, digest), "right").astype(np.int32))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        ctx = TaskContext.get()
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        done: list[tuple] = []
        out, name, first, last, count, size = None, "", None, None, 0, 0
        here, parts, before, again = None, 0, None, 0

        def close() -> None:
            nonlocal out
            out.close()
            final, temporary = f"{root}/{name}", f"{root}/.{name}.{ctx.taskAttemptId()}"
            if files.get_file_info(final).type != fs.FileType.NotFound:
                files.delete_file(final)
            files.move(temporary, final)
            done.append((name, first, last, count, size))
            out = None

        for rows in batches:
            for page, url, payload, digest, n, revisit, refers, at in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if at != here:
                    if out is not None:
                        close()
                    here, parts = at, 0
                if out is None:
                    name = f"range-{at:06d}-{parts:04d}.warc.gz"
                    out = files.open_output_stream(f"{root}/.{name}.{ctx.taskAttemptId()}", compression=None)
                    first, count, size, parts = page, 0, 0, parts + 1
                before, again = (page, digest), again + 1 if before == (page, digest) else 0
                member = gzip.compress(_record(page, url, payload or b"", _base32(bytes.fromhex(digest)), n, refers, revisit, again), 6, mtime=0)
                out.write(member)
                last, count, size = page, count + 1, size + len(member)
                if size >= roll_bytes:
                    close()
        if out is not None:
            close()
        cols = list(zip(*done, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["file", "first", "last", "records", "bytes"])

    # each range is one task's, neither hashed together with others nor left without
    placed = records.withColumn("range", place("page_id", "digest"))
    ranged = placed.repartitionById(max(1, len(bounds.value) + 1), "range").sortWithinPartitions("range", "page_id", "digest", "url")
    ranged.mapInArrow(task, MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def _parse(raw: io.RawIOBase) -> Iterator[tuple]:
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw))
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no record begins with {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            key, _, value = line.decode("utf-8").partition(": ")
            head[key] = value
        block = stream.read(int(head["Content-Length"]))
        stream.read(4)
        if _base32(hashlib.sha1(block).digest()) != head["WARC-Block-Digest"].removeprefix("sha1:"):
            raise ValueError(f"the block of {head['WARC-Record-ID']} differs from its digest")
        digest, payload = head["WARC-Payload-Digest"].removeprefix("sha1:"), None
        if head["WARC-Type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if _base32(hashlib.sha1(payload).digest()) != digest:
                raise ValueError(f"the payload of {head['WARC-Record-ID']} differs from its digest")
        refers = head.get("X-Refers-To-Page-Id")
        page = head["X-Page-Id"]
        yield int(page) if page else None, head["WARC-Target-URI"], head["WARC-Type"], int(refers) if refers else None, digest, int(head["X-Payload-Length"]), payload


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest names; digests are verified. Files are streamed, record by record."""
    _common.prepare(spark)
    committed = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("file")
    spread = max(1, min(committed.count(), 16 * spark.sparkContext.defaultParallelism))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        files, root = fs.FileSystem.from_uri(folder)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for rows in batches:
            for name in rows.column(0).to_pylist():
                with files.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    made, size = [], 0
                    for r in _parse(raw):
                        made.append(r if payloads else (*r[:6], None))
                        size += len(r[6] or b"") if payloads else 0
                        if len(made) == 1000 or size > ROLL_BYTES:
                            yield batch(made)
                            made, size = [], 0
                    if made:
                        yield batch(made)

    # files are dealt evenly, not by hash: a file is a task's work
    return committed.repartition(spread).mapInArrow(task, RECORD)
