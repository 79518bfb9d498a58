"""WARC archives: written with revisit records, read back by splittable byte ranges."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nivo.llm.shared import Scratch, workers_find_package

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payloads below this many bytes are stored again and again rather than referred to.
LEAST_BYTES = 100
#: Tasks that read archives, at most.
MOST_TASKS = 10_000
#: Bytes of an archive that one row of the ranges covers.
SPLIT_BYTES = 4 << 20
CHUNK = 1 << 16

RECORD = (
    "file string, offset long, record_type string, page_id long, target_uri string, "
    "payload binary, payload_digest string, refers_to long"
)


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path)
    return system, name


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member of its own."""
    block = HTTP + payload if refers_to is None else HTTP
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.insert(2, ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + lines + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        name = f"{base}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        attempt = f"{base}/.attempt-{uuid.uuid4().hex}"
        out, size, records = None, 0, 0
        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for row in range(batch.num_rows):
                if out is None:
                    out = system.open_output_stream(attempt)
                packed = record(*[column[row].as_py() for column in columns])
                out.write(packed)
                size, records = size + len(packed), records + 1
        if out is not None:
            out.close()
            system.move(attempt, name)  # A repeated task replaces the file by one of equal records.
            uri = f"{folder}/{name.rsplit('/', 1)[1]}"
            yield pa.RecordBatch.from_arrays(
                [pa.array([uri]), pa.array([size], pa.int64()), pa.array([records], pa.int64())],
                names=["file", "bytes", "records"],
            )

    return write


def write(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Archives with a record per page, one file per partition; returns ``file, bytes, records``.

    Of pages with equal payloads of ``LEAST_BYTES`` or more, the one with the smallest page_id
    is a response and the others revisit it; the groups are found by digest, aggregated before they
    are shuffled. NULL html is an empty payload, a NULL url is left out. NULL ids are the
    largest: such a page is a response only if no page with an id has its payload. Rows
    that repeat the smallest id are responses all.
    """
    workers_find_package(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    long_enough = F.octet_length("payload") >= LEAST_BYTES
    first = (
        rows.where(long_enough)
        .groupBy(F.col("digest").alias("same"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    # Short payloads have no key to meet at, so the many pages that share one stay where they are.
    keyed = rows.withColumn("key", F.when(long_enough, F.col("digest")))
    long_rows = keyed.where("key is not null").join(first, F.col("key") == F.col("same"), "left")
    short_rows = keyed.where("key is null").withColumn("first", F.lit(None).cast("long"))
    columns = ["page_id", "url", "payload", "digest", "first"]
    records = long_rows.select(*columns).unionByName(short_rows.select(*columns)).select(
        "page_id", "url", "payload", "digest", refers.alias("refers_to")
    )
    folder = scratch.path("archives")
    system, name = _open(folder)
    system.create_dir(name)
    written = records.mapInArrow(_writer(folder), "file string, bytes long, records long")
    return scratch.write(written, "files")


def decode(fetch: Callable[[int, int], bytes], offset: int) -> tuple[bytes, int] | None:
    """The member at an offset and its packed length; None if no whole WARC record starts there."""
    opener, parts, fed, checked = zlib.decompressobj(31), [], 0, False
    while not opener.eof:
        chunk = fetch(offset + fed, CHUNK)
        if not chunk:
            return None
        fed += len(chunk)
        try:
            parts.append(opener.decompress(chunk))
        except zlib.error:
            return None
        if not checked and sum(map(len, parts)) >= len(VERSION):
            if not b"".join(parts).startswith(b"WARC/1."):
                return None
            checked = True
    return (b"".join(parts), fed - len(opener.unused_data)) if checked else None


def members(
    fetch: Callable[[int, int], bytes], start: int, end: int
) -> Iterator[tuple[int, bytes]]:
    """Offset and content of the records that start in [start, end), wherever they end."""
    at = start
    while at < end:
        window = fetch(at, CHUNK)
        found = window.find(MAGIC)
        if found < 0:
            if len(window) < CHUNK:
                return
            at += len(window) - len(MAGIC) + 1
            continue
        at += found
        if at >= end:
            return
        decoded = decode(fetch, at)
        if decoded is None:
            at += 1
            continue
        yield at, decoded[0]
        at += decoded[1]


def parse(content: bytes) -> dict:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", 0))]
    kind = fields.get("warc-type", "")

    def page(uri: str | None) -> int | None:
        number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number.lstrip("-").isdigit() else None

    return {
        "record_type": kind,
        "page_id": page(fields.get("warc-record-id")),
        "target_uri": fields.get("warc-target-uri"),
        "payload": block.partition(b"\r\n\r\n")[2] if kind == "response" else None,
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:"),
        "refers_to": page(fields.get("warc-refers-to")),
    }


_SCHEMA = pa.schema(
    [
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("target_uri", pa.string()),
        ("payload", pa.binary()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
    ]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, start, end in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            system, name = _open(file)
            with system.open_input_file(name) as source:
                size = source.size()

                def fetch(at: int, n: int) -> bytes:
                    return source.read_at(min(n, size - at), at) if at < size else b""

                rows, held = [], 0
                for offset, content in members(fetch, start, end):
                    rows.append({"file": file, "offset": offset, **parse(content)})
                    held += len(content)
                    if held >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


def read(files: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """The records of archives, given as ``file, bytes``; each range of ``split`` bytes is a row of its own.

    A task looks for gzip magic in its range, takes a place for a member only if it unpacks to a
    WARC header, and reads the records that start inside, past the end of the range if need
    be. Members that are damaged or cut off are passed over. Empty files give no records.

    Ranges are dealt over a stated number of tasks, as many as there are ranges up to ``MOST_TASKS``: rows of
    ranges are a few bytes, so a plan that sizes its tasks by them would read all archives in one.
    """
    spark = files.sparkSession
    workers_find_package(spark)
    n_ranges = files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 0
    tasks = max(1, min(int(n_ranges), MOST_TASKS))
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))
    ranges = (
        files.where("bytes > 0")
        .select("file", "bytes", F.explode(starts).alias("start"))
        .select("file", "start", F.least(F.col("start") + split, F.col("bytes")).alias("end"))
        .repartition(tasks, "file", "start")
    )
    return ranges.mapInArrow(_scan, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """Records with ``payload_bytes``; those of a revisit are its response's, found by id and digest."""
    sizes = records.select(
        "page_id",
        "record_type",
        "refers_to",
        F.when(F.col("payload").isNotNull(), F.sha2("payload", 256))
        .otherwise(F.col("payload_digest"))
        .alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    kinds = Scratch(records.sparkSession, "warc-resolve").write(sizes, "sizes")
    responses = kinds.where("record_type = 'response'")
    known = responses.groupBy(
        F.col("page_id").alias("known_id"), F.col("payload_digest").alias("known_digest")
    ).agg(F.max("payload_bytes").alias("known_bytes"))
    revisits = (
        kinds.where("record_type = 'revisit'")
        .drop("payload_bytes")
        .join(
            known,
            (F.col("refers_to") == F.col("known_id"))
            & (F.col("payload_digest") == F.col("known_digest")),
            "left",
        )
        .withColumn("payload_bytes", F.col("known_bytes"))
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*columns).union(revisits.select(*columns))
