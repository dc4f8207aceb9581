"""WARC archives in Zstandard: one frame per record, with a dictionary in a leading skippable frame.

Writing: every task of a table of pages writes archives of bounded size into a shared folder; a task
that runs again writes the same bytes and moves them into place whole. Reading: archives are listed
and read by Spark, the dictionary is taken from the first frame, each frame is decoded on its own, and
headers, lengths and digests are checked.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import query, table
from quillspark.session import note_written, shared_folder

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
SKIPPABLE_RANGE = range(0x184D2A50, 0x184D2A60)
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEADER = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

ARCHIVE_BYTES = 24 << 20  # payload bytes an archive takes before the next one starts
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20  # payload bytes a dictionary is made from
MIN_REVISIT = 100
RECORD = (
    "archive string, page_id long, url string, record_id string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, block binary"
)


class WarcError(ValueError):
    """An archive that breaks the format."""


def record_id(page_id: int | None, place: str) -> str:
    """Made from the page id, so a revisit can name its response without a look-up."""
    name = f"page:{page_id}" if page_id is not None else f"row:{place}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, place: str) -> bytes:
    """Headers, an empty line, the block and two line ends. A revisit's block holds no payload."""
    revisit = refers_to is not None
    block = HTTP_HEADER if revisit else HTTP_HEADER + payload
    lines = [
        VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, place)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    lines.append(f"X-Payload-Length: {len(payload)}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, '')}", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive_head(samples: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressionDict | None]:
    """The skippable frame with a trained dictionary, and the dictionary; few samples train none."""
    raw = b""
    if len(samples) >= 8 and sum(map(len, samples)) >= 8192:
        try:
            size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
            raw = zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            raw = b""
    packed = zstandard.ZstdCompressor(level=3).compress(raw) if raw else b""
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed, zstandard.ZstdCompressionDict(raw) if raw else None


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, checked. Raises WarcError where the format is broken."""
    if len(data) < 8:
        raise WarcError("no room for the dictionary frame")
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE or 8 + size > len(data):
        raise WarcError("the archive does not start with a whole dictionary frame")
    packed = data[8 : 8 + size]
    # the frame's content may itself be compressed
    raw = zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == ZSTD_MAGIC else packed
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    view, at = memoryview(data), 8 + size
    while at < len(data):
        if len(data) - at >= 8 and struct.unpack_from("<I", data, at)[0] in SKIPPABLE_RANGE:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        one = decoder.decompressobj()
        try:
            record = one.decompress(view[at:])
        except zstandard.ZstdError as error:
            raise WarcError(f"frame at {at}: {error}") from error
        if not one.eof:
            raise WarcError(f"frame at {at} is cut off")
        at = len(data) - len(one.unused_data)
        yield parse_record(record)


def parse_record(record: bytes) -> dict:
    head, gap, rest = record.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("record without the end of its headers")
    version, *lines = head.decode("utf-8").split("\r\n")
    if version != VERSION:
        raise WarcError(f"unknown version {version!r}")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name:
            raise WarcError(f"broken header {line!r}")
        if name.lower() in fields:
            raise WarcError(f"repeated header {name!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "x-payload-length"):
        if name not in fields:
            raise WarcError(f"missing header {name}")
    length = fields["content-length"]
    if not length.isdigit() or int(length) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the block's length is not the one in the header")
    block = rest[:-4]
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise WarcError("the block does not start with an HTTP header")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["x-payload-length"]):
            raise WarcError("the payload does not match its digest or length")
        refers = None
    elif kind == "revisit":
        if payload or "x-refers-to-page" not in fields:
            raise WarcError("a revisit with a payload or without its response")
        refers = int(fields["x-refers-to-page"])
    else:
        raise WarcError(f"unexpected record type {kind!r}")
    page = fields.get("x-page-id")
    return {
        "page_id": None if page is None else int(page), "url": fields.get("warc-target-uri"),
        "record_id": fields["warc-record-id"], "record_type": kind, "payload_bytes": int(fields["x-payload-length"]),
        "payload_digest": digest, "refers_to": refers, "block": block,
    }


def mark_revisits(pages: DataFrame, id_col: str, body_col: str, url_col: str) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: equal payloads of at least MIN_REVISIT bytes refer to the smallest id."""
    payload = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    first = (
        rows.filter(F.length("payload") >= MIN_REVISIT).filter("page_id is not null").groupBy("digest")
        .agg(F.min("page_id").alias("least"), F.count("*").alias("many")).filter("many > 1").select("digest", "least")
    )
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(F.col("page_id") != F.col("least"), F.col("least")).alias("refers_to"),
    )


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", body_col: str = "html", url_col: str = "url"
) -> DataFrame:
    """Writes ``pages`` below ``folder`` and returns ``archive, records, bytes``; computing it is what writes.

    A null body is an empty payload, a null id or url leaves out its header, repeated ids are records of their own (equal
    bodies under one id are all responses). An empty table writes nothing. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        number, held, size = 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            samples, taken = [], 0
            for row in held:
                if taken < SAMPLE_BYTES and row[4] is None and row[2]:
                    samples.append(row[2][: 64 << 10])
                    taken += len(samples[-1])
            head, dictionary = archive_head(samples)
            options = {"dict_data": dictionary} if dictionary else {}
            compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, **options)
            name = f"part-{task.partitionId():06d}-{number:04d}.warc.zst"
            attempt = f"{root}/.attempt-{task.taskAttemptId()}-{name}"
            total = len(head)
            with store.open_output_stream(attempt, compression=None) as out:
                out.write(head)
                for place, (page, url, payload, digest, refers) in enumerate(held):
                    frame = compressor.compress(record_bytes(page, url, payload, digest, refers, f"{name}:{place}"))
                    total += len(frame)
                    out.write(frame)
            # another attempt of this task has written the same bytes
            if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                store.move(attempt, f"{root}/{name}")
            else:
                store.delete_file(attempt)
            done = pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([total], pa.int64())], names=["archive", "records", "bytes"]
            )
            number, held, size = number + 1, [], 0
            return done

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[2])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    # one order whatever the order of fetching, so that a task that runs again cuts the same archives
    rows = mark_revisits(pages, id_col, body_col, url_col).sortWithinPartitions("page_id", "digest", "url")
    return rows.mapInArrow(run, "archive string, records long, bytes long")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives in ``folder``, checked: a broken archive fails the job and names itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in RECORD.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                archive = path.as_py().rsplit("/", 1)[-1]
                try:
                    for record in read_archive(content.as_buffer().to_pybytes()):
                        rows.append({"archive": archive} | record)
                        size += len(record["block"])
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)
                            rows, size = [], 0
                except (WarcError, zstandard.ZstdError) as error:
                    raise WarcError(f"{archive}: {error}") from error
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder).select("path", "content")
    )
    return files.mapInArrow(run, RECORD)


@query(
    "op10_warc_zstd",
    f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
n AS (SELECT page_id, digest, strlen(html) AS bytes FROM p),
f AS (SELECT digest, min(page_id) AS least FROM n WHERE bytes >= {MIN_REVISIT} GROUP BY digest)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to
FROM n LEFT JOIN f USING (digest)
""",
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Writes all pages to archives and reads them back."""
    root = f"{shared_folder(spark).rstrip('/')}/quillspark-llm/warc-{uuid.uuid4().hex}"
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    note_written(root)
    written = write_archives(table(spark, folder, "pages"), root)
    if written.agg(F.sum("records")).first()[0] is None:
        spark_rows = spark.createDataFrame([], RECORD)
    else:
        spark_rows = read_archives(spark, root)
    return spark_rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
