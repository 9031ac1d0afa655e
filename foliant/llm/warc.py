"""WARC archives of Zstandard frames: writer, reader, and revisits of equal payloads.

An archive starts with a skippable frame that holds a dictionary trained on its
own records; each record is a frame of its own. The reader loads the dictionary,
walks the frames by their block headers, decodes one at a time and checks version,
header lines, both content lengths and the payload digest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, scratch_path
from .components import lookup

#: Magic numbers of the skippable frame that holds a dictionary, and of a Zstandard frame.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
DICT_BYTES = 32_768
#: Uncompressed bytes after which a writer starts the next archive.
ARCHIVE_BYTES = 24_000_000
DATE = "2020-01-01T00:00:00Z"


class ArchiveError(ValueError):
    """An archive, or a record in it, that is not well-formed."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """A record as bytes; a revisit keeps the HTTP headers and leaves out the body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(chr(c) for c in range(33, 127) if chr(c) != '%'))}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive: the dictionary in a skippable frame, if one can be trained, then a frame for each record."""
    step, total = max(1, len(records) // 2_000), sum(map(len, records))
    samples = records[::step] if total // step < 100 * DICT_BYTES else records[:: max(step, total // (100 * DICT_BYTES))]
    try:
        content = zstandard.train_dictionary(DICT_BYTES, [r[:65_536] for r in samples], k=512, d=8).as_bytes()
        own = zstandard.ZstdCompressionDict(content)
        own.precompute_compress(level=3)
        head = struct.pack("<II", DICT_MAGIC, len(content)) + content
        press = zstandard.ZstdCompressor(dict_data=own, write_checksum=True)
    except zstandard.ZstdError:
        head, press = b"", zstandard.ZstdCompressor(level=3, write_checksum=True)
    return head + b"".join(map(press.compress, records))


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, by its block headers."""
    if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ArchiveError(f"no frame at byte {at}")
    checksum = zstandard.get_frame_parameters(bytes(data[at : at + 18])).has_checksum
    at += zstandard.frame_header_size(bytes(data[at : at + 18]))
    last = 0
    while not last:
        if at + 3 > len(data):
            raise ArchiveError("archive ends inside a frame")
        word = int.from_bytes(data[at : at + 3], "little")
        last, kind, n = word & 1, word >> 1 & 3, word >> 3
        at += 3 + (1 if kind == 1 else n)
    at += 4 * checksum
    if at > len(data):
        raise ArchiveError("archive ends inside a frame")
    return at


def unpack(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    data, at, own = memoryview(content), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        held = bytes(data[8 : 8 + n])
        if len(held) < n:
            raise ArchiveError("archive ends inside its dictionary")
        if held[:4] == struct.pack("<I", FRAME_MAGIC):
            held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
        own, at = zstandard.ZstdCompressionDict(held), 8 + n
    reader = zstandard.ZstdDecompressor(dict_data=own) if own else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        try:
            yield reader.decompressobj().decompress(data[at:end])
        except zstandard.ZstdError as error:
            raise ArchiveError(f"frame at byte {at}: {error}") from error
        at = end


def parse(raw: bytes) -> dict:
    """Fields of a record, after checks of its header and lengths."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or first not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError(f"bad version line {first[:40]!r}")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ArchiveError(f"bad header line {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not length.isdigit() or not fields.get("warc-type") or not fields.get("warc-record-id") or not fields.get("warc-date"):
        raise ArchiveError("a required header is missing or bad")
    if len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ArchiveError(f"content length {length}, but {len(rest) - 4} bytes")
    block = rest[:-4]
    http, found, payload = block.partition(b"\r\n\r\n")
    size = next((v.strip() for n, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if n.strip().lower() == b"content-length"), b"")
    if not found or not size.isdigit():
        raise ArchiveError("no length in the HTTP headers")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != int(size) or digest_of(payload) != digest):
        raise ArchiveError("payload doesn't have the length or digest that its headers name")
    if fields["warc-type"] == "revisit" and payload:
        raise ArchiveError("a revisit with a payload")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("x-page-id"), "payload_bytes": int(size), "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": number("x-refers-to-page-id"),
        "target_uri": fields.get("warc-target-uri"), "payload": payload if fields["warc-type"] == "response" else None,
    }


def plan_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, payload, kind, refers_to`` for every row of ``pages``.

    Of rows with equal payloads of at least ``min_bytes`` bytes those with the
    largest id are responses (several, if rows repeat) and the rest revisits.
    A null payload is empty. Null ids lose to others; alone they are responses."""
    rows = pick(pages, [id_col, url_col, html_col]).select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.withColumn("digest", F.sha1("payload"))
    heads = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    heads = materialize(heads.where("n > 1"), "warc-heads")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return lookup(rows, heads, "digest", "page_id", "n").select(
        "page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to")
    )


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``plan_records`` to archives in ``folder``, a folder that
    all executors share, and return their manifest (``name, records``).

    Each attempt of a task uses names of its own, and the manifest has only the
    names of attempts that ended well, so repeated or lost tasks do no harm. A path
    without a scheme is one of Spark's default file system, for writer and reader alike."""
    path = records.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    folder = path.getFileSystem(records.sparkSession._jsc.hadoopConfiguration()).makeQualified(path).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = (pafs.LocalFileSystem(), folder.removeprefix("file:")) if folder.startswith("file:/") and "://" not in folder else pafs.FileSystem.from_uri(folder)
        held: list[bytes] = []
        size = 0

        def put() -> pa.RecordBatch:
            files.create_dir(root, recursive=True)
            name = f"{uuid.uuid4().hex}.warc.zst"
            with files.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(pack(held))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], names=["name", "records"])

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "payload", "kind", "refers_to")), strict=True):
                held.append(record(*row))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield put()
                    held, size = [], 0
        if held:
            yield put()

    return materialize(records.mapInArrow(run, "name string, records bigint"), "warc-manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """The records of all ``*.warc.zst`` in ``folder`` (of those that ``manifest``
    names, if it is given). A record that fails a check ends the read with ArchiveError."""
    if manifest is not None and not manifest.limit(1).count():
        return spark.createDataFrame([], _schema(payloads))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    if manifest is not None:
        names = manifest.select(F.col("name").alias("_name"))
        found = found.join(names, F.substring_index("path", "/", -1) == F.col("_name"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in kinds.items()], names=list(kinds))

        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "target_uri": pa.string()}
        kinds |= {"payload": pa.binary()} if payloads else {}
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows, size = [], 0
                try:
                    for raw in unpack(content.as_py()):
                        rows.append(parse(raw))
                        size += len(raw)
                        if size > 4_000_000 or len(rows) >= 5_000:
                            yield batch(rows)
                            rows, size = [], 0
                except ArchiveError as error:
                    raise ArchiveError(f"{path}: {error}") from error
                yield batch(rows)

    return found.mapInArrow(run, _schema(payloads))


def _schema(payloads: bool) -> str:
    return "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string" + (", payload binary" if payloads else "")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    manifest = write_archives(plan_records(pages, min_bytes), folder)
    return read_archives(spark, folder, manifest, payloads=False).drop("target_uri")


#: What ``round_trip`` gives over the table ``pages``; base32 of the digest is spelled out five bits at a time.
ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT hex, list_reduce(list_transform(range(40), lambda i:
    lpad(bin(CAST('0x' || substr(hex, CAST(i + 1 AS INT), 1) AS INT)), 4, '0')), lambda a, b: a || b) AS b FROM (SELECT DISTINCT hex FROM p)),
codes AS (SELECT hex, list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
    16 * CAST(substr(b, CAST(5*i+1 AS INT), 1) AS INT) + 8 * CAST(substr(b, CAST(5*i+2 AS INT), 1) AS INT) + 4 * CAST(substr(b, CAST(5*i+3 AS INT), 1) AS INT)
    + 2 * CAST(substr(b, CAST(5*i+4 AS INT), 1) AS INT) + CAST(substr(b, CAST(5*i+5 AS INT), 1) AS INT) AS INT), 1)), lambda a, b: a || b) AS code FROM bits),
firsts AS (SELECT hex, max(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, code AS payload_digest,
    CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN codes USING (hex) JOIN firsts USING (hex)"""
