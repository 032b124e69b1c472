"""WARC archives as seekable Zstandard bundles.

Each page is one record. Records of equal payloads of at least ``LEAST_BYTES`` bytes are written once,
as the response of the largest page id; the others are revisit records that refer to it. A task groups
its records into independent Zstandard frames of about ``FRAME_BYTES``, and frames into bundles of about
``BUNDLE_BYTES`` (a larger record has a frame or bundle of its own), each ending in the seek table of
the seekable format: a skippable frame with the sizes of all frames and a magic number.

Bundles are files in the shared folder, written by Spark's text writer with one row for each file: the
row holds the bundle without its last four bytes, and the line separator is those four bytes, the magic
number. So any file system Spark can write to serves, and the tasks need no file access of their own.
``index`` reads bundles back and maps each record to its frame and its offset in the frame; ``fetch``
decodes only the frames that hold the records asked for.

Null html is an empty payload, a null url writes no target. A null page id never is the response of
others. Rows that repeat the largest page id of a payload are all responses. An empty table writes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import shared_folder

LEAST_BYTES = 1000
FRAME_BYTES, BUNDLE_BYTES = 128 << 10, 8 << 20
LEVEL = 3
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_MAGIC = struct.pack("<I", _SEEKABLE)
_PREFIX = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, frame_start long, offset long, length long"


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and the page id to refer to (null: a response). Groups of equal
    payloads are found from digests alone; only groups of two and more are joined back."""
    own = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    own = own.select("*", F.sha1(F.col("html").cast("binary")).alias("digest"))
    large = own.filter(F.octet_length("html") >= LEAST_BYTES)
    keepers = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1 and keeper is not null")
    out = own.join(keepers.select("digest", "keeper"), "digest", "left")
    other = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")) & (F.octet_length("html") >= LEAST_BYTES)
    return out.select("page_id", "url", "html", "digest", F.when(other, F.col("keeper")).alias("refers_to"))


def _record(kind: str, fields: Sequence[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))))
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None, date: str) -> bytes:
    payload = html.encode("utf-8", "surrogatepass")
    fields = [("WARC-Record-ID", f"<{_PREFIX}{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _record("response", fields, http + payload)
    return _record("revisit", [*fields, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_PREFIX}{refers_to}>")], http)


class Bundle:
    """Frames of one archive file."""

    def __init__(self, date: str):
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        self.frames, self.sizes, self.open, self.held = [], [], [], 0
        name = str(uuid.uuid4())
        self.add(_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def add(self, record: bytes) -> None:
        self.open.append(record)
        self.held += len(record)
        if self.held >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            data = b"".join(self.open)
            self.frames.append(self.compressor.compress(data))
            self.sizes.append((len(self.frames[-1]), len(data)))
            self.open, self.held = [], 0

    @property
    def stored(self) -> int:
        return sum(n for n, _ in self.sizes)

    def finish(self) -> bytes:
        """The whole file, seek table included."""
        self.close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IB", len(self.sizes), 0) + _MAGIC
        return b"".join(self.frames) + struct.pack("<II", _SKIPPABLE, len(table)) + table


def write(pages: DataFrame, folder: str, date: str = "2021-02-01T00:00:00Z") -> None:
    """Archives of decided pages: files under ``folder``."""

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if bundle is None:
                    bundle, size = Bundle(date), 0
                bundle.add(page_record(**row, date=date))
                if len(bundle.frames) != size:
                    size = len(bundle.frames)
                    if bundle.stored >= BUNDLE_BYTES:
                        yield _row(bundle)
                        bundle = None
        if bundle is not None:
            yield _row(bundle)

    rows = pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(bundles, "bundle binary")
    end = {"lineSep": _MAGIC.decode("latin-1"), "encoding": "ISO-8859-1"}
    rows.select(F.col("bundle").cast("string").alias("value")).write.options(maxRecordsPerFile=1, **end).text(folder)


def _row(bundle: Bundle) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bundle": pa.array([bundle.finish()[: -len(_MAGIC)]], pa.binary())})


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, stored bytes, plain bytes) of every frame."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    sizes = struct.unpack(f"<{2 * n}I", data[-9 - 8 * n : -9])
    out, at = [], 0
    for stored, plain in zip(sizes[::2], sizes[1::2], strict=True):
        out.append((at, stored, plain))
        at += stored
    return out


def _page(uri: str | None) -> int | None:
    number = (uri or "").strip("<>").removeprefix(_PREFIX)
    return int(number) if number.lstrip("-").isdigit() else None


def parse_frame(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, block) of every record in a plain frame."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:head_end].decode().split("\r\n")[1:])
        end = head_end + 4 + int(fields["Content-Length"])
        yield at, end + 4 - at, fields, data[head_end + 4 : end]
        at = end + 4


def _described(fields: dict[str, str], block: bytes) -> dict | None:
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    whole = fields["WARC-Type"] == "response"
    if whole:
        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        n = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    return {"page_id": _page(fields["WARC-Record-ID"]), "payload_bytes": n, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": _page(fields.get("WARC-Refers-To"))}


def index(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the bundles under ``folder``, with frame, place in the file and offset in the frame."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        schema = None
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data, rows = content.as_buffer().to_pybytes(), []
                for i, (start, stored, plain) in enumerate(seek_table(data)):
                    frame = zstandard.ZstdDecompressor().decompress(data[start : start + stored], max_output_size=plain)
                    for offset, length, fields, block in parse_frame(frame):
                        if found := _described(fields, block):
                            rows.append(found | {"bundle": path, "frame": i, "frame_start": start, "offset": offset, "length": length})
                schema = schema or pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_start", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(folder).filter("length > 0")
    return files.select("path", "content").mapInArrow(read, _RECORD)


def fetch(records: DataFrame, page_ids: Sequence[int]) -> DataFrame:
    """page_id and payload of the given pages, revisits followed to their response. ``records`` is an index; of each bundle only the
    frames that hold an asked record are decoded."""
    asked = records.filter(F.col("page_id").isin(list(page_ids)))
    source = F.coalesce("refers_to", "page_id").alias("source")
    asked = asked.select(F.col("page_id").alias("asked"), source)
    held = asked.join(records.filter("record_type = 'response'"), F.col("source") == F.col("page_id"))
    held = held.groupBy("bundle").agg(F.collect_list(F.struct("asked", "frame", "offset", "length")).alias("records"))
    paths = [r["bundle"] for r in held.select("bundle").collect()]  # at most one for each page asked for
    if not paths:
        return held.sparkSession.createDataFrame([], "page_id long, payload string")
    files = held.sparkSession.read.format("binaryFile").load(paths).select(F.col("path").alias("bundle"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for row in batch.to_pylist():
                frames, plain = seek_table(row["content"]), {}
                out = {"page_id": [], "payload": []}
                for r in row["records"]:
                    if r["frame"] not in plain:
                        start, stored, size = frames[r["frame"]]
                        plain[r["frame"]] = zstandard.ZstdDecompressor().decompress(row["content"][start : start + stored], max_output_size=size)
                    record = plain[r["frame"]][r["offset"] : r["offset"] + r["length"]]
                    block = next(parse_frame(record))[3]
                    out["page_id"].append(r["asked"])
                    out["payload"].append(block.partition(b"\r\n\r\n")[2].decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_pydict(out, pa.schema([("page_id", pa.int64()), ("payload", pa.string())]))

    return files.join(held, "bundle").select("content", "records").mapInArrow(read, "page_id long, payload string")


def query(pages: DataFrame) -> DataFrame:
    """The registered query: write all pages, read the archives back."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write(decide(pages), folder)
    return index(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
