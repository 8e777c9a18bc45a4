"""WARC archives as seekable Zstandard bundles.

Each partition of the records goes to bundle files of bounded size. A bundle is a row of independent
Zstandard frames, each holding some whole WARC records, and a footer of skippable frames: an index for each frame, which lists
the frame's record ids with their offsets inside it; a lookup table, sorted by the hash of the page, which gives the frame;
and a seek table (the seekable format: magic 0x184D2A5E; per frame compressed and decompressed size; count,
descriptor and magic 0x8F92EAB1). A reader opens the end of a file and then only the frames it wants with their
indexes; a record is found by binary search in the lookup table. Records of equal payload refer to the first one (revisit).

A bundle is written under a name of its own attempt and then moved, so a task that is run again
leaves no half-written file, and the list of bundles is what tasks report, not a folder's content. Record ids hold the
page's id, the bundle's name and a number, so no two records share one; a revisit names the page that it refers to.

Defined results: a null payload is empty; URLs are read back as they were, null too; equal payloads of at least ``least``
bytes have their smallest page id as response (rows that repeat that id too), the others are revisits; a null id is
never the smallest unless all are null, and then all are responses; repeated rows are records each; payloads of any length
are written whole; an empty table makes no bundle; further columns, also with clashing names, are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, pick, saved

SKIP_INDEX, SKIP_LOOKUP, SKIP_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
LOOKUP = np.dtype([("page", "<u8"), ("frame", "<u4")])
#: Characters of a URL that a header holds as they are.
URI_SAFE = "%:/?#[]@!$&'()*+,;=-._~"
#: Uncompressed bytes after which a frame ends, and compressed bytes after which a bundle does.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
#: Digests of repeated payloads up to which they are broadcast.
BROADCAST_ROWS = 200_000
#: Tasks that read bundles, at most.
MOST_TASKS = 20_000
DATE = "2024-01-01T00:00:00Z"
#: The record that stands for a missing page id.
NO_ID = "null"


def skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


def page_hash(page: int | None) -> int:
    return xxhash.xxh3_64_intdigest(str(page))


@dataclass
class Bundle:
    """The bytes of a bundle in the making."""

    sink: object
    level: int = 3
    frames: list[tuple[int, int]] = field(default_factory=list)
    indexes: list[bytes] = field(default_factory=list)
    lookup: list[tuple[int, int]] = field(default_factory=list)
    own: list[tuple[str, int]] = field(default_factory=list)
    parts: list[bytes] = field(default_factory=list)
    held: int = 0
    size: int = 0

    def add(self, page: int | None, key: str, record: bytes) -> None:
        self.own.append((key, self.held))
        self.lookup.append((page_hash(page), len(self.frames)))
        self.parts.append(record)
        self.held += len(record)
        if self.held >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if self.held:
            press = zstandard.ZstdCompressor(level=self.level).compress
            data = press(b"".join(self.parts))
            self.sink.write(data)
            self.frames.append((len(data), self.held))
            self.indexes.append(press(json.dumps(self.own).encode()))
            self.size += len(data)
            self.parts, self.own, self.held = [], [], 0

    def end(self) -> None:
        self.end_frame()
        table = np.array(sorted(set(self.lookup)), LOOKUP).tobytes()
        footer = [skippable(SKIP_INDEX, x) for x in self.indexes] + [skippable(SKIP_LOOKUP, table)]
        for x in footer:
            self.sink.write(x)
        rows = [*self.frames, *((len(x), 0) for x in footer)]
        self.sink.write(skippable(SKIP_SEEK, b"".join(struct.pack("<II", *r) for r in rows) + struct.pack("<IBI", len(rows), 0, SEEK_MAGIC)))


class BundleReader:
    """Random access to the records of a bundle."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError("not a seekable bundle")
        source.seek(size - 9 - 8 * n)
        lengths = np.frombuffer(source.read(8 * n), "<u4").reshape(-1, 2)[:, 0].astype(np.int64)
        ends = np.cumsum(lengths)
        self.spans = list(zip((ends - lengths).tolist(), lengths.tolist()))
        self.n_frames = (n - 1) // 2

    def part(self, i: int, skip: int = 0) -> bytes:
        at, length = self.spans[i]
        self.source.seek(at + skip)
        return self.source.read(length - skip)

    def frame(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.part(k))

    def index(self, k: int) -> list[tuple[str, int]]:
        """Record ids of a frame with their offsets in it."""
        return json.loads(zstandard.ZstdDecompressor().decompress(self.part(self.n_frames + k, 8)))

    def records(self, first: int = 0, past: int | None = None) -> Iterator[tuple[str, bytes]]:
        """(id, record) of the frames from ``first`` on; one frame is in memory at a time."""
        for k in range(first, min(self.n_frames, self.n_frames if past is None else past)):
            data, own = self.frame(k), self.index(k)
            for (key, a), (_, b) in zip(own, [*own[1:], ("", len(data))]):
                yield key, data[a:b]

    def of_page(self, page: int | None) -> list[bytes]:
        """The records of a page; only the frames that hold some are read."""
        table = np.frombuffer(self.part(2 * self.n_frames, 8), LOOKUP)
        a, b = (int(np.searchsorted(table["page"], page_hash(page), side)) for side in ("left", "right"))
        return [r for k in table["frame"][a:b].tolist() for key, r in self.records(k, k + 1) if page_of(key) == page]


def warc_record(kind: str, record_id: str, uri: str | None, digest: str, payload: bytes, full: int, refers: str | None) -> bytes:
    """One WARC 1.1 record. A revisit has no payload of its own and says how long and of which page the payload is.

    The target is percent-encoded where a header can't hold it; X-Page-URL keeps it reversibly.
    """
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote((uri or '').strip(), safe=URI_SAFE) or 'about:blank'}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {full}", "Content-Type: text/html; charset=utf-8",
    ]
    if uri is not None:
        head.append(f"X-Page-URL: {quote(uri, safe=URI_SAFE.replace('%', ''))}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers}"]
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def url_of(fields: dict[str, str]) -> str | None:
    return unquote(fields["X-Page-URL"]) if "X-Page-URL" in fields else None


def record_id(page: int | None, bundle: str, number: int) -> str:
    return f"urn:pagestrata:{bundle}:{number}:page:{NO_ID if page is None else page}"


def page_of(urn: str) -> int | None:
    told = urn.strip("<>").rpartition(":")[2]
    return None if told == NO_ID else int(told)


def with_references(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for a response).

    Only ids and digests are compared across rows, and only digests that occur more than once take part
    in the join. As long as these are few, a checked count, they are broadcast and payloads stay where
    they are read; else payloads are dealt out by digest.
    """
    raw = pick(pages, "page_id", "url", "html").select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    known = raw.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    many = known.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    many = saved(many, "repeated")
    return known.join(F.broadcast(many) if many.count() <= BROADCAST_ROWS else many, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, least: int = 100, level: int = 3, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes the pages' records below ``folder``; returns the bundles: path, n_records, n_frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        bundle, name = None, ""

        def finish() -> pa.RecordBatch:
            bundle.end()
            bundle.sink.close()
            done = f"{root}/{name}.warc.zst"
            files.move(f"{root}/_{name}", done)
            return pa.RecordBatch.from_pydict({"path": [f"{name}.warc.zst"], "n_records": [len(bundle.lookup)], "n_frames": [len(bundle.frames)]})

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, digest, refers = (c[i].as_py() for c in batch.columns)
                if bundle is None:
                    name = uuid.uuid4().hex
                    bundle = Bundle(files.open_output_stream(f"{root}/_{name}"), level)
                kind = "response" if refers is None else "revisit"
                key = record_id(page, name, len(bundle.lookup))
                bundle.add(page, key, warc_record(kind, key, url, digest, payload if refers is None else b"", len(payload), None if refers is None else str(refers)))
                if bundle.size >= bundle_bytes:
                    yield finish()
                    bundle = None
        if bundle is not None:
            yield finish()

    return with_references(pages, least).mapInArrow(run, "path string, n_records bigint, n_frames bigint")


def read_bundles(bundles: DataFrame, folder: str, frames_a_task: int = 16) -> DataFrame:
    """All records of the listed bundles: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Work is dealt out by ranges of frames, which the seek tables make independent. A response's digest
    and length are those of the payload that is read; a revisit has the ones that its header states.
    """
    ranges = bundles.select("path", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_frames") - 1, F.lit(0)), F.lit(frames_a_task))).alias("first"))
    # the list is tiny however much it stands for: its rows are dealt out by number, not by size
    tasks = max(1, min(MOST_TASKS, int(bundles.agg(F.sum(F.ceil(F.greatest(F.col("n_frames"), F.lit(1)) / frames_a_task))).head()[0] or 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with files.open_input_file(f"{root}/{path}") as source:
                    for key, record in BundleReader(source).records(first, first + frames_a_task):
                        head, payload = parse_record(record)
                        kind = head["WARC-Type"]
                        digest = hashlib.sha256(payload).hexdigest() if kind == "response" else head["WARC-Payload-Digest"].removeprefix("sha256:")
                        refers = int(head["X-Refers-To-Page"]) if kind == "revisit" else None
                        rows.append((page_of(key), len(payload) if kind == "response" else int(head["X-Payload-Length"]), digest, kind, refers, url_of(head)))
                columns = list(zip(*rows)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return ranges.repartition(tasks, F.col("path"), F.col("first")).mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")


def warc_round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Archives all pages below the shared folder and returns what is read back from the archives."""
    folder = fresh_dir(pages.sparkSession, "warc")
    return read_bundles(saved(write_bundles(pages, folder, least), "bundles"), folder)
