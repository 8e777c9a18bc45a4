"""op4: archives read back as written, by sequence and by record; frames stand alone."""

import hashlib
import io
import struct

import pytest
import zstandard

from pagestrata.llm import op4_warc
from pagestrata.llm.op4_warc import Bundle, BundleReader, page_of, parse_record, record_id, warc_record, warc_round_trip

from .helpers import LONG, ask


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_bundle(monkeypatch):
    monkeypatch.setattr(op4_warc, "FRAME_BYTES", 500)
    sink = io.BytesIO()
    bundle = Bundle(sink)
    pages = [*range(40), None, 17, 17]
    records = {record_id(p, "b", i): warc_record("response", record_id(p, "b", i), f"http://x/{p}", "d", f"payload {i}\r\n\r\n".encode() * (i % 9), 1, None) for i, p in enumerate(pages)}
    for page, (key, record) in zip(pages, records.items()):
        bundle.add(page, key, record)
    bundle.end()
    data = sink.getvalue()
    reader = BundleReader(Source(data))
    assert reader.n_frames == len(bundle.frames) > 5
    assert dict(reader.records()) == records and len(records) == len(pages)
    for page in (0, 17, 39, None, 99):
        assert reader.of_page(page) == [r for key, r in records.items() if page_of(key) == page]
    assert parse_record(records[record_id(5, "b", 5)])[1] == b"payload 5\r\n\r\n" * 5
    # any decompressor reads the whole: indexes and tables are skippable frames
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(records.values())
    n, _, magic = struct.unpack("<IBI", data[-9:])
    assert magic == 0x8F92EAB1 and n == 2 * len(bundle.frames) + 1
    assert [k for k, _ in reader.records(2, 4)] == [k for f in (2, 3) for k, _ in reader.index(f)]
    # each frame, and each offset of its index, stands alone
    frame, at = reader.frame(3), reader.index(3)[1][1]
    assert frame[at:].startswith(b"WARC/1.1\r\n")


URLS = ["u", None, "", " http://a b\r\nc/%20é?x=1#y ", "a%zz\t", "日本"]


@pytest.mark.parametrize("limit", [op4_warc.BROADCAST_ROWS, 0])
def test_round_trip(spark, monkeypatch, limit):
    monkeypatch.setattr(op4_warc, "BROADCAST_ROWS", limit)
    same, short = "é" * 60, "x" * 99
    rows = [*((20 + i, u, f"page {i}") for i, u in enumerate(URLS)), (5, "u", same), (3, None, same), (9, "http://a b\r\nc/", same), (1, "u", short), (2, "u", short), (4, "u", None), (6, "u", ""), (7, "u", LONG), (None, "u", same), (8, "u", "\r\n\r\n" * 40)]
    table = spark.createDataFrame([(*r, 0, "z") for r in rows], "page_id bigint, url string, html string, digest int, URL string")
    read = warc_round_trip(table).cache()
    got = ask(read, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert ask(read, "page_id", "url") == sorted([(p, u) for p, u, _ in rows], key=repr)

    def row(page, text, refers=None):
        data = (text or "").encode()
        return page, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers

    assert got == sorted([row(p, h, 3 if h == same and p != 3 else None) for p, _, h in rows], key=repr)


def test_edge_cases(spark):
    kind = "page_id bigint, url string, html string"
    assert warc_round_trip(spark.createDataFrame([], kind)).count() == 0
    text = "y" * 200
    rows = [(None, "u", text), (None, "u", text)]
    assert [r["record_type"] for r in warc_round_trip(spark.createDataFrame(rows, kind)).collect()] == ["response"] * 2
    twice = [(3, "u", text), (3, "u", text), (4, "u", text)]
    assert ask(warc_round_trip(spark.createDataFrame(twice, kind)), "page_id", "record_type", "refers_to") == [(3, "response", None), (3, "response", None), (4, "revisit", 3)]
