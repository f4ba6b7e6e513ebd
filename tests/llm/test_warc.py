import base64
import hashlib
import io

import pytest

from glossweave.llm import warc
from glossweave.session import new_scratch_path

PAGES = "page_id long, url string, html string"


def expected(rows, least=0):
    largest = {}
    for page_id, _, html in rows:
        same = html or ""
        if page_id is not None:
            largest[same] = max(largest.get(same, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        top = largest.get(html or "")
        revisit = len(payload) >= least and top is not None and page_id != top
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page_id, len(payload), digest, "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def roundtrip(spark, frame, **options):
    folder = new_scratch_path(spark, "warc-test")
    warc.write_archives(frame, folder, **options)
    return warc.read_archives(spark, folder)


def digest_rows(records):
    chosen = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return sorted(map(tuple, chosen), key=str)


def test_pages_come_back(spark, tables):
    pages = tables["pages"]
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    records = roundtrip(spark, pages)
    assert digest_rows(records) == expected(rows)
    payloads = {r.page_id: bytes(r.payload).decode() for r in warc.with_payloads(records).collect()}
    assert payloads == {p: h for p, _, h in rows}


@pytest.mark.parametrize("least", [0, 3])
def test_odd_pages(spark, least):
    rows = [
        (1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "ü", None), (4, "u", ""), (None, "u", "same"),
        (7, "u", "x" * 3_000_000), (8, "u", "WARC/1.1\r\n\r\n"), (9, "u", "a"), (10, "u", "a"), (10, "u", "a"), (None, None, "lone"),
    ]
    frame = spark.createDataFrame([(*r, "z") for r in rows], PAGES + ", payload string").repartition(3)
    records = roundtrip(spark, frame, min_revisit_bytes=least)
    assert digest_rows(records) == expected(rows, least)
    full = {(r.page_id, bytes(r.payload).decode()) for r in warc.with_payloads(records).collect()}
    assert full == {(p, h or "") for p, _, h in rows}


def test_no_pages(spark):
    assert roundtrip(spark, spark.createDataFrame([], PAGES)).collect() == []


def test_dictionary_leads_and_every_record_is_a_frame():
    import zstandard

    records = [warc.page_record(i, f"http://h/{i}", (f"<html><p>page {i} " + "common words here " * 20).encode(), None, "2020-01-01T00:00:00Z") for i in range(400)]
    sink = io.BytesIO()
    count, size, trained = warc.write_file(sink, iter(records), b"")
    raw = sink.getvalue()
    assert (count, size) == (400, len(raw)) and trained > 0
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_MAGIC and int.from_bytes(raw[4:8], "little") == trained
    table = zstandard.ZstdCompressionDict(raw[8:8 + trained])
    rest, found = raw[8 + trained:], []
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=table).decompressobj()
        found.append(one.decompress(rest))
        rest = one.unused_data
    assert found == [b"", *records]
    plain = sum(len(zstandard.compress(r, 3)) for r in records)
    assert len(raw) - trained < plain / 2
