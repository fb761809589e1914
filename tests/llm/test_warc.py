import base64
import hashlib
import random
from collections import defaultdict

import pytest
import zstandard

from prosemill.llm import warc


def brute(rows, least=0):
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[(html or "").encode()].append(page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        ids = [x for x in groups[data] if x is not None]
        top = max(ids, default=None)
        revisit = len(data) >= least and top is not None and page_id != top
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 10])
def test_as_brute_force(spark, least):
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}", rng.choice([None, "", "é" * 3, "<p>same</p>", "x" * 300_000, f"own {i}", f"own {i // 2}"])) for i in range(120)]
    rows += [(None, None, "<p>same</p>"), (None, "a b\r\nc", "alone"), (7, "u", "<p>seven</p>"), (7, "u", "<p>seven</p>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, URL string")
    assert result(warc.archive_pages(df, least)) == brute(rows, least)
    assert warc.archive_pages(df.where("false")).count() == 0


def test_table_and_payloads(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    got = warc.archive_pages(pages, payloads=True)
    assert result(got) == brute(rows)
    html = {p: (h or "").encode() for p, _, h in rows}
    assert all(bytes(r.payload) == html[r.page_id] for r in got.collect() if r.record_type == "response")


def test_bundle_is_plain_zstandard_and_seekable():
    w = warc.BundleWriter()
    rows = [(i, f"http://x/{i}", b"p" * (i * 3000)) for i in range(200)]
    for i, url, data in rows:
        w.add(i, warc.record(i, url, data))
    data = w.close()
    reader = warc.BundleReader(data)
    assert len(reader) > 3
    for name, i, frame, offset in (w.index[0], w.index[77], w.index[199]):
        head, block, _ = warc.parse_record(reader.frame(frame), offset)
        assert head["X-Page-ID"] == str(i) and head["WARC-Record-ID"] == name and block.endswith(rows[i][2])
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    at = n = 0
    while at < len(whole):
        _, _, at = warc.parse_record(whole, at)
        n += 1
    assert n == 200


def test_records_are_named_once(spark):
    rows = [(None, "u", "same"), (None, "u", "same"), (3, "u", "same"), (3, "u", "other"), (3, "v", "other"), (4, "w", "own"), (9, "x", "same")]
    bundles = warc.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    heads = []
    for b in bundles.collect():
        reader = warc.BundleReader(b.bundle)
        for x in b.records:
            head, _, _ = warc.parse_record(reader.frame(x.frame), x.offset)
            assert head["WARC-Record-ID"] == x.record_id
            heads.append(head)
    names = [h["WARC-Record-ID"] for h in heads]
    assert len(names) == 7 and len(set(names)) == 6  # page 3 is twice the response of "other"
    by_name = {h["WARC-Record-ID"]: h for h in heads}
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 3 and all(by_name[h["WARC-Refers-To"]]["X-Page-ID"] == "9" for h in revisits)
