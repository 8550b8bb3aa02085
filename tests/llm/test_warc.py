import gzip
import hashlib
import io

import pytest
from helpers import rng
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolescope.llm import warc
from rolescope.llm.warc import RangeReader, member, read_archives, record, write_archives
from rolescope.session import new_work_dir

SCHEMA = "page_id long, url string, html string"
STAMP = "2020-01-01T00:00:00Z"


def simple(i, payload):
    return record(f"urn:page:{i}", f"http://x/{i}", payload, len(payload), hashlib.sha1(payload).hexdigest(), None, STAMP)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=8), st.lists(st.integers(0, 4000), max_size=6), st.integers(0, 2))
def test_ranges_own_each_record_once(payloads, cuts, noise):
    members = [member(simple(i, p)) for i, p in enumerate(payloads)]
    data = (b"\x1f\x8b\x08 no member " * noise).join([b"", *members, b""])
    cuts = sorted({0, len(data), *[c for c in cuts if c < len(data)]})
    got = []
    for low, high in zip(cuts, cuts[1:]):
        for at, fields, block in RangeReader(io.BytesIO(data), low, high).records():
            assert low <= at < high
            got.append((at, fields["warc-record-id"], block.split(b"\r\n\r\n", 1)[1]))
    assert [g[1:] for g in got] == [(f"<urn:page:{i}>", p) for i, p in enumerate(payloads)]
    assert [data[g[0] : g[0] + 3] for g in got] == [warc.MAGIC] * len(payloads)


def test_archives_inside_payloads():
    """A payload that cannot be compressed further and holds members: a reader that starts inside must not take these for records."""
    inner = b"".join(member(simple(i, rng(i).bytes(3000))) for i in range(20))
    outer = member(simple(100, inner)) + member(simple(101, b"last"))
    assert inner in gzip.decompress(outer) and inner[:2000] not in outer
    for cut in range(1, len(outer), 997):
        names = [f["warc-record-id"] for low, high in ((0, cut), (cut, len(outer))) for _, f, _ in RangeReader(io.BytesIO(outer), low, high).records()]
        assert names == ["<urn:page:100>", "<urn:page:101>"]


def test_damage_and_several_records_in_a_member():
    data = member(simple(1, rng(1).bytes(500_000)))
    for bad in (data[:400_000], data[:300_000] + b"\xff" * 100 + data[300_100:]):
        with pytest.raises(ValueError, match="record at byte 0"):
            list(RangeReader(io.BytesIO(bad), 0, len(bad)).records())
    double = gzip.compress(simple(1, b"a") + simple(2, b"b"))
    assert [f["warc-record-id"] for _, f, _ in RangeReader(io.BytesIO(double), 0, 10).records()] == ["<urn:page:1>", "<urn:page:2>"]
    with pytest.raises(ValueError, match="no whole record"):
        list(RangeReader(io.BytesIO(gzip.compress(b"WARC/1.1\r\nno length\r\n\r\n")), 0, 10).records())


def rows_of_all_kinds():
    long_, odd = "é" * 500, "x\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a", long_), (2, None, long_), (7, "http://c\r\nX: y", long_), (None, "http://d", long_), (7, "http://e", long_), (3, "u", "é" * 499 + "a"), (4, "u", "é" * 499 + "a"),
            (5, "u", None), (6, "u", ""), (None, None, None), (None, "u", odd), (None, "u", odd), (8, "u", "short"), (9, "u", "short"), (10, "u", "z" * 3_000_000), (-5, "u", "y" * 1000), (-6, "ü", "y" * 1000)]
    return rows + [(1000 + i, "u", "hot" * 400) for i in range(300)]


def expected(rows):
    last = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and i is not None:
            last[body] = max(last.get(body, i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        to = last.get(body)
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), *(("revisit", to) if to is not None and to != i else ("response", None))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("file_bytes", "range_bytes", "broadcast"), [(1 << 30, 1 << 26, "10m"), (2000, 777, "-1")])
def test_written_and_read(spark, file_bytes, range_bytes, broadcast):
    rows = rows_of_all_kinds()
    pages = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("page", "uri", "payload", "size", "sha1", "last", "n", "name", "refers_to", "path", "bytes")})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        files = write_archives(pages.repartition(3), new_work_dir(spark, "archives"), file_bytes=file_bytes)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = read_archives(spark, files, range_bytes).collect()

    def page(name):
        return None if name in (None, "urn:page:null") else int(name.removeprefix("urn:page:"))

    assert sorted(((page(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, page(r.refers_to)) for r in got), key=str) == expected(rows)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert sorted(bytes(r.payload) for r in got if r.payload is not None) == sorted((h or "").encode() for i, _, h in rows if not any(e[0] == i and e[3] == "revisit" and e[1] == len((h or "").encode()) for e in expected(rows)))
    assert {r.target_uri for r in got if page(r.record_id) in (2, 7, -6)} == {None, "http://c%0D%0AX: y", "http://e", "ü"}
    assert len({(r.path, r.place) for r in got}) == len(rows) == sum(f.records for f in files.collect())


def test_empty_table(spark):
    files = write_archives(spark.createDataFrame([], SCHEMA), new_work_dir(spark, "archives"))
    assert files.count() == 0 and read_archives(spark, files).count() == 0
