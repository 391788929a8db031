import base64
import gzip
import hashlib
import itertools
from collections import defaultdict

import pytest

from draftloom.llm import warc
from draftloom.llm.shared import shared_path

PAGES = [
    (1, "http://a/", "same"), (2, "http://b/", "same"), (9, "http://c/\r\nX: y", "same"), (3, None, None), (4, "http://d/", ""), (5, "http://e/", "x\r\n\r\nWARC/1.1\r\n\r\ny"),
    (6, "http://f/", "é日\u0000\t"), (7, "http://g/", "z" * 300_000), (None, "http://h/", "same"), (8, "http://i/", "\r\n\r\n"), (5, "http://e2/", "other"),
]


def expected(pages, least=0):
    groups = defaultdict(list)
    for p, _, html in pages:
        groups[html or ""].append(p)
    out = []
    for p, _, html in pages:
        data = (html or "").encode()
        last = max((q for q in groups[html or ""] if q is not None), default=None)
        revisit = len(data) >= least and p != last
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "per_file"), [(0, 3), (5, 1000)])
def test_round_trip_and_revisits(spark, least, per_file):
    df = spark.createDataFrame([(*p, "mine") for p in PAGES], "page_id long, url string, html string, payload string")
    first, second = shared_path(spark, "t"), shared_path(spark, "t")
    warc.write_archive(warc.records(df), first, per_file)
    stored = {(r.page_id, bytes(r.block)) for r in warc.read_archive(spark, first).collect()}
    assert stored == {(p, (h or "").encode()) for p, _, h in PAGES}
    warc.deduplicate_archive(spark, first, second, least, per_file)
    rows = warc.read_archive(spark, second).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr)
    assert got == expected(PAGES, least)
    assert all(len(r.block) == (0 if r.record_type == "revisit" else r.payload_bytes) for r in rows)
    assert len({r.record_id for r in rows}) == len(rows)


def test_records_are_standard(spark):
    df = spark.createDataFrame([(1, "http://a/", "body"), (2, "http://b/", "body")], "page_id long, url string, html string")
    first, second = shared_path(spark, "t"), shared_path(spark, "t")
    warc.write_archive(warc.records(df), first)
    warc.deduplicate_archive(spark, first, second)
    raw = b"".join(gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(second).collect())
    records = list(warc.parse_records(raw))
    assert raw.startswith(b"WARC/1.1\r\n") and len(records) == 2
    revisit = next(f for f, _ in records if f["warc-type"] == "revisit")
    response = next(f for f, _ in records if f["warc-type"] == "response")
    assert revisit["warc-refers-to"] == response["warc-record-id"] and revisit["warc-refers-to-target-uri"] == "http://b/" and revisit["warc-profile"] == warc.PROFILE


def test_parser():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse_records(record * 2)] == [b"abc", b"abc"]
    for broken in (b"junk", record[:-4], record.replace(b"3", b"2")):
        with pytest.raises(ValueError):
            list(warc.parse_records(broken))


def test_empty_and_digest(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    first, second = shared_path(spark, "t"), shared_path(spark, "t")
    warc.write_archive(warc.records(df), first)
    warc.deduplicate_archive(spark, first, second)
    assert warc.read_archive(spark, second).count() == 0
    one = spark.createDataFrame([("é",)], "t string")
    digest = one.select(warc.base32_sha1(one.t.cast("binary")).alias("d")).first().d
    assert digest == base64.b32encode(hashlib.sha1("é".encode()).digest()).decode()


def _record(n, body):
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: r{n}\r\nWARC-Target-URI: http://x/\r\nWARC-Payload-Digest: sha1:{digest}\r\nX-Page-Id: {n}\r\nX-Payload-Length: {len(body)}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_streams_of_members_and_plain_files(spark, tmp_path):
    """Line ends in every mixture within, before and behind blocks; members one by one, and a plain file beside them."""
    bodies = [bytes(ends) for n in range(7) for ends in itertools.product(b"\r\n", repeat=n)]
    bodies += [b"a" * k + b"\r\n\r\r\n\r\n" + b"b" * k for k in (65_530, 65_536, 131_070)] + [b"\r\n\r\n" * 5_000, b""]
    records = [_record(n, b) for n, b in enumerate(bodies)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(_record(-1, b"plain\r\n") + _record(-2, b""))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(_record(-3 - n, b) for n, b in enumerate(bodies))))
    got = {(r.page_id, bytes(r.block)) for r in warc.read_archive(spark, f"file://{tmp_path}").collect()}
    assert got == {*enumerate(bodies), (-1, b"plain\r\n"), (-2, b""), *((-3 - n, b) for n, b in enumerate(bodies))}
    assert list(warc.stream_records(piece for r in records for piece in r[:-4].split(b"\r\n\r\n"))) == list(warc.parse_records(b"".join(records)))


def test_large_payloads_are_not_held_together(spark):
    """2,000 payloads of a quarter megabyte in one file, written, resolved and read in a session of 4 GB."""
    df = spark.range(2_000).repartition(1).selectExpr("id as page_id", "'http://x/' as url", "concat(cast(id % 1500 as string), repeat('0123456789abcdef', 16000)) as html")
    first, second = shared_path(spark, "t"), shared_path(spark, "t")
    warc.write_archive(warc.records(df), first)
    warc.deduplicate_archive(spark, first, second)
    kinds = {r.record_type: r["count"] for r in warc.read_archive(spark, second, blocks=False).groupBy("record_type").count().collect()}
    assert kinds == {"response": 1_500, "revisit": 500}
