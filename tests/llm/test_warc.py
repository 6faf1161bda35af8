import base64
import gzip
import hashlib
import io

import pytest

from folio.llm import warc
from folio.llm.queries import op5_warc

PAGES = [
    (1, "http://a/", "same"),
    (2, None, "same"),
    (3, "http://b/\r\nX: 1", "same"),
    (4, "", None),
    (5, "http://c/", ""),
    (6, "http://d/", "é" * 50_000),
    (7, "http://d/", "WARC/1.1\r\n\r\n0\r\n\r\n" * 3000),
    (8, "http://e/", "x" * warc.SEGMENT_BYTES),
    (9, "http://f/", "once"),
    (9, "http://f/", "once"),
    (None, "http://g/", "same"),
    (None, "http://h/", "of null id only"),
    (None, "http://h/", "of null id only"),
]


def frame(spark, rows=PAGES):
    from pyspark.sql import functions as F

    made = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("id", "key", "keeper", "payload", "record", "n"):
        made = made.withColumn(name, F.lit(1))
    return made


def brute(rows, least=0):
    groups = {}
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for payload, ids in groups.items():
        keeper = max((i for i in ids if i is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for i in ids:
            revisit = len(ids) > 1 and i != keeper and keeper is not None and len(payload) >= least
            out.append((i, len(payload), digest, "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


def test_round_trip_through_the_query(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted((tuple(r) for r in op5_warc(spark, str(tmp_path)).collect()), key=str) == brute(PAGES)


@pytest.mark.parametrize("groups", [0, 100])
def test_payloads(spark, tmp_path, groups):
    path = str(tmp_path / "w")
    warc.write_archive(frame(spark), path, segment_bytes=1000, records_per_file=7, broadcast_groups=groups, min_revisit_bytes=5)
    rows = warc.read_archive(spark, path).collect()
    assert all(r.complete for r in rows)
    got = sorted(((r.id, bytes(r.payload).decode()) for r in rows if r.warc_type == "response"), key=str)
    assert got == sorted(((i, h or "") for i, _, h in PAGES), key=str)  # "same" is under 5 bytes: no revisits


def test_documents(spark, small):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op5_warc(spark, small).collect()), key=str) == brute(rows)


def test_empty(spark, tmp_path):
    warc.write_archive(frame(spark, []), str(tmp_path / "w"))
    assert warc.read_archive(spark, str(tmp_path / "w")).count() == 0


def test_files_are_members_of_gzip(spark, tmp_path):
    warc.write_archive(frame(spark).coalesce(1), str(tmp_path / "w"))
    data = next((tmp_path / "w").glob("part*")).read_bytes()
    whole = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
    assert list(warc.parse(data)) == list(warc.parse(whole))
    assert sum(1 for _ in warc.parse(data)) > len(PAGES)


def test_missing_and_wrong_segments(spark):
    def records(numbers, total):
        return [("<o>" if n == 1 else f"<{n}>", "response" if n == 1 else "continuation", None, None, None, n, None if n == 1 else "<o>", total if n == max(numbers) else None, b"HTTP/1.1 200 OK\r\n\r\n" if n == 1 else b"ab") for n in numbers]

    run = lambda rows: warc.with_payloads(warc.reassemble(spark.createDataFrame(rows, warc.RECORD))).collect()[0]
    good = run(records([3, 1, 2], 23))
    assert good.complete and bytes(good.payload) == b"abab"
    for numbers, total in (([1, 3], 23), ([2, 3], 23), ([1, 2, 3], 22), ([1, 2, 3], None)):
        bad = run(records(numbers, total))
        assert not bad.complete and bad.payload is None


def test_framing():
    for payload in (b"", b"x", b"ab" * 5000):
        assert warc.http_payload(warc.http_chunked(payload, 999)) == payload
    for broken in (b"5\r\nabc", b"3\r\nabcX\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(broken)
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.members(warc.member(b"abc")[:-3]))


def test_damaged_members_and_records_are_incomplete(spark, tmp_path):
    """One file of gzip members and one of plain records, each with damage between sound records."""
    one = lambda name, text: next(warc.records_of(name, "http://a/", text.encode(), None, 10**6))
    sound = [one(str(i), f"text {i} " * 50) for i in range(4)]
    flipped = bytearray(warc.member(sound[1]))
    flipped[40:60] = bytes(20)
    cut = warc.member(sound[2])[:-30]
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(warc.member(sound[0]) + bytes(flipped) + cut + warc.member(sound[3]))
    short = sound[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    bare = sound[2].replace(b"Content-Length: ", b"Content-Length: x", 1)
    (folder / "b.warc").write_bytes(one("10", "first") + short + bare + b"rubbish\r\n\r\n" + one("13", "last"))
    rows = warc.read_archive(spark, str(folder)).collect()
    whole = {r.id: bytes(r.payload).decode() for r in rows if r.complete}
    assert whole == {0: "text 0 " * 50, 3: "text 3 " * 50, 10: "first", 13: "last"}
    broken = [r for r in rows if not r.complete]
    assert len(broken) >= 4 and all(r.payload is None for r in broken)
    assert {1, 2} <= {r.id for r in broken}  # where headers can be read
    assert warc.with_digests(warc.read_archive(spark, str(folder))).where("complete").count() == 4
