"""WARC archives: writing, reading, and reassembly of segmented records.

Writing. Each page becomes a WARC/1.1 record in a gzip member of its own. A response's block is an
HTTP message with chunked transfer framing; a block over ``segment_bytes`` is split into segments:
the first keeps the record's type, the others are `continuation` records that name the first as
their origin, and the last holds the total length. Of equal payloads the page with the largest id
is the response and the others are revisits. Spark's text writer commits the files, with an empty
gzip member as line separator, so the archives lie in any store that Spark reaches, written once
even if tasks are retried, and any WARC reader can read them.

Reading. Files are read whole (``records_per_file`` bounds their size) and parsed by their length
headers. Continuations are grouped by origin, ordered by segment number, checked for gaps and for
the total length, joined, and the chunked framing is decoded. Only segmented records are shuffled;
a group holds one record, however many pages there are.

Edge cases: null html counts as empty. Payloads of 0 bytes are payloads like others. Rows of one
id: those with the payload of the keeper's row are all responses if they have the keeper's id. A
null id never is the keeper while the group has another, and its record refers to the keeper; a
group of null ids only consists of responses. A null url is left out of the record, line ends in a
url become spaces. Records with missing segments, a wrong total or broken framing are returned with
complete = false and no payload, and so are damaged ones (a broken or cut-off gzip member, bad headers,
a wrong length), with those headers that can be read; reading goes on with the next record. Only the
named columns are read, so others can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.batches import small_batches
from folio.storage import discard, save

SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
RECORDS_PER_FILE = 4000
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
#: Groups of equal payloads up to which their table is broadcast; beyond it they are joined by shuffle.
BROADCAST_GROUPS = 250_000
#: A gzip member without content.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:folio:page:"

RECORD = (
    "record_id string, warc_type string, target_uri string, refers_to string, payload_digest string, "
    "segment_number int, origin_id string, total_length long, block binary"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def http_chunked(payload: bytes, chunk_bytes: int = CHUNK_BYTES) -> bytes:
    """An HTTP response with the payload in chunks."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    parts = [payload[i : i + chunk_bytes] for i in range(0, len(payload), chunk_bytes)]
    return head + b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def records_of(name: str, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page; name is unique among the archive's pages."""
    own, digest = f"<{ID}{name}>", "sha1:" + base32_sha1(payload)
    url = None if url is None else re.sub(r"[\r\n]+", " ", url)
    about = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest)]
    if refers_to is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *about, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{ID}{refers_to}>")], b"")
        return
    block = http_chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(parts) == 1:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *about, kind], block)
        return
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *about, kind, ("WARC-Segment-Number", "1")], parts[0])
    for n, part in enumerate(parts[1:], 2):
        total = str(len(block)) if n == len(parts) else None
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{ID}{name};segment={n}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n)), ("WARC-Segment-Total-Length", total)], part)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE, broadcast_groups: int = BROADCAST_GROUPS) -> None:
    """Write the pages as WARC files below path."""
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = own.withColumn("key", F.unhex(F.sha2("payload", 256)))
    sized = keyed.where(F.octet_length("payload") >= min_revisit_bytes)
    groups, groups_at = save(sized.groupBy("key").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-groups")
    held = F.broadcast(groups) if groups.count() <= broadcast_groups else groups
    marked = keyed.join(held, "key", "left")
    marked = marked.select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[bytes] = []
                for x in batch.slice(at, 256).to_pylist():
                    name = f"{'' if x['id'] is None else x['id']}#{task}.{row}"
                    row += 1
                    out += [member(r) for r in records_of(name, (x["url"] or "") if x["url"] is not None else None, x["payload"], x["refers_to"], segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = small_batches(marked).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    options = {"lineSep": EMPTY_MEMBER.decode("latin-1"), "encoding": "ISO-8859-1", "maxRecordsPerFile": str(records_per_file)}
    lines.write.options(**options).text(path)
    discard(pages.sparkSession, groups_at)


def _salvaged(unpacker, step: bytes) -> bytes:
    """What a decompressor gives of a step that breaks it, byte by byte up to the damage."""
    out = []
    try:
        for i in range(len(step)):
            out.append(unpacker.decompress(step[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def members(data: bytes, lenient: bool = False) -> Iterator[bytes]:
    """Contents of gzip members one after another, without copying the rest each time.

    lenient: of a broken member what can be unpacked, though it be nothing, and on with the next one that
    opens behind its start."""
    view, at, size = memoryview(data), 0, len(data)
    while at < size:
        unpacker, parts, start, fault = zlib.decompressobj(31), [], at, None
        while not unpacker.eof and fault is None:
            if start >= size:
                fault = "a gzip member is cut off"
                break
            step, before = view[start : start + 65536], unpacker.copy() if lenient else None
            try:
                parts.append(unpacker.decompress(step))
            except zlib.error as e:
                fault = f"a gzip member is broken: {e}"
                if before is not None:
                    parts.append(_salvaged(before, bytes(step)))
            start += len(step)
        if fault and not lenient:
            raise ValueError(fault)
        behind = data.find(b"\x1f\x8b\x08", at + 1) if fault else start - len(unpacker.unused_data)
        at = size if behind < 0 else behind
        if (whole := b"".join(parts)) or fault:
            yield whole


def _record_at(piece: bytes, at: int) -> tuple[dict[str, str], int, int]:
    """(headers, start and end of the block); headers in lower case."""
    end = piece.find(b"\r\n\r\n", at)
    head = piece[at:end].decode("utf-8", "replace").split("\r\n")
    if end < 0 or not head[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}: {piece[at : at + 40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise _Damaged(f"the record at {at} has no length", fields)
    start, stop = end + 4, end + 4 + int(size)
    if piece[stop : stop + 4] != b"\r\n\r\n":
        raise _Damaged(f"the record at {at} isn't {size} bytes long", fields)
    return fields, start, stop


class _Damaged(ValueError):
    """A record whose headers can be read."""

    def __init__(self, message: str, fields: dict[str, str]):
        super().__init__(message)
        self.fields = fields


def parse(data: bytes, lenient: bool = False) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of each record of an archive file; header names in lower case.

    lenient: a damaged record has a null block, and those headers that can be read; reading goes on behind
    the next blank line that a record follows."""
    for piece in members(data, lenient) if data[:2] == b"\x1f\x8b" else [data]:
        at = 0
        if not piece and lenient:
            yield {}, None
        while at < len(piece):
            try:
                fields, start, stop = _record_at(piece, at)
            except ValueError as fault:
                if not lenient:
                    raise
                yield getattr(fault, "fields", {}), None
                behind = piece.find(b"\r\n\r\nWARC/", at)
                at = len(piece) if behind < 0 else behind + 4
                continue
            yield fields, piece[start:stop]
            at = stop + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below path, segments apart, by the columns of RECORD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("warc-record-id", "warc-type", "warc-target-uri", "warc-refers-to", "warc-payload-digest", "warc-segment-number", "warc-segment-origin-id", "warc-segment-total-length")
        kinds = [pa.string()] * 5 + [pa.int32(), pa.string(), pa.int64()]
        columns = [x.split()[0] for x in RECORD.split(", ")]
        number = lambda x, digits: int(x) if x is not None and x.isascii() and x.isdigit() and len(x) <= digits else None

        def made(rows: list) -> pa.RecordBatch:
            cols = [[r[0].get(n) for r in rows] for n in names]
            cols[5], cols[7] = [number(x, 9) for x in cols[5]], [number(x, 18) for x in cols[7]]
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array([r[1] for r in rows], pa.binary())], columns)

        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in parse(content.as_py(), lenient=True):
                    rows.append(r)
                    if len(rows) == 500:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(run, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: record_id, warc_type, target_uri, refers_to, payload_digest, block, complete."""
    kept = ["record_id", "warc_type", "target_uri", "refers_to", "payload_digest"]
    segment = F.col("segment_number").isNotNull()
    alone = records.where(~segment).select(*kept, "block", F.col("block").isNotNull().alias("complete"))
    part = F.struct("segment_number", "total_length", F.col("block").cast("string").alias("bytes"), *kept)
    grouped = records.where(segment).groupBy(F.coalesce("origin_id", "record_id").alias("origin")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    first, last = F.col("parts")[0], F.element_at("parts", -1)
    block = F.array_join(F.col("parts.bytes"), "").cast("binary")
    numbers = F.col("parts.segment_number") == F.sequence(F.lit(1), F.size("parts"))
    whole = F.coalesce(numbers & (last["total_length"] == F.octet_length(block)), F.lit(False))
    joined = grouped.select(*(first[k].alias(k) for k in kept), block.alias("block"), whole.alias("complete"))
    return alone.union(joined)


def dechunked(body: bytes) -> bytes:
    """Decode chunked transfer framing."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + size]
        if len(chunk) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(chunk)
        at = end + 4 + size


def http_payload(block: bytes) -> bytes:
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP message")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    return dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def with_payloads(whole: DataFrame) -> DataFrame:
    """record_id, id, warc_type, target_uri, refers_to (an id), payload_digest, complete, payload (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, fine = [], []
            for kind, block, complete in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("warc_type", "block", "complete")), strict=True):
                payload = None
                if complete and kind == "response":
                    try:
                        payload = http_payload(block)
                    except ValueError:
                        complete = False
                out.append(payload)
                fine.append(complete)
            kept = [batch.column(batch.schema.get_field_index(n)) for n in ("record_id", "warc_type", "target_uri", "refers_to", "payload_digest")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fine, pa.bool_()), pa.array(out, pa.binary())], ["record_id", "warc_type", "target_uri", "refers_to", "payload_digest", "complete", "payload"])

    read = whole.mapInArrow(run, "record_id string, warc_type string, target_uri string, refers_to string, payload_digest string, complete boolean, payload binary")
    number = lambda c: F.regexp_extract(c, f"{ID}(-?[0-9]+)", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return read.select("record_id", as_id("record_id").alias("id"), "warc_type", "target_uri", as_id("refers_to").alias("refers_to"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "complete", "payload")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the archives below path, as with_payloads gives them."""
    return with_payloads(reassemble(read_records(spark, path)))


def with_digests(pages: DataFrame) -> DataFrame:
    """payload_bytes, and own_digest: the base32 SHA-1 of the payload that was read; both null without one."""
    kept = [n for n in pages.columns if n != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.column(batch.schema.get_field_index("payload")).to_pylist()
            columns = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([None if x is None else len(x) for x in got], pa.int64()), pa.array([None if x is None else base32_sha1(x) for x in got], pa.string())], [*kept, "payload_bytes", "own_digest"])

    types = dict(pages.dtypes)
    return pages.mapInArrow(run, ", ".join(f"{n} {types[n]}" for n in kept) + ", payload_bytes long, own_digest string")
