"""Web archives: writing records, and reading them back with segment reassembly.

Writing: one response record a row; of rows with equal payloads the smallest
page_id is a response and the others are revisits that refer to it.  Payloads
above `chunk_bytes` use chunked transfer framing; blocks above `segment_bytes`
are cut into a first record and continuation records, which carry the first
one's id and a segment number, the last one also the total length.  Archives are
gzip members a record, begin with a warcinfo record, are rolled over at
`archive_bytes` and lie in the shared folder; all fields are standard ones: the
record's id is a tag URI that holds the page_id, WARC-Refers-To is the response's
id, and a null url has no WARC-Target-URI.  Archives' names hold the task attempt and only files of committed tasks are in the
manifest, so a task that is run again does no harm.

Reading: archives are parsed as streams.  Records of several segments are
grouped by origin id with one shuffle, ordered by segment number, checked for
gaps and against the total length, joined, and their chunked framing decoded;
the payload's SHA-1 is then compared with the recorded digest.  A task holds one
record at a time.

Defined results: a null payload is empty; a null page_id stays null; rows that
repeat both page_id and payload are each kept; a record with a missing segment,
a wrong length, bad framing or a wrong digest is returned with that `status` and
without payload, and so is one whose header can't be read (bad_header) or an
archive that isn't gzip or breaks off (bad_archive), of which nothing after that
is read; records of other origin have a null page_id; an empty table gives no
archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._io import Table, new_path

CRLF = b"\r\n"
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, segments int, status string"


@dataclass(frozen=True)
class WarcParams:
    chunk_bytes: int = 4096
    segment_bytes: int = 16_384
    archive_bytes: int = 32 << 20
    gzip_level: int = 1
    max_broadcast_rows: int = 200_000
    keep_payload: bool = False


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, row: int, part: int = 0) -> str:
    """The id of a row's record, or of a continuation of it."""
    return f"<tag:quillspark,2024:page/{'' if page_id is None else page_id}/{digest}/{row}{f'/{part}' if part else ''}>"


_PAGE = re.compile(r"<tag:quillspark,2024:page/(-?[0-9]{1,19})/")


def page_of(identifier: str | None) -> int | None:
    """The page_id in a record's id; None in a foreign one."""
    m = _PAGE.match(identifier or "")
    return int(m[1]) if m and abs(int(m[1])) < 2**63 else None


def chunked(payload: bytes, size: int) -> bytes:
    """payload in chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [b"%x" % len(piece), CRLF, piece, CRLF]
    return b"".join([*parts, b"0", CRLF, CRLF])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            return None
        out.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    headers = [*headers, ("WARC-Block-Digest", f"sha1:{digest_of(block)}")]
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"".join([b"WARC/1.1\r\n", head.encode("utf-8", "replace"), b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"])


def _clean(url: str | None) -> str:
    return "".join(c for c in (url or "") if c >= " ")


def info_of(name: str) -> bytes:
    """The record an archive begins with."""
    date = ("WARC-Date", "2024-01-01T00:00:00Z")
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<tag:quillspark,2024:archive/{name}>"), date, ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: quillspark\r\nformat: WARC File Format 1.1\r\n")


def records_of(page_id: int | None, url: str | None, payload: bytes, refers: int | None, row: int, params: WarcParams, refers_row: int | None = None) -> Iterator[bytes]:
    """The records of one row; refers and refers_row are those of the response with the same payload."""
    digest = digest_of(payload)
    own = record_id(page_id, digest, row)
    common: list[tuple[str, object]] = [
        ("WARC-Record-ID", own),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Profile", profile), ("WARC-Refers-To", record_id(refers, digest, refers_row or 0))], head + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    if len(payload) > params.chunk_bytes:
        block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, params.chunk_bytes)
    else:
        block = head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    size = params.segment_bytes
    if len(block) <= size:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    count = -(-len(block) // size)
    yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], block[:size])
    for k in range(1, count):
        last = [("WARC-Segment-Total-Length", len(block))] if k == count - 1 else []
        yield _record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, digest, row, k)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k + 1), *last],
            block[k * size : (k + 1) * size],
        )


def write(pages: DataFrame, params: WarcParams = WarcParams(), folder: str | None = None) -> DataFrame:
    """Write (page_id, url, html) as archives; returns the manifest (path, records, bytes)."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("sum", F.unhex(F.sha1("payload")))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row")))
    firsts = Table(rows.groupBy("sum").agg(F.count("*").alias("copies"), least.alias("first")).where("copies > 1").select("sum", F.col("first.page_id").alias("first"), F.col("first.row").alias("first_row")), "firsts").df
    small = firsts.count() <= params.max_broadcast_rows
    rows = rows.join(F.broadcast(firsts) if small else firsts, "sum", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    rows = rows.select("page_id", "url", "payload", refers.alias("refers"), "row", "first_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name, number, out, sizes = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", 0, None, [0, 0]
        done = []

        def pressed(record: bytes) -> bytes:
            c = zlib.compressobj(params.gzip_level, zlib.DEFLATED, 31)
            return c.compress(record) + c.flush()

        def close() -> None:
            out.close()
            done.append((f"{folder}/{name}-{number:04d}.warc.gz", *sizes))

        for batch in batches:
            for page_id, url, payload, ref, row, ref_row in zip(*[batch.column(i).to_pylist() for i in (0, 1)], batch.column(2), *[batch.column(i).to_pylist() for i in (3, 4, 5)]):
                for record in records_of(page_id, url, payload.as_py(), ref, row, params, ref_row):
                    if out is None:
                        file = f"{name}-{number:04d}.warc.gz"
                        out, sizes = fs.open_output_stream(f"{root}/{file}", compression=None), [0, 0]
                        out.write(pressed(info_of(file)))
                    member = pressed(record)
                    out.write(member)
                    sizes[0] += 1
                    sizes[1] += len(member)
                    # Continuations may thus lie in another archive than their origin.
                    if sizes[1] >= params.archive_bytes:
                        close()
                        out, number = None, number + 1
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "records": [d[1] for d in done], "bytes": [d[2] for d in done]})

    return Table(rows.mapInArrow(run, MANIFEST), "manifest").df


class _Stream:
    """A gzip file of many members, read piece by piece."""

    def __init__(self, raw, step: int = 1 << 20):
        self.raw, self.step, self.have, self.at, self.z = raw, step, b"", 0, zlib.decompressobj(31)
        self.pending = b""
        self.bad = False

    def more(self) -> bool:
        data = b"" if self.bad else self.pending or self.raw.read(self.step)
        if not data:
            return False
        parts = []
        while data:
            try:
                parts.append(self.z.decompress(data))
            except zlib.error:
                self.bad, data = True, b""
                break
            data = self.z.unused_data
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            if sum(map(len, parts)) > 4 * self.step:
                break
        self.pending = data
        self.have, self.at = self.have[self.at :] + b"".join(parts), 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = self.at
        while (end := self.have.find(mark, start)) < 0:
            left = len(self.have) - self.at
            if not self.more():
                return None
            start = max(0, left - len(mark))
        out = self.have[self.at : end]
        self.at = end + len(mark)
        return out

    def take(self, n: int) -> bytes | None:
        while len(self.have) - self.at < n:
            if not self.more():
                return None
        out = self.have[self.at : self.at + n]
        self.at += n
        return out


def _whole(value: str | bytes | None) -> int | None:
    """A number of at most 18 digits, else None."""
    text = (value.decode("latin-1") if isinstance(value, bytes) else value or "").strip()
    return int(text) if re.fullmatch("[0-9]{1,18}", text) else None


def parse(raw) -> Iterator[tuple[dict[str, str], bytes | None, str]]:
    """(headers, block, status) of each record of an open archive; block is None where the file ends within it or its length can't be read, which ends the reading."""
    s = _Stream(raw)
    while (head := s.until(CRLF + CRLF)) is not None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = _whole(headers.get("content-length", "0"))
        if size is None or not lines[0].startswith("WARC/"):
            yield headers, None, "bad_header"
            return
        block = s.take(size)
        if block is None and s.bad:
            break
        yield headers, block, "complete" if block is not None else "truncated"
        if block is None or s.take(4) is None:
            break
    else:
        headers = {}
    if s.bad:
        yield headers, None, "bad_archive"


def _finish(headers: dict[str, str], block: bytes | None, segments: int, status: str, params: WarcParams) -> tuple:
    page, url, refers = page_of(headers.get("warc-record-id")), headers.get("warc-target-uri"), page_of(headers.get("warc-refers-to"))
    told = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    size, payload = None, None
    if status == "complete":
        head, _, body = block.partition(CRLF + CRLF)
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
        if headers.get("warc-type") == "revisit":
            size = _whole(http.get(b"content-length", b"0"))
        else:
            payload = unchunked(body) if http.get(b"transfer-encoding", b"").lower() == b"chunked" else body
            if payload is None:
                status = "bad_framing"
            elif digest_of(payload) != told:
                status, payload = "wrong_digest", None
            else:
                size = len(payload)
    return (page, url, headers.get("warc-type"), refers, told, size, payload if params.keep_payload else None, segments, status)


SEGMENTS = "origin string, number int, total long, headers string, block binary, finished binary"


def read(manifest: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """The records of the archives at `path`, reassembled; payloads only if keep_payload."""
    import json
    import pickle

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("headers", pa.string()), ("block", pa.binary()), ("finished", pa.binary())])
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(name, compression=None) as raw:
                    for headers, block, status in parse(raw):
                        kind, number = headers.get("warc-type"), headers.get("warc-segment-number")
                        own = headers.get("warc-record-id", "")
                        if number is not None and _whole(number) is None:
                            status = "bad_header"
                        if status in ("bad_header", "bad_archive"):
                            rows.append((own, 0, None, None, None, pickle.dumps(_finish(headers, None, 1, status, params))))
                            continue
                        if kind not in ("response", "revisit", "continuation"):
                            continue
                        if block is None:
                            block, number = b"", number or "1"
                        if kind == "continuation" or number is not None:
                            total = headers.get("warc-segment-total-length")
                            first = kind != "continuation"
                            rows.append((own if first else headers.get("warc-segment-origin-id", ""), _whole(number) or 0, _whole(total), json.dumps(headers) if first else None, block, None))
                            held += len(block)
                        else:
                            rows.append((own, 0, None, None, None, pickle.dumps(_finish(headers, block, 1, "complete", params))))
                            held += len(rows[-1][5])
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    def whole(parts: list[tuple]) -> tuple:
        headers = json.loads(parts[0][2]) if parts[0][2] else {}
        numbers = [p[0] for p in parts]
        total = parts[-1][1]
        if numbers != list(range(1, len(parts) + 1)) or total is None:
            return _finish(headers, None, len(parts), "missing_segment", params)
        block = b"".join(p[3] for p in parts)
        return _finish(headers, block, len(parts), "complete" if len(block) == total else "wrong_length", params)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("segments", pa.int32()), ("status", pa.string())])
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            out = []
            for origin, number, total, headers, block, finished in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if parts and origin != now:
                    out.append(whole(parts))
                    parts = []
                if finished is not None:
                    out.append(pickle.loads(finished))
                    continue
                now = origin
                parts.append((number, total, headers, block))
            if out:
                yield made(out)
        if parts:
            yield made([whole(parts)])

    files = manifest.select("path").distinct()
    spark = manifest.sparkSession
    tasks = max(1, min(files.count(), 100_000))
    rows = files.repartition(tasks).mapInArrow(scan, SEGMENTS)
    width = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(width, "origin").sortWithinPartitions("origin", "number").mapInArrow(assemble, RECORDS)


def oracle(params: WarcParams = WarcParams()) -> str:
    """DuckDB SQL for what reading back the archives of pages gives; segments by the arithmetic of framing."""
    head = len("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n")
    full, chunk = f"{params.chunk_bytes:x}", params.chunk_bytes
    framed = f"b + (b // {chunk}) * {len(full) + 4} + CASE WHEN b % {chunk} > 0 THEN length(format('{{:x}}', b % {chunk})) + 4 ELSE 0 END + 5"
    block = f"{head} + CASE WHEN b > {chunk} THEN {len('Transfer-Encoding: chunked') + 4} + {framed} ELSE length('Content-Length: ' || b) + 4 + b END"
    quad = "('0x' || substr(x, 1 + 5 * k, 5))::INT"
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ({quad} >> {shift}) % 32, 1)" for shift in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
 d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS b, sha1(encode(h)) AS x, min(page_id) OVER (PARTITION BY h) AS low FROM p),
 r AS (SELECT *, low IS NOT NULL AND page_id IS DISTINCT FROM low AS again FROM d)
SELECT page_id, b AS payload_bytes, array_to_string(list_transform(range(8), lambda k: {letters}), '') AS payload_digest,
 CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN low END AS refers_to,
 CASE WHEN again THEN 1 ELSE ceil(({block}) / {params.segment_bytes}.0)::INT END AS segments, 'complete' AS status FROM r"""
