"""WARC archives: a writer with revisit records and a reader that salvages what it can from damaged files."""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, shared_folder, written

VERSION, DATE = b"WARC/1.1", "2024-01-01T00:00:00Z"
#: Compressed bytes after which a task starts a new archive; a reader holds one archive at a time.
ARCHIVE_BYTES = 8 << 20
#: Bytes of an archive or of inflated data that are looked at at once, of a record's header at most, and of records in a batch.
BITE, HEADER_BYTES, BATCH_BYTES = 1 << 16, 1 << 16, 4 << 20
PAGE = "urn:page:"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the page whose payload is the same."""
    block = _HTTP.format(len(payload)).encode() + (payload if refers_to is None else b"")
    head = [VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PAGE}{page_id}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}"] if url else []
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    head += [f"WARC-Refers-To: <{PAGE}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as one gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Source:
    """Bytes or an open file, read at any place."""

    def __init__(self, data: bytes | pa.NativeFile) -> None:
        self.data, self.size = data, len(data) if isinstance(data, bytes) else data.size()

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        return b"" if n <= 0 else self.data[at : at + n] if isinstance(self.data, bytes) else self.data.read_at(n, at)

    def next_mark(self, at: int) -> int:
        """Where a gzip member or a version line may begin, at ``at`` or later; the size where none does."""
        while at < self.size:
            block = self.read(at, 16 * BITE)
            if found := _MARKS.search(block):
                return at + found.start()
            at += max(1, len(block) - 6)  # a mark may lie across two blocks
            if at + 6 >= self.size:
                break
        return self.size


class Stream:
    """Data that comes in chunks: a buffer that is filled at its end and taken from at its front."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.buffer = chunks, bytearray()

    def fill(self, n: int) -> bool:
        """Have ``n`` bytes, or all that are left."""
        while len(self.buffer) < n:
            if (chunk := next(self.chunks, None)) is None:
                return False
            self.buffer += chunk
        return True


_MARKS = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
#: Names of header fields; a value that ends in a version line, as one header runs into the next.
_NAME, _TORN = re.compile(rb"[!#-9;-~]+"), re.compile(rb"WARC/1\.\d+$")


def parse(stream: Stream, most: int | None = None) -> tuple[dict, int, bool]:
    """Check and read the record at the start of the stream: its fields, length, and whether a digest vouches for it.

    ValueError says what is wrong; nothing is taken from the stream. ``most`` is how many bytes there can be.
    """
    stream.fill(7)
    if not stream.buffer.startswith(b"WARC/1."):
        raise ValueError("no version line")
    end, have = -1, 0
    while (end := stream.buffer.find(b"\r\n\r\n", max(0, have - 3), HEADER_BYTES)) < 0:
        have = len(stream.buffer)
        if have >= HEADER_BYTES or not stream.fill(have + 1):
            raise ValueError("header not ended")
    fields = [x.split(b":", 1) for x in bytes(stream.buffer[:end]).split(b"\r\n")[1:]]
    if not all(len(x) == 2 and _NAME.fullmatch(x[0]) and not _TORN.search(x[1]) for x in fields) or len({x[0].lower() for x in fields}) < len(fields) - sum(x[0].lower() == b"warc-concurrent-to" for x in fields):
        raise ValueError("header is torn")
    head = dict(fields)
    head = {k.strip().lower().decode("ascii", "replace"): v.strip().decode("utf-8", "replace") for k, v in head.items()}
    if not re.fullmatch("[0-9]{1,18}", head.get("content-length", "")):
        raise ValueError("no length")
    stop = end + 4 + int(head["content-length"])
    if most is not None and stop + 4 > most or not stream.fill(stop + 4) or stream.buffer[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("length is wrong")
    with memoryview(stream.buffer) as view:
        block = bytes(view[end + 4 : stop])
    sha1 = lambda name: (head.get(name, "").lower().startswith("sha1:") and head[name][5:].strip()) or None
    if (want := sha1("warc-block-digest")) and want.upper() != digest(block):
        raise ValueError("block digest differs")
    http, cut_off, payload = block.partition(b"\r\n\r\n") if head.get("content-type", "").replace(" ", "").lower().startswith("application/http") else (b"", b"", block)
    out = {"record_type": head.get("warc-type"), "record_id": head.get("warc-record-id", "").strip("<>"), "url": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to", "").strip("<>") or None, "payload": payload}
    out["payload_digest"] = sha1("warc-payload-digest")
    if out["record_type"] != "revisit":
        out["payload_bytes"] = len(payload)
        if out["payload_digest"] and out["payload_digest"].upper() != digest(payload):
            raise ValueError("payload digest differs")
    else:
        found = re.search(rb"(?i)^content-length:\s*(\d+)", http, re.M)
        out["payload_bytes"] = int(found[1]) if found else None
    return out, stop + 4, bool(want or (out["payload_digest"] and out["record_type"] != "revisit"))


def _member(source: Source, at: int) -> Iterator[tuple[str, int, int, dict | str]]:
    """Records and gaps of the gzip member at ``at``; a record ends where the file had been read to when it was whole.

    A record that no digest vouches for waits for the member's own check. Where a record fails its checks, the next
    version line inside the member is looked for. The last value says how the member ended: ("end", at, stop, "" or why).
    """
    place, why = [at], [""]

    def inflated() -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof and not why[0]:
            if not (bite := source.read(place[0], BITE)):
                why[0] = "member not ended"
                return
            before = z.copy()
            try:
                out = z.decompress(bite)
                place[0] += len(bite) - len(z.unused_data)
            except zlib.error as e:  # what comes before the damage, byte by byte
                why[0], out, n = str(e)[:100], b"", 0
                with contextlib.suppress(zlib.error):
                    while True:
                        out, n = out + before.decompress(bite[n : n + 1]), n + 1
                place[0] += n
            if out:
                yield out

    stream, waiting, done, bad = Stream(inflated()), [], at, ""
    while stream.fill(1):
        try:
            fields, used, vouched = parse(stream)
        except ValueError as e:
            bad = bad or str(e)[:100]
            while (found := stream.buffer.find(b"WARC/1.", 1)) < 0 and stream.fill(len(stream.buffer) + 1):
                del stream.buffer[:-7]
            del stream.buffer[: found if found >= 0 else len(stream.buffer)]
            continue
        del stream.buffer[:used]
        if bad:
            yield "gap", done, place[0], f"{bad}, inside a member"
            bad = ""
        stream.fill(1)  # the member may end with this record
        done, row = place[0], ("record", at, place[0], fields)
        if vouched and not waiting:
            yield row
        else:
            waiting.append(row)
    if not why[0]:
        yield from waiting
        if bad:
            yield "gap", done, place[0], f"{bad}, inside a member"
    else:
        yield from (r for r in waiting if r[3]["payload_digest"])
    yield "end", at, done if why[0] else place[0], why[0]


def salvage(data: bytes | pa.NativeFile) -> Iterator[tuple[str, int, int, dict | str]]:
    """Records and quarantined gaps of an archive: ("record", start, end, fields) or ("gap", start, end, reason).

    Compressed members (of one or several records) and plain records may be mixed. Where one fails a check, the reader
    looks for the next place where a gzip member or a version line begins and a whole record can be read; the bytes
    between are a gap. Of a damaged member the records before the damage stay, if a digest vouches for them. The file is read
    in bites, and memory holds one record at a time; several records of one member all start where it does.
    """
    source = Source(data)
    at, gap, why = 0, -1, ""
    while at < source.size:
        found, stop = False, at
        if source.read(at, 3) == b"\x1f\x8b\x08":
            for kind, start, end, what in _member(source, at):
                if kind == "end":
                    stop, failed = end, what
                    break
                if gap >= 0 and kind == "record":
                    yield "gap", gap, at, why
                    gap = -1
                found = found or kind == "record"
                if kind == "record" or found:
                    yield kind, start, end, what
            failed = failed or ("" if found else "no record in a member")
        else:
            block = lambda at=at: (source.read(k, BITE) for k in range(at, source.size, BITE))
            try:
                fields, used, _ = parse(Stream(block()), source.size - at)
                failed, found, stop = "", True, at + used
            except ValueError as e:
                failed = str(e)[:100]
            if found:
                if gap >= 0:
                    yield "gap", gap, at, why
                    gap = -1
                yield "record", at, stop, fields
        if failed:
            if gap < 0:
                gap, why = stop if found else at, failed
            at = source.next_mark(at + 1)
        else:
            at = stop
    if gap >= 0 and gap < source.size:
        yield "gap", gap, source.size, why


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for every page into .warc.gz files below ``folder``; one row per finished archive: path, records, bytes.

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest id is written in full, the
    others as revisits of it. A null html is an empty payload, a null url is left out; a null id is written as no page
    and repeats nothing; repeated rows with the smallest id are all responses. Other columns are not carried. Files carry the task attempt's name, and only those of attempts that succeeded are listed.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    # ids alone tell which pages repeat another; whole pages are then joined by their own id, which no key dominates
    ids = written(rows.where(F.octet_length("html") >= least).select("page_id", "digest"))
    same = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = cut(ids.join(same, "digest").where("page_id <> first").distinct())
    rows = rows.join(again, ["page_id", "digest"], "left").drop("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, top = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        name = f"{context.stageId()}-{context.partitionId()}-{context.taskAttemptId()}"
        done, out, path, n, size = [], None, "", 0, 0
        for b in batches:
            for i, u, h, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path, n, size = f"{top}/{name}-{len(done)}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                data = member(record(i, u, h.encode(), None if first is None or first == i else first))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done, out = [*done, (path, n, size)], None
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            scheme = folder[: folder.index(top)] if top in folder else ""
            yield pa.RecordBatch.from_pylist([{"path": scheme + p, "records": n, "bytes": s} for p, n, s in done])

    return cut(rows.select("page_id", "url", "html", "first").mapInArrow(run, "path string, records long, bytes long"))


def read_archives(archives: DataFrame) -> DataFrame:
    """Read back every archive of ``archives`` (path), salvaging damaged ones; a row per record or gap.

    kind (record or gap), path, start, end (bytes of the file), reason (gaps), and of records record_type, record_id,
    url, payload_bytes, payload_digest, refers_to and payload (null for revisits). An empty file has no rows; a null path is
    passed over. The gaps are the quarantine log: ``where("kind = 'gap'")``.
    """
    schema = "kind string, path string, start long, end long, reason string, record_type string, record_id string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"start": pa.int64(), "end": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, place = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(place) as f:
                    rows, held = [], 0
                    for kind, start, end, what in salvage(f):
                        fields = {"reason": what} if isinstance(what, str) else what | {"payload": None if what["record_type"] == "revisit" else what["payload"]}
                        rows.append({"kind": kind, "path": path, "start": start, "end": end} | fields)
                        held += len(fields.get("payload") or b"")
                        if len(rows) == 256 or held >= BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    paths = archives.where("path is not null").select("path")
    return paths.repartition(max(1, paths.sparkSession.sparkContext.defaultParallelism * 4)).mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write ``pages`` and read them back, without payloads; fails if not every record written was read, and names the gaps."""
    archives = write_archives(pages, folder, least)
    read = written(read_archives(archives).drop("payload"))
    wrote = archives.agg(F.sum("records")).first()[0] or 0
    found = {r["kind"]: r["count"] for r in read.groupBy("kind").count().collect()}
    if found.get("record", 0) != wrote or found.get("gap"):
        some = [tuple(r) for r in read.where("kind = 'gap'").select("path", "start", "end", "reason").limit(5).collect()]
        raise ValueError(f"{wrote} records were written and {found.get('record', 0)} read; gaps: {some}")
    return read.where("kind = 'record'")
