"""WARC archives: writing with revisit records, and a salvage reader.

A writer task makes one archive of gzip members, one record each, in the shared
folder. The reader checks every member and record (compression, version line,
lengths, block and payload digests). After a failed check it searches for the
next gzip member or version line that starts a valid record, goes on there and
logs the bytes between as a quarantined gap. A member may hold many records: the
same search goes on within its decoded bytes, so one bad record costs no other.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.batches import bounded
from sievelake.session import materialize, work_dir

VERSION = b"WARC/1."
GZIP = b"\x1f\x8b\x08"
CHUNK = 1 << 20
#: Decoded bytes of a member that are kept; a longer one is decoded again, piece by piece.
KEPT = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "archive string, offset long, stored_bytes long, record_type string, record_id string, refers_to string, uri string, payload_bytes long, payload_digest string, payload binary, gap_reason string, inside_offset long, inside_bytes long"


class Damaged(Exception):
    """A check of a member or record failed."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- writing -------------------------------------------------------------------------------


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:x-page:none:{digest}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP head alone, with the digest and length of the payload."""
    digest = base32_sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if record_type == "response":
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if record_type == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def mark_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, payload) with ``record_type`` and ``refers_to``.

    Of equal payloads of at least ``min_bytes`` the row with the largest id is the
    response. Rows that share that id and payload are all responses; so are all
    rows of a payload whose ids are all null. Counts are taken before the shuffle,
    and only payloads that occur twice are joined back.
    """
    base = pages.withColumn("_digest", F.sha1(payload_col))
    groups = base.filter(F.octet_length(payload_col) >= min_bytes).groupBy("_digest").agg(F.max(id_col).alias("_keep"), F.count("*").alias("_n"))
    groups = materialize(groups.filter("_n > 1 and _keep is not null").drop("_n"), "payloads")
    joined = base.join(groups.hint("shuffle_hash"), "_digest", "left")
    is_response = F.col("_keep").isNull() | F.col(id_col).eqNullSafe(F.col("_keep"))
    return joined.select(
        *pages.columns,
        F.when(is_response, "response").otherwise("revisit").alias("record_type"),
        F.when(~is_response, F.col("_keep")).alias("refers_to"),
    )


def write_archives(marked: DataFrame, folder: str, roll_bytes: int = 256 << 20) -> DataFrame:
    """Write rows (page_id, url, payload, record_type, refers_to) to gzip WARC files in ``folder``, a
    URI that all executors share; returns ``path``, ``records``, ``bytes`` of the finished archives.

    Files are named by partition and attempt and closed before their row is
    returned; only returned paths count, so an attempt that is lost or repeated
    leaves at most a file that nobody reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        task, part, out, stats = TaskContext.get(), 0, None, [0, 0]
        names: list[tuple[str, int, int]] = []

        def close() -> None:
            out.close()
            names.append((path, *stats))

        for batch in batches:
            for page_id, url, payload, kind, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{part}.warc.gz"
                    path, out, stats = f"{folder}/{name}", files.open_output_stream(f"{base}/{name}", compression=None), [0, 0]
                member = gzip_member(record_bytes(page_id, url, payload or b"", kind, refers))
                out.write(member)
                stats = [stats[0] + 1, stats[1] + len(member)]
                if stats[1] >= roll_bytes:
                    close()
                    out, part = None, part + 1
        if out is not None:
            close()
        columns = list(zip(*names)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["path", "records", "bytes"])

    return bounded(marked.select("page_id", "url", "payload", "record_type", "refers_to")).mapInArrow(run, "path string, records long, bytes long")


# --- reading -------------------------------------------------------------------------------


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and where it ends; raises Damaged."""
    if data[at : at + len(VERSION)] != VERSION:
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers have no end")
    lines = data[at:end].split(b"\r\n")[1:]
    head = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("malformed header")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", head.get("content-length", "")):
        raise Damaged("no content length")
    start = end + 4
    stop = start + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("record is cut or too long")
    block = data[start:stop]
    _verify(head.get("warc-block-digest"), block, "block")
    head["block"] = block
    return head, stop + 4


def _verify(stated: str | None, data: bytes, what: str) -> None:
    if stated and stated.lower().startswith("sha1:") and stated[5:].upper() != base32_sha1(data):
        raise Damaged(f"{what} digest differs")


def describe(head: dict) -> dict:
    """Columns of a parsed record. A revisit states its payload's digest and length, a response must match them."""
    block, kind = head.pop("block"), head.get("warc-type", "")
    payload, length = block, len(block)
    if "application/http" in head.get("content-type", ""):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise Damaged("HTTP head has no end")
        stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
        length = int(stated[1]) if stated and kind == "revisit" else len(payload)
    digest = head.get("warc-payload-digest", "")
    if kind != "revisit":
        _verify(digest, payload, "payload")
        digest = digest or "sha1:" + base32_sha1(payload)
    return {
        "record_type": kind, "record_id": head.get("warc-record-id"), "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri"),
        "payload_bytes": length, "payload_digest": digest.rpartition(":")[2].upper(), "payload": payload if kind != "revisit" else None,
    }


class Salvage:
    """Iterates over records and gaps of one archive, a seekable file of ``size`` bytes."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _decoded(self, at: int) -> Iterator[bytes]:
        """The decoded bytes of the gzip member at ``at`` in pieces; the generator's value is the member's end."""
        unpack, pos = zlib.decompressobj(31), at
        while not unpack.eof:
            chunk = unpack.unconsumed_tail
            if not chunk:
                chunk = self._read(pos, CHUNK if pos > at else 1 << 16)
                pos += len(chunk)
                if not chunk:
                    raise Damaged("member is cut")
            before = unpack.copy() if pos - at > 1 << 16 else None
            try:
                piece = unpack.decompress(chunk, 4 * CHUNK)
            except zlib.error as error:
                yield self._until_error(before or zlib.decompressobj(31), chunk)
                raise Damaged(f"member fails: {error}") from error
            if piece:
                yield piece
        return pos - len(unpack.unused_data)

    @staticmethod
    def _until_error(unpack, chunk: bytes) -> bytes:
        """What a chunk decodes to before the byte that fails."""
        parts = []
        try:
            for at in range(len(chunk)):
                parts.append(unpack.decompress(chunk[at : at + 1]))
        except zlib.error:
            pass
        return b"".join(parts)

    def _member(self, at: int) -> tuple[Iterator[tuple[int, int, dict | str]], int, str | None]:
        """The records and gaps (place and length in the decoded bytes) of the gzip member at ``at``, its end, and what is wrong
        with the member itself. Raises Damaged if no record can be had from it."""
        parts, size, end, problem = [], 0, at, None
        pieces = self._decoded(at)
        while True:
            try:
                piece = next(pieces)
            except StopIteration as over:
                end = over.value
                break
            except Damaged as damage:
                problem = str(damage)
                break
            size += len(piece)
            if size <= KEPT:
                parts.append(piece)
        again = (lambda: iter(parts)) if size <= KEPT else lambda: self._again(at)
        scan = lambda: self._inside(again(), problem is not None)
        first = next((w for _, _, w in scan() if isinstance(w, dict)), None) if size > KEPT or problem else None
        if first is None and (size > KEPT or problem):
            raise Damaged(problem or "member has no record")
        if problem and not any(isinstance(w, str) for _, _, w in scan()):
            # The member fails and each record verifies: the damage may be in any header.
            raise Damaged(problem)
        if size <= KEPT:
            found = list(scan())
            if not any(isinstance(w, dict) for _, _, w in found):
                raise Damaged(next((w for _, _, w in found), "member is empty"))
            return iter(found), end, problem
        return scan(), end, problem

    def _again(self, at: int) -> Iterator[bytes]:
        try:
            yield from self._decoded(at)
        except Damaged:
            return

    @staticmethod
    def _inside(pieces: Iterator[bytes], strict: bool) -> Iterator[tuple[int, int, dict | str]]:
        """Records and gaps of decoded bytes, with place and length; holds one record at a time. ``strict`` takes only
        records that state a block digest."""
        data, base, gap, reason, more = b"", 0, None, "", True

        def fetch() -> bool:
            nonlocal data, more
            piece = next(pieces, None)
            more = piece is not None
            data += piece or b""
            return more

        while True:
            try:
                while len(data) < len(VERSION) and fetch():
                    pass
                if not data:
                    break
                if data.startswith(VERSION):
                    while (need := _length(data)) is None and fetch():
                        pass
                    missing, parts = (need or 0) - len(data), []
                    while missing > 0 and (piece := next(pieces, None)) is not None:
                        parts.append(piece)
                        missing -= len(piece)
                    data += b"".join(parts)
                head, stop = parse_record(data)
                if strict and not head.get("warc-block-digest"):
                    raise Damaged("record in a damaged member states no digest")
                record = describe(head)
            except Damaged as problem:
                if gap is None:
                    gap, reason = base, str(problem)
                at = data.find(VERSION, 1)
                while at < 0:
                    keep = min(len(data), len(VERSION) - 1)
                    base, data = base + len(data) - keep, data[len(data) - keep :]
                    if not fetch():
                        base, data, at = base + len(data), b"", 0
                        break
                    at = data.find(VERSION, 1 if keep == len(data) else 0)
                base, data = base + at, data[at:]
                continue
            if gap is not None:
                yield gap, base - gap, reason
                gap = None
            yield base, stop, record
            base, data = base + stop, data[stop:]
        if gap is not None:
            yield gap, base - gap, reason

    def _plain(self, at: int) -> tuple[dict, int]:
        """The uncompressed record at ``at``, read on until it is whole, and its end."""
        want, data = 1 << 16, b""
        while True:
            data = self._read(at, want)
            need = _length(data)
            if need is not None and (len(data) >= need or need > self.size - at) or len(data) < want:
                head, stop = parse_record(data)
                return describe(head), at + stop
            want = max(need or 0, want * 2 if need is None else 0)

    def _next_start(self, at: int) -> int:
        """The first place from ``at`` on that looks like a member or a version line."""
        while at < self.size:
            data = self._read(at, CHUNK + 8)
            found = re.search(re.escape(GZIP) + b"|" + re.escape(VERSION), data)
            if found and found.start() < CHUNK:
                return at + found.start()
            at += CHUNK
        return self.size

    def __iter__(self) -> Iterator[tuple[int, int, dict | str, int | None, int | None]]:
        """(offset, bytes, record or a gap's reason, place inside, bytes inside) in order of offsets. ``bytes`` are the file's bytes
        that the row accounts for: rows add up to the file, so of the rows of one member the first has them all. The places inside
        are those in a member's decoded bytes; they are None for plain records and for gaps between members."""
        at, gap, reason = 0, None, ""
        while at < self.size:
            magic, problem = self._read(at, 8), None
            try:
                if magic.startswith(GZIP):
                    found, end, problem = self._member(at)
                elif magic.startswith(VERSION):
                    record, end = self._plain(at)
                    found = iter([(None, None, record)])
                else:
                    raise Damaged("neither a member nor a version line")
            except Damaged as damage:
                if gap is None:
                    gap, reason = at, str(damage)
                at = self._next_start(at + 1)
                continue
            if gap is not None:
                yield gap, at - gap, reason, None, None
                gap = None
            stored = 0 if problem else end - at
            for place, length, what in found:
                yield at, stored, what, place, length
                stored = 0
            if problem:
                gap, reason, at = at, problem, self._next_start(at + 1)
            else:
                at = end
        if gap is not None:
            yield gap, self.size - gap, reason, None, None


def _length(data: bytes) -> int | None:
    """Bytes of the record that begins the data, as its headers state; None as long as they don't."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    stated = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})\r?$", data[: end + 2])
    return end + 8 + int(stated[1]) if stated else 0


def _rows(archive: str, file, size: int, keep_payload: bool) -> Iterator[dict]:
    for offset, stored, what, place, length in Salvage(file, size):
        row = {"archive": archive, "offset": offset, "stored_bytes": stored, "inside_offset": place, "inside_bytes": length}
        if isinstance(what, str):
            row |= {"record_type": "gap", "gap_reason": what}
        else:
            row |= what if keep_payload else what | {"payload": None}
        yield row


ARROW = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in RECORDS.split(", ")])


def _batched(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("payload") or b"")
        if len(held) >= 2000 or size > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, ARROW)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, ARROW)


def read_archives(paths: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives in column ``path`` (URIs that pyarrow opens: file, hdfs, s3, gs).

    Gaps have ``record_type`` 'gap' and ``gap_reason``; ``offset`` and
    ``stored_bytes`` tell the quarantined bytes, ``inside_offset`` and
    ``inside_bytes`` those of a gap within a member's decoded bytes. A member whose
    checksum fails gives the records that verify by themselves, and a gap. An
    empty file gives no rows, nor do null paths; a path that occurs twice is read
    twice; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, place = fs.FileSystem.from_uri(path)
                with files.open_input_file(place) as file:
                    yield from _batched(_rows(path, file, file.size(), keep_payload))

    return paths.select("path").filter("path IS NOT NULL").mapInArrow(run, RECORDS)


def read_contents(files: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The same for rows of Spark's ``binaryFile`` source (path, content), for stores that only Spark opens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _batched(_rows(path, pa.BufferReader(content or b""), len(content or b""), keep_payload))

    return files.select("path", "content").mapInArrow(run, RECORDS)


def page_number(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write every page to archives in the shared folder and return a DataFrame of their paths.

    Null html is an empty payload, a null url is left out, a null id gets a
    record id from its payload and never is a revisit's target. Repeated rows are
    written each. Other columns are ignored, whatever their names. An empty table
    writes no archive and gives no paths.
    """
    chosen = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8").alias("payload"),
    )
    marked = mark_revisits(chosen, "page_id", "payload", min_bytes)
    folder = re.sub(r"^file:/+", "file:///", f"{work_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    return materialize(write_archives(marked, folder), "archives")
