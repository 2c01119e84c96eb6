"""WARC archives: a writer with revisit records, and a salvage reader that goes on after damage.

Writing: each task writes its rows as gzip members, one per record, into files of about ``roll`` bytes under a shared
folder, through the file system that the folder's address names. File names are new for each attempt and the files of
the attempts that counted are listed in a stored table, so a task that runs again neither overwrites nor doubles rows.

Reading: a file is read in blocks of bounded size. Each member (or plain record) is checked: gzip's own CRC, the version
line, the headers, Content-Length, the record's end, block and payload digests. After a failed check the reader looks for
the next gzip member that begins with a version line (or, in plain files, the next version line), goes on there, and
reports the bytes between as a quarantined gap. A member may hold several records. Memory is bounded by the largest
member, or plain record.

A round trip stores what it read, gaps included, and fails if that is not a record for each one written.

Of rows with equal payloads of ``least`` bytes or more, the one with the largest page_id is the response and the others
revisit it; repeated rows with that page_id are all responses, and so are rows with a null page_id unless a row with the
same payload has one. A null html is an empty payload; a null url gives a record without a target. Other columns of the
input are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, stored

#: Fixed values of the format (ISO 28500).
VERSION = b"WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/[0-9]\.[0-9]{1,2}\r\n")
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
ID = "<urn:x-page:{}>"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of ``refers_to`` that holds the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": ID.format("" if page_id is None else page_id), "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": ID.format(refers_to)}
    head |= {"WARC-Payload-Digest": "sha1:" + digest(payload), "WARC-Block-Digest": "sha1:" + digest(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass") + b"\r\n" + block + END


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(END)[2]


@dataclass
class Gap:
    """Quarantined bytes [offset, offset + length) and the first check that failed there."""

    offset: int
    length: int
    reason: str


class Damaged(Exception):
    pass


@dataclass
class Salvager:
    """Records and gaps of one archive; ``read_at(offset, n)`` gives up to n bytes."""

    read_at: Callable[[int, int], bytes]
    size: int
    step: int = 1 << 20
    plain: bool = False
    _at: int = field(default=-1, init=False)
    _block: bytes = field(default=b"", init=False)

    def _bytes(self, offset: int, n: int) -> bytes:
        """Like read_at, through one block of read-ahead."""
        if not self._at <= offset or offset + n > self._at + len(self._block):
            self._at, self._block = offset, self.read_at(offset, max(n, self.step))
        return self._block[offset - self._at : offset - self._at + n]

    def __iter__(self) -> Iterator[Record | Gap]:
        at, bad, why = 0, None, ""
        while at < self.size:
            try:
                found = self._member(at) if not self.plain and self._bytes(at, 3) == MAGIC else [self._plain(at)]
            except Damaged as e:
                if bad is None:
                    bad, why = at, str(e)
                at = self._next(at + 1)
                continue
            if bad is not None:
                yield Gap(bad, at - bad, why)
                bad = None
            yield from found
            at += sum(x.length for x in found)
        if bad is not None:
            yield Gap(bad, self.size - bad, why)

    def _member(self, at: int) -> list[Record | Gap]:
        """The record of a gzip member; of several all that are whole, of which the first has the member's length."""
        inflate, out, pos = zlib.decompressobj(31), [], at
        try:
            while not inflate.eof:
                piece = self._bytes(pos, 1 << 16)
                if not piece:
                    raise Damaged("cut member")
                out.append(inflate.decompress(piece))
                pos += len(piece)
        except zlib.error:
            raise Damaged("member check") from None
        data, length = b"".join(out), pos - len(inflate.unused_data) - at
        head, at_block, n = parse_head(data)
        if len(data) <= at_block + n + len(END):
            if len(data) < at_block + n + len(END):
                raise Damaged("content length")
            return [check(Record(at, length, head, data[at_block : at_block + n]), data[-4:])]
        found = list(Salvager(lambda k, m: data[k : k + m], len(data), self.step, True))
        if not any(isinstance(x, Record) for x in found):
            raise Damaged(found[0].reason)
        for k, x in enumerate(found):
            x.offset, x.length = at, 0 if k else length
            if isinstance(x, Gap):
                x.reason += " inside a member"
        return found

    def _plain(self, at: int) -> Record:
        n = 1 << 14
        start = self._bytes(at, n)
        if not VERSION_LINE.match(start):
            raise Damaged("version line")
        while END not in start and len(start) == n:
            n *= 4
            start = self._bytes(at, n)
        head, at_block, length = parse_head(start)
        if at + at_block + length + len(END) > self.size:
            raise Damaged("content length")
        data = self._bytes(at + at_block, length + len(END))
        return check(Record(at, at_block + length + len(END), head, data[:length]), data[length:])

    def _next(self, at: int) -> int:
        """Where the next member that begins with a version line, or the next version line itself, is."""
        while at < self.size:
            piece = self.read_at(at, self.step + 16)
            for m in re.finditer(rb"\x1f\x8b\x08|WARC/[0-9]\.[0-9]{1,2}\r\n", piece):
                if m.start() >= self.step:
                    break
                if m[0] != MAGIC or not self.plain and self._opens(at + m.start()):
                    return at + m.start()
            at += self.step
        return self.size

    def _opens(self, at: int) -> bool:
        """Whether a gzip member that begins with a version line is here, however long its own header is."""
        inflate, out = zlib.decompressobj(31), b""
        try:
            while len(out) < 11 and not inflate.eof and (piece := self._bytes(at, 4096)):
                out += inflate.decompress(piece, 11 - len(out))
                at += len(piece)
        except zlib.error:
            return False
        return VERSION_LINE.match(out) is not None


def parse_head(data: bytes) -> tuple[dict[str, str], int, int]:
    """(headers by lower-case name, where the block begins, its length) of bytes that begin with a record."""
    if not VERSION_LINE.match(data):
        raise Damaged("version line")
    stop = data.find(END)
    if stop < 0:
        raise Damaged("headers")
    head = {}
    for line in data[:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("headers")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "surrogatepass")
    if not head.get("content-length", "").isascii() or not head.get("content-length", "").isdigit():
        raise Damaged("content length")
    return head, stop + len(END), int(head["content-length"])


def check(record: Record, end: bytes) -> Record:
    if end != END:
        raise Damaged("record end")
    for name, data in (("warc-block-digest", record.block), ("warc-payload-digest", None if record.headers.get("warc-type") == "revisit" else record.payload)):
        told = record.headers.get(name, "")
        if data is not None and told.startswith("sha1:") and told[5:] != digest(data):
            raise Damaged(name.removeprefix("warc-").replace("-", " "))
    return record


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _normal(path: str) -> str:
    return re.sub(r"^file:/(?=[^/])", "file:///", path)


def write_archives(pages: DataFrame, folder: str, least: int = 0, roll: int = 32 << 20) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html); returns the stored list of files: path, records, bytes."""
    raw = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    raw = raw.withColumn("key", F.sha1("payload"))
    last = stored(raw.groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")), "payloads")
    total = last.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a payload with a thousandth of all rows or more, of which there are a thousand at most, meets its rows by broadcast;
    # in the join of the others those rows have a key each
    hot = F.broadcast(last.where(F.col("n") * 1000 >= total).select("key", F.col("last").alias("hot_last"), F.lit(True).alias("hot")))
    rest = last.where(F.col("n") * 1000 < total).select(F.col("key").alias("own"), "last")
    raw = raw.join(hot, "key", "left").withColumn("own", F.when(F.col("hot"), F.concat(F.lit("hot"), F.monotonically_increasing_id())).otherwise(F.col("key")))
    raw = raw.join(rest, "own", "left").withColumn("last", F.coalesce("hot_last", "last"))
    told = F.when((F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    rows = raw.select("page_id", "url", "payload", told.alias("refers_to"))
    folder = _normal(folder)

    def write(batches):
        out = None
        system = None

        def close():
            out[0].close()
            return pa.RecordBatch.from_pydict({"path": [out[1]], "records": [out[2]], "bytes": [out[3]]})

        for batch in batches:
            if system is None:
                system, base = _file_system(folder)
                system.create_dir(base, recursive=True)
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4))):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = [system.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}", 0, 0]
                data = gzip.compress(build_record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()), 6, mtime=0)
                out[0].write(data)
                out[2] += 1
                out[3] += len(data)
                if out[3] >= roll:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return stored(rows.mapInArrow(write, "path string, records long, bytes long"), "archives")


RECORD = "path string, offset long, length long, reason string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(files: DataFrame, payload: bool = True) -> DataFrame:
    """Records and gaps of the archives in ``files`` (path string), columns :data:`RECORD`.

    A gap has a reason and no record columns. ``payload_bytes`` and ``payload_digest`` are of the full payload, for a
    revisit as its record tells them. ``payload`` is null for revisits, and for all if it isn't asked for.
    """
    n = max(1, files.count())
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(RECORD)

    def number(text: str | None) -> int | None:
        found = re.fullmatch(r"<urn:x-page:(-?\d+)>", text or "")
        return int(found[1]) if found else None

    def read(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _file_system(_normal(path))
                with system.open_input_file(name) as f:
                    rows, held, size = [], 0, f.size()
                    for x in Salvager(lambda at, k: f.read_at(min(k, max(0, size - at)), at), size):
                        if isinstance(x, Gap):
                            row = (path, x.offset, x.length, x.reason) + (None,) * 7
                        else:
                            h, revisit = x.headers, x.headers.get("warc-type") == "revisit"
                            told = re.search(rb"(?i)\r\nContent-Length: *(\d+)", x.block.partition(END)[0]) if revisit else None
                            data = x.payload if payload and not revisit else None
                            row = (path, x.offset, x.length, None, number(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"), number(h.get("warc-refers-to")), int(told[1]) if told else len(x.payload), h.get("warc-payload-digest", "").removeprefix("sha1:"), data)
                            held += len(data or b"")
                        rows.append(row)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    return files.select("path").repartition(min(n, 10_000)).mapInArrow(read, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as its record was read back.

    Raises an error that names the stored table of gaps unless as many records were read as were written.
    """
    files = write_archives(pages, new_folder(pages.sparkSession, "warc"), least)
    found = stored(read_archives(files, payload=False), "records")
    written = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    read, gaps, quarantined = found.agg(F.count_if(F.col("reason").isNull()), F.count("reason"), F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("length"))), F.lit(0))).first()
    if read != written or gaps:
        raise OSError(f"{written} records written, {read} read; {gaps} gaps of {quarantined} bytes, listed in {found.inputFiles()[:1]}")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
