"""A Python data source for WARC archives, and pages as archives of responses and revisits.

Reading plans partitions of whole files up to `partitionBytes`, takes over equality and IN
filters on the record type and on header columns, reads a record's headers first, and leaves its
payload undecoded where a filter refuses it. Each record is a gzip member of its own that
carries its compressed length, so that the reader skips a refused one without inflating it;
archives without such lengths are read too, as are members of several records and files without
compression. With option `payload` false no payload is decoded. What can't be read ends the job, or
with option `errors` as `rows` is a row with the reason in `error`.

Writing gives each task files of about `fileBytes`, under temporary names; the driver's commit
renames the files of the attempts that counted, so tasks that run twice leave nothing.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import materialize, shared_dir

COLUMNS = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, content_length long, error string, payload binary"
#: Header names of the columns. Fixed values of the format.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _open(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def member(data: bytes) -> bytes:
    """A gzip member with its compressed and its plain length in an extra field `SL`."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"SL" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """A record of the given columns; a header's line breaks become spaces. Records without a
    payload (revisits) have an HTTP head alone as their block."""
    payload = row["payload"]
    block = _HTTP.format(len(payload) if payload is not None else 0).encode() + bytes(payload or b"")
    lines = ["WARC/1.1"]
    for column, name in HEADERS.items():
        if row[column] is not None:
            lines.append(f"{name}: {' '.join(str(row[column]).split())}")
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return member("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def _head(data: bytes) -> tuple[dict[str, str], int] | None:
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def _row(head: dict[str, str], block: bytes | None) -> tuple:
    payload = None
    if block is not None and head.get("warc-type") != "revisit":
        http = head.get("content-type", "").startswith("application/http")
        payload = block[block.find(b"\r\n\r\n") + 4 :] if http else block
    values = {column: head.get(name.lower()) for column, name in HEADERS.items()}
    return (*values.values(), int(head.get("content-length") or 0), None, payload)


class Damaged(ValueError):
    """A part of an archive that can't be read as records."""


class _Plain:
    """The bytes of a stream that isn't compressed."""

    def __init__(self, stream):
        self.stream, self.data = stream, b""

    def more(self) -> bool:
        piece = self.stream.read(1 << 16)
        self.data += piece
        return bool(piece)

    def skip(self, n: int) -> None:
        self.stream.seek(n - 1, 1)
        if not self.stream.read(1):
            raise Damaged("truncated record")

    def ended(self) -> bool:
        self.data = b""
        return not self.more()

    def close(self) -> None:
        pass


class _Member:
    """The inflated bytes of a gzip member, and its lengths where a field `SL` states them."""

    def __init__(self, stream):
        self.stream, self.begin = stream, stream.tell()
        first = stream.read(10)
        if len(first) < 10 or first[:3] != b"\x1f\x8b\x08":
            raise Damaged("no gzip member")
        self.packed = self.plain = None
        if first[3] & 4:
            size = stream.read(2)
            extra = stream.read(struct.unpack("<H", size)[0]) if len(size) == 2 else b""
            first, at = first + size + extra, 0
            while at + 4 <= len(extra):
                n = struct.unpack("<H", extra[at + 2 : at + 4])[0]
                if extra[at : at + 2] == b"SL" and n == 8:
                    self.packed, self.plain = struct.unpack("<II", extra[at + 4 : at + 12])
                at += 4 + n
        self.inflate, self.data, self.out = zlib.decompressobj(31), b"", 0
        self._feed(first)

    def _feed(self, piece: bytes) -> None:
        try:
            got = self.inflate.decompress(piece)
        except zlib.error as e:
            raise Damaged(f"damaged gzip member: {e}") from None
        self.data += got
        self.out += len(got)

    def more(self, n: int = 4096) -> bool:
        if self.inflate.eof:
            return False
        piece = self.stream.read(n)
        if not piece:
            raise Damaged("truncated gzip member")
        self._feed(piece)
        return True

    def skip(self, n: int) -> None:
        """Leaves out the next bytes; at once, if they are the rest of the member."""
        if self.packed and self.out + n + 4 == self.plain and not self.inflate.eof:
            self.stream.seek(self.begin + self.packed - 1, 0)
            self.inflate = None
            if not self.stream.read(1):
                raise Damaged("truncated gzip member")
            return
        while n:
            if not self.data and not self.more(1 << 16):
                raise Damaged("truncated record")
            n, self.data = n - min(n, len(self.data)), self.data[n:]

    def ended(self) -> bool:
        self.data = b""
        return self.inflate is None or not self.more()

    def close(self) -> None:
        if self.inflate is not None and self.inflate.unused_data:
            self.stream.seek(-len(self.inflate.unused_data), 1)


#: The longest head of a record.
LONGEST_HEAD = 1 << 20


def _in(source, wanted, payloads: bool) -> Iterator[tuple]:
    """The records of a source, one after the other."""
    while True:
        while not (at_record := source.data.lstrip(b"\r\n")) and not source.ended():
            pass
        if not at_record:
            return
        source.data = at_record
        while (found := _head(source.data)) is None and len(source.data) < LONGEST_HEAD and source.more():
            source.data = source.data.lstrip(b"\r\n")
        if found is None:
            if not source.data.strip():
                return
            raise Damaged("no head of a record")
        if not source.data.startswith(b"WARC/"):
            raise Damaged("no record")
        head, start = found
        source.data = source.data[start:]
        if not head.get("content-length", "").isdigit():
            raise Damaged("a record without its length")
        length = int(head["content-length"])
        keep = wanted(head)
        if keep and payloads:
            parts, have = [source.data], len(source.data)
            while have < length:
                source.data = b""
                if not source.more():
                    raise Damaged("truncated record")
                parts.append(source.data)
                have += len(source.data)
            block = b"".join(parts)
            block, source.data = block[:length], block[length:]
        else:
            block, rest = None, length - len(source.data)
            source.data = source.data[length:]
            if rest > 0:
                source.skip(rest)
        if keep:
            yield _row(head, block)
        if getattr(source, "inflate", source) is None:
            return


def _next_member(stream, at: int) -> bool:
    """Moves to the first place from `at` on where a gzip member may begin."""
    stream.seek(at, 0)
    held = b""
    while piece := stream.read(1 << 16):
        held += piece
        found = held.find(b"\x1f\x8b\x08")
        if found >= 0:
            stream.seek(found - len(held), 1)
            return True
        held = held[-2:]
    return False


def records(stream, wanted, payloads: bool, errors: str = "raise") -> Iterator[tuple]:
    """Rows of a stream of gzip members, each of one record or more, or of records without
    compression. `wanted(head)` decides before a payload is decoded.

    What can't be read raises `Damaged`; with `errors` as "rows" it gives one row with its reason in
    `error`, whatever is wanted, and reading goes on at the next gzip member.
    """
    start = stream.tell()
    plain = stream.read(5) == b"WARC/"
    stream.seek(start, 0)
    if plain:
        try:
            yield from _in(_Plain(stream), wanted, payloads)
        except Damaged as e:
            if errors != "rows":
                raise
            yield (*[None] * 7, str(e), None)
        return
    lost = False
    while stream.read(1):
        stream.seek(-1, 1)
        begin = stream.tell()
        try:
            member = _Member(stream)
            for row in _in(member, wanted, payloads):
                lost = False
                yield row
            member.close()
            lost = False
        except Damaged as e:
            if errors != "rows":
                raise
            if not lost:  # a false start on the way to the next member is no further loss
                yield (*[None] * 7, f"{e} at byte {begin}", None)
            lost = True
            if not _next_member(stream, begin + 1):
                return


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payloads = options["path"], str(options.get("payload", "true")).lower() != "false"
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))
        self.errors = str(options.get("errors", "raise")).lower()
        self.tests: list[tuple[str, set]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in HEADERS:
                self.tests.append((HEADERS[name].lower(), {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, path = _open(self.path)
        one = system.get_file_info(path)
        inside = [one] if one.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = [f for f in inside if f.is_file and f.path.endswith((".warc.gz", ".warc"))]
        out, size = [Files([])], 0
        for f in sorted(files, key=lambda f: f.path):
            if out[-1].paths and size + f.size > self.most:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        wanted = lambda head: all(head.get(name) in values for name, values in self.tests)
        system, _ = _open(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as f:
                yield from records(_Buffered(f), wanted, self.payloads, self.errors)


class _Buffered:
    """Reads ahead in blocks, and goes back or skips by moving within a block where it can."""

    def __init__(self, f, block: int = 1 << 20):
        self.f, self.block, self.data, self.at = f, block, b"", 0

    def read(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            self.data = self.data[self.at :] + self.f.read(max(n, self.block))
            self.at = 0
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        return out

    def tell(self) -> int:
        return self.f.tell() + self.at - len(self.data)

    def seek(self, n: int, whence: int) -> None:
        n = n if whence else n - self.tell()
        if 0 <= self.at + n <= len(self.data):
            self.at += n
        else:
            self.f.seek(self.tell() + n)
            self.data, self.at = b"", 0


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("filebytes", options.get("fileBytes", 64 << 20)))
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        paths: list[str] = []
        out, size = None, 0
        for row in iterator:
            if out is None or size >= self.most:
                if out:
                    out.close()
                paths.append(f"{path}/.{self.job}-{context.partitionId():06d}-{len(paths):04d}-{context.taskAttemptId()}.tmp")
                out, size = system.open_output_stream(paths[-1]), 0
            data = record(row.asDict())
            out.write(data)
            size += len(data)
        if out:
            out.close()
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _open(self.path)
        for name in (p for m in messages if m for p in m.paths):
            job, part, k, _ = name.rpartition("/")[2].removeprefix(".").split("-")
            system.move(name, f"{path}/part-{part}-{k}-{job}.warc.gz")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _open(self.path)
        for name in (p for m in messages if m for p in m.paths):
            system.delete_file(name)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes format `warc` known, with filters given to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


SHORTEST = 100
_ID = "urn:page:"


def archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for each row of `pages` (page_id, url, html; other columns are ignored).

    Null html is an empty payload; a null url gives no target. Of equal payloads of `SHORTEST`
    bytes or more, the row with the smallest page_id is the response (rows that repeat that id
    too), others revisit it. A null page_id comes after all others: such a row revisits where a
    named one has its payload, else it is a response.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = rows.filter(F.octet_length("payload") >= SHORTEST)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("many")).filter("many > 1").drop("many")
    # A table of its own, so that Spark may split a payload of very many pages when it joins them.
    placed = rows.join(materialize(firsts, "firsts"), "digest", "left")
    revisits = F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    placed.select(
        F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")).alias("record_id"),
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(revisits, F.concat(F.lit(f"<{_ID}"), F.col("first_id").cast("string"), F.lit(">"))).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("content_length"),
        F.when(~revisits, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def _page(column: str):
    """The page id of a record id, null where it has none."""
    return F.expr(f"try_cast(nullif(regexp_extract({column}, '{_ID}(-?[0-9]*)>', 1), '') AS long)")


def records_of(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record; a revisit's
    payload is the one of the response it refers to."""
    stored = spark.read.format("warc")
    found = stored.load(path).filter("record_type = 'response'")
    responses = found.select(_page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    known = responses.filter("page_id IS NOT NULL").groupBy("page_id", "payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    again = stored.option("payload", "false").load(path).filter("record_type = 'revisit'")
    again = again.select(_page("record_id").alias("page_id"), _page("refers_to").alias("refers_to"), F.expr("substring(payload_digest, 8)").alias("payload_digest"))
    known = known.withColumnRenamed("page_id", "refers_to")
    revisits = again.join(known, ["refers_to", "payload_digest"]).select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return responses.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    register(spark)
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return records_of(spark, path)


OP7_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
