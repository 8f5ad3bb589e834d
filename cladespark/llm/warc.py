"""WARC archives: written as one gzip stream, normalised to a member a record with an offset index, and read back."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, shared_folder, text_steps

#: Bytes of records that one archive holds, or a single larger record.
ARCHIVE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
_CHUNK = 1 << 18


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return "<urn:x-none:>" if page_id is None else f"<urn:x-page:{quote(str(page_id), safe='')}>"


def page_of(record: str | None) -> str | None:
    """The page id in a record id of ours, as text; null for others."""
    found = re.fullmatch(r"<urn:x-page:([^>]*)>", record or "")
    return unquote(found[1]) if found else None


def clean_uri(uri: str | None) -> str:
    """A header can hold no control characters or white space: such characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "") or "urn:x-none:"


def record(page_id, uri: str | None, payload: bytes, first: int | None) -> bytes:
    """A response record, or a revisit that refers to page ``first`` and keeps only the HTTP head."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if first is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean_uri(uri)}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(archive: str) -> bytes:
    """The warcinfo record that opens an archive and names it."""
    block = b"software: corpus archive writer\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:x-archive:{archive}>", f"WARC-Date: {DATE}", f"WARC-Filename: {archive}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Fields by lower-case name, the first line left out; a line that starts with white space goes on with the one before."""
    out, key = {}, None
    for x in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if x[:1] in (" ", "\t") and key:
            out[key] += " " + x.strip()
        elif ":" in x:
            key, _, v = x.partition(":")
            key = key.strip().lower()
            out[key] = v.strip()
    return out


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, whole, holding no more than one of them and a chunk. Blank lines before a record are
    skipped, and those after the last one may be missing."""
    held = bytearray()
    need = -1
    for chunk in stream:
        held += chunk
        while True:
            if need < 0:
                blank = len(held) - len(held.lstrip(b"\r\n"))
                end = held.find(b"\r\n\r\n", blank)
                if end < 0:
                    break
                del held[:blank]
                head = headers(bytes(held[: end - blank]))
                if not held.startswith(b"WARC/") or not head.get("content-length", "").isdigit():
                    raise ValueError("a record has no WARC head with a length")
                need = end - blank + 4 + int(head["content-length"])
            if len(held) < need + 4:
                break
            yield bytes(held[:need]) + b"\r\n\r\n"
            del held[:need]
            need = -1
    if need >= 0 and len(held) >= need:
        yield bytes(held[:need]) + b"\r\n\r\n"
    elif held.strip():
        raise ValueError("the archive ends within a record")


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """The HTTP fields of a block and its payload, with a chunked transfer put together; a block that is no HTTP message is
    its own payload."""
    cut = block.find(b"\r\n\r\n")
    if cut < 0 or not block.startswith(b"HTTP/"):
        return {}, block
    http, body = headers(block[:cut]), block[cut + 4 :]
    if http.get("transfer-encoding", "").lower() != "chunked":
        return http, body
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return http, body  # it says chunked, but is stored put together
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return http, b"".join(out)


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and contents of each gzip member; empty members are skipped."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z, fed, step, out = zlib.decompressobj(31), at, 1 << 13, []
        while not z.eof and fed < len(data):
            out.append(z.decompress(view[fed : fed + step]))
            fed += min(step, len(data) - fed)
            step = min(2 * step, _CHUNK)
        if not z.eof:
            raise ValueError("the archive ends within a member")
        end = fed - len(z.unused_data)
        if raw := b"".join(out):
            yield at, end - at, raw
        at = end


def inflate(data: bytes) -> Iterator[bytes]:
    """The contents of a gzip file of one or many members, in chunks; a file that is no gzip is its own contents."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[at : at + _CHUNK] for at in range(0, len(data), _CHUNK))
        return
    z = zlib.decompressobj(31)
    for at in range(0, len(data), _CHUNK):
        part = data[at : at + _CHUNK]
        while part:
            if out := z.decompress(part):
                yield out
            part = z.unused_data
            if z.eof and part:
                z = zlib.decompressobj(31)
            elif z.eof:
                z, part = zlib.decompressobj(31), b""
    if tail := z.flush():
        yield tail


def monolith(parts: Iterator[bytes]) -> bytes:
    """One gzip member around all records."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return b"".join([z.compress(p) for p in parts] + [z.flush()])


def normalise(data: bytes) -> tuple[bytes, list[dict]]:
    """Each record as a gzip member of its own, and the sidecar: offset, length, and the id, type and URI of each record. The
    input, of one member or many, is inflated once, as a stream that holds one record at a time; empty members go."""
    out, index, at = [], [], 0
    for r in records(inflate(data)):
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(r) + z.flush()
        head = headers(r[: r.find(b"\r\n\r\n")])
        out.append(member)
        index.append({"offset": at, "length": len(member), "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"), "uri": head.get("warc-target-uri")})
        at += len(member)
    return b"".join(out), index


def planned(pages: DataFrame, html: str, uri: str, id_col: str, least: int) -> DataFrame:
    """``(page_id, uri, html, first)``: ``first`` is the page that a revisit refers to, null for responses.

    Digests are compared in narrow rows: the smallest page of a digest is a partial aggregate, so one payload that a
    third of all pages share is no burden, and the payloads themselves move once, by page.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(uri).cast("string").alias("uri"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    narrow = base.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("bytes")).filter((F.col("bytes") >= least) & F.col("page_id").isNotNull())
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    revisits = narrow.join(first, "digest").filter("page_id <> first").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first").distinct()
    return base.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).join(revisits, (F.col("digest") == F.col("d")) & (F.col("page_id") == F.col("p")), "left").select("page_id", "uri", "html", "first")


INDEX = "array<struct<offset:bigint,length:bigint,record_id:string,record_type:string,uri:string>>"
ARCHIVE = f"archive string, content binary, index {INDEX}"
ARCHIVE_NAMES = ["archive", "content", "index"]
_INDEX_KIND = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string())]))


def _archive_row(name: str, content: bytes, index: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), pa.array([index], _INDEX_KIND)], names=ARCHIVE_NAMES)


def write(pages: DataFrame, html: str = "html", uri: str = "url", id_col: str = "page_id", least: int = 0, normal: bool = True) -> DataFrame:
    """Archives ``(archive, content, index)``, each at most ARCHIVE_BYTES of records or one larger record, after a warcinfo
    record with the archive's name.

    Each is first written as a single gzip stream. With ``normal`` that stream is inflated once, every record becomes
    its own member, and ``index`` is the sidecar with each record's place; otherwise it is empty. ``content`` is a complete
    .warc.gz file, which ``write_files`` puts into a store. Null html is empty; equal payloads of at least ``least`` bytes
    are one response, that of the smallest page id, and revisits; pages without an id are responses; rows that repeat the
    id and payload of the response are responses as well; an empty table gives no archives; ids may be of any type.
    """
    bound_batches(pages.sparkSession)
    source = planned(pages, html, uri, id_col, least)

    def close(held: list[bytes], number: int) -> pa.RecordBatch:
        name = f"part-{TaskContext.get().partitionId():06d}-{number:05d}.warc.gz"
        data, index = monolith(iter([info(name), *held])), []
        if normal:
            data, index = normalise(data)
        return _archive_row(name, data, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        for batch in batches:
            for step in text_steps(batch, "html"):
                for row in step.to_pylist():
                    r = record(row["page_id"], row["uri"], row["html"].encode(), row["first"])
                    if held and size + len(r) > ARCHIVE_BYTES:
                        yield close(held, number)
                        held, size, number = [], 0, number + 1
                    held.append(r)
                    size += len(r)
        if held:
            yield close(held, number)

    return source.mapInArrow(run, ARCHIVE)


#: A gzip member without contents. Spark's text writer ends each row with it, which keeps a gzip file a gzip file.
NOTHING = zlib.compressobj(LEVEL, zlib.DEFLATED, 31).flush()
#: Archives that a task keeps open while it writes; beyond that Spark sorts the rest by archive.
OPEN_FILES = 256


def write_files(archives: DataFrame, path: str) -> None:
    """Each archive as ``<archive>`` (.warc.gz) and its sidecar as ``<archive>.cdx.gz`` in a new folder of any store that Spark
    writes to.

    Tasks write the bytes through Spark's own writer and committer, so a lost executor leaves no half files; only names pass
    through the driver, which moves each file out of the folder of its partition. A sidecar is a gzip text of a line for
    each record: offset, length, record id, type and URI, parted by tabs, - for none. Archives of one name are an error.
    """
    spark = archives.sparkSession
    line = lambda x: F.concat_ws("\t", x["offset"].cast("string"), x["length"].cast("string"), *[F.coalesce(x[k], F.lit("-")) for k in ("record_id", "record_type", "uri")])
    text = F.concat(F.array_join(F.transform("index", line), "\n"), F.lit("\n"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, side in zip(*(batch.column(k) for k in ("archive", "content", "side")), strict=True):
                packed = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                side = packed.compress(side.as_py().encode()) + packed.flush()
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * 2), pa.array(["warc", "cdx"]), pa.array([content.as_py(), side], pa.binary())], names=["archive", "kind", "content"])

    parts = archives.select("archive", "content", text.alias("side")).mapInArrow(squeeze, "archive string, kind string, content binary")
    key, before = "spark.sql.maxConcurrentOutputFileWriters", spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    spark.conf.set(key, str(OPEN_FILES))
    try:
        parts.select("archive", "kind", F.col("content").cast("string").alias("value")).write.mode("errorifexists").partitionBy("archive", "kind").option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).text(path)
    finally:
        spark.conf.set(key, before)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path
    root = where(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(root):
        name = folder.getPath().getName().removeprefix("archive=")
        if not folder.isDirectory() or name == folder.getPath().getName():
            continue
        for kind, suffix in (("warc", ""), ("cdx", ".cdx.gz")):
            files = fs.listStatus(where(folder.getPath(), f"kind={kind}"))
            if len(files) != 1:
                raise ValueError(f"{len(files)} archives have the name {name}")
            fs.rename(files[0].getPath(), where(root, name + suffix))
        fs.delete(folder.getPath(), True)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(archive, content)`` of the files of a folder whose names fit the pattern. A file is one value of its task, so it
    has at most 2 GB, and tasks must have room for it."""
    bound_batches(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, content)`` of the .warc.gz files of a folder."""
    return _files(spark, path, "*.warc.gz")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, offset, length, record_id, record_type, uri)`` of the sidecars of a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [x.split("\t") for x in b"".join(inflate(content)).decode().split("\n") if x]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                text = [[None if x == "-" else x for x in c] for c in cols[2:]]
                yield pa.RecordBatch.from_arrays([pa.array([name.removesuffix(".cdx.gz")] * len(rows), pa.string()), *[pa.array([int(x) for x in c], pa.int64()) for c in cols[:2]], *[pa.array(c, pa.string()) for c in text]], names=["archive", "offset", "length", "record_id", "record_type", "uri"])

    return _files(spark, path, "*.cdx.gz").mapInArrow(run, "archive string, offset long, length long, record_id string, record_type string, uri string")


def normalised(files: DataFrame) -> DataFrame:
    """Archives ``(archive, content, index)`` from ``(archive, content)`` of any .warc.gz or .warc files: every record, whatever
    its type and writer, as its own member. A file that ends within a record is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("archive"), batch.column("content"), strict=True):
                yield _archive_row(name.as_py(), *normalise(content.as_py()))

    return files.select("archive", "content").mapInArrow(run, ARCHIVE)


RECORD = "archive string, offset long, length long, record_id string, record_type string, uri string, date string, payload_bytes long, payload_digest string, refers_to string, intact boolean"
_RECORD_KINDS = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.string(), pa.bool_()]


def parsed(raw: bytes) -> tuple:
    """What ``read`` says of one record, from its id on."""
    end = raw.find(b"\r\n\r\n")
    head = headers(raw[:end])
    http, payload = payload_of(raw[end + 4 : end + 4 + int(head["content-length"])])
    kind, known = head.get("warc-type"), head.get("warc-payload-digest", "")
    given = known.removeprefix("sha1:").upper() if known.lower().startswith("sha1:") else None
    if kind == "revisit":  # its payload is elsewhere; size and digest are what its headers say
        size = http.get("content-length", "")
        n, sha, intact = int(size) if size.isdigit() else None, given, None
    else:
        n, sha = len(payload), digest(payload)
        intact = None if given is None else given == sha
    return head.get("warc-record-id"), kind, head.get("warc-target-uri"), head.get("warc-date"), n, sha, head.get("warc-refers-to"), intact


def read(archives: DataFrame) -> DataFrame:
    """A row (RECORD) for every record of normalised archives ``(archive, content)``: where its member is, its id, type, URI
    and date, the bytes and digest of its full payload, and what a revisit refers to.

    Digests are worked out from payloads, and ``intact`` says whether a record's own header agrees (null without such a
    header). A revisit has no payload of its own: its size and digest are those that its headers give, which are the
    response's, or null. Members that are empty are skipped.
    """
    bound_batches(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column("archive"), batch.column("content"), strict=True):
                got = [(name.as_py(), at, n, *parsed(raw)) for at, n, raw in members(content.as_py())]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), _RECORD_KINDS, strict=True)], names=names)

    return archives.select("archive", "content").mapInArrow(run, RECORD)


def pages_of(rows: DataFrame, kind: str = "bigint") -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of the pages among read records; one whose payload
    does not have its digest is an error."""
    def id_in(c: str):
        text = F.regexp_extract(c, r"^<urn:x-page:([^>]*)>$", 1)
        return F.when(F.col(c).startswith("<urn:x-page:"), F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))).cast(kind)

    checked = F.when(F.coalesce("intact", F.lit(True)), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload without its digest: "), "record_id")))
    return rows.filter(F.col("record_type").isin("response", "revisit")).select(id_in("record_id").alias("page_id"), "payload_bytes", checked.alias("payload_digest"), "record_type", id_in("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write the archives of ``pages`` and their sidecars as files, and read all records back from the files that the index
    names. ``path`` is a new folder, by default one beside the checkpoints in the cluster's shared folder."""
    spark = pages.sparkSession
    path = path or shared_folder(spark, "warc")
    write_files(write(pages, **how), path)
    found = read(read_files(spark, path))
    listed = read_index(spark, path).select("archive", "offset", "length")
    return pages_of(found.join(listed, ["archive", "offset", "length"]), pages.schema[how.get("id_col", "page_id")].dataType.simpleString())
