"""WARC archives: writing, normalising whole-file gzip streams, and reading by offset.

An archive compressed as one gzip stream can only be read from its start. The normaliser inflates such a
stream once, writes every record as a gzip member of its own, and puts a sidecar index of offsets beside it;
any record is then one seek and one small inflate away, and archives can be read in parallel pieces.

Files are written whole by one task each, under a name of that attempt, and moved into place when complete;
the manifest of a stage lists those that count, so a task that runs twice does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import file_system

from . import common

#: A task goes on with another archive when one has so many bytes.
ROLL = 1 << 30
CHUNK, GZIP = 1 << 18, 31
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, sidecar string, records long, bytes long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


class _Sink:
    """A file that appears under its name only when complete."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.size = self.fs.open_output_stream(self.path + ".part", compression=None), 0

    def write(self, data: bytes) -> None:
        self.size += len(data)
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.path + ".part", self.path)


def _urn(name: str) -> str:
    h = hashlib.sha1(name.encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: an HTTP response with the payload, or a revisit with the response's headers alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(f'{page_id}:{digest}')}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(f'{refers_to}:{digest}')}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def parse(raw: bytes) -> dict:
    """The fields of one record that the readers return; a response's digest is that of its own payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = _headers(head)
    http, _, payload = rest[: int(h["content-length"])].partition(b"\r\n\r\n")
    number = lambda k: int(h[k]) if k in h else None
    if h["warc-type"] == "revisit":
        digest = base64.b32decode(h["warc-payload-digest"].rpartition(":")[2]).hex()
        size, payload = int(_headers(http)["content-length"]), None
    else:
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    return {"page_id": number("x-page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": number("x-refers-to-page-id"), "payload": payload}


class _Inflated:
    """The bytes of a gzip file, of one member or many, in bounded pieces."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.z, self.buffer = read, zlib.decompressobj(GZIP), bytearray()

    def more(self) -> bool:
        while True:
            if self.z.eof:
                data, self.z = self.z.unused_data, zlib.decompressobj(GZIP)
            else:
                data = self.z.unconsumed_tail
            data = data or self.read(CHUNK)
            if not data:
                return False
            out = self.z.decompress(data, CHUNK)
            if out:
                self.buffer += out
                return True

    def head(self) -> bytes | None:
        """Up to and with the empty line; None at the end."""
        at = -1
        while (at := self.buffer.find(b"\r\n\r\n", max(0, at))) < 0:
            at = len(self.buffer) - 3
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("the archive ends inside a record's header")
                return None
        return self.take(at + 4)

    def take(self, n: int) -> bytes:
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise ValueError("the archive ends inside a record")
            out = self.take(min(n, CHUNK))
            n -= len(out)
            yield out


def normalise_file(source: str, target: str, level: int = 4) -> tuple[str, int, int]:
    """Rewrites one archive; returns its sidecar, records and bytes. Memory holds a piece of a record at a time."""
    fs, path = file_system(source)
    sidecar, out = target + ".idx", _Sink(target)
    index = _Sink(sidecar)
    with fs.open_input_stream(path, compression=None) as stream:
        raw, n = _Inflated(lambda size: stream.read(size)), 0
        while (head := raw.head()) is not None:
            h, at = _headers(head[:-4]), out.size
            z = zlib.compressobj(level, zlib.DEFLATED, GZIP)
            out.write(z.compress(head))
            for piece in raw.pieces(int(h["content-length"]) + 4):
                out.write(z.compress(piece))
            out.write(z.flush())
            index.write(json.dumps({"offset": at, "length": out.size - at, "id": h.get("warc-record-id"), "type": h.get("warc-type"), "uri": h.get("warc-target-uri")}).encode() + b"\n")
            n += 1
    out.close()
    index.close()
    return sidecar, n, out.size


def write_monolithic(records: DataFrame, folder: str, level: int = 1, roll: int = ROLL) -> DataFrame:
    """Writes (page_id, url, payload, revisit, refers_to) as archives of one gzip stream each, of about ``roll`` bytes at most; returns the manifest.

    Rows that repeat are records of their own, null ids and URLs have no header, and an empty table gives no archive.
    """
    schema = common.arrow_type(MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, sink, n, k = TaskContext.get(), None, 0, 0

        def ended() -> pa.RecordBatch:
            sink.write(z.flush())
            sink.close()
            return common.to_batch({"archive": [uri], "sidecar": [None], "records": [n], "bytes": [sink.size]}, schema)

        for b in batches:
            for lo in range(0, b.num_rows, 64):
                for page_id, url, payload, revisit, refers in zip(*(c.to_pylist() for c in b.slice(lo, 64).columns)):
                    if sink is None:
                        uri = f"{folder}/part-{t.partitionId():05d}-{k:05d}-{t.taskAttemptId()}.warc.gz"
                        sink, z = _Sink(uri), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                    sink.write(z.compress(record(page_id, url, payload, refers, revisit)))
                    n += 1
                    if sink.size >= roll:
                        yield ended()
                        sink, n, k = None, 0, k + 1
        if sink is not None:
            yield ended()

    common.ship(records.sparkSession)
    return common.materialize(records.select("page_id", "url", "payload", "revisit", "refers_to").mapInArrow(run, MANIFEST), "manifest")


def normalise(manifest: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Normalises every archive of ``manifest`` into ``folder``, a task each; returns the new manifest."""
    schema = common.arrow_type(MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source in b.column(0).to_pylist():
                target = f"{folder}/{source.rpartition('/')[2].split('.')[0]}-{TaskContext.get().taskAttemptId()}.warc.gz"
                sidecar, n, size = normalise_file(source, target, level)
                yield common.to_batch({"archive": [target], "sidecar": [sidecar], "records": [n], "bytes": [size]}, schema)

    spread = manifest.repartition(max(1, manifest.count()))
    return common.materialize(spread.mapInArrow(run, MANIFEST), "manifest")


def index(manifest: DataFrame) -> DataFrame:
    """(archive, offset, length, id, type, uri): the sidecars' rows."""
    ddl = "archive string, offset long, length long, id string, type string, uri string"
    schema = common.arrow_type(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, sidecar in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = file_system(sidecar)
                with fs.open_input_stream(path, compression=None, buffer_size=CHUNK) as f:
                    rest = b""
                    while data := f.read(CHUNK):
                        *lines, rest = (rest + data).split(b"\n")
                        rows = [json.loads(x) for x in lines]
                        yield common.to_batch({"archive": [archive] * len(rows)} | {k: [r[k] for r in rows] for k in schema.names[1:]}, schema)

    return manifest.mapInArrow(run, ddl)


def read(entries: DataFrame, split_bytes: int = 16 << 20, with_payload: bool = False) -> DataFrame:
    """The records at the (archive, offset, length) of ``entries``, in pieces of about ``split_bytes`` per task."""
    ddl = RECORD + (", payload binary" if with_payload else "")
    schema = common.arrow_type(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                out: dict[str, list] = {x: [] for x in schema.names}
                for archive, offset, length in zip(*(c.to_pylist() for c in b.slice(lo, 64).columns[:3])):
                    if archive != name:
                        fs, path = file_system(archive)
                        name, f = archive, fs.open_input_file(path)
                    f.seek(offset)
                    row = parse(zlib.decompress(f.read(length), GZIP)) | {"archive": archive, "offset": offset}
                    for x in schema.names:
                        out[x].append(row[x])
                yield common.to_batch(out, schema)

    spark = entries.sparkSession
    piece = F.floor(F.col("offset") / split_bytes)
    spread = entries.select("archive", "offset", "length").repartition(common.shuffle_partitions(spark), "archive", piece).sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(run, ddl)


def revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``pages`` (page_id, url, payload) with revisit and refers_to.

    Of rows with equal payloads of at least ``least`` bytes those with the largest page_id are responses and the
    others refer to it; null ids are smaller than any, and rows that repeat the largest id, or a group of null ids
    alone, are all responses. The payloads cross the network once; the groups are found on digests, and hot
    groups are combined before their shuffle.
    """
    marked = pages.withColumn("digest", F.sha1("payload"))
    small = marked.where(F.octet_length("payload") >= least).select("page_id", "digest")
    first = small.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    again = small.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    again = again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").hint("shuffle_hash")
    on = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return marked.join(again, on, "left").select("page_id", "url", "payload", F.col("refers_to").isNotNull().alias("revisit"), "refers_to")


def op1_warc_normaliser(spark, sf_dir: str) -> DataFrame:
    """All pages written to monolithic archives, normalised, and read back through the offset index.

    A null html is an empty payload, rows that repeat are records of their own (``revisits`` says which refer to which), very long
    payloads pass in pieces, columns besides page_id, url and html are not read, and an empty table gives no rows.
    """
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    folders = [common.new_path(spark, name) for name in ("warc-monolithic", "warc")]
    whole = write_monolithic(revisits(pages), folders[0])
    for f in folders:
        common.make(spark, f)
    done = normalise(whole, folders[1])
    common.discard(spark, folders[0])  # the rewritten archives are complete and listed
    return read(index(done)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""
