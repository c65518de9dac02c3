"""WARC archives: one gzip member a record, written and read in parallel, one archive a task.

The reader is sequential: it inflates a member as its bytes come, frames the block by Content-Length, and verifies the
block's digest and, where the payload is there, the payload's.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
#: Parts that the keys of a digest are dealt over, and bytes after which a task begins another archive.
SALTS = 16
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 16


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_folder(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder)


def make_record(key: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A gzip member with a response, or with a revisit that names the response's record."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if key is None else quote(key, safe='')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~")),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        *([] if refers_to is None else [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{quote(refers_to, safe='')}>")]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


class _Member:
    """Inflated bytes of one gzip member, as they are asked for."""

    def __init__(self, stream, left: bytes):
        self.stream, self.raw, self.plain, self.inflater = stream, left, bytearray(), zlib.decompressobj(31)

    def more(self) -> bool:
        """Inflate some more; False at the member's end."""
        while not self.inflater.eof:
            data = self.inflater.unconsumed_tail or self.raw or self.stream.read(CHUNK)
            self.raw = b""
            got = self.inflater.decompress(data, CHUNK)
            if not data and not got and not self.inflater.eof:
                raise ValueError("the archive ends inside a member")
            if got:
                self.plain += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.plain.find(mark, start)) < 0:
            start = max(0, len(self.plain) - len(mark) + 1)
            if not self.more():
                raise ValueError("a header does not end")
        out = bytes(self.plain[: at + len(mark)])
        del self.plain[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.plain and not self.more():
                raise ValueError("a block is shorter than its Content-Length")
            out = bytes(self.plain[:n])
            del self.plain[: len(out)]
            n -= len(out)
            yield out

    def end(self) -> bytes:
        """Check what closes a record; the bytes of the next member that were read already."""
        while self.more():
            pass
        if bytes(self.plain) != b"\r\n\r\n":
            raise ValueError("a record does not end after its Content-Length")
        return self.inflater.unused_data


def read_records(stream, keep_payload: bool = False) -> Iterator[dict]:
    """Records of a stream of gzip members, one after the other; a digest or framing that fails raises ValueError."""
    left = b""
    while left or (left := stream.read(CHUNK)):
        member = _Member(stream, left)
        lines = member.until(b"\r\n\r\n").decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        block, payload, head, size, kept = hashlib.sha1(), hashlib.sha1(), b"", 0, []
        in_head = True
        for part in member.take(int(fields["content-length"])):
            block.update(part)
            if in_head:
                head += part
                if (at := head.find(b"\r\n\r\n")) < 0:
                    continue
                in_head, part, head = False, head[at + 4 :], head[: at + 4]
            payload.update(part)
            size += len(part)
            if keep_payload:
                kept.append(part)
        left = member.end()
        if f"sha1:{base64.b32encode(block.digest()).decode()}" != fields["warc-block-digest"]:
            raise ValueError(f"block digest of {fields['warc-record-id']}")
        if fields["warc-type"] == "response" and f"sha1:{base64.b32encode(payload.digest()).decode()}" != fields["warc-payload-digest"]:
            raise ValueError(f"payload digest of {fields['warc-record-id']}")
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:] if x)}
        full = int(http["content-length"])
        if fields["warc-type"] == "response" and full != size:
            raise ValueError(f"payload length of {fields['warc-record-id']}")
        yield {"fields": fields, "payload_bytes": full, "payload": b"".join(kept) if keep_payload else None}


def _page(urn: str | None) -> str | None:
    return unquote(urn[len("<urn:page:") : -1]) or None if urn else None


def mark_revisits(pages: DataFrame, key: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """``pages`` with refers_to: the largest key among rows of an equal payload, where that is another row's.

    Heads of groups are found with a map-side maximum on a digest, so a large group of copies costs a row a task. Only
    keys and digests meet them, dealt over SALTS parts a digest; payloads are joined by their row's own key, so an error
    page that a million rows share is spread like any other.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    marked = pages.withColumns({"__size": F.octet_length(body), "__digest": F.concat_ws(":", F.sha1(body), F.octet_length(body).cast("string"))})
    heads = marked.where(F.col("__size") >= least_bytes).groupBy("__digest").agg(F.max(key).alias("__head"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    other = F.col("__head").isNotNull() & ~F.col(key).eqNullSafe(F.col("__head"))
    light = marked.select(key, "__digest").distinct().withColumn("__salt", F.pmod(F.xxhash64(F.col(key)), F.lit(SALTS)))
    heads = heads.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    refers = light.join(heads, ["__digest", "__salt"]).where(other).select(F.col(key).alias("__key"), F.col("__digest").alias("__of"), F.col("__head").alias("refers_to"))
    mine = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__digest") == F.col("__of"))
    return marked.join(refers, mine, "left").drop("__digest", "__size", "__key", "__of")


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", url: str = "url", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record a row and return the archives (path, records), read back from a written table.

    A task writes files named by its attempt; only files of attempts that succeeded are in the returned table, so a
    lost executor or a second attempt leaves no double record. The payload is the text in UTF-8, null: empty. Of rows
    with an equal payload of at least ``least_bytes`` the one with the largest key is a response (all rows of that key,
    if it repeats), the others are revisits; a null key is never referred to unless all keys of the payload are null,
    and then all those rows are responses. An empty table writes no archive.
    """
    rows = mark_revisits(pages.select(key, url, payload), key, payload, least_bytes)
    rows = rows.select(F.col(key).cast("string"), url, payload, F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        out, path, size, n, done = None, "", 0, 0, []
        for batch in batches:
            for k, u, text, head in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, n = store.open_output_stream(f"{root}/{path}", compression=None), 0, 0
                record = make_record(k, u, (text or "").encode("utf-8", "surrogatepass"), head)
                out.write(record)
                size += len(record)
                n += 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p}" for p, _ in done]), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    return common.settle(rows.mapInArrow(run, "path string, records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the archives in column path: record_key, payload_bytes, payload_digest, record_type, refers_key.

    Each archive is read by one task, front to back; a record that fails its framing or digest fails the read.
    """
    spread = max(1, min(20_000, archives.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                folder, _, name = path.rpartition("/")
                store, root = open_folder(folder)
                rows: list[tuple] = []
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for r in read_records(stream):
                        f = r["fields"]
                        rows.append((_page(f["warc-record-id"]), r["payload_bytes"], f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"], _page(f.get("warc-refers-to"))))
                        if len(rows) == 10_000:
                            yield _records(rows)
                            rows = []
                if rows:
                    yield _records(rows)

    return archives.select("path").repartition(spread).mapInArrow(run, "record_key string, payload_bytes long, payload_digest string, record_type string, refers_key string")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["record_key", "payload_bytes", "payload_digest", "record_type", "refers_key"])


def round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """Write all pages to archives in the shared folder and read them back; one row a page."""
    kind = pages.schema[key].dataType
    archives = write_archives(pages, common.new_folder(pages.sparkSession, "warc"), key, payload, url)
    return read_archives(archives).select(
        F.col("record_key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_key").cast(kind).alias("refers_to")
    )
