"""WARC archives: a writer that stores equal payloads once, and a sequential reader.

Every record is one gzip member, so a reader can begin at any record. The
reader inflates a file piece by piece (never more than ``CHUNK`` bytes of
input at a time), frames each block by its Content-Length, checks that the record
ends where the member ends, and verifies block and payload digests.

Writing: payload digests are computed in the JVM; groups of equal payloads are found
by a grouped maximum over (digest, id), combined before the shuffle. Only
digests that occur twice or more are joined back to the pages (by broadcast
where Spark measures them small, else by a join it may split for a hot payload). Each task
writes its own archive files straight to the shared folder under a name of its own
attempt and reports them; only reported files are read, so what a lost or
repeated task left behind is never seen.

Defined results: a null html is an empty payload; a null url is a record without
target; payloads under ``LEAST_SHARED`` bytes are always responses; rows that
repeat id and payload of a group's response are responses too; a payload or url of any length is one
record. Only the id, url and html are read, so other columns may have any name. An empty
table gives no files and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.llm.common import fresh_path, saved

LEAST_SHARED = 1000
CHUNK = 1 << 18
FILE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


class WarcError(ValueError):
    """A record that is cut short, badly framed, or whose digest is wrong."""


# ---------------------------------------------------------------- records

def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def sha1_hex(label: str) -> str:
    return base64.b32decode(label.removeprefix("sha1:")).hex()


def http_head(n_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()


def build_record(page_id: int | None, url: str | None, payload: bytes, payload_digest: bytes, n_bytes: int,
                 refers_to: int | None = None, is_revisit: bool = False) -> bytes:
    """An uncompressed record; a revisit holds the HTTP head alone."""
    block = http_head(n_bytes) + (b"" if is_revisit else payload)
    label = sha1_label(payload_digest)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}",
             f"WARC-Record-ID: {record_id(page_id, label)}", f"WARC-Date: {DATE}"]
    if url is not None:
        # No line break or control sign may enter a header.
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if is_revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, label)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {label}",
              f"WARC-Block-Digest: {sha1_label(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def gzip_member(record: bytes, level: int = 3) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


# ---------------------------------------------------------------- reader

class _Member:
    """The inflated bytes of one gzip member, a bounded piece at a time."""

    def __init__(self, source: _Source):
        self.source, self.inflate, self.rest = source, zlib.decompressobj(31), b""

    def more(self) -> bytes:
        """The next piece; empty when the member has ended."""
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.source.take()
            try:
                out = self.inflate.decompress(data, CHUNK)
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            if not data and not out and not self.inflate.eof:
                raise WarcError("the file ends inside a record")
            if self.inflate.eof:
                self.source.back(self.inflate.unused_data)
            if out:
                return out
        return b""

    def until(self, mark: bytes) -> bytes:
        """Bytes before ``mark``, which is taken too; as many as the member has, since a url may be very long."""
        data, seen = bytearray(self.rest), 0
        while (at := data.find(mark, seen)) < 0:
            seen = max(0, len(data) - len(mark) + 1)
            piece = self.more()
            if not piece:
                raise WarcError("a header without an end")
            data += piece
        self.rest = bytes(data[at + len(mark):])
        return bytes(data[:at])

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.rest:
                self.rest = self.more()
                if not self.rest:
                    raise WarcError("the block is shorter than its Content-Length")
            piece, self.rest = self.rest[:n], self.rest[n:]
            n -= len(piece)
            yield piece


class _Source:
    def __init__(self, stream):
        self.stream, self.left = stream, b""

    def take(self) -> bytes:
        data, self.left = self.left, b""
        return data or self.stream.read(CHUNK)

    def back(self, data: bytes) -> None:
        self.left = data + self.left

    def ended(self) -> bool:
        if not self.left:
            self.left = self.stream.read(CHUNK)
        return not self.left


def _headers(data: bytes, first: str) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith(first):
        raise WarcError(f"not a {first} header")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError("a header line without a colon")
        out[name.strip().lower()] = value.strip()
    return out


def read_records(stream, keep_payload: bool = False) -> Iterator[dict]:
    """Records of a stream in order: headers, payload_bytes, payload_digest (hex), payload if kept.

    A response's digest is computed from its bytes and must equal the header's;
    a revisit, which holds no payload, gives the header's.
    """
    source = _Source(stream)
    while not source.ended():
        member = _Member(source)
        headers = _headers(member.until(END), "WARC/")
        try:
            left = int(headers["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("no Content-Length") from e
        whole, payload, kept, head, n_bytes = hashlib.sha1(), hashlib.sha1(), [], b"", 0
        http: dict[str, str] | None = None
        for piece in member.exactly(left):
            whole.update(piece)
            if http is None:
                head += piece
                if (at := head.find(END)) < 0:
                    continue
                http, piece = _headers(head[:at], "HTTP/"), head[at + len(END):]
            payload.update(piece)
            n_bytes += len(piece)
            if keep_payload:
                kept.append(piece)
        if b"".join(member.exactly(4)) != END or member.rest or member.more():
            raise WarcError("the record does not end with its block")
        if http is None:
            raise WarcError("a block without an HTTP header")
        if headers.get("warc-block-digest") != sha1_label(whole.digest()):
            raise WarcError("wrong block digest")
        record = {"headers": headers, "payload": b"".join(kept)}
        stated = headers.get("warc-payload-digest", "")
        if headers.get("warc-type") == "revisit":
            record |= {"payload_bytes": int(http["content-length"]), "payload_digest": sha1_hex(stated)}
        else:
            if stated != sha1_label(payload.digest()):
                raise WarcError("wrong payload digest")
            if n_bytes != int(http["content-length"]):
                raise WarcError("the payload's length differs from its HTTP header")
            record |= {"payload_bytes": n_bytes, "payload_digest": payload.hexdigest()}
        yield record


# ---------------------------------------------------------------- on Spark

def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Hadoop-style URI, as seen from any executor."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    for spark_name, name in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if uri.startswith(spark_name):
            uri = name + uri.removeprefix(spark_name)
    return fs.FileSystem.from_uri(uri)


def with_decisions(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, url, html, digest, n_bytes, is_revisit, refers_to) of every row."""
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        (F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")).alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html"))).withColumn("n_bytes", F.octet_length("html"))
    copied = rows.where(F.col("n_bytes") >= LEAST_SHARED).groupBy("digest").agg(
        F.max("id").alias("winner"), F.count("*").alias("n")).where("n > 1").select("digest", "winner", F.lit(True).alias("shared"))
    out = rows.join(copied, "digest", "left")
    revisit = F.coalesce(F.col("shared") & ~F.col("id").eqNullSafe(F.col("winner")), F.lit(False))
    return out.select("id", "url", "html", "digest", "n_bytes", revisit.alias("is_revisit"), F.when(revisit, F.col("winner")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", html_col: str = "html",
                   file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages as archives below ``folder``; returns the saved list of files (path, n_records, n_bytes)."""
    where, _ = folder, _open(folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _open(where)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        name, n_files = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", 0
        out, path, n_records, done = None, "", 0, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    path = f"{name}-{n_files:04d}.warc.gz"
                    out, n_records, n_files = system.open_output_stream(f"{base}/{path}", compression=None), 0, n_files + 1
                known = None if pd.isna(row.id) else int(row.id)
                refers = None if pd.isna(row.refers_to) else int(row.refers_to)
                out.write(gzip_member(build_record(known, row.url, row.html, row.digest, row.n_bytes, refers, row.is_revisit)))
                n_records += 1
                if out.tell() >= file_bytes:
                    done.append((f"{where}/{path}", n_records, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((f"{where}/{path}", n_records, out.tell()))
            out.close()
        yield pd.DataFrame(done, columns=["path", "n_records", "n_bytes"])
    files = with_decisions(pages, id_col, html_col).mapInPandas(write, "path string, n_records long, n_bytes long")
    return saved(files, "warc_files")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(files: DataFrame) -> DataFrame:
    """One row per record of the listed files, each file read in order by one task."""
    n = max(1, files.count())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, expected in zip(batch["path"], batch["n_records"], strict=True):
                system, name = _open(path)
                rows, n_seen = [], 0
                with system.open_input_stream(name, compression=None) as stream:
                    for r in read_records(stream):
                        h = r["headers"]
                        rows.append((int(h["x-page-id"]) if "x-page-id" in h else None, r["payload_bytes"], r["payload_digest"],
                                     h["warc-type"], int(h["x-refers-to-page-id"]) if "x-refers-to-page-id" in h else None))
                        n_seen += 1
                        if len(rows) == 5000:
                            yield _frame(rows)
                            rows = []
                if n_seen != expected:
                    raise WarcError(f"{path}: {n_seen} records, {expected} were written")
                if rows:
                    yield _frame(rows)
    return files.repartition(n).mapInPandas(read, READ)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to the shared folder, then read every record back."""
    return read_archives(write_archives(pages, fresh_path(pages.sparkSession, "warc")))
