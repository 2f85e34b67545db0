"""WARC archives as a table of chunks, written and read without a whole record in one row.

Writing: a payload longer than a chunk becomes segments, as the format provides: a first record with
WARC-Segment-Number 1 and continuation records that name it, the last with the total length. Each
segment is one row, so no row holds more than a chunk and its headers. Records of equal payloads of
at least `least_bytes` bytes are written once, for the largest page_id; the others are revisit records
that refer to it. Files are gzip members written by Spark's text sink to any storage it knows.

Reading: every file is streamed line by line through a parser that keeps an unfinished header or the
bytes that its record still lacks. It returns rows (record_id, chunk number, payload bytes and SHA-1
so far, last or not, data), the digest carried on from chunk to chunk, so that nothing is joined or
held back to learn a payload's length and digest.

Defined cases: a null html is an empty payload; a null url is a record without target; a null page_id
is a record without id and comes back as null, and loses against any other id; rows that share the
largest page_id of their payload are responses all of them; repeated rows are records of their own.
Line ends inside urls are percent-encoded. Other columns are ignored; an empty table gives no records.
"""

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

from flowspark.llm.keys import columns_of
from flowspark.llm.words import slices
from flowspark.session import forget_at_exit, work_dir

CHUNK = 1 << 16
LEAST_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_HELD = 1 << 20


def _planned(pages, least_bytes):
    """Pages with their payload, its digest and length, and the page a revisit refers to."""
    html = F.coalesce("html", F.lit(""))
    rows = columns_of(pages, "page_id", "url", "html").select(
        "page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"),
        F.octet_length(html).cast("long").alias("n_bytes"))
    large = rows.where(F.col("n_bytes") >= least_bytes)
    first = large.groupBy(F.col("digest").alias("of"), F.col("n_bytes").alias("size")).agg(
        F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").drop("n")
    joined = rows.join(first, (F.col("digest") == F.col("of")) & (F.col("n_bytes") == F.col("size")), "left")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to"))
    return joined.select("page_id", "url", "html", "digest", "n_bytes", other.alias("refers_to"))


def _record_id(page_id, digest, *more):
    name = hashlib.md5("/".join(map(str, (page_id, digest, *more))).encode()).hexdigest()
    return f"<urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>"


def _base32(digest):
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _header(*fields):
    return "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"


def _safe(url):
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _segments(page_id, url, html, digest, n_bytes, refers_to, chunk):
    """The records of a page as texts, each without its last line feed."""
    first = _record_id(page_id, digest)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", _safe(url)), ("X-Page-Id", page_id),
              ("WARC-Payload-Digest", _base32(digest)), ("X-Payload-Length", n_bytes)]
    if refers_to is not None:
        yield _header(("WARC-Type", "revisit"), ("WARC-Record-ID", first), *common,
                      ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                      ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page", refers_to),
                      ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(_HTTP))) + _HTTP + "\r\n\r"
        return
    parts = max(1, -(-len(html) // chunk))
    for k in range(parts):
        piece = html[k * chunk:(k + 1) * chunk]
        block = (_HTTP if k == 0 else "") + piece
        length = len(_HTTP) * (k == 0) + len(piece.encode())
        segment = [("WARC-Segment-Number", k + 1)] if parts > 1 else []
        if k:
            segment += [("WARC-Segment-Origin-ID", first)]
            if k == parts - 1:
                segment += [("WARC-Segment-Total-Length", len(_HTTP) + n_bytes)]
        named = [("WARC-Type", "continuation" if k else "response"),
                 ("WARC-Record-ID", _record_id(page_id, digest, k) if k else first), *(common if not k else common[:3])]
        yield _header(*named, *segment, ("X-Segments", parts), ("Content-Type", "application/http; msgtype=response"),
                      ("Content-Length", length)) + block + "\r\n\r"


def write_warc(pages, path, chunk=CHUNK, least_bytes=LEAST_BYTES):
    """Write one record or more per row of pages to gzip files in a folder."""

    def records(batches):
        for batch in slices(batches, 64):
            held, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for record in _segments(*row, chunk):
                    held.append(record)
                    size += len(record)
                    if size >= _HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                        held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    rows = _planned(pages, least_bytes).mapInArrow(records, "value string")
    rows.write.option("lineSep", "\n").option("compression", "gzip").text(path)


class _Reader:
    """The state of one file's stream."""

    def __init__(self, rows, with_data):
        self.left, self.rows, self.with_data = b"", rows, with_data
        self.fields, self.missing, self.skip = None, 0, 0
        self.sha, self.size, self.chunk, self.segments = None, 0, 0, 1
        self.origin, self.open = None, False

    def unfinished(self):
        """Whether the stream stands inside a record, or before a segment that its record still needs."""
        return bool(self.left) or self.fields is not None or self.open

    def feed(self, data):
        """Take the next bytes; rows of chunks are appended as far as they are complete."""
        data = self.left + data
        at = 0
        while True:
            if self.fields is None:
                end = data.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                self._begin(data[at:end].decode())
                at = end + 4
            if len(data) - at < self.missing + 4:
                break
            block = data[at:at + self.missing]
            at += self.missing + 4
            self._end(block)
        self.left = data[at:]

    def _begin(self, head):
        lines = head.split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        self.fields = dict(line.split(": ", 1) for line in lines[1:])
        self.missing = int(self.fields["Content-Length"])
        if self.open and self.fields["WARC-Type"] != "continuation":
            raise ValueError("a record ends before its last segment")

    def _end(self, block):
        f = self.fields
        kind = f["WARC-Type"]
        if kind != "continuation":
            block = block[block.index(b"\r\n\r\n") + 4:]
            self.sha, self.size, self.chunk = hashlib.sha1(), 0, 0
            self.origin = f
        else:
            if self.origin is None or f["WARC-Segment-Origin-ID"] != self.origin["WARC-Record-ID"]:
                raise ValueError("a continuation does not follow its record")
            self.chunk += 1
        first = self.origin
        self.sha.update(block)
        self.size += len(block)
        revisit = first["WARC-Type"] == "revisit"
        stated = base64.b32decode(first["WARC-Payload-Digest"][5:]).hex()
        last = self.chunk + 1 == int(f.get("X-Segments", 1))
        self.open = not last
        digest, size = (stated, int(first["X-Payload-Length"])) if revisit else (self.sha.hexdigest(), self.size)
        if last and (digest, size) != (stated, int(first["X-Payload-Length"])):
            raise ValueError("a payload differs from the digest of its record")
        page, other = first.get("X-Page-Id"), first.get("X-Refers-To-Page")
        self.rows.append((first["WARC-Record-ID"], page, self.chunk, last, size, digest, first["WARC-Type"], other,
                          block.decode() if self.with_data and not revisit else None))
        self.fields, self.missing = None, 0


_CHUNKS = ("record_id string, page_id string, chunk int, last boolean, bytes_so_far long, digest_so_far string, "
           "record_type string, refers_to string, data string")


def read_warc(spark, path, with_data=True):
    """The chunk table of a folder of archives."""
    names = [c.split()[0] for c in _CHUNKS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

    def parse(batches):
        file, reader, rows = None, None, []
        for batch in slices(batches, 4096):
            lines, files = batch.column(0).to_pylist(), batch.column(1)
            start = 0
            while start < len(lines):
                here = files[start].as_py()
                # a batch may hold the end of one file and the start of the next
                end = len(lines) if files[len(lines) - 1].as_py() == here else next(
                    i for i in range(start, len(lines)) if files[i].as_py() != here)
                if here != file:
                    if reader is not None and reader.unfinished():
                        raise ValueError(f"{file} ends inside a record")
                    file, reader = here, _Reader(rows, with_data)
                reader.feed(("\n".join(lines[start:end]) + "\n").encode())
                start = end
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
            rows.clear()
        if reader is not None and reader.unfinished():
            raise ValueError(f"{file} ends inside a record")

    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.mapInArrow(parse, _CHUNKS)


def round_trip(pages, **settings):
    """Write all pages, read the archives back, and give one row per record.

    page_id, payload_bytes, payload_digest, record_type, refers_to.
    """
    spark = pages.sparkSession
    path = work_dir(spark, "warc")
    write_warc(pages, path, **settings)
    forget_at_exit(spark, path)
    kind = dict(pages.dtypes)["page_id"]
    return read_warc(spark, path, with_data=False).where("last").select(
        F.col("page_id").cast(kind).alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"),
        F.col("digest_so_far").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


SQL = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
m AS (SELECT d, n, max(page_id) AS top FROM p WHERE n >= {LEAST_BYTES} GROUP BY d, n)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM p LEFT JOIN m USING (d, n)
"""
