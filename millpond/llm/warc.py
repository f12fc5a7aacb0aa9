"""WARC archives with an index: write records, then read chosen ones by coalesced byte ranges.

``decide`` marks each row as response or revisit. ``write`` puts one gzip member per record into archives in a shared
folder and returns the index: file, offset, length, URL and digest of each record. ``read`` sorts the wanted index rows
by file and offset, joins near ranges into single reads and parses the records.

Each task writes archives under names of its own attempt. Only the rows of successful attempts reach the index, which
Spark commits as a table; what a lost or repeated attempt wrote is named by no row. Archives are opened with
pyarrow's filesystems, so the folder may be any store they know (local and NFS paths, HDFS, object stores).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millpond.llm.common import slices, stored
from millpond.session import new_folder

ARCHIVE_BYTES = 512 << 20  # a task starts another archive beyond this
GAP = 64 << 10  # bytes between two wanted records that are read over rather than skipped
RUN = 8 << 20  # most bytes of one read, but for a single longer record
MIN_REVISIT = 1000  # smaller payloads are always stored
INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_id long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def decide(pages: DataFrame, payload: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, refers_to of every row; refers_to is null for responses.

    Of rows with equal payloads of at least ``min_bytes`` those with the largest page_id are responses and the others
    refer to it. A null payload is an empty one. A null page_id is below all others; where all of a group are null, all
    are responses. Rows that repeat a page_id each keep a record of their own.

    Payloads move once, by page; the grouping by digest, where copies may be a third of all rows, sees only ids.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    digest = F.sha1("payload")
    large = rows.where(F.length("payload") >= min_bytes).select("page_id", digest.alias("digest"))
    kept = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    # The groups are written, so that both sides of the next join are plain shuffles that Spark may split.
    kept = stored(kept, "warc-groups")
    again = large.join(kept, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    # Null ids match nothing in a plain join, so they are told apart by a flag.
    key = [F.coalesce("page_id", F.lit(0)).alias("_id"), F.col("page_id").isNull().alias("_null"), F.col("digest").alias("_digest")]
    again = again.select(*key, "refers_to")
    rows = rows.withColumn("digest", digest)
    return rows.join(again, [F.coalesce(rows.page_id, F.lit(0)) == again._id, rows.page_id.isNull() == again._null, rows.digest == again._digest], "left").select("page_id", "url", "payload", "digest", "refers_to")


def header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record. A revisit names the payload it repeats by digest, length and record, and carries none."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    body = payload if refers_to is None else b""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 or c == "%" else c for c in url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(body))))
    return header(fields) + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """page_id, url, record type, refers_to, length and digest of the full payload, payload (null for a revisit)."""
    from urllib.parse import unquote

    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    number = lambda k: None if k not in fields or "none" in fields[k] else int(fields[k].rsplit(":", 1)[1].rstrip(">"))
    url, kind = fields.get("WARC-Target-URI"), fields["WARC-Type"]
    body = rest[: int(fields["Content-Length"])]
    return number("WARC-Record-ID"), None if url is None else unquote(url), kind, number("WARC-Refers-To"), int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), body if kind == "response" else None


def write(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write what ``decide`` returns below ``folder`` and return the index of all records, stored."""

    def run(batches: Iterator) -> Iterator:
        import gzip
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, at, name = None, 0, ""
        for part in slices(batches, "payload"):
            index = []
            for page_id, url, payload, digest, refers_to in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None or at >= archive_bytes:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip.compress(record(page_id, url, payload, digest, refers_to), 4, mtime=0)
                out.write(member)
                index.append((name, at, len(member), url, digest, "response" if refers_to is None else "revisit", page_id))
                at += len(member)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()))], names=["file", "offset", "length", "url", "digest", "record_type", "page_id"])
        if out:
            out.close()

    return stored(rows.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, folder: str, gap: int = GAP, run_bytes: int = RUN, payloads: bool = True) -> DataFrame:
    """The records of the given index rows, in their full form or, without ``payloads``, with that column null.

    Rows are dealt by ranges of (file, offset) and sorted, so a task reads each archive from front to back; ranges that
    lie within ``gap`` bytes of each other are one read of at most ``run_bytes``. The digest of each payload read is
    compared with the record's and the index's.
    """

    def fetched(source, run: list) -> Iterator:
        import gzip
        import hashlib

        start = run[0][1]
        data = memoryview(source.read_at(max(o + n for _, o, n, _ in run) - start, start))
        for _, offset, length, digest in run:
            row = parse(gzip.decompress(data[offset - start : offset - start + length]))
            if row[5] != digest or row[6] is not None and hashlib.sha1(row[6]).hexdigest() != digest:
                raise ValueError(f"digest of record at {offset} differs from its payload or index")
            yield row if payloads else (*row[:6], None)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = [x.split()[0] for x in RECORD.split(", ")]
        source, opened = None, None

        def ready(pending):
            nonlocal source, opened
            if opened != pending[0][0]:
                if source:
                    source.close()
                source, opened = store.open_input_file(f"{root}/{pending[0][0]}"), pending[0][0]
            found = list(fetched(source, pending))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=names)

        pending: list = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "digest"))):
                end = pending[-1][1] + pending[-1][2] if pending else 0
                if pending and (row[0] != pending[0][0] or row[1] > end + gap or row[1] + row[2] - pending[0][1] > run_bytes):
                    yield ready(pending)
                    pending = []
                pending.append(row)
        if pending:
            yield ready(pending)
        if source:
            source.close()

    wanted = index.select("file", "offset", "length", "digest")
    return wanted.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive every row and read every record back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = new_folder(spark, "warc")
    index = write(decide(pages), folder)
    return read(index, folder, payloads=False).drop("payload", "url")
