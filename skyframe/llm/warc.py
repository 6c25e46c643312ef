"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own.  The reader deals byte ranges to tasks; a task looks for gzip magic in
its range, accepts a candidate only if it decodes to a WARC header and its member is whole and followed by another
member or the file's end, and owns the records that start inside its range, however far they reach.
"""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_lookup, shuffle_partitions

MAGIC = b"\x1f\x8b\x08"
DATE = "2020-01-01T00:00:00Z"  # records carry this date: equal input gives equal archives
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _files(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member: a response, or a revisit of another page's response if `refers_to` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + body + b"\r\n\r\n") + deflate.flush()


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, html) -> page_id, url, payload, digest, refers_to.

    Of rows with equal payloads of `least` bytes or more the smallest page_id keeps the payload and all others
    refer to it.  A null page_id is never the smallest; rows that repeat that page_id exactly are responses too.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= least)
    seen = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    out = hot_lookup(rows, seen, "digest", pages.count())
    return out.withColumn("refers_to", F.when(F.col("first") != F.coalesce("page_id", F.lit(-1) - F.col("first")), F.col("first"))).drop("first")


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """Writes part-<task>.warc.gz files and returns (file, bytes), one row for each.

    A task writes under a name of its own and renames it when it is complete, so a task that is run again (or
    twice) leaves one whole file; the same rows give the same bytes.
    """
    files, top = _files(path)
    files.create_dir(top)

    def run(batches):
        task, (fs, top) = TaskContext.get(), _files(path)
        own = f"{top}/.part-{task.partitionId():06d}-{task.taskAttemptId()}"
        with fs.open_output_stream(own) as out:
            for batch in batches:
                for r in batch.to_pylist():
                    out.write(record(**r))
        name = f"part-{task.partitionId():06d}.warc.gz"
        size = fs.get_file_info(own).size
        fs.move(own, f"{top}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], names=["file", "bytes"])

    ordered = records.select("page_id", "url", "payload", "digest", "refers_to").sortWithinPartitions("page_id", "digest")
    done = ordered.mapInArrow(run, "file string, bytes long")
    return records.sparkSession.createDataFrame(done.collect(), "file string, bytes long")  # one row for each file


def members(fs, name: str, start: int, end: int, step: int = 1 << 20):
    """The decoded members of a file that start in [start, end) and are WARC records."""
    with fs.open_input_file(name) as f:
        size = f.size()
        at, buf = start, b""  # buf holds the file from `at` on

        def more() -> bool:
            nonlocal buf
            f.seek(at + len(buf))
            got = f.read(step)
            buf += got
            return bool(got)

        while at < end and (len(buf) > 2 or more() or buf):
            k = buf.find(MAGIC)
            if k < 0 or at + k >= end:
                if at + len(buf) >= min(end + 2, size) or not more():
                    return
                drop = max(0, min(len(buf), k if k >= 0 else len(buf) - step - 2))
                at, buf = at + drop, buf[drop:]
                continue
            at, buf = at + k, buf[k:]
            stream, parts, fed, good = zlib.decompressobj(31), [], 0, True
            try:
                while not stream.eof:
                    if fed == len(buf) and not more():
                        good = False
                        break
                    parts.append(stream.decompress(buf[fed:]))
                    fed = len(buf)
                    if len(parts) == 1 and not parts[0][:7].startswith(b"WARC/1."[: len(parts[0][:7])]):
                        good = False
                        break
            except zlib.error:
                good = False
            if good:
                used = fed - len(stream.unused_data)
                while len(buf) < used + 3 and more():
                    pass
                good = buf[used : used + 3] in (MAGIC, b"")
            whole = b"".join(parts)
            if good and whole.startswith(b"WARC/1.") and b"\r\n\r\n" in whole:
                yield whole
                at, buf = at + used, buf[used:]
            else:
                at, buf = at + 1, buf[1:]


def parse(whole: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names lower-cased) and the block."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest[: int(fields["content-length"])]


def read_archives(spark: SparkSession, path: str, files: DataFrame, split: int = 8 << 20) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record of the files (file, bytes).

    A response's length and digest are those of the payload as read, and must agree with its header; a revisit has
    no payload, so they are those of its headers.
    """
    splits = files.select("file", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split}L)")).alias("start"))

    def run(batches):
        fs, top = _files(path)
        import hashlib

        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for whole in members(fs, f"{top}/{row['file']}", row["start"], row["start"] + split):
                    fields, block = parse(whole)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size, kind = int(re.search(rb"(?i)content-length: *(\d+)", http)[1]), fields["warc-type"]
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"a damaged record in {row['file']}")
                    page, first = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    out.append((page and int(page), fields.get("warc-target-uri"), size, digest, kind, first and int(first)))
                    if len(out) >= 4096:
                        yield _batch(out)
                        out = []
                yield _batch(out)

    n = max(1, splits.count())
    return splits.repartition(min(n, 4 * shuffle_partitions(spark)), "file", "start").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _batch(rows: list):
    cols, kinds = list(zip(*rows)) or [[]] * 6, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def archive_pages(pages: DataFrame, path: str) -> DataFrame:
    """Writes a record for each row of (page_id, url, html) to `path` and reads all of them back.

    Null html is an empty payload; a null url has no target field; a null page_id no page field, and it is a
    revisit if its payload is another page's.  Repeated rows give repeated records.  An empty table gives an empty
    result; other columns are left out.  The payloads themselves are in the archives (members(), parse()).
    """
    files = write_archives(with_revisits(pages), path)
    return read_archives(pages.sparkSession, path, files)
