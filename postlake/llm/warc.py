"""WARC archives: written by tasks, indexed by record, read back by byte ranges.

Each task writes its rows to archives of its own, one gzip member per record, and returns an index row per record:
file, offset, length, URL, digest. A file's name holds a random part, so a task that runs again after a lost executor
writes another file and the index names only that of the attempt that ended; nothing is overwritten. Reading starts
from the index: selected records are grouped by file and stretch of bytes, neighbours are read in one range, and each
record is inflated from its own slice. Paths go through pyarrow's file systems, so the folder may be local, HDFS or an
object store.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from postlake.llm.rows import bounded_batches, split_by_ids
from postlake.sources.scratch import Scratch

#: Payloads below this size are never replaced by a revisit record.
LEAST_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
STRETCH_BYTES = 8 << 20
GAP_BYTES = 64 << 10
#: Bytes of archives that a reading task gets.
TASK_BYTES = 32 << 20
_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string, refers_to long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _name(page_id) -> str:
    return f"<urn:page:{'' if pd.isna(page_id) else int(page_id)}>"


def _page(name: str | None):
    digits = (name or "").rpartition(":")[2].strip("<> ")
    return int(digits) if digits else None


def _header_value(value: str) -> str:
    """Keeps a value on its line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One record: a response with its payload, or a revisit without it."""
    revisit = not pd.isna(refers_to)
    block = _HTTP if revisit else _HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers (lower-case names) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    return headers | {"payload": block.partition(b"\r\n\r\n")[2]}


def _deflate(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for row in batch.itertuples(index=False):
                    if out is None or offset >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    payload = (row.html or "").encode("utf-8", "surrogatepass")
                    data = _deflate(record(row.page_id, row.url, payload, row.refers_to))
                    out.write(data)
                    revisit = not pd.isna(row.refers_to)
                    rows.append((row.page_id, row.url, name, offset, len(data), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", row.refers_to))
                    offset += len(data)
                yield pd.DataFrame(rows, columns=["page_id", "url", "file", "offset", "length", "payload_digest", "record_type", "refers_to"])
        finally:
            if out is not None:
                out.close()

    return write


def with_revisits(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds refers_to: for a page whose payload equals that of a page with a larger id, the largest such id.

    The groups are found on digests alone, by partial maxima; only pages of digests that occur more than once are joined to them,
    so other payloads are never shuffled. Of a group's payloads, the joined ones are all equal.
    """
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"))
    heads = pages.where(F.octet_length(payload) >= LEAST_BYTES).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null").select("digest", "head")
    heads = scratch.table(heads, "heads", small=True)
    refers = F.when((F.col("head") != F.col("page_id")) | (F.col("page_id").isNull() & F.col("head").isNotNull()), F.col("head"))
    maybe, alone = split_by_ids(pages, heads, "digest")
    joined = maybe.join(heads, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    return joined if alone is None else alone.select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to")).unionByName(joined)


def write_archives(pages: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html; others ignored) under ``folder``; returns the index.

    A null html is an empty payload; a null url or page_id leaves its header empty. Repeated rows get a record each. A payload of any
    length is one record; a task holds one at a time beside its batch.
    """
    bounded_batches(pages.sparkSession)
    return scratch.table(with_revisits(pages, scratch).mapInPandas(_writer(folder), INDEX), "index", small=True)


def _reader(folder: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.itertuples(index=False):
                spans = sorted((int(x["offset"]), int(x["length"])) for x in row.spans)
                found = []
                with system.open_input_file(f"{path}/{row.file}") as source:
                    k = 0
                    while k < len(spans):
                        start, end, first = spans[k][0], sum(spans[k]), k
                        while k + 1 < len(spans) and spans[k + 1][0] - end <= GAP_BYTES:
                            k += 1
                            end = max(end, sum(spans[k]))
                        k += 1
                        data = source.read_at(end - start, start)
                        for offset, length in spans[first:k]:
                            x = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                            revisit = x["warc-type"] == "revisit"
                            digest = x["warc-payload-digest"].removeprefix("sha1:")
                            if not revisit and hashlib.sha1(x["payload"]).hexdigest() != digest:
                                raise ValueError(f"{row.file} at {offset}: the payload differs from its digest")
                            found.append((_page(x["warc-record-id"]), x.get("warc-target-uri"), x["warc-type"], _page(x.get("warc-refers-to")), None if revisit else len(x["payload"]), digest, None if revisit else x["payload"]))
                frame = pd.DataFrame(found, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
                yield frame.astype({k: "Int64" for k in ("page_id", "refers_to", "payload_bytes")})

    return read


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """The records of the index rows ``selected``. Revisit records have no payload of their own here.

    The rows of a stretch of 8 MB meet in one task; a record has some hundred bytes at least, which bounds them.
    """
    stretches = selected.withColumn("stretch", F.floor(F.col("offset") / STRETCH_BYTES)).groupBy("file", "stretch").agg(F.collect_list(F.struct("offset", "length")).alias("spans"))
    total = selected.agg(F.sum("length").alias("bytes")).first()["bytes"] or 0
    # rows are tiny beside what they stand for, so their number of tasks follows the bytes to read
    return stretches.select("file", "spans").repartition(1 + total // TASK_BYTES).mapInPandas(_reader(folder), RECORDS)


def archived_pages(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Writes ``pages`` to archives and returns what is read back: one row per page with its full payload's size and
    digest, record_type and refers_to. A revisit's size is that of the response it names. Empty tables give no rows.

    Null and empty html are payloads of no bytes; a null url or page_id stays null, and a page without id is never what others refer to. Of equal
    payloads the largest page_id is the response; rows that repeat it are responses too. Payloads of any length are kept whole; columns other than
    page_id, url and html are ignored, whatever their names.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.root}/archives"
    index = write_archives(pages, folder, scratch)
    back = scratch.table(read_records(index, folder).drop("payload", "url"), "read")
    heads = back.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("head"), F.col("payload_digest").alias("head_digest")).agg(F.max("payload_bytes").alias("head_bytes"))
    joined = back.join(heads, (F.col("refers_to") == F.col("head")) & (F.col("payload_digest") == F.col("head_digest")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "head_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
