"""WARC archives: a writer with revisit records, and a splittable reader.

Archives are sequences of gzip members, one record each. A reading task gets a
byte range of a file, scans it for gzip's magic bytes, accepts a candidate only
if it inflates to a whole WARC header, and reads every record that starts
inside its range, past the range's end if the record does. So no index and no
agreement between tasks is needed, and a lost task is simply run again.

Files are reached by pyarrow's file systems from URIs under the cluster's
shared folder. A writing task names its files by a fresh random id and reports
them in the manifest; files of failed attempts are in no manifest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, settled

#: Fixed values of the WARC 1.1 and gzip formats.
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:page:%s>"
DATE = "2000-01-01T00:00:00Z"
#: Bytes inflated at a time while a header's end is sought.
HEADER_STEP = 1 << 16

MANIFEST = "path string, bytes long, records long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def decided(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 (hex), first: the page_id that a revisit
    refers to, null for responses. Of equal payloads of at least
    min_revisit_bytes bytes, the rows with the largest page_id are responses;
    null ids count as smallest. A null html is an empty payload.

    Only ids and digests meet on the digest (a join whose hot keys adaptive
    execution can split); the texts move once, by page_id.
    """
    base = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.sha1("payload"))
    ids = base.select("page_id", "sha1", F.octet_length("payload").alias("n"))
    groups = settled(ids.where(F.col("n") >= min_revisit_bytes).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").drop("copies"), "groups")
    later = ids.select("page_id", "sha1").join(groups, "sha1").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    return base.withColumn("key", key).join(later.select(key.alias("key"), "sha1", "first"), ["key", "sha1"], "left").drop("key")


def _record(page_id, url, payload: bytes, sha1: str, first) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {RECORD_ID % ('null' if page_id is None else page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%]", lambda m: f"%{ord(m[0]):02X}", url))
    if first is not None:
        head += [f"WARC-Refers-To: {RECORD_ID % first}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _whole(x) -> int | None:
    return None if x is None or x != x else int(x)


def write_archives(decisions: DataFrame, folder: str, max_bytes: int = 256 << 20, level: int = 3) -> DataFrame:
    """Writes the rows of decided() to archives under folder, one or more a
    task, and returns their manifest, settled."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, done = None, []
        for batch in batches:
            for page_id, url, payload, sha1, first in zip(batch["page_id"], batch["url"], batch["payload"], batch["sha1"], batch["first"], strict=True):
                if out is None:
                    done.append([f"{uuid.uuid4().hex}.warc.gz", 0, 0])
                    out = store.open_output_stream(f"{root}/{done[-1][0]}", compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(_record(_whole(page_id), url, bytes(payload), sha1, _whole(first))) + packer.flush()
                out.write(member)
                done[-1][1] += len(member)
                done[-1][2] += 1
                if done[-1][1] >= max_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pd.DataFrame([(f"{folder}/{name}", size, n) for name, size, n in done], columns=["path", "bytes", "records"])

    texts = decisions.select(F.col("page_id").cast("string"), "url", "payload", "sha1", F.col("first").cast("string"))
    return settled(texts.mapInPandas(write, MANIFEST), "manifest")


def _header(text: bytes) -> tuple[dict[str, str], int] | None:
    """Fields (names in lower case) and length of a header, None if it is no whole one."""
    end = text.find(b"\r\n\r\n")
    if end < 0 or not text.startswith(b"WARC/1."):
        return None
    lines = text[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return (fields, end + 4) if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def records_in(source, start: int, end: int, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a seekable file whose gzip
    member starts at start <= p < end. A member that begins like a record is
    inflated until its header ends, however long it is. Memory: the range's
    window and a record."""
    size = source.size()
    p, window, base = start, b"", start

    def more(at: int) -> bytes:
        return source.read_at(min(step, size - at), at) if at < size else b""

    while p < min(end, size):
        if p < base or p + len(MAGIC) > base + len(window):
            window, base = more(p), p
            if len(window) < len(MAGIC):
                return
        k = window.find(MAGIC, p - base)
        if k < 0:  # the last two bytes may begin the magic
            p = base + len(window) - len(MAGIC) + 1
            if base + len(window) >= size:
                return
            continue
        p = base + k
        if p >= end:
            return
        inflate, got, found, searched = zlib.decompressobj(31), bytearray(), None, 0
        pending, at = window[k:], base + len(window)  # at: where the file goes on after pending
        try:
            while not inflate.eof:
                if not pending:
                    pending = more(at)
                    at += len(pending)
                    if not pending:
                        break
                got += inflate.decompress(pending, 0 if found else HEADER_STEP)
                pending = inflate.unconsumed_tail
                if found is None:
                    if got[:7] != b"WARC/1."[: len(got)]:
                        break
                    ended = got.find(b"\r\n\r\n", max(0, searched - 3)) >= 0
                    if ended and (found := _header(bytes(got))) is None:
                        break
                    searched = len(got)
        except zlib.error:
            found = None
        if found is None or not inflate.eof:
            p += 1
            continue
        fields, head = found
        yield fields, bytes(got[head : head + int(fields["content-length"])])
        p = at - len(inflate.unused_data)


def _page(fields: dict[str, str], block: bytes) -> tuple:
    number = lambda x: int(m[1]) if (m := re.search(r":(-?\d+)>$", x or "")) else None
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = (fields.get("warc-payload-digest") or "").removeprefix("sha1:")
    url = fields.get("warc-target-uri")
    if url is not None:
        url = re.sub(r"%([01][0-9A-F]|2[05])", lambda m: chr(int(m[1], 16)), url)
    if fields["warc-type"] == "revisit":
        told = re.search(rb"(?i)content-length: *(\d+)", http)
        return number(fields["warc-record-id"]), url, "revisit", number(fields.get("warc-refers-to")), int(told[1]) if told else None, digest, None
    return number(fields["warc-record-id"]), url, fields["warc-type"], None, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), payload


def read_archives(manifest: DataFrame, split_bytes: int = 4 << 20, payloads: bool = True) -> DataFrame:
    """Records of all archives of a manifest (path, bytes), in as many tasks as
    there are ranges of split_bytes. payload_digest is computed from a response's payload, and is
    the stated one of a revisit, whose payload is null."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        columns = [x.split()[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for path, start, end in zip(batch["path"], batch["start"], batch["end"], strict=True):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as source:
                    rows, held = [], 0
                    for fields, block in records_in(source, start, end):
                        row = _page(fields, block)
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(block)
                        if len(rows) >= 1000 or held > 16 << 20:
                            yield _frame(rows, columns)
                            rows, held = [], 0
                    if rows:
                        yield _frame(rows, columns)

    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    # Ranges are tiny rows: without a number of partitions they would meet in one task.
    tasks = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    return ranges.repartition(int(tasks), "path", "start").mapInPandas(read, RECORDS)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns, dtype=object)
    for c in ("page_id", "refers_to", "payload_bytes"):
        out[c] = out[c].astype("Int64")
    return out


def checked(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """records, settled; an error if they are not as many as the manifest states."""
    records = settled(records, "records")
    read, written = records.count(), manifest.agg(F.sum("records")).first()[0] or 0
    if read != written:
        raise ValueError(f"{read} records read of {written} written")
    return records


def round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    manifest = write_archives(decided(pages, min_revisit_bytes), fresh_path(spark, "warc"))
    return checked(read_archives(manifest, payloads=payloads), manifest)


def op6(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """A row a page, as read back. Null payloads are empty; an empty table gives
    an empty result; other columns of pages are left out."""
    return round_trip(spark, pages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
