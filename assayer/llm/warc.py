"""Legacy archive converter: ARC files, version 1 and 2, to WARC with identifiers, timestamps, types and digests."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.shared import new_path, store

# Header fields of an ARC record by version of the file.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
# Fixed value: the profile of a record whose payload another record holds.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP_RESPONSE = "application/http; msgtype=response"
LEAST_BYTES = 100
EPOCH = "1970-01-01T00:00:00Z"


@dataclass
class ArcRecord:
    number: int
    url: str
    ip: str
    date: str
    mime: str
    block: bytes
    declared: int

    @property
    def is_http(self) -> bool:
        return self.block.startswith(b"HTTP/")

    def parts(self) -> tuple[bytes, bytes]:
        """HTTP header with its empty line, and payload; a block that is no HTTP message is all payload."""
        if not self.is_http:
            return b"", self.block
        end = self.block.find(b"\r\n\r\n")
        return (self.block[:end + 4], self.block[end + 4:]) if end >= 0 else (self.block, b"")


def timestamp(date: str) -> str:
    """ISO form of an ARC date of 4 to 14 digits; the epoch if it is none."""
    digits = (date + "00000101000000"[len(date):]) if re.fullmatch(r"\d{4,14}", date) else ""
    try:
        return pd.Timestamp(f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return EPOCH


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """Records of an ARC file or of several in a row, one at a time.

    The version line in the first record tells the fields of the header lines after it; the URL may hold spaces, as the
    other fields are counted from the end. The declared length alone says where a record ends. Lines that are no header
    are passed over, a record that ends before its declared length is returned as far as it goes.
    """
    version, number = 1, 0
    while line := stream.readline():
        fields = line.rstrip(b"\r\n").decode("utf-8", "replace").rsplit(" ", 4 if line.startswith(b"filedesc://") else len(ARC_FIELDS[version]) - 1)
        if len(fields) < 5 or not fields[-1].isascii() or not fields[-1].isdigit():
            continue
        declared = int(fields[-1])
        block = stream.read(declared)
        if fields[0].startswith("filedesc://"):
            found = re.match(rb"\s*(\d+)", block)
            version = int(found[1]) if found and int(found[1]) in ARC_FIELDS else 1
            continue
        yield ArcRecord(number, *fields[:4], block, declared)
        number += 1


def arc_record(version: int, url: str, ip: str, date: str, mime: str, block: bytes, status: int = 200) -> bytes:
    """Header line and block. White space in a URL would end the field for other readers and is escaped."""
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "unknown:"
    middle = [str(status), "-", "-", "0", "-"] if version == 2 else []
    return " ".join([url, ip, date, mime, *middle, str(len(block))]).encode() + b"\n" + block


def arc_head(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 assayer\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body


def record_id(archive: str, number: int) -> str:
    """Identifier made from a record's place in its archive: the same whenever the archive is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{number}')}>"


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def warc_record(fields: dict[str, str | None], block: bytes) -> bytes:
    """A record but for the two line ends that follow it."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields.items() if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def converted(archive: str, r: ArcRecord, same_as: tuple[str, str, str] | None) -> bytes:
    """The WARC record of an ARC record; same_as: identifier, URL and date of the record that holds an equal payload."""
    head, payload = r.parts()
    fields: dict[str, str | None] = {
        "WARC-Type": "revisit" if same_as else "response" if r.is_http else "resource", "WARC-Record-ID": record_id(archive, r.number),
        "WARC-Date": timestamp(r.date), "WARC-Target-URI": r.url, "WARC-IP-Address": None if r.ip in ("", "-", "0.0.0.0") else r.ip,
        "WARC-Payload-Digest": digest(payload), "Content-Type": HTTP_RESPONSE if r.is_http else r.mime,
        "WARC-Truncated": "length" if len(r.block) < r.declared else None}
    if same_as:
        fields |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": same_as[0], "WARC-Refers-To-Target-URI": same_as[1], "WARC-Refers-To-Date": same_as[2]}
    block = head if same_as else r.block
    return warc_record(fields | {"WARC-Block-Digest": digest(block)}, block)


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, names in lower case, and block of each record; the declared length says where a block ends."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


def unpacked(content: bytes) -> BinaryIO:
    raw = io.BytesIO(content)
    return gzip.open(raw) if content[:2] == b"\x1f\x8b" else raw


def write_records(records: DataFrame, path: str, separator: str) -> None:
    """One gzip file per task, each row of `record` followed by the separator. Spark writes the bytes as they are."""
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", separator).option("compression", "gzip").text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """`path, content` of the archives in a folder, which any store can hold that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> None:
    """Pages as ARC files, one per task, of version 1 and 2 in turn. A page's id becomes a header of its HTTP message, its
    date and address are made from the id. A null page is an empty payload."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        version, begun = 1 + task % 2, False
        for batch in batches:
            out = [] if begun else [arc_head(version, f"part-{task:06d}.arc", "20010101000000")]
            begun = True
            for i, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                payload = (html or "").encode()
                date = (pd.Timestamp("2001-01-01") + pd.Timedelta(seconds=(i or 0) % 10**8)).strftime("%Y%m%d%H%M%S")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n" + (
                    "" if i is None else f"X-Page-Id: {i}\r\n") + "\r\n"
                out.append(arc_record(version, url or "", f"192.0.2.{(i or 0) % 256}", date, "text/html", head.encode() + payload))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
    slim = pages.select(F.col(id_column).cast("long").alias("i"), F.col(url_column).alias("u"), F.col(html_column).alias("h"))
    write_records(slim.mapInArrow(pack, "record binary"), path, "\n")


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name).encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


def _whole(value: str | None) -> int | None:
    """The whole number a field says, if it is one of 64 bits."""
    found = int(value) if value and re.fullmatch(r"-?[0-9]{1,19}", value) else None
    return found if found is not None and -(1 << 63) <= found < 1 << 63 else None


ENTRIES = "archive string, number int, record_id string, url string, date string, page_id long, payload_bytes long, payload_digest string, http boolean"
SCHEMA = pa.schema([("archive", pa.string()), ("number", pa.int32()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()),
                    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("http", pa.bool_())])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out = []
            for r in read_arc(unpacked(content.as_py())):
                head, payload = r.parts()
                out.append((path, r.number, record_id(path, r.number), r.url, timestamp(r.date), _whole(http_field(head, "X-Page-Id")), len(payload),
                            digest(payload), r.is_http))
            yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, row, strict=True)) for row in out], SCHEMA)


def convert(spark: SparkSession, source: str, target: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write a WARC record for every record of the ARC files in the folder `source` to gzip files in `target`.

    Of HTTP records with equal payloads of at least `least_bytes` bytes, the first by page id (those without come last),
    then by place, becomes the response, the others revisits of it. A first pass lists the records without payloads, so
    equal payloads are matched by digest alone; a second pass writes the files. Only compressed archives are shuffled
    in between, each with the revisits among its own records.
    """
    listed = store(files(spark, source).mapInArrow(_entries, ENTRIES), "entries")
    same = listed.where(F.col("http") & (F.col("payload_bytes") >= least_bytes))
    order = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "archive", "number")
    first = store(same.groupBy("payload_digest").agg(
        F.min_by(F.struct("record_id", "url", "date"), order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first")
    revisits = same.join(first, "payload_digest").where(F.col("record_id") != F.col("first.record_id")).groupBy(F.col("archive").alias("path")).agg(
        F.collect_list(F.struct("number", "first")).alias("revisits"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, revisits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                again = {r["number"]: tuple(r["first"].values()) for r in revisits or []}
                info = b"format: WARC File Format 1.1\r\n"
                out, size = [warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(path, -1), "WARC-Date": EPOCH,
                                          "WARC-Filename": path.rsplit("/", 1)[-1], "Content-Type": "application/warc-fields"}, info)], 0
                for r in read_arc(unpacked(content.as_py())):
                    out.append(converted(path, r, again.get(r.number)))
                    size += len(out[-1])
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    joined = files(spark, source).join(revisits, "path", "left").select("path", "content", "revisits")
    write_records(joined.mapInArrow(write, "record binary"), target, "\r\n\r\n")


READ = "record_id string, record_type string, page_id long, payload_bytes long, payload_digest string, refers_to string"
READ_SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                         ("payload_digest", pa.string()), ("refers_to", pa.string())])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(1):
            out = []
            for fields, block in read_warc(unpacked(content.as_py())):
                kind, told = fields.get("warc-type"), fields.get("warc-payload-digest")
                if kind == "warcinfo":
                    continue
                head, payload = ArcRecord(0, "", "", "", "", block, len(block)).parts()
                if kind != "revisit" and told != digest(payload):
                    raise ValueError(f"payload of {fields.get('warc-record-id')} does not have its digest")
                size = _whole(http_field(head, "Content-Length")) if kind == "revisit" else len(payload)
                out.append((fields.get("warc-record-id"), kind, _whole(http_field(head, "X-Page-Id")), size, told.partition(":")[2], fields.get("warc-refers-to")))
            yield pa.RecordBatch.from_pylist([dict(zip(READ_SCHEMA.names, row, strict=True)) for row in out], READ_SCHEMA)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """`record_id, record_type, page_id, payload_bytes, payload_digest, refers_to` of the WARC files in a folder.

    Digests of payloads are recomputed and compared; a revisit tells those of the full payload that it stands for.
    refers_to is the page id of the response, null for other records.
    """
    listed = store(files(spark, path).mapInArrow(_read_back, READ), "records")
    response = listed.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("_page"))
    plain = listed.where("record_type <> 'revisit'").withColumn("_page", F.lit(None).cast("long"))
    again = listed.where("record_type = 'revisit'").join(response, "refers_to", "left")
    return plain.unionByName(again).drop("refers_to").withColumnRenamed("_page", "refers_to")


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Pages to ARC, ARC to WARC, WARC to rows: `read_records` of the pages. Files are kept in the session's shared folder.

    Null pages are empty payloads; rows that repeat or have no id are records of their own. An empty table gives an
    empty result.
    """
    spark = pages.sparkSession
    arc, out = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, out, least_bytes)
    return read_records(spark, out)
