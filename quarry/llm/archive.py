"""Legacy archive converter: ARC files of both versions to WARC records, WARC files written and read back.

An ARC file starts with a version block that names the fields of its header lines; each record is such a line, then as
many bytes as it declares. The converter keeps a record's bytes and synthesises what WARC asks for: an identifier from
the record's digest and place, an ISO timestamp, a type, and digests.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpoint_dir, cut

#: The header fields that each ARC version declares.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
_END = "\r\n\r\n"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    body: bytes


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = b""
    extra: dict = field(default_factory=dict)

    def dump(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.headers.items())
        return f"WARC/1.1\r\n{head}Content-Length: {len(self.block)}{_END}".encode() + self.block


def write_arc(records: list[ArcRecord], version: int = 1, name: str = "pages.arc", date: str = "20240101000000") -> bytes:
    """An ARC file of one version; each record's Archive-length is set from its bytes."""
    fields = ARC_FIELDS[version]
    block = f"{version} 0 quarry\n{' '.join(fields)}\n\n".encode()
    line = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name}
    out = [(" ".join((line | {"Archive-length": str(len(block))})[f] for f in fields) + "\n").encode(), block, b"\n"]
    for r in records:
        own = {"Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name} | r.fields
        out += [(" ".join((own | {"Archive-length": str(len(r.body))})[f] for f in fields) + "\n").encode(), r.body, b"\n"]
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file by its declared fields and lengths; the version block itself is left out.

    The version block's first line names the version and its second the fields; a header line with another number of
    fields, a length that is no number and bytes missing at the end raise ValueError.
    """
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError("a header line has no end")
        line = data[at:stop].decode("utf-8", "replace").rstrip("\r").split(" ")
        size = int(line[-1])
        body = data[stop + 1 : stop + 1 + size]
        if len(body) < size:
            raise ValueError(f"{size} bytes declared, {len(body)} there")
        at = stop + 1 + size
        if fields is None:
            head = body.decode("utf-8", "replace").split("\n")
            version = int(head[0].split(" ")[0])
            fields = tuple(head[1].split()) or ARC_FIELDS[version]
            continue
        if len(line) != len(fields):
            raise ValueError(f"{len(line)} fields where {len(fields)} are declared")
        yield ArcRecord(dict(zip(fields, line)), body)


def split_http(body: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of an HTTP response; a body without a status line is all payload."""
    if not body.startswith(b"HTTP/"):
        return {}, body
    head, mark, payload = body.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload if mark else b""


def convert(record: ArcRecord, refers_to: str | None = None, identity: str = "") -> WarcRecord:
    """The WARC record of an ARC record: response, resource if it has no HTTP head, revisit if ``refers_to`` is given."""
    http, payload = split_http(record.body)
    digest = hashlib.sha256(payload).hexdigest()
    d = record.fields["Archive-date"]
    kind = "revisit" if refers_to else "response" if http else "resource"
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record.fields["URL"]}|{d}|{digest}|{identity}')}>",
        "WARC-Target-URI": record.fields["URL"],
        "WARC-IP-Address": record.fields["IP-address"],
        "WARC-Date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(record.body).hexdigest()}",
        "Content-Type": "application/http; msgtype=response" if http else record.fields["Content-type"],
    }
    block = record.body
    if refers_to:
        headers |= {"WARC-Refers-To": refers_to, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        block = record.body[: len(record.body) - len(payload)]
        headers["WARC-Block-Digest"] = f"sha256:{hashlib.sha256(block).hexdigest()}"
    return WarcRecord(headers, block, {"payload": payload, "http": http})


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    """Records of a WARC file by their declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:stop].decode("utf-8").split("\r\n")[1:]
        headers = {k: v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers.pop("Content-Length"))
        block = data[stop + 4 : stop + 4 + size]
        if len(block) < size:
            raise ValueError(f"{size} bytes declared, {len(block)} there")
        at = stop + 4 + size
        http, payload = split_http(block)
        yield WarcRecord(headers, block, {"payload": payload, "http": http})


def write_pages(pages: DataFrame, path: str, date: str = "20240101000000", smallest: int = 100) -> None:
    """WARC files of ``pages`` (page_id, url, html) under ``path``, by way of ARC records of both versions.

    Among rows with equal payloads of at least ``smallest`` bytes those with the smallest page_id are responses, the
    others revisits of it. Null html is empty, a null url '-', a null page_id is never referred to, but may refer.
    Repeated rows are records of their own; extra columns are ignored; an empty table writes no records.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("-")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    digest = F.unhex(F.sha2("html", 256))
    keyed = rows.where("page_id IS NOT NULL").where(F.octet_length("html") >= smallest).select(digest.alias("digest"), "page_id", "url")
    first = keyed.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # copies meet by keys alone; the payloads join by a hash of row and payload, which spreads the copies of one page
    long = F.octet_length("html") >= smallest
    place = F.xxhash64(F.coalesce("page_id", F.lit(-1)), "url", digest)
    again = cut(rows.where(long).select(digest.alias("digest"), place.alias("place")).distinct())
    again = again.join(cut(first).hint("merge"), "digest").select("place", "digest", "first")
    rows = rows.withColumn("digest", digest).withColumn("place", place)
    joined = rows.join(again.hint("merge"), ["place", "digest"], "left").select("page_id", "url", "html", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))

    def legacy(page, url, html):
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\nX-Page-Id: {'' if page is None else page}\r\n\r\n"
        return ArcRecord({"URL": quote(url, safe=":/?#[]@!$&'()*+,;=%~") or "-", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html"}, head.encode() + html)

    def make(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64).to_pylist()
                arc = write_arc([legacy(r["page_id"], r["url"], r["html"]) for r in part], version=1 + i // 64 % 2)
                out = []
                for r, record in zip(part, read_arc(arc), strict=True):
                    refers = None
                    if r["first_id"] is not None and r["page_id"] != r["first_id"]:
                        refers = convert(legacy(r["first_id"], r["first_url"], r["html"]), None, str(r["first_id"])).headers["WARC-Record-ID"]
                    warc = convert(record, refers, str(r["page_id"]))
                    if refers:
                        warc.headers["X-Refers-To-Page"] = str(r["first_id"])
                    out.append(warc.dump())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = joined.mapInArrow(make, "value binary").select(F.col("value").cast("string"))
    records.write.mode("overwrite").option("lineSep", _END).option("maxRecordsPerFile", 2000).option("compression", "gzip").text(path)


def read_pages(spark, path: str) -> DataFrame:
    """What the archives under ``path`` hold: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Digests of responses are computed from the payload as read and must equal the recorded ones.
    """
    files = spark.read.format("binaryFile").load(path).select("content")  # an empty folder gives no rows

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
                whole = content.as_buffer().to_pybytes()
                for r in read_warc(gzip.decompress(whole) if whole[:2] == b"\x1f\x8b" else whole):
                    http, payload, kind = r.extra["http"], r.extra["payload"], r.headers["WARC-Type"]
                    digest = r.headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{r.headers['WARC-Record-ID']} has another digest than recorded")
                    page, refers = http.get("x-page-id"), r.headers.get("X-Refers-To-Page")
                    for k, v in zip(rows, (int(page) if page else None, int(http["content-length"]) if kind == "revisit" else len(payload), digest, kind, int(refers) if refers else None)):
                        rows[k].append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))

    return files.mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, name: str = "warc") -> DataFrame:
    """Write the archives into the shared checkpoint folder and read them back."""
    spark = pages.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    write_pages(pages, path)
    return read_pages(spark, path)
