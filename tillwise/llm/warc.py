"""WARC archives with an index first, read back by coalesced byte ranges.

Each task writes its pages into archives of one gzip member per record and returns an index
row per record: archive, offset, length, URL, payload digest. The committed
index is what says which archives count; an archive that a lost or repeated task left
is in no index row. A payload of ``MIN_REVISIT_BYTES`` or more that another page with a
smaller page_id has too is a ``revisit`` record without a body, which names that page's
record. Reading takes any selection of index rows, deals them by archive and
region, sorts them by offset and reads neighbours in one request.

Archives go to the shared folder through Arrow's file systems, so that the folder may be a local
mount, HDFS or an object store.

Cases: null html is an empty payload; equal payloads under the bound are all responses; of rows
that share the least page_id each is a response; pages without an id are never
referred to; null URLs are left out of the record; an empty table writes no archive; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, write_shared

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 1 << 30
REGION_BYTES = 8 << 20
READ_BYTES = 4 << 20
READ_GAP = 64 << 10
#: Some 150 bytes each in an executor's memory.
BROADCAST_REVISITS = 200_000
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "1970-01-01T00:00:00Z"

INDEX = ("archive string, offset bigint, length bigint, url string, digest string, page_id {kind}, record_type string, "
         "refers_to {kind}")
RECORD = "page_id {kind}, url string, record_type string, refers_to {kind}, payload_bytes bigint, payload_digest string"


def _record_id(page_id) -> str:
    return f"<urn:tillwise:page:{'' if page_id is None else page_id}>"


def encode_record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One record as a gzip member: headers, HTTP headers, and the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}",
            f"WARC-Date: {WARC_DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def decode_record(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers, HTTP headers, payload) of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _page_of(record_id: str) -> str:
    return record_id.removeprefix("<urn:tillwise:page:").removesuffix(">")


def _digested(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, first_id): the pages whose payload belongs to another page; no payload is shuffled for it."""
    facts = _digested(pages).select("page_id", "digest", F.octet_length("payload").alias("size")).where(F.col("size") >= MIN_REVISIT_BYTES)
    first = facts.groupBy(F.col("digest").alias("f_digest")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (facts.join(first, F.col("digest") == F.col("f_digest")).where(other).select("page_id", "digest", "first_id").distinct())


def with_types(pages: DataFrame) -> DataFrame:
    """Pages with payload digest, record_type and refers_to.

    The revisits are rows of an id and a digest. They are broadcast while they are few, and pages then stay where they
    were read; beyond that pages are shuffled by id, which spreads a body that very many pages share.
    """
    again = write_shared(revisits(pages), "warc-revisits")
    n = again.count()
    again = again.select(F.col("page_id").alias("a_id"), F.col("digest").alias("a_digest"), "first_id")
    p = _digested(pages)
    joined = p.join(F.broadcast(again) if n <= BROADCAST_REVISITS else again,
                    F.col("page_id").eqNullSafe(F.col("a_id")) & (F.col("digest") == F.col("a_digest")), "left")
    found = F.col("first_id").isNotNull()
    return joined.select("page_id", "url", "payload", "digest", F.when(found, "revisit").otherwise("response").alias("record_type"),
                         F.col("first_id").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record per page under ``folder`` (a new shared folder by default); the index as a table."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    folder = folder or scratch_path(spark, "warc")

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        sink = name = None
        at = 0
        try:
            for b in batches:
                rows = []
                for cells in zip(*b.columns, strict=True):  # one payload at a time as a Python object
                    r = {k: c.as_py() for k, c in zip(b.schema.names, cells, strict=True)}
                    if sink is None or at >= ARCHIVE_BYTES:
                        if sink is not None:
                            sink.close()
                        store.create_dir(root, recursive=True)
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        sink = store.open_output_stream(posixpath.join(root, name), compression=None)
                    data = encode_record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"],
                                         r["record_type"] == "revisit")
                    sink.write(data)
                    rows.append((name, at, len(data), r["url"], r["digest"], r["page_id"], r["record_type"], r["refers_to"]))
                    at += len(data)
                cols = list(zip(*rows, strict=True)) or [[]] * 8
                ids = b.schema.field("page_id").type
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), ids, pa.string(), ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                                 names=["archive", "offset", "length", "url", "digest", "page_id",
                                                        "record_type", "refers_to"])
        finally:
            if sink is not None:
                sink.close()

    index = with_types(pages).mapInArrow(run, INDEX.format(kind=kind))
    return write_shared(index.withColumn("folder", F.lit(folder)), "warc-index")


def _ranges(rows: list[dict]) -> Iterator[list[dict]]:
    """Rows in (archive, offset) order, cut where a gap, another archive or the read size says so."""
    group: list[dict] = []
    for r in rows:
        if group and (r["archive"] != group[0]["archive"] or r["offset"] - group[-1]["offset"] - group[-1]["length"] > READ_GAP
                      or r["offset"] + r["length"] - group[0]["offset"] > READ_BYTES):
            yield group
            group = []
        group.append(r)
    if group:
        yield group


def read_records(index: DataFrame) -> DataFrame:
    """What the archives hold for the index rows given: ids, type, and size and digest of the payload read.

    A revisit has the size and digest of the payload that it stands for in its headers.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    number = kind in ("bigint", "int", "smallint", "tinyint")
    dealt = (index.withColumn("region", F.expr(f"offset DIV {REGION_BYTES}")).repartition("archive", "region")
             .sortWithinPartitions("archive", "offset").select("folder", "archive", "offset", "length", "url", "page_id"))

    def run(batches):
        store = root = None
        for b in batches:
            out = []
            for group in _ranges(b.to_pylist()):
                if store is None:
                    store, root = fs.FileSystem.from_uri(group[0]["folder"])
                begin = group[0]["offset"]
                size = group[-1]["offset"] + group[-1]["length"] - begin
                with store.open_input_file(posixpath.join(root, group[0]["archive"])) as f:
                    data = f.read_at(size, begin)
                for r in group:
                    fields, http, payload = decode_record(data[r["offset"] - begin:r["offset"] - begin + r["length"]])
                    page = _page_of(fields["WARC-Record-ID"])
                    if page != ("" if r["page_id"] is None else str(r["page_id"])):
                        raise ValueError(f"index row of page {r['page_id']} points at the record of page {page}")
                    kind_of, refers, digest = fields["WARC-Type"], None, hashlib.sha256(payload).hexdigest()
                    n = len(payload)
                    if kind_of == "revisit":
                        refers = _page_of(fields["WARC-Refers-To"])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        refers = int(refers) if number else refers
                    out.append((r["page_id"], r["url"], kind_of, refers, n, digest))
            ids = b.schema.field("page_id").type
            kinds = [ids, pa.string(), pa.string(), ids, pa.int64(), pa.string()]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                             names=["page_id", "url", "record_type", "refers_to", "payload_bytes",
                                                    "payload_digest"])

    return dealt.mapInArrow(run, RECORD.format(kind=kind))


#: What the archives must hold, from the pages themselves.
ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {MIN_REVISIT_BYTES} GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
