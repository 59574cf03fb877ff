"""WARC archives of pages: written with segments and chunked framing, read back and reassembled.

A page becomes an HTTP response record, its payload framed in chunks of CHUNK bytes. A record whose
block is longer than SEGMENT bytes is cut: the first part is a response record with segment number 1, the others are
continuation records with the origin's id, and the last gives the total length. Reading groups
continuations by origin identifier, orders them by segment number, checks that numbers have no
gap and that the parts add up to the total, and decodes the chunks.

Of pages with equal payloads of at least MIN_BYTES the one of the smallest page_id is the response;
the others are revisit records that refer to it and keep its headers and digests. Archives are rows of
gzip members (about ARCHIVE bytes each) in the shared folder, so any store will do.

Null html counts as an empty payload, a null url as "". Rows that repeat page_id and payload are all
responses if they have the smallest page_id. A null page_id is never the smallest. A very long payload makes as many segments as it
needs. Other columns are ignored. An empty table gives no archives and an empty result.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SEGMENT = 16_384
CHUNK = 4_096
ARCHIVE = 4_000_000
PIECE = 16_384  # bytes of an archive that are inflated at a time
DATE = "2024-01-01T00:00:00Z"
MIN_BYTES = 0


def with_referrals(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, refers_to: the page that has the response of an equal payload, null for responses."""
    p = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("key", F.unhex(F.sha2("payload", 256)))
    first = p.where(F.octet_length("payload") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return p.join(first, "key", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(payload[k : k + size]), payload[k : k + size]) for k in range(0, len(payload), size)]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[at : at + size])
        at += size + 2


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(*of: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, of)))}>"


def _record(fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {**fields, "Content-Length": len(block)}.items())
    return b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def page_records(name: str, page_id: int | None, url: str, payload: bytes, refers_to: int | None, segment: int = SEGMENT) -> list[bytes]:
    """The WARC records of a page; name tells rows apart that repeat a page_id."""
    url = "".join(url.split()) or "about:blank"
    own = _id("page", name)
    common = {"WARC-Target-URI": url, "WARC-Date": DATE, "X-Page-Id": "" if page_id is None else page_id, "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\nX-Payload-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        fields = {"WARC-Type": "revisit", "WARC-Record-ID": own, **common, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": refers_to, "Content-Type": "application/http;msgtype=response"}
        return [_record(fields, http)]
    block = http + chunked(payload)
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    first = {"WARC-Type": "response", "WARC-Record-ID": own, **common, "Content-Type": "application/http;msgtype=response"}
    if len(parts) > 1:
        first["WARC-Segment-Number"] = 1
    out = [_record(first, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": _id("page", name, k), "WARC-Target-URI": url, "WARC-Date": DATE, "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": k}
        if k == len(parts):
            more["WARC-Segment-Total-Length"] = len(block)
        out.append(_record(more, part))
    return out


def write_archives(pages: DataFrame, min_bytes: int = MIN_BYTES, segment: int = SEGMENT) -> DataFrame:
    """The archives, stored: part, number, data (gzip members, one for each record)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held, size, row = TaskContext.get().partitionId(), 0, [], 0, 0
        for b in batches:
            for page, url, payload, to in zip(b["page_id"], b["url"], b["payload"], b["refers_to"], strict=True):
                row += 1
                ids = [None if pd.isna(x) else int(x) for x in (page, to)]
                for r in page_records(f"{part}:{row}:{ids[0]}", ids[0], url, bytes(payload), ids[1], segment):
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    held.append(z.compress(r) + z.flush())
                    size += len(held[-1])
                    if size >= ARCHIVE:
                        yield pd.DataFrame({"part": [part], "number": [number], "data": [b"".join(held)]})
                        held, size, number = [], 0, number + 1
        if held:
            yield pd.DataFrame({"part": [part], "number": [number], "data": [b"".join(held)]})

    return stored(with_referrals(pages, min_bytes).mapInPandas(each, "part int, number int, data binary"), "none")


def read_members(data: bytes, segmented: bool | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive; segmented: only records that are segments, or only whole ones."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            piece = view[at : at + PIECE]
            if not len(piece):
                raise ValueError("cut WARC archive")
            out.append(z.decompress(piece))
            at += len(piece)
        at -= len(z.unused_data)
        head, _, rest = b"".join(out).partition(b"\r\n\r\n")
        if segmented is not None and (b"\r\nWARC-Segment-Number:" in head) != segmented:
            continue
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        if len(rest) < n:
            raise ValueError("short WARC record")
        yield fields, rest[:n]


RECORDS = "origin string, segment int, total long, page_id long, record_type string, refers_to long, stated string, block binary"


def _number(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if fields.get(name) else None


def read_records(archives: DataFrame, segmented: bool | None = None) -> DataFrame:
    """A row for each record: origin is the id of the record that it begins or continues; segment is 0 for whole records."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["data"]:
                rows = []
                for f, block in read_members(data, segmented):
                    rows.append((f.get("warc-segment-origin-id", f["warc-record-id"]), _number(f, "warc-segment-number") or 0, _number(f, "warc-segment-total-length"), _number(f, "x-page-id"), f["warc-type"], _number(f, "x-refers-to-page"), f.get("warc-payload-digest", "").removeprefix("sha1:"), block))
                if rows:
                    yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORDS.split(", ")]).astype({"total": "Int64", "page_id": "Int64", "refers_to": "Int64"})

    return archives.select("data").mapInPandas(each, RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records from segments. They meet by origin: a group is one record, whose blocks are put together at once."""
    parts = records.where("segment > 0").groupBy("origin").agg(
        F.expr("listagg(block) WITHIN GROUP (ORDER BY segment)").alias("block"), F.sort_array(F.collect_list("segment")).alias("numbers"), F.max("total").alias("total"), *(F.first(c, True).alias(c) for c in ("page_id", "refers_to")), F.max(F.when(F.col("segment") == 1, F.col("stated"))).alias("stated")
    )
    good = (F.col("total") == F.octet_length("block")) & (F.col("numbers") == F.sequence(F.lit(1), F.size("numbers")))
    checked = F.when(good, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments do not make up record "), F.col("origin"))).cast("binary"))
    return parts.select("page_id", F.lit("response").alias("record_type"), "refers_to", "stated", checked.alias("block"))


PAGES = "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(page: int | None, kind: str, to: int | None, stated: str, block: bytes) -> tuple:
    """A row of PAGES from a whole record."""
    head, _, body = block.partition(b"\r\n\r\n")
    length = int(head.lower().partition(b"x-payload-length:")[2].split(b"\r\n")[0])
    payload = unchunked(body) if kind == "response" else None
    if payload is not None and (len(payload) != length or digest(payload) != stated):
        raise ValueError("payload and headers disagree")
    return page, payload, length, stated, kind, to


def _pages(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in PAGES.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_pages(archives: DataFrame) -> DataFrame:
    """PAGES: payloads decoded and held against the stated length and digest; null for revisits, whose length and digest are those of the response. Whole records are decoded where they are read; segments are put together first."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["data"]:
                rows = [_page(_number(f, "x-page-id"), f["warc-type"], _number(f, "x-refers-to-page"), f.get("warc-payload-digest", "").removeprefix("sha1:"), block) for f, block in read_members(data, False)]
                if rows:
                    yield _pages(rows)

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _pages([_page(None if pd.isna(page) else int(page), kind, None if pd.isna(to) else int(to), stated, bytes(block)) for page, kind, to, stated, block in zip(b["page_id"], b["record_type"], b["refers_to"], b["stated"], b["block"], strict=True)])

    return archives.select("data").mapInPandas(whole, PAGES).unionByName(reassemble(read_records(archives, True)).mapInPandas(joined, PAGES))
