"""WARC archives with revisit records: write deduplicated, read back, resolve.

Only headers (page, digest, size) are shuffled by payload digest: first as
map-side maxima, so a payload that a third of all pages share meets as a few
partial rows, then in a join with the written maxima, whose hot digests adaptive
execution can split. Pages that are not the last of an equal payload become
revisits of it; the decision joins the pages by page, evenly, and Spark's text writer
puts each record on disk as bytes (a WARC record ends in CRLF CRLF, so CRLF is
the line end). Archives hold about ``Archive.bytes`` of payload each, written
with fresh headers: ids, digests, lengths and the fixed date are recomputed.

Reading takes whole archives of that bounded size, walks their records by
Content-Length, checks every payload against its digest, and joins revisits to
the original responses they name: by record id, or, where they have none, by
target URI and date. Archives of other writers are read, too: of WARC 1.0 and 1.1,
with header names in any case, digests in hex or base 32, and records of other
types between, which are passed over; a resource is a response without a head of
its own. The page headers are this writer's; records without them have null pages.

Defined results: null html is an empty payload; payloads below ``Archive.least``
bytes are always responses; a null url is left out of the headers; rows
repeated with one page_id and one payload are alike in type, and if they are the
last of their payload all are responses, each with a record id of its own, of
which revisits name the first; a page_id with several payloads is a record for
each, found again by its payload's digest; a null page_id is never referred to, and pages that
are all null-numbered are all responses; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomshed.llm.common import stored


@dataclass(frozen=True)
class Archive:
    """``least`` bytes of a payload that may be a revisit; about ``bytes`` of payload an archive."""

    least: int = 1000
    bytes: int = 8 << 20
    date: str = "2024-01-01T00:00:00Z"


_NONE = -(1 << 63)


def _hashed(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("page_id").cast("long"), F.lit(_NONE)).alias("key"),
        F.sha1(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).cast("long").alias("bytes"),
        "url",
        payload.alias("payload"),
    )


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, key, digest, bytes) of every page, written once: all that deduplication shuffles."""
    return stored(_hashed(pages).select("page_id", "key", "digest", "bytes"), "warc-headers")


def revisits(heads: DataFrame, spec: Archive = Archive()) -> DataFrame:
    """(key, digest, refers_to) of the headers whose equal payload has a larger page_id."""
    heads = heads.filter(F.col("bytes") >= spec.least)
    last = stored(
        heads.groupBy("digest").agg(
            F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("c")
        ).filter("c > 1 and refers_to is not null").select("digest", "refers_to"),
        "warc-last",
    )
    return heads.select("key", "digest").join(last, "digest").filter(F.col("key") != F.col("refers_to")).dropDuplicates(
        ["key", "digest"]
    )


def _record_id(page: Column, digest: Column, copy: Column) -> Column:
    """Record id of a page's payload; ``copy`` numbers rows that are equal in both, from 1."""
    h = F.md5(F.concat_ws(":", page.cast("string"), digest, F.nullif(copy.cast("string"), F.lit("1"))).cast("binary"))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(pages: DataFrame, spec: Archive = Archive()) -> DataFrame:
    """One column ``value``: each page's record, without its last CRLF."""
    rows, heads = _hashed(pages), headers(pages)
    total = heads.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-total // spec.bytes))
    told = rows.repartition(n, "key", "digest").join(
        revisits(heads, spec).repartition(n, "key", "digest"), ["key", "digest"], "left"
    )
    told = told.withColumn("copy", F.row_number().over(Window.partitionBy("key", "digest").orderBy("url")))
    crlf, revisit = F.lit("\r\n"), F.col("refers_to").isNotNull()
    # Control characters cannot stand in a header line.
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value, crlf)

    def maybe(name: str, value: Column) -> Column:
        return F.coalesce(line(name, value), F.lit(""))

    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line(
            "WARC-Record-ID",
            _record_id(F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.col("digest"), F.col("copy")),
        ),
        line("WARC-Date", F.lit(spec.date)),
        maybe("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest"), F.lit(1))),
                line("X-Refers-To-Page", F.col("refers_to").cast("string")),
            ),
        ).otherwise(""),
        maybe("X-Page-Id", F.col("page_id").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        crlf,
    )
    return told.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload")), crlf).alias("value"))


def write_archives(pages: DataFrame, path: str, spec: Archive = Archive()) -> None:
    """Write every page's record below ``path``, in gzipped archives."""
    records(pages, spec).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive's bytes; raises on anything else."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in data[at + 10 : end].decode().split("\r\n"):
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        start = end + 4
        stop = start + int(headers["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield headers, data[start:stop]
        at = stop + 4


def sha1_of(digest: str | None) -> str | None:
    """The hex form of a labelled SHA-1 in hex or base 32; null for other labels and none."""
    label, _, value = (digest or "").partition(":")
    if label.lower() != "sha1":
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(out)


_TEXTS = ("record_id", "record_type", "payload_digest", "url", "date", "refers_record", "refers_uri", "refers_date")
_NUMBERS = ("page_id", "payload_bytes", "refers_to")
_SCHEMA = ", ".join([*(f"{c} string" for c in _TEXTS), *(f"{c} long" for c in _NUMBERS), "payload binary"])
_ARROW = pa.schema([*((c, pa.string()) for c in _TEXTS), *((c, pa.int64()) for c in _NUMBERS), ("payload", pa.binary())])


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _row(h: dict[str, str], block: bytes, payloads: bool) -> dict | None:
    """One record's row; null for a type that is neither a payload nor a revisit of one."""
    kind = h.get("warc-type", "").lower()
    row = {
        "record_id": h.get("warc-record-id"),
        "page_id": _number(h.get("x-page-id")),
        "record_type": kind,
        "url": h.get("warc-target-uri"),
        "date": h.get("warc-date"),
        "payload_digest": sha1_of(h.get("warc-payload-digest")),
    }
    if kind == "revisit":
        return row | {
            "refers_to": _number(h.get("x-refers-to-page")),
            "refers_record": h.get("warc-refers-to"),
            "refers_uri": h.get("warc-refers-to-target-uri"),
            "refers_date": h.get("warc-refers-to-date"),
        }
    if kind not in ("response", "resource"):
        return None
    head, mark, payload = block.partition(b"\r\n\r\n")
    if kind == "resource" or not mark or not head.startswith(b"HTTP/"):
        payload = block
    digest = hashlib.sha1(payload).hexdigest()
    if row["payload_digest"] not in (None, digest):
        raise ValueError(f"payload of record {row['record_id']} does not match its digest")
    return row | {
        "record_type": "response", "payload_digest": digest, "payload_bytes": len(payload), "payload": payload if payloads else None
    }


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every response and revisit below ``path``. Responses carry size and digest of the payload as read
    (and the payload, if asked for); revisits carry what they name: a record, a URI and date, this writer's page."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = [r for h, block in parse(gunzip(content.as_py())) if (r := _row(h, block, payloads))]
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, _SCHEMA)


def resolve(found: DataFrame) -> DataFrame:
    """Records with every revisit's size, digest and page taken from the response it names.

    A revisit names a record, or, where it does not, a URI and a date (needs ``url``; of several responses
    there the first by record id). ``found`` is read several times, so store it if it comes from archives.
    A revisit whose response is missing, or has another digest, keeps a null size.
    """
    responses, back = found.filter("record_type = 'response'"), found.filter("record_type = 'revisit'")
    what = F.struct(F.col("page_id").alias("p"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    named = responses.filter("record_id is not null").groupBy(F.col("record_id").alias("refers_record")).agg(
        F.min(what).alias("_named")
    )
    back = back.join(named, "refers_record", "left")
    if "url" in found.columns:
        placed = responses.filter("url is not null and date is not null").groupBy(
            F.col("url").alias("refers_uri"), F.col("date").alias("refers_date")
        ).agg(F.min_by(what, "record_id").alias("_placed"))
        back = back.join(placed, ["refers_uri", "refers_date"], "left").withColumn(
            "_named", F.when(F.col("refers_record").isNull(), F.col("_placed")).otherwise(F.col("_named"))
        )
    same = F.col("payload_digest").isNull() | (F.col("payload_digest") == F.col("_named.d"))
    back = back.withColumns(
        {
            "payload_bytes": F.when(same, F.col("_named.b")),
            "payload_digest": F.coalesce("payload_digest", F.col("_named.d")),
            "refers_to": F.coalesce("refers_to", F.when(same, F.col("_named.p"))),
        }
    )
    return responses.unionByName(back.select(*found.columns))
