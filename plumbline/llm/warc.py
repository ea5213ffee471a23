"""WARC archives: writing, reading, and resolving equal payloads into revisit records.

Archives are written and committed by Spark's text writer, whose strings are bytes to it, so payloads of
any charset go through unchanged. They are read as a stream of pieces that Spark cuts at a record's
first letters and put together again by Content-Length, so an archive of any size needs the memory of
one record, and one gzip member for each record is as good as one for all. Only headers are shuffled to
find equal payloads; the records are then written anew, equal payloads once, the others as revisit
records that name the response. Records of other kinds pass as they are.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import forget, fresh_path, skew_join, written

# What every record begins with, and names of header fields.
MARK = "WARC/1."
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Kinds of record with a payload of their own.
CARRIERS = ("response", "resource")
#: Records of one archive, and bytes that a reading task holds before it sends them on.
RECORDS, HELD = 2000, 8 << 20
_EOL = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of bytes: 40 bits at a time from the hex digits."""
    digest = F.sha1(payload)
    part = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*part), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _clean(url: Column) -> Column:
    return F.regexp_replace(url, "[\r\n]", "%0A")


def _as_it_is() -> Column:
    """Whether a record's header is kept whole: kinds without a payload of their own, and revisits for another reason than an equal payload."""
    return F.coalesce(F.col("extra"), F.lit("")).rlike("(?im)^warc-type:")


def rendered(records: DataFrame) -> DataFrame:
    """One text for each record, without its last line end.

    records: record, url, date, kind, digest, http, payload (binary), type (of the block), extra (further
    header lines, each with its end), refers_to (a record's name), refers_to_url, refers_to_date. A
    revisit has its HTTP head and no payload. Where the extra lines name the kind, they are the whole header.
    """
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_EOL)), F.lit(""))
    named = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    revisit = F.col("kind") == "revisit"
    nothing = F.lit("").cast("binary")
    http, payload = F.coalesce("http", nothing), F.when(revisit & ~_as_it_is(), nothing).otherwise(F.coalesce("payload", nothing))
    known = F.concat(
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", named("record")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", _clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, named("refers_to"))),
        line("WARC-Refers-To-Target-URI", F.when(revisit, _clean(F.col("refers_to_url")))),
        line("WARC-Refers-To-Date", F.when(revisit, F.col("refers_to_date"))),
        line("Content-Type", F.col("type")),
    )
    known = F.when(_as_it_is(), "").otherwise(known)
    length = F.octet_length(http) + F.octet_length(payload)
    head = F.concat(F.lit(VERSION + _EOL), known, F.coalesce("extra", F.lit("")), F.lit("Content-Length: "), length.cast("string"), F.lit(_EOL + _EOL))
    return records.select(F.concat(head.cast("binary"), http, payload, F.lit(_EOL).cast("binary")).cast("string").alias("value"))


def write_archives(records: DataFrame, path: str, records_each: int = RECORDS) -> None:
    rendered(records).write.option("lineSep", _EOL).option("compression", "gzip").option("maxRecordsPerFile", records_each).text(path)


_LENGTH = re.compile(rb"^content-length:\s*(\d+)", re.I | re.M)
_END = b"\r\n\r\n"
#: Fields that are written fresh; the other lines of a header are kept as they stand.
_FRESH = frozenset("warc-type warc-record-id warc-date warc-target-uri warc-payload-digest warc-profile warc-refers-to warc-refers-to-target-uri warc-refers-to-date content-type content-length warc-block-digest warc-truncated-length".split())


def parsed(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields by lower-case name, the header's lines, block) of each record, from what stands between the MARKs of an archive.

    Content-Length says where a record ends, wherever MARK occurs in it. ValueError where an archive
    has something between records or ends in the middle of one.
    """
    mark = MARK.encode()
    held: list[bytes] = []
    need = 0
    for k, piece in enumerate(pieces):
        if not held:
            if k == 0 or not piece:
                if piece.strip():
                    raise ValueError("an archive does not begin with a record")
                continue
            stop = piece.find(_END)
            head, need = piece[:stop], 0
            if stop >= 0 and (m := _LENGTH.search(head)):
                need = stop + 4 + int(m[1])
            else:
                raise ValueError("a record without a length")
            held, size = [piece], len(piece)
        else:
            held += [mark, piece]
            size += len(mark) + len(piece)
        if size < need:
            continue
        whole = b"".join(held) if len(held) > 1 else held[0]
        if whole[need:].strip():
            raise ValueError("something stands between two records")
        stop = whole.index(_END)
        lines = whole[:stop].split(b"\r\n", 1)[1:]
        fields = {n.lower(): v.strip() for n, _, v in (x.partition(":") for x in lines[0].decode("utf-8", "replace").split(_EOL))} if lines else {}
        yield fields, lines[0] if lines else b"", whole[stop + 4 : need]
        held = []
    if held:
        raise ValueError("an archive ends in the middle of a record")


HEADERS = "spot string, record string, url string, date string, kind string, digest string, size long, refers_to string, refers_to_url string, refers_to_date string, type string, extra string"


def _row(spot: str, fields: dict[str, str], lines: bytes, block: bytes) -> tuple:
    """The columns of HEADERS, then the HTTP head and the payload."""
    kind, media = fields.get("warc-type", ""), fields.get("content-type")
    http, payload = b"", block
    if (media or "").lower().startswith("application/http") and kind in (*CARRIERS, "revisit"):
        stop = block.find(_END) + 4
        http, payload = (block[:stop], block[stop:]) if stop >= 4 else (block, b"")
    size, digest, extra = len(payload), None, lines
    if kind in CARRIERS:
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    elif kind == "revisit":
        found = _LENGTH.search(http)
        size = int(found[1]) if found else None
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind in CARRIERS or (kind == "revisit" and "identical-payload-digest" in fields.get("warc-profile", "identical-payload-digest")):
        extra = b"\r\n".join(x for x in lines.split(b"\r\n") if x.partition(b":")[0].decode("utf-8", "replace").lower() not in _FRESH)
    else:
        extra = b"\r\n".join(x for x in lines.split(b"\r\n") if not x.lower().startswith(b"content-length"))
    named = lambda c: fields.get(c, "").strip("<>") or None
    text = extra.decode("utf-8", "replace")
    return spot, named("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), kind, digest, size, named("warc-refers-to"), fields.get("warc-refers-to-target-uri"), fields.get("warc-refers-to-date"), media, text + _EOL if text else "", http, payload


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all gzipped archives under a path: the columns of HEADERS, with ``payloads`` also http and payload (binary).

    spot is the archive and the place in it. digest and size are computed from the payload where the
    record has one; a revisit has those that it claims. The payload of a response is what follows its
    HTTP head, as stored.
    """
    names = [x.split()[0] for x in HEADERS.split(", ")] + ["http", "payload"] * payloads
    schema = pa.schema([(n, pa.int64() if n == "size" else pa.binary() if n in ("http", "payload") else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def runs() -> Iterator[tuple[str, bytes]]:
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)

        pieces, ahead = runs(), None
        ahead = next(pieces, None)
        while ahead:
            file = ahead[0]

            def own(file=file) -> Iterator[bytes]:
                nonlocal ahead
                while ahead and ahead[0] == file:
                    piece = ahead[1]
                    ahead = next(pieces, None)
                    yield piece

            name = hashlib.blake2b(file.encode(), digest_size=8).hexdigest()
            for k, record in enumerate(parsed(own())):
                rows.append(_row(f"{name}:{k}", *record)[: len(names)])
                held += len(record[2]) * payloads + 200
                if held > HELD:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    # gzip does not split, so the pieces of an archive come in one task, in order
    text = spark.read.option("lineSep", MARK).option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary")).mapInArrow(run, HEADERS + ", http binary, payload binary" * payloads)


def _key(record: Column) -> Column:
    """The number in a record's name, by which responses are chosen."""
    return F.regexp_extract(record, "^urn:page:(-?[0-9]*):", 1).try_cast("long")


def as_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, date: str) -> DataFrame:
    """Response records of pages, named urn:page:<id>:<a number of its own>; null html is an empty payload."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    record = F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.monotonically_increasing_id().cast("string"))
    none = F.lit(None).cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(_EOL + _EOL)).cast("binary")
    return pages.select(record.alias("record"), F.col(url_col).alias("url"), F.lit(date).alias("date"), F.lit("response").alias("kind"), base32_sha1(payload).alias("digest"), http.alias("http"), payload.alias("payload"), F.lit("application/http; msgtype=response").alias("type"), none.alias("extra"), none.alias("refers_to"), none.alias("refers_to_url"), none.alias("refers_to_date"))


def decided(heads: DataFrame, least: int) -> DataFrame:
    """(spot, to): what each record that revisits another refers to, as (record, url, date) of a response.

    Of records with equal payloads of ``least`` bytes or more that with the largest id (ties: the
    greatest name, then spot) is the response and the others revisit it. A revisit that is there already goes to
    the response that has become of the record it refers to, or, where that is not among the archives,
    to that with the payload digest it claims; where neither is, it has no row and stays as it is.
    """
    total = heads.count()
    own = heads.where(F.col("kind").isin(*CARRIERS) & (F.col("size") >= least))
    best = F.max(F.struct(F.coalesce(_key(F.col("record")), F.lit(-(1 << 63))).alias("k"), "record", "spot", "url", "date")).alias("top")
    tops = own.groupBy("digest").agg(best, F.count("*").alias("w"))
    to = F.struct("top.record", "top.url", "top.date").alias("to")
    met = skew_join(own.select("spot", "record", "digest"), tops.where("w > 1"), "digest", "w", total, "spot", "inner")
    moved = met.where(F.col("spot") != F.col("top.spot")).select("spot", "record", to)
    old = heads.where((F.col("kind") == "revisit") & ~_as_it_is()).select("spot", "refers_to", "digest")
    # what each record that carries a payload has become, by name
    carriers = heads.where(F.col("kind").isin(*CARRIERS)).groupBy("record").agg(F.min(F.struct("record", "url", "date")).alias("itself"))
    became = carriers.join(moved.groupBy("record").agg(F.min("to").alias("to")), "record", "left").select(F.col("record").alias("refers_to"), F.coalesce("to", "itself").alias("to"))
    asked = old.groupBy("refers_to").agg(F.count("*").alias("w"))
    by_name = skew_join(old, became.join(asked, "refers_to"), "refers_to", "w", total, "spot", "left")
    claims = old.groupBy("digest").agg(F.count("*").alias("claims"))
    by_digest = tops.join(claims, "digest").select("digest", F.col("claims").alias("w"), F.struct("top.record", "top.url", "top.date").alias("same"))
    both = skew_join(by_name, by_digest, "digest", "w", total, "spot", "left")
    again = both.select("spot", F.coalesce("to", "same").alias("to")).where(F.col("to").isNotNull())
    return moved.select("spot", "to").unionByName(again)


def resolve_revisits(spark: SparkSession, source: str, target: str, least: int = 0) -> None:
    """Write the archives under ``source`` anew under ``target``, every payload of ``least`` bytes or more once.

    Headers alone are grouped by digest and joined to their response; a hot digest is met by
    ``skew_join``. Payloads move once, to meet what was decided about their record. Digests of records
    with a payload are not believed but computed. A record keeps its HTTP head and the header lines that
    are not about what it refers to; warcinfo, request, metadata and other kinds stay as they are, and so
    do revisits of what is not there. A second run changes nothing.
    """
    heads = written(read_archives(spark, source), "headers")
    found = decided(heads, least).withColumnRenamed("spot", "at")
    full = read_archives(spark, source, payloads=True)
    out = full.join(found, full["spot"] == found["at"], "left")
    other = {"refers_to": "record", "refers_to_url": "url", "refers_to_date": "date"}
    out = out.withColumns({c: F.when(F.col("to").isNotNull(), F.col(f"to.{x}")).otherwise(F.col(c)) for c, x in other.items()})
    write_archives(out.withColumn("kind", F.when(F.col("to").isNotNull(), "revisit").otherwise(F.col("kind"))), target)


def deduplicated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "2000-01-01T00:00:00Z", path: str | None = None) -> DataFrame:
    """One row per page, read back from the deduplicated archives: (id, record, url, size, digest, kind, refers_to, refers_to_id).

    Null html is an empty payload, a null url has no target line, rows may repeat (each is a record of
    its own). Pages of any size are written whole. An empty table gives no rows; further columns are
    ignored. Archives go under ``path``, where the first ones stay too, or a new folder in the shared one.
    """
    spark = pages.sparkSession
    base = path or fresh_path(spark, "warc")
    write_archives(as_records(pages, id_col, url_col, html_col, date), f"{base}/original")
    resolve_revisits(spark, f"{base}/original", f"{base}/deduplicated", least)
    if path is None:
        forget(spark, f"{base}/original")
    back = read_archives(spark, f"{base}/deduplicated")
    return back.select(_key(F.col("record")).alias("id"), "record", "url", "size", "digest", "kind", "refers_to", _key(F.col("refers_to")).alias("refers_to_id"))
