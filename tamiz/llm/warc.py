"""WARC archives without repeated payloads.

Headers (key, digest, length) are shuffled by payload digest; of equal payloads one record stays the response and the others become revisit
records that name it. The archives are written by Spark's text writer through the cluster's file system: a record is its WARC header, a
blank line, the HTTP header and the payload, and the line separator is the two line breaks that end a record. A file is one gzip stream.
Reading goes by Content-Length, record by record, and joins revisit records to their responses; it also takes archives as they are
published, with a gzip member per record, or not packed at all.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm.common import bound_batches, cut

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS = 32


def _record_id(page: Column, otherwise: Column) -> Column:
    """A uuid from the page's id, so that a retried task writes the same one."""
    h = F.md5(F.coalesce(F.concat(F.lit("page:"), page.cast("string")), otherwise))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def headers(pages: DataFrame, payload: Column) -> DataFrame:
    """``pages`` with the payload, its length and digest, and a salt that splits the rows of one digest."""
    body = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    return pages.withColumns({"_payload": F.coalesce(payload, F.lit("")), "_bytes": F.octet_length(body).cast("long"), "_digest": F.sha1(body), "_salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")})


def originals(heads: DataFrame, least_bytes: int) -> DataFrame:
    """(_digest, _salt, _original): of payloads that occur twice or more, the largest page_id, once for each salt that occurs.

    Rows are summed per digest and salt before they are shuffled, so a digest with a third of all rows is as cheap as any.
    """
    some = heads.where(F.col("_bytes") >= least_bytes).groupBy("_digest", "_salt").agg(F.max("page_id").alias("m"), F.count("*").alias("n"))
    top = some.groupBy("_digest").agg(F.max("m").alias("_original"), F.sum("n").alias("n"), F.collect_list("_salt").alias("salts")).where("n > 1 and _original is not null")
    return top.select("_digest", F.explode("salts").alias("_salt"), "_original")


def write(pages: DataFrame, path: str, least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 2000) -> None:
    """Write (page_id, url, html) as deduplicated archives under ``path``.

    Of equal payloads of at least ``least_bytes`` bytes, the one with the largest page_id is the response. A null payload is empty, a null
    url has no WARC-Target-URI, a null page_id has no WARC-Page-ID and is no original. Rows that repeat the original's page_id are
    responses too. An empty table gives an empty folder of archives.
    """
    heads = headers(pages.select("page_id", "url", "html"), F.col("html"))
    joined = heads.join(originals(heads.drop("_payload", "html"), least_bytes), ["_digest", "_salt"], "left")
    revisit = F.col("_original").isNotNull() & (F.col("_bytes") >= least_bytes) & ~F.col("_original").eqNullSafe(F.col("page_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit(END))
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.concat_ws("|", F.lit("none"), "_digest", "url"))),
        F.concat(F.lit("WARC-Page-ID: "), F.col("page_id").cast("string")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("_digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _record_id(F.col("_original"), F.lit("")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("_bytes"))).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit(END), http, F.when(revisit, "").otherwise(F.col("_payload")))
    joined.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _unpacked(content: bytes) -> Iterator[bytes]:
    """The bytes of a file, a piece at a time: a gzip stream, or many one after another, or plain text."""
    if not content.startswith(b"\x1f\x8b"):
        yield content
        return
    gunzip = None  # none between members, where zeros may stand
    for at in range(0, len(content), 1 << 16):
        piece = content[at : at + (1 << 16)]
        while piece := piece if gunzip else piece.lstrip(b"\0"):
            gunzip = gunzip or zlib.decompressobj(47)
            yield gunzip.decompress(piece)
            piece = gunzip.unused_data
            if gunzip.eof:
                gunzip = None
    if gunzip:
        raise ValueError("an archive is cut short")


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name, the first of a name; folded lines go on the line before, and lines without a colon are left out."""
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            name, value = line.split(b":", 1)
            last = name.strip().lower().decode("utf-8", "replace")
            if last in out:
                last = None
            else:
                out[last] = value.strip().decode("utf-8", "replace")
    return out


_GAP = re.compile(rb"\r?\n\r?\n")


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; unpacks a piece at a time."""
    pieces, held = _unpacked(content), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while not held.lstrip(b"\r\n"):
            held.clear()
            if not more():
                return
        del held[: len(held) - len(held.lstrip(b"\r\n"))]
        seen = 0
        while not (gap := _GAP.search(held, max(seen - 4, 0))):
            seen = len(held)
            if not more():
                raise ValueError("a record's header does not end")
        fields = _fields(bytes(held[: gap.start()]).splitlines()[1:])
        if not fields.get("content-length", "").isdigit():
            raise ValueError("a record has no Content-Length")
        end = gap.end() + int(fields["content-length"])
        while len(held) < end:
            if not more():
                raise ValueError("a record is cut short")
        yield fields, bytes(held[gap.end() : end])
        del held[:end]


def _sha1(declared: str | None) -> str | None:
    """A declared SHA-1 as lower-case hex, from hex or base 32; null for other digests and for none."""
    kind, _, value = (declared or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if len(value) == 32:
        try:
            return base64.b32decode(value.upper()).hex()
        except ValueError:
            return None
    return value.lower() if re.fullmatch("[0-9a-fA-F]{40}", value) else None


def _row(fields: dict[str, str], block: bytes) -> tuple:
    """A record's columns, with its payload: what comes after the HTTP header, if it has one, and else the block."""
    kind = fields.get("warc-type", "").lower() or None
    http, payload = {}, block
    if block.startswith(b"HTTP/") and (gap := _GAP.search(block)):
        http, payload = _fields(block[: gap.start()].splitlines()[1:]), block[gap.end() :]
    digest, declared = _sha1(fields.get("warc-payload-digest")), http.get("content-length", "")
    if kind == "revisit":
        size, intact = int(declared) if declared.isdigit() else None, not payload
    else:
        size, intact = len(payload), hashlib.sha1(payload).hexdigest() == digest and declared in ("", str(len(payload))) if digest else None
    page = fields.get("warc-page-id", "")
    found = (int(page) if re.fullmatch("-?[0-9]+", page) else None, fields.get("warc-target-uri"), fields.get("warc-record-id"), kind, fields.get("warc-refers-to"), size, digest, intact)
    return (*found, None if kind == "revisit" else payload)


_SCHEMA = "page_id long, url string, record_id string, record_type string, refers_to_id string, payload_bytes long, payload_digest string, intact boolean"


def _reader(with_payload: bool):
    names = [x.split()[0] for x in _SCHEMA.split(", ")] + ["payload"] * with_payload
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for files in batches:
            for content in files.column(0):
                rows, size = [], 0
                for fields, block in _records(content.as_py()):
                    rows.append(_row(fields, block)[: len(names)])
                    size += len(block) * with_payload + 200
                    if size > 4_000_000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return read


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives under ``path`` (names that end in .gz or .warc).

    A task holds one packed archive at a time (see ``records_per_file``) and unpacks it record by record. Archives of others may lack what
    ``write`` puts in: a record without WARC-Page-ID has a null page_id; a digest that is no SHA-1, or none, is null; payload_bytes of a revisit
    without an HTTP Content-Length is null. ``intact`` tells whether a payload has its declared digest and length (a revisit: has none), and is null
    without a digest. Records of further types are returned with theirs. Header fields may be folded, in any case, without a space after
    the colon, or repeated (the first counts). A record without Content-Length, or cut short, is an error.
    """
    bound_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path)
    return files.select("content").mapInArrow(_reader(with_payload), _SCHEMA + ", payload binary" * with_payload)


def resolve(records: DataFrame) -> DataFrame:
    """Responses and revisits with ``refers_to``: for a revisit, the page_id of the response it names (null if that isn't there); and its payload, if read."""
    extra = ["payload"] if "payload" in records.columns else []
    kept = [c for c in records.columns if c not in ("refers_to_id", *extra)]
    responses = records.where("record_type = 'response'")
    # rows that repeat a page_id give one record twice; written, so that skew handling can split a record that many name
    targets = cut(responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), *extra).dropDuplicates(["refers_to_id"]), "responses")
    revisits = records.where("record_type = 'revisit'").select(*kept, "refers_to_id").join(targets, "refers_to_id", "left").select(*kept, "refers_to", *extra)
    return responses.select(*kept, F.lit(None).cast("long").alias("refers_to"), *extra).unionByName(revisits)
