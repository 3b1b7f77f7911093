"""WARC archives: written by Spark's text writer, read back by length, and assembled to captures.

A capture is a request, a response (or a revisit of an earlier one) and a metadata record. The writer makes every record
with SQL expressions; a record's last line end is the writer's line separator, so each file is a gzipped WARC file, whose
size in bytes is bounded through the largest capture. The reader inflates a file piece by piece, whether it is one gzip
member, one for each record, or plain, follows Content-Length, never the separator, and computes digests from the bytes
it reads. What an archive holds after damage is left out; a row of kind "damaged" says what and where.

Request and metadata name the records they belong to in WARC-Concurrent-To, which may be there several times;
``assemble`` joins on it and gives one nested row for each capture.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.cluster import Scratch, ship, then_give_back

#: Bytes of captures in one file, but for a larger single one; payloads below so many bytes are always stored; bytes that
#: are inflated at once; bytes of rows that leave a worker at once.
FILE_BYTES, LEAST_REVISIT, PIECE, BATCH_BYTES = 64 << 20, 100, 1 << 20, 8 << 20
#: What a capture's records need besides the payload and two or three urls.
OVERHEAD = 4_096
_END = "\r\n"
RECORD = "record_id string, kind string, target string, date string, concurrent_to array<string>, refers_to string, block_digest string, payload_bytes long, payload_sha256 string, payload binary, fields map<string,string>"


def _identifier(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}:"), key).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[part for a, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for part in (F.substring(h, a, n), F.lit("-"))], F.substring(h, 21, 12), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1{_END}")]
    for name, value in headers:
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(_END))).otherwise(F.lit("")))
    lines += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END * 2), block, F.lit(_END)]
    return F.concat(*lines)


def write_archives(pages: DataFrame, folder: str, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a capture for each row below ``folder``; the payload is the html in UTF-8 (null: empty).

    Of rows with equal payloads of at least LEAST_REVISIT bytes, the one with the smallest id is stored as a response
    and the others as revisits that refer to it; shorter payloads are always stored. A record is named by id and
    payload: repeated rows are stored again under the same name. Line ends in urls are taken out, a null url is an empty
    one; null ids sort last and are kept.
    """
    page = pages.select(F.col(id_column).cast("long").alias("page"), F.regexp_replace(F.coalesce(F.col(url_column).cast("string"), F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("body"))
    page = page.withColumn("digest", F.sha2("body", 256)).withColumn("size", F.octet_length("body"))
    order = F.struct(F.col("page").isNull(), "page")
    again = page.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).filter("n > 1")
    page = page.join(again.select(F.col("digest").alias("same"), F.lit(True).alias("found"), F.col("first.page").alias("first_page")), F.col("digest") == F.col("same"), "left")
    known = F.coalesce(F.col("found"), F.lit(False)) & ~F.col("page").eqNullSafe(F.col("first_page"))
    key = lambda number: F.concat_ws("/", F.coalesce(number.cast("string"), F.lit("null")), F.col("digest"))
    own = key(F.col("page"))
    response, day, digest = _identifier("response", own), F.lit(date), F.concat(F.lit("sha256:"), F.col("digest"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("size").cast("string"), F.lit(_END * 2))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", day)]
    stored = _record([("WARC-Type", F.lit("response")), ("WARC-Record-ID", response), *common, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(head, F.col("body")))
    revisit = _record([("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", response), *common, ("WARC-Refers-To", _identifier("response", key(F.col("first_page")))), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))], head)
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _identifier("request", own)), *common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{_END * 2}")))
    about = F.concat(F.when(F.col("page").isNotNull(), F.concat(F.lit("page-id: "), F.col("page").cast("string"), F.lit(_END))).otherwise(F.lit("")), F.lit(f"fetchTimeMs: 0{_END}"))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _identifier("metadata", own)), *common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))], about)
    whole = F.concat(request, F.lit(_END), F.when(known, revisit).otherwise(stored), F.lit(_END), metadata)
    most = page.agg(F.max(F.col("size") + 4 * F.octet_length("url"))).first()[0] or 0
    captures = max(1, FILE_BYTES // (most + OVERHEAD))  # as many of the largest as a file may hold
    page.select(whole.alias("value")).write.mode("overwrite").option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", captures).text(folder)


class Damaged(ValueError):
    """An archive that cannot be read on."""


def _inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of a gzipped or plain archive, at most PIECE at a time; members follow each other."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), PIECE):
            yield data[at : at + PIECE]
        return
    left = memoryview(data)
    while len(left):
        stream, at = zlib.decompressobj(31), 0
        try:
            while not stream.eof:
                held = stream.unconsumed_tail or bytes(left[at : at + PIECE])
                if not stream.unconsumed_tail:
                    at += len(held)
                out = stream.decompress(held, PIECE)
                if out:
                    yield out
                if not held and not out and not stream.eof:
                    raise Damaged("a gzip member that is cut off")
        except zlib.error as error:
            raise Damaged(f"a gzip member that is broken ({error})") from error
        left = left[at - len(stream.unused_data) :]


class _Reader:
    """Bytes of an archive in order, of which only the record that is read is held."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, bytearray(), 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to a mark, which is left out; None at the end of the archive."""
        searched = 0
        while (found := self.held.find(mark, searched)) < 0:
            searched = max(0, len(self.held) - len(mark))
            if not self.more():
                if self.held.strip():
                    raise Damaged("a record's header that is cut off")
                return None
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        self.at += found + len(mark)
        return out

    def take(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self.more():
                raise Damaged("a record that is cut off")
        out = bytes(self.held[:size])
        del self.held[:size]
        self.at += size
        return out


def records_in(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Header fields, with all of their values, and block of each record of an archive, by Content-Length."""
    reader = _Reader(_inflated(data))
    while (head := reader.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise Damaged(f"no record at byte {reader.at}")
        fields: dict[str, list[str]] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        size = fields.get("content-length", [""])[0]
        if not size.isdigit():
            raise Damaged(f"a record without a length at byte {reader.at}")
        block = reader.take(int(size))
        if reader.take(4) != b"\r\n\r\n":
            raise Damaged(f"no end of record at byte {reader.at}")
        yield fields, block


def _row(fields: dict[str, list[str]], block: bytes, payloads: bool) -> tuple:
    one = lambda name: fields.get(name, [None])[0]
    kind, size, sha, body, about = one("warc-type"), None, None, None, None
    if kind == "response":
        _, mark, payload = block.partition(b"\r\n\r\n")
        payload = payload if mark else block
        size, sha, body = len(payload), hashlib.sha256(payload).hexdigest(), payload if payloads else None
        if (said := one("warc-payload-digest")) and said.startswith("sha256:") and said != f"sha256:{sha}":
            kind = "damaged"
    elif kind == "metadata":
        about = [tuple(line.split(": ", 1)) for line in block.decode("utf-8", "replace").split("\r\n") if ": " in line]
    return one("warc-record-id"), kind, one("warc-target-uri"), one("warc-date"), fields.get("warc-concurrent-to"), one("warc-refers-to"), one("warc-payload-digest"), size, sha, body, about


def read_archives(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """A row for each record (RECORD). ``payload_bytes`` and ``payload_sha256`` are computed from what was read, for
    responses only; ``payload`` is left null without ``payloads``. ``fields`` holds those of a metadata block. A response
    whose digest does not fit is of kind "damaged", and so is a row for the rest of a file that cannot be read on, whose
    ``target`` says why."""
    ship(spark)
    files = spark.read.format("binaryFile").load(folder).select("content")
    names = [part.split()[0] for part in RECORD.split(", ")]
    kinds = [pa.string()] * 4 + [pa.list_(pa.string())] + [pa.string()] * 2 + [pa.int64(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.string())]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                try:
                    for fields, block in records_in(content.as_py()):
                        rows.append(_row(fields, block, payloads))
                        held += 500 + len(rows[-1][9] or b"")
                        if held >= BATCH_BYTES:
                            yield told(rows)
                            rows, held = [], 0
                except Damaged as error:
                    rows.append((None, "damaged", str(error), *[None] * 8))
                if rows:
                    yield told(rows)

    return files.mapInArrow(then_give_back(parse), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: record_id, target, date, response (a struct of the response or revisit), request and
    metadata (structs, null if there is none; with several, the one with the smallest id).

    Request and metadata belong to the records that their concurrent-to identifiers name, all of them; those that name no
    response or revisit are left out, and so is what is damaged.
    """
    made = F.struct("record_id", "kind", "refers_to", "block_digest", "payload_bytes", "payload_sha256", "payload")
    main = records.filter(F.col("kind").isin("response", "revisit")).select("record_id", "target", "date", made.alias("response"))
    side = records.filter(F.col("kind").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    small = F.struct("record_id", "target", "date")
    side = side.withColumn("_of", F.explode(F.array_distinct("concurrent_to")))
    parts = side.groupBy("_of").agg(
        F.min(F.when(F.col("kind") == "request", small)).alias("request"),
        F.min_by(F.struct("record_id", "fields"), F.when(F.col("kind") == "metadata", F.col("record_id"))).alias("metadata"),
    )
    return main.join(parts, main["record_id"] == parts["_of"], "left").drop("_of")


def warc_captures(pages: DataFrame, **columns: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) for each row of ``pages``, from archives that
    are written to the shared folder and read back.

    Size and digest of a revisit come from the response it refers to. Pages are stored whole, however long. Null html is an empty payload; repeated rows come
    back as often as they are; a null id is kept as null; an empty table gives an empty result; other columns play no part.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    write_archives(pages, scratch.path("archives"), **columns)
    captures = scratch.table(assemble(read_archives(spark, scratch.path("archives"), payloads=False)).select("record_id", F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), "response"), "captures")
    scratch.drop("archives")
    seen = captures.filter("response.kind = 'response'")
    wanted = captures.filter("response.kind = 'revisit'").select(F.col("response.refers_to").alias("record_id")).distinct()
    named = seen.join(wanted, "record_id", "left_semi").groupBy(F.col("record_id").alias("_to")).agg(F.min("page_id").alias("_page"), F.min("response.payload_bytes").alias("_bytes"), F.min("response.payload_sha256").alias("_sha"))
    out = captures.join(named, captures["response.refers_to"] == named["_to"], "left")
    return out.select("page_id", F.coalesce("response.payload_bytes", "_bytes").alias("payload_bytes"), F.coalesce("response.payload_sha256", "_sha").alias("payload_digest"), F.col("response.kind").alias("record_type"), F.col("_page").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
