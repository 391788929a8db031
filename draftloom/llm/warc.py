"""WARC archives: writing, reading, and revisit resolution by payload digest."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches

#: Records of an archive file; with page-sized payloads some tens of MB before compression. It bounds what one task reads, not what
#: it holds: files are read as streams.
RECORDS_PER_FILE = 4_000
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: five hexadecimal digits of the digest give four characters."""
    digest = F.sha1(data)
    out = []
    for k in range(8):
        bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One response per row: record_id, page_id, uri, payload, payload_bytes, payload_digest.

    Null payloads are empty. Repeated ids stay apart. Line breaks in a URI are percent-encoded, as headers are lines.
    """
    data = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    uri = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(uri_col), F.lit("")), "\r", "%0D"), "\n", "%0A")
    out = pages.select(F.col(id_col).cast("long").alias("page_id"), uri.alias("uri"), data.alias("payload"))
    out = out.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    return out.withColumn("record_id", record_id(F.col("page_id"), F.col("payload_digest"), F.lit("response")))


def record_id(page_id: Column, digest: Column, kind: Column) -> Column:
    """A UUID made from the page, the payload and the kind of record: reruns and retried tasks write the same."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest, kind).cast("binary"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def write_archive(rows: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write rows of record_id, page_id, uri, payload, payload_bytes, payload_digest and, for revisits, refers_to (a
    page_id), refers_to_id and refers_to_uri, as WARC/1.1 files.

    Spark's text writer does it, with the end of a record as line separator: files appear whole when their task is
    committed, in any store that Spark writes. A revisit has no payload of its own; its length stands in an extension
    field. Files are gzip streams of many records.
    """
    revisit = F.col("refers_to_id").isNotNull() if "refers_to_id" in rows.columns else F.lit(False)
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    head = [
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", F.col("uri")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        field("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        field("X-Payload-Length", F.col("payload_bytes")),
    ]
    if "refers_to_id" in rows.columns:
        refers = [field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", F.col("refers_to_id")), field("WARC-Refers-To-Target-URI", F.col("refers_to_uri")), field("X-Refers-To-Page", F.col("refers_to"))]
        head.append(F.when(revisit, F.concat(*refers)).otherwise(F.lit("")))
    head += [field("Content-Type", F.lit("text/html; charset=utf-8")), field("Content-Length", F.octet_length(body)), F.lit("\r\n"), body]
    (
        rows.select(F.concat(*head).alias("value"))
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def stream_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record; blocks are cut by Content-Length alone.

    ``pieces`` are what stands between the END marks of one archive or of several, one after another. No more than a record
    and a piece is held. Line ends before a record are passed over; an archive that stops within a record is an error.
    """
    mark = END.encode()
    held, fields, start, need = bytearray(), {}, 0, 0
    for piece in pieces:
        held += piece
        held += mark
        while True:
            if not need:
                del held[: len(held) - len(held.lstrip(b"\r\n"))]
                if not held:
                    break
                cut = held.find(mark)
                if not held.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record at {bytes(held[:20])!r}")
                lines = held[:cut].decode().split("\r\n")[1:]
                fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
                start = cut + len(mark)
                need = start + int(fields["content-length"]) + len(mark)
            if len(held) < need:
                break
            if held[need - len(mark) : need] != mark:
                raise ValueError(f"{fields.get('warc-record-id')}: the record does not end where its length says")
            yield fields, bytes(held[start : need - len(mark)])
            del held[:need]
            need = 0
    if need:
        raise ValueError(f"{fields.get('warc-record-id')}: the archive stops within the record")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive that is at hand as a whole."""
    if not data.endswith(END.encode()):
        raise ValueError("the archive does not end where a record does")
    return stream_records([data])


ARCHIVED = "record_id string, record_type string, page_id long, uri string, payload_digest string, payload_bytes long, refers_to long, block binary"
#: Bytes of blocks that a batch from a reader holds; a longer block has a batch of its own.
BATCH_BYTES = 4_000_000


def read_archive(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """The records of all WARC files below ``path``, plain or gzip. A block that does not match its digest is an error.

    Spark's text reader unpacks gzip files as streams, which it never splits, and cuts them at END marks: a task holds a batch
    of pieces and one record, whatever the size of a file. Plain files, which this module does not write, are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in ARCHIVED.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        number = lambda text: int(text) if text else None
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows, size = [], 0
        for f, block in stream_records(piece.as_py() for batch in batches for piece in batch.column(0)):
            digest = f["warc-payload-digest"].removeprefix("sha1:")
            if f["warc-type"] == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                raise ValueError(f"{f['warc-record-id']}: the payload does not match its digest")
            rows.append((f["warc-record-id"], f["warc-type"], number(f.get("x-page-id")), f["warc-target-uri"], digest, number(f.get("x-payload-length")), number(f.get("x-refers-to-page")), block if blocks else None))
            size += len(block)
            if size > BATCH_BYTES:
                yield table(rows)
                rows, size = [], 0
        if rows:
            yield table(rows)

    def pieces(names: str, whole: bool) -> DataFrame:
        found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).text(path, wholetext=whole, lineSep=None if whole else END)
        return found.select(F.col("value").cast("binary"))

    zipped, plain = pieces("*.{txt.gz,warc.gz}", False), pieces("*.warc", True)
    return small_batches(zipped.unionAll(plain)).mapInArrow(run, ARCHIVED)


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """For each record that repeats a payload of at least ``min_bytes``: v_id, refers_to, refers_to_id, refers_to_uri.

    Headers alone are shuffled. Of the records with one digest and length the one with the largest page_id (null last,
    then the largest record_id) is the original; all others refer to it. The originals are pre-aggregated before the
    shuffle, and the join back to a digest that many records share is one that Spark can split.
    """
    big = headers.where(F.col("payload_bytes") >= min_bytes).select("payload_digest", "payload_bytes", "page_id", "record_id", "uri")
    best = F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("o"), F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("uri").alias("refers_to_uri"))
    firsts = big.groupBy(F.col("payload_digest").alias("o_digest"), F.col("payload_bytes").alias("o_bytes")).agg(F.max(best).alias("best"), F.count("*").alias("n")).where("n > 1")
    joined = big.join(firsts, (big.payload_digest == firsts.o_digest) & (big.payload_bytes == firsts.o_bytes))
    return joined.where(F.col("record_id") != F.col("best.refers_to_id")).select(F.col("record_id").alias("v_id"), "best.refers_to", "best.refers_to_id", "best.refers_to_uri")


def deduplicate_archive(spark: SparkSession, source: str, target: str, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Read the archives below ``source`` and write them to ``target``, repeated payloads replaced by revisit records with
    headers of their own. Records that are copies of one another (same page and payload) share an id; they stay responses
    together or become revisits together. An empty archive gives an empty one."""
    headers = read_archive(spark, source, blocks=False).drop("block")
    found = resolve_revisits(headers, min_bytes).dropDuplicates(["v_id"])
    joined = read_archive(spark, source).withColumnRenamed("block", "payload").drop("refers_to").join(found, F.col("record_id") == F.col("v_id"), "left")
    fresh = F.when(F.col("refers_to_id").isNotNull(), record_id(F.col("page_id"), F.col("payload_digest"), F.lit("revisit"))).otherwise(F.col("record_id"))
    write_archive(joined.withColumn("record_id", fresh), target, records_per_file)
