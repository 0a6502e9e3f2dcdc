"""WARC archives: writing, reading, and the resolution of revisits.

A record is a header and a payload; archives are written by Spark's text writer, one record per
row, so that they are committed as every Spark output is, and lost tasks are done again. Archives
are compressed. They are read as binary files, unpacked and cut at the lengths that the headers state
piece by piece, so that a task holds a compressed archive and one record, not what an archive unpacks to.

Revisit resolution: headers (digest, length, id) are aggregated by the payload digest; the least id of
a digest that several records have is the response, and the others become revisits of it. The records
are joined to these answers by digest, which moves each payload once (short ones, which cannot be revisits,
stay where they are); revisits then drop theirs and
every record gets a fresh header. Reading back, revisits are joined to the responses they name, without
payloads. A digest that a third of the records share is reduced by partial aggregation, and the join to
it is one that adaptive execution may split.

Defined cases: a null payload is empty. Payloads under ``least_bytes`` are always responses. Rows
that repeat the id of their response are responses too. Null ids sort last and stay null.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmend.llm.common import shared_folder

#: Names of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
ARCHIVE_RECORDS = 20_000
# What is unpacked at a time, and blocks of records handed on together (or one larger).
PIECE_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
END = "\r\n\r\n"


def record_id(record_key: Column, payload_digest: Column) -> Column:
    """A name that follows from id and payload: a repeated task writes the same one."""
    h = F.md5(F.concat_ws("|", record_key.cast("string"), payload_digest))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
                    F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def header(fields: list[tuple[str, Column]]) -> Column:
    """The lines of a header; fields that are null are left out. Line ends inside a value become
    blanks."""
    lines = [F.when(value.isNotNull(), F.concat(
        F.lit(f"\r\n{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "))) for name, value in fields]
    return F.concat(F.lit(VERSION), *[F.coalesce(line, F.lit("")) for line in lines], F.lit(END))


def resolve(records: DataFrame, *, least_bytes: int = 100) -> DataFrame:
    """``records`` (``id``, ``uri``, ``payload`` as text) with ``payload_bytes``, ``payload_digest``,
    ``record_type`` and ``refers_to``."""
    payload = F.coalesce("payload", F.lit(""))
    sized = records.select(
        "id", "uri", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"))
    # Headers only: id, digest and length; digests that one record has need no join.
    first = (sized.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
             .agg(F.min("id").alias("first_id"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    joined = sized.where(F.col("payload_bytes") >= least_bytes).join(first, "payload_digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    short = sized.where(F.col("payload_bytes") < least_bytes).select(
        "id", "uri", "payload", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
        F.lit(None).cast(records.schema["id"].dataType).alias("refers_to"))
    return short.unionByName(joined.select(
        "id", "uri", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to")))


def write_archives(resolved: DataFrame, folder: str, date: str = EPOCH) -> None:
    """Archives of fresh headers: responses with their payload, revisits without. ``date`` is the
    ``WARC-Date`` of all records (one value, so that a repeated task writes the same bytes)."""
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = header([
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", record_id(F.col("id"), F.col("payload_digest"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("uri")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        ("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to"), F.col("payload_digest")))),
        ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        ("X-Record-Key", F.col("id")),
        ("Content-Length", F.octet_length(block)),
    ])
    (resolved.select(F.concat(head, block).alias("value")).write
     .option("lineSep", END).option("maxRecordsPerFile", ARCHIVE_RECORDS).option("compression", "gzip").text(folder))


def unpacked(data: bytes) -> Iterator[bytes]:
    """The content of an archive, with or without compression (one member or many), piece by piece."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        member = zlib.decompressobj(wbits=31)
        while not member.eof and data:
            piece = member.decompress(data, PIECE_BYTES)
            data = member.unused_data if member.eof else member.unconsumed_tail
            if piece:
                yield piece
        if not member.eof:
            raise ValueError("a compressed archive is cut off")


def records_in(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    pieces, held, end = unpacked(data), bytearray(), END.encode()

    def until(enough) -> bool:
        while not enough():
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    searched = 0
    while until(lambda: len(held) > 0):
        def header_ends() -> bool:
            nonlocal searched
            found = held.find(end, searched)
            # The end may lie across two pieces.
            searched = found if found >= 0 else max(0, len(held) - len(end))
            return found >= 0

        searched = 0
        if not until(header_ends):
            raise ValueError(f"a record without an end: {bytes(held[:40])!r}")
        stop = searched
        first, *lines = held[:stop].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record here: {first[:40]!r}")
        fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        begin = stop + len(end)
        length = int(fields["content-length"])
        if not until(lambda: len(held) >= begin + length):
            raise ValueError("a record is cut off")
        yield fields, bytes(held[begin:begin + length])
        until(lambda: len(held) >= begin + length + len(end))
        del held[:begin + length + len(end)]


SCHEMA = ("record_type string, record_id string, uri string, record_key string, refers_to_record string, "
          "stated_digest string, payload binary, payload_digest string, payload_bytes long")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives below the folder; digest and length are of the block as read."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for fields, block in records_in(data.as_py()):
                    size += len(block)
                    rows.append((fields["warc-type"], fields["warc-record-id"], fields.get("warc-target-uri"),
                                 fields.get("x-record-key"), fields.get("warc-refers-to"),
                                 fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                                 block, hashlib.sha256(block).hexdigest(), len(block)))
                    if len(rows) == 1000 or size > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 6 + [pa.binary(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return files.mapInArrow(run, SCHEMA)


def resolved_records(records: DataFrame) -> DataFrame:
    """Records of archives with revisits resolved: ``refers_to`` is the key of the response, and
    length and digest are the response's. Only headers are shuffled."""
    heads = records.drop("payload")
    responses = heads.where("record_type = 'response'").groupBy("record_id").agg(
        F.min("record_key").alias("refers_to"), F.min("payload_digest").alias("_digest"), F.min("payload_bytes").alias("_bytes"))
    revisit = F.col("record_type") == "revisit"
    # Responses refer to nothing: their null key is spread, not gathered in one task.
    joined = heads.where(revisit).join(
        responses.withColumnRenamed("record_id", "refers_to_record"), "refers_to_record", "left").select(
        "record_key", "uri", "record_type", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "refers_to")
    plain = heads.where(~revisit).select(
        "record_key", "uri", "record_type", "payload_bytes", "payload_digest", F.lit(None).cast("string").alias("refers_to"))
    return plain.unionByName(joined)


def deduplicate(records: DataFrame, folder: str | None = None, *, least_bytes: int = 100, date: str = EPOCH) -> DataFrame:
    """Write deduplicated archives of ``records`` (``id``, ``uri``, ``payload``) and read them back."""
    spark = records.sparkSession
    folder = folder or shared_folder(spark)
    write_archives(resolve(records, least_bytes=least_bytes), folder, date)
    return resolved_records(read_archives(spark, folder))
