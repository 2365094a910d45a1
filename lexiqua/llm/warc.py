"""WARC archives: write, normalise to one gzip member per record, read back by offset.

Spark's text writer makes monolithic archives, one gzip stream per file, wherever the folder is.
The normaliser inflates such a stream once, record by record, writes each record as a member of
its own, and beside the archive a sidecar index with every member's offset and length.  A task
holds one record at a time.  Files get their final name when they are complete, and a repeated
task writes the same bytes again, so a lost executor costs only its own archives.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.joins import lookup_join
from ..plans.staging import fresh_path, stage

#: Records per archive, bytes read from a stream at a time.
RECORDS_PER_ARCHIVE = 5_000
CHUNK = 1 << 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Crawl date put into every record where pages carry none.
DATE = "1970-01-01T00:00:00Z"
BREAK = "\r\n\r\n"


def base32(hexed: Column) -> Column:
    """Base32 of a 40-digit hex string."""
    chars = []
    for group in range(8):
        value = F.conv(F.substring(hexed, group * 5 + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            chars.append(F.substring(F.lit(ALPHABET), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*chars)


def records(pages: DataFrame, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(record): WARC text of every page, without the break that ends a record.

    Equal payloads are found by their digest in one map-side aggregation; of at least
    ``min_bytes`` the smallest page id holds the payload and the others revisit it.
    """
    base = pages.select(
        F.col(page_id).alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"[\x00-\x20]+", "%20").alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("payload"),
    ).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    repeated = stage(
        base.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n"), "payloads"
    )
    joined = lookup_join(base, repeated, ["sha"], ["page_id"], "left")
    size = F.octet_length("payload")
    revisit = F.coalesce((F.col("page_id") != F.col("first")) & (size >= min_bytes), F.lit(False))
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    lines = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        ("X-Payload-Length", size.cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    refers = F.when(
        revisit,
        F.concat(
            F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">\r\n"),
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
        ),
    ).otherwise("")
    header = F.concat(F.lit("WARC/1.1\r\n"), *[F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")) for k, v in lines], refers, F.lit("\r\n"))
    return joined.select(F.concat(header, block).alias("record"))


def write_monolithic(made: DataFrame, path: str, per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Write archives that are a single gzip stream each."""
    made.write.option("compression", "gzip").option("lineSep", BREAK).option("maxRecordsPerFile", per_archive).text(path)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it, on whichever machine this runs."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class Inflated:
    """Bytes of a gzip stream (of one or several members) as they are asked for.

    A member that ends early is an EOFError, so nothing is lost in silence.  Zero bytes after the
    last member are padding; anything else there is a ValueError.  A file without a byte is empty.
    """

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.codec, self.rest = source, None, bytearray()

    def _more(self) -> bool:
        data = b""
        if self.codec is not None and self.codec.eof:
            data, self.codec = self.codec.unused_data, None
        data = data or self.source.read(CHUNK)
        if self.codec is None:
            data = self._next_member(data)
        if not data:
            if self.codec is not None:
                raise EOFError("the gzip stream ends within a member")
            return False
        try:
            self.rest += self.codec.decompress(data)
        except zlib.error as e:
            raise ValueError(f"damaged gzip stream: {e}") from e
        return True

    def _next_member(self, data: bytes) -> bytes:
        """``data`` from the first byte of the next member on, or nothing at the end."""
        while data and not (data := data.lstrip(b"\0")):
            data = self.source.read(CHUNK)
        if data:
            self.codec = zlib.decompressobj(31)
        return data

    def line(self) -> bytes:
        """Up to and with the next line feed; empty at the end."""
        looked = 0
        while (at := self.rest.find(b"\n", looked)) < 0:
            looked = len(self.rest)
            if not self._more():
                at = len(self.rest) - 1
                break
        return self.take(at + 1)

    def take(self, n: int) -> bytes:
        while len(self.rest) < n and self._more():
            pass
        out = bytes(self.rest[:n])
        del self.rest[:n]
        return out


def read_records(stream: Inflated) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields in lower case, header bytes, block) of every record.

    Raises if the stream ends within a record, and where no record stands.
    """
    while line := stream.line():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        head, fields = [line], {}
        while (line := stream.line()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
            head.append(line)
        if not line or "content-length" not in fields:
            raise ValueError(f"incomplete header of record {fields.get('warc-record-id', '')}")
        size = int(fields["content-length"])
        block = stream.take(size)
        if len(block) < size:
            raise EOFError(f"record {fields.get('warc-record-id', '')} has {len(block)} of {size} bytes")
        yield fields, b"".join([*head, line]), block


INDEX = T.StructType(
    [T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("record", T.StringType())]
)


def _normalise(source: str, target: str) -> int:
    """Rewrite one archive with a member per record, and its index; returns the records."""
    fs_in, path_in = open_store(source)
    fs_out, path_out = open_store(target)
    own = f".{uuid.uuid4().hex}"
    offset = count = 0
    with (
        fs_in.open_input_stream(path_in, compression=None) as raw,
        fs_out.open_output_stream(path_out + own) as archive,
        fs_out.open_output_stream(path_out + ".idx" + own) as index,
    ):
        for fields, head, block in read_records(Inflated(raw)):
            codec = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = codec.compress(head + block + BREAK.encode()) + codec.flush()
            archive.write(member)
            row = {"archive": target, "offset": offset, "length": len(member), "record": fields.get("warc-record-id", "")}
            index.write(json.dumps(row).encode() + b"\n")
            offset, count = offset + len(member), count + 1
    fs_out.move(path_out + own, path_out)
    fs_out.move(path_out + ".idx" + own, path_out + ".idx")
    return count


def target_name(path: str) -> str:
    """The normalised archive's name: the file's own, and a hash of its path."""
    stem = re.sub(r"(\.txt|\.warc)?\.gz$", "", path.rsplit("/", 1)[-1])
    return f"{stem}-{hashlib.sha1(path.encode()).hexdigest()[:16]}.warc.gz"


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Normalise every ``*.gz`` archive below ``source`` into ``target``; (archive, records) per file.

    ``target`` is a folder that all executors reach.  Folders below ``source`` are searched too; the
    name in ``target`` ends in a hash of the whole path, so that archives of the same name stay
    apart.  An archive without records gives an empty archive and index.  A damaged archive (cut
    off, with bytes behind the last member that are not zero, with an incomplete record) ends the
    job with an error; no file of its final name is left.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true")
    found = reader.load(source).select("path")
    names = found.repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    fs, path = open_store(target)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out = f"{target}/{target_name(name)}"
                yield pa.RecordBatch.from_pylist([{"archive": out, "records": _normalise(name, out)}])

    return stage(names.mapInArrow(run, "archive string, records long"), "archives")


READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    ]
)


def _id(value: str) -> int | None:
    found = re.search(r"urn:page:(-?\d+)", value)
    return int(found[1]) if found else None


def read_member(member: bytes) -> dict:
    """Fields of the record in one gzip member; raises if a payload does not fit its digest."""
    data = zlib.decompress(member, 31)
    head, _, block = data.partition(BREAK.encode())
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
    if fields["warc-type"] == "response":
        payload = block[: int(fields["content-length"])].partition(BREAK.encode())[2]
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"damaged record {fields['warc-record-id']}")
    return {
        "page_id": _id(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["warc-type"], "refers_to": _id(fields.get("warc-refers-to", "")),
    }


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the normalised archives in ``folder``, each read by its index entry."""
    index = spark.read.schema(INDEX).json(f"{folder}/*.idx").select("archive", "offset", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            made = []
            for archive, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if archive != name:
                    fs, path = open_store(archive)
                    name, file = archive, fs.open_input_file(path)
                made.append(read_member(file.read_at(length, offset)))
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=ARROW)

    return index.mapInArrow(run, READ)


ARROW = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, normalise them, and read them back.

    A null html is an empty payload, a null url an empty one.  A row without ``page_id`` is a
    response that nothing refers to; rows that repeat the smallest id of a payload are all
    responses.  Other columns are not read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    raw, target = fresh_path(spark, "monolithic"), fresh_path(spark, "warc")
    write_monolithic(records(pages, min_bytes), raw)
    normalise(spark, raw, target)
    if not open_store(target)[0].get_file_info(pafs.FileSelector(open_store(target)[1])):
        return spark.createDataFrame([], READ)
    return read_archives(spark, target)


_CHAR = "substr('" + ALPHABET + "', CAST((CAST('0x' || substr(sha, (i // 4) * 5 + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS n, sha1(payload) AS sha, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i: {_CHAR}), '') AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d"""
