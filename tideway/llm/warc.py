"""WARC archives compressed with Zstandard: a dictionary in the leading skippable frame, then one frame per record.

An archive is a file that any Zstandard decoder with that dictionary opens: ``write_archives`` makes its content,
``archive_pages`` writes the files, and ``read_archives`` reads them back record by record. An empty skippable frame ends
each file, as the writer puts one after every value.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm.shared import discard, least_hashed, materialize, new_folder, read_files, write_files

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
SKIPPABLE_FROM, SKIPPABLE_TO = 0x184D2A50, 0x184D2A5F
FRAME = 0xFD2FB528
#: An empty skippable frame; every byte of it is a character of ASCII.
EMPTY_FRAME = "P*M\x18\0\0\0\0"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_SCHEMA = "name string, content binary"
RECORD_SCHEMA = "archive string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def payload_digest(text):
    """Bare lower-case hex SHA-256 of a text column's UTF-8 bytes, null read as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def mark_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type and refers_to to rows (page_id, url, html).

    Equal payloads of at least ``least`` bytes: the smallest page_id is the response, rows of other ids revisit it.
    Only digests that occur twice reach the join; its smaller side holds one row each, and a hot digest on the larger
    side is split by adaptive execution.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("payload_bytes", F.octet_length(F.coalesce("html", F.lit(""))).cast("long")).withColumn("payload_digest", payload_digest(F.col("html")))
    thin = rows.filter(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    first = thin.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("payload_digest").alias("_digest"), "first_id")
    copies = thin.join(first, F.col("payload_digest") == F.col("_digest")).filter("first_id IS NOT NULL AND NOT page_id <=> first_id").select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_of"), "first_id").distinct()
    marked = rows.join(copies, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_of")), "left")
    kind = F.when(F.col("first_id").isNotNull(), F.lit("revisit")).otherwise(F.lit("response"))
    return marked.withColumn("record_type", kind).withColumnRenamed("first_id", "refers_to").drop("_id", "_of")


def train_dictionary(pages: DataFrame, samples: int = 300, size: int = 16384) -> bytes:
    """A dictionary from at most ``samples`` whole pages, those of least hash; b"" if there are too few."""
    rows = pages.filter("html IS NOT NULL").select(F.lit("all").alias("g"), F.xxhash64("page_id").alias("k"), F.col("html").alias("t"))
    texts = [t.encode() for t in least_hashed(rows, {"all": rows.count()}, samples)["all"] if t]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes() if len(texts) >= 10 else b""
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    """The skippable frame that opens an archive."""
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, size: int, payload: bytes) -> bytes:
    """One WARC record; a revisit has the full payload's digest and length, and no content."""
    clean = re.sub(r"[\r\n]+", " ", url or "")
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Target-URI: {clean}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
        payload = b""
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def write_archives(marked: DataFrame, dictionary: bytes, most: int = 4 << 20) -> DataFrame:
    """Archives of rows of ``mark_revisits``: each closes once its frames have ``most`` bytes."""
    base = marked.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"), "payload_bytes", "payload_digest", "record_type", "refers_to", F.spark_partition_id().alias("pid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True, write_content_size=True)
        frames, held, k, pid = [dictionary_frame(dictionary)], 0, 0, 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{pid:06d}-{k:05d}.warc.zst"]), pa.array([b"".join(frames)], pa.binary())], ["name", "content"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    pid = r["pid"]
                    frames.append(pack.compress(record(r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"], r["payload"])))
                    held += len(frames[-1])
                    if held >= most:
                        yield close()
                        frames, held, k = [dictionary_frame(dictionary)], 0, k + 1
        if held:
            yield close()

    return base.mapInArrow(run, ARCHIVE_SCHEMA)


def archive_records(content: bytes) -> Iterator[bytes]:
    """Records of one archive: its own dictionary first, then frame by frame; damage raises ValueError."""
    if len(content) < 8 or struct.unpack_from("<I", content)[0] != SKIPPABLE:
        raise ValueError("no leading skippable frame")
    end = 8 + struct.unpack_from("<I", content, 4)[0]
    dictionary = content[8:end]
    if len(dictionary) + 8 != end:
        raise ValueError("cut dictionary")
    if dictionary[:4] == struct.pack("<I", FRAME):  # the dictionary itself may be compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while end < len(content):
        kind, size = struct.unpack("<II", content[end : end + 8]) if len(content) - end >= 8 else (0, 0)
        if SKIPPABLE_FROM <= kind <= SKIPPABLE_TO and end + 8 + size <= len(content):
            end += 8 + size
            continue
        if kind != FRAME:
            raise ValueError(f"no frame at byte {end}")
        one, parts, at = unpack.decompressobj(), [], end
        while not one.eof:  # fed in small pieces: what follows the frame is never copied whole
            piece = content[at : at + 16384]
            if not piece:
                raise ValueError(f"cut frame at byte {end}")
            parts.append(one.decompress(piece))
            at += len(piece)
        end = at - len(one.unused_data)
        data = b"".join(parts)
        yield data


def parse_record(data: bytes) -> dict:
    """Fields of one record; header, length or digest that do not hold raise ValueError."""
    head, gap, body = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"header line without a colon: {line[:40]!r}")
        fields[name.strip().lower().decode()] = value.strip().decode()
    size = int(fields["content-length"])
    if len(body) != size + 4 or body[size:] != b"\r\n\r\n":
        raise ValueError(f"content of {len(body) - 4} bytes, header says {size}")
    payload, kind, digest = body[:size], fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or int(fields["x-payload-length"]) != size):
        raise ValueError("payload does not match its digest or length")
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    return {"page_id": number("warc-record-id"), "url": fields["warc-target-uri"], "record_type": kind, "refers_to": number("warc-refers-to"), "payload_bytes": int(fields["x-payload-length"]), "payload_digest": digest, "payload": payload, "error": None}


def read_archives(archives: DataFrame, with_payload: bool = True, damaged: str = "raise") -> DataFrame:
    """One row per record of archives (name, content).

    Damage, whether of a frame, a header, a length or a digest, fails the job and names the archive; with ``damaged`` "row"
    it gives a row with ``error`` set and ends its archive.
    """
    if damaged not in ("raise", "row"):
        raise ValueError(f"damaged: {damaged}")
    names = ["archive", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "error"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def pack(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, content, rows, held = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), [], 0
                try:
                    for data in archive_records(content):
                        rows.append({"archive": name} | parse_record(data))
                        if with_payload:
                            held += len(data)
                        else:
                            rows[-1]["payload"] = None
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield pack(rows)
                            rows, held = [], 0
                except (ValueError, KeyError, zstandard.ZstdError) as e:
                    if damaged == "raise":
                        raise ValueError(f"archive {name}: {e}") from e
                    rows.append({"archive": name, "error": str(e)})
                if rows:
                    yield pack(rows)

    return archives.select("name", "content").mapInArrow(run, RECORD_SCHEMA)


def open_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Archives (name, content) of a folder of files."""
    return read_files(spark, folder).select(F.regexp_extract("path", r"archive=([^/]+)/", 1).alias("name"), "content")


def archive_pages(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write all pages to archive files in the shared folder, ``archive=pages-*.warc.zst``/one file each, and return them (name, content).

    Null html is an empty payload; a null url an empty one; rows with equal page_id and payload are all written, and
    are of one kind; rows with a null page_id never lend their id; an empty table gives no archive; other columns are
    ignored.
    """
    spark = pages.sparkSession
    marked = materialize(mark_revisits(pages, least), "marked")
    folder = new_folder(spark, "archives")
    write_files(write_archives(marked, train_dictionary(pages)).withColumnRenamed("name", "archive"), "content", "archive", folder, EMPTY_FRAME)
    discard(marked)
    return open_archives(spark, folder)
