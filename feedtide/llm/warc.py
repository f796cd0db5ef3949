"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedtide.llm.common import bounded_sample, text_or_empty
from feedtide.session import fresh_path

DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"  # skippable frame that holds a dictionary
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
GAP = "P*M\x18\x00\x00\x00\x00"  # an empty skippable frame; ends every row of Spark's text writer
SAMPLE_PAGES = 400  # bound of the dictionary's training sample
SAMPLE_CHARS = 4096
DICTIONARY_BYTES = 32_768
RECORDS = 20_000  # rows of an archive, its dictionary and padding included
ARCHIVE_BYTES = 32 << 20  # compressed size after which an archive is closed
BATCH_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"


def base32_sha1(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the SAMPLE_PAGES pages with the smallest hashes, at most SAMPLE_CHARS characters of each."""
    import zstandard

    sample = bounded_sample(pages.select("page_id", F.substring("html", 1, SAMPLE_CHARS).alias("s")), ["page_id", "s"], SAMPLE_PAGES)
    texts = [r["s"].encode() for r in sample.collect() if r["s"]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:  # too little to learn from: use the text itself
        return (b"".join(texts) or b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n")[:DICTIONARY_BYTES]


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{PAGE}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PAGE}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, revisit_from: int = 0, dictionary: bytes | None = None) -> None:
    """Writes a record per row of page_id, url, html to archives under `path`, through Spark's writer.

    Of records with equal payloads of at least `revisit_from` bytes the one with the smallest page_id is a response, the others are
    revisits of it. A null html is an empty payload; a null url is left out; a null page_id has an empty record id and refers to
    the smallest id, or is a response where no row has one; rows that repeat the smallest page_id are all responses. Other columns
    are not looked at. An archive ends after ARCHIVE_BYTES: the rows left until Spark starts the next file are empty frames.
    """
    dictionary = train_dictionary(pages) if dictionary is None else dictionary
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", text_or_empty("html").cast("binary").alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    first = (
        rows.select("page_id", "sha", F.octet_length("payload").alias("n"))
        .filter(F.col("n") >= revisit_from)
        .groupBy("sha")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )
    marked = rows.join(first, "sha", "left").select(
        "page_id", "url", "payload", "sha", F.when(F.col("page_id").eqNullSafe(F.col("first_id")), None).otherwise(F.col("first_id")).alias("refers_to")
    )

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        head = DICTIONARY_MAGIC + len(dictionary).to_bytes(4, "little") + dictionary
        out, held, in_file, file_bytes = [], 0, 0, 0

        def batch_of(frames: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if in_file == 0:
                    out.append(head)
                    in_file, file_bytes = 1, len(head)
                frame = compressor.compress(_record(*row[:3], base32_sha1(row[3]), row[4]))
                out.append(frame)
                in_file, file_bytes, held = in_file + 1, file_bytes + len(frame), held + len(frame)
                if file_bytes >= ARCHIVE_BYTES:
                    out.extend([b""] * (RECORDS - in_file))
                    in_file = RECORDS
                if in_file == RECORDS:
                    in_file = 0
                if held >= BATCH_BYTES:
                    yield batch_of(out)
                    out, held = [], 0
        if out:
            yield batch_of(out)

    frames = marked.mapInArrow(compress, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("lineSep", GAP).option("maxRecordsPerFile", RECORDS).text(path)


def frames(data: memoryview) -> Iterator[tuple[bool, memoryview]]:
    """(skippable, bytes) of each frame of an archive; the ends come from the frame and block headers."""
    import zstandard

    at, size = 0, len(data)
    while at < size:
        magic = bytes(data[at : at + 4])
        if magic[1:] == DICTIONARY_MAGIC[1:] and magic[0] & 0xF0 == 0x50:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if at + 8 > size or end > size:
                raise ValueError("truncated skippable frame")
            yield True, data[at:end]
            at = end
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        head = bytes(data[at : at + 18])
        end, last = at + zstandard.frame_header_size(head), False
        while not last:
            if end + 3 > size:
                raise ValueError("truncated frame")
            block = int.from_bytes(data[end : end + 3], "little")
            last, kind, length = bool(block & 1), block >> 1 & 3, block >> 3
            if kind == 3:
                raise ValueError("reserved block type")
            end += 3 + (1 if kind == 1 else length)
        end += 4 * zstandard.get_frame_parameters(head).has_checksum
        if end > size:
            raise ValueError("truncated frame")
        yield False, data[at:end]
        at = end


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, int | None, str | None]:
    """Headers (lower case), payload, the length that HTTP declares, and what is wrong, if anything."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    if not found or not lines[0].startswith("WARC/1."):
        return headers, b"", None, "no WARC header"
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in headers]
    if missing:
        return headers, b"", None, "missing " + ", ".join(missing)
    length = headers["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        return headers, b"", None, "wrong record length"
    block = rest[:-4]
    if not headers.get("content-type", "").startswith("application/http"):
        return headers, block, len(block), None
    http, found, payload = block.partition(b"\r\n\r\n")
    declared = next((v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"), b"")
    if not found or not declared.isdigit():
        return headers, payload, None, "no HTTP header"
    if headers["warc-type"] == "revisit":
        return headers, payload, int(declared), "revisit with payload" if payload else None
    if int(declared) != len(payload):
        return headers, payload, int(declared), "wrong payload length"
    digest = headers.get("warc-payload-digest")
    if digest and digest != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
        return headers, payload, int(declared), "wrong digest"
    return headers, payload, int(declared), None


def read_archives(spark: SparkSession, path: str, payloads: bool = True, raise_errors: bool = True) -> DataFrame:
    """record_id, record_type, target_uri, refers_to, payload_bytes, payload_digest, payload, error for each record under `path`.

    The dictionary is loaded from the leading skippable frame (it may itself be compressed), later skippable frames are passed over, each
    other frame is one record. Headers, lengths and digests are checked: a bad record raises, or with raise_errors=False comes with its
    `error`; a frame that cannot be found or decoded ends its archive with such a row. `payload` is null with payloads=False. An empty
    archive has no record. An archive is read whole by one task; the writer bounds its size.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)

        def records(data: memoryview) -> Iterator[tuple]:
            decoder = zstandard.ZstdDecompressor()
            try:
                for n, (skippable, frame) in enumerate(frames(data)):
                    if skippable:
                        if n == 0 and bytes(frame[:4]) == DICTIONARY_MAGIC:
                            content = bytes(frame[8:])
                            if content[:4] == FRAME_MAGIC:
                                content = decoder.decompressobj().decompress(content)
                            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
                        continue
                    headers, payload, size, error = parse_record(decoder.decompressobj().decompress(frame))
                    plain = lambda name: headers.get(name, "").strip("<>") or None  # noqa: B023, E731
                    yield plain("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"), plain("warc-refers-to"), size, headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, payload if payloads else None, error
            except (ValueError, zstandard.ZstdError) as problem:
                yield None, None, None, None, None, None, None, str(problem)

        for batch in batches:
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in records(memoryview(content.as_buffer())):
                    if row[-1] and raise_errors:
                        raise ValueError(f"{place}: {row[0]}: {row[-1]}")
                    rows.append(row)
                    held += 300 + len(row[6] or b"")
                    if held >= BATCH_BYTES:
                        yield flush()
                        rows.clear()
                        held = 0
        if rows:
            yield flush()

    NAMES = ["record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload", "error"]
    TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    schema = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, payload binary, error string"
    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    return archives.mapInArrow(decode, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads these back."""
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    page = lambda name: F.when(F.col(name) != PAGE, F.substring(F.col(name), len(PAGE) + 1, 30).cast("long"))
    return read_archives(spark, path, payloads=False).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )
