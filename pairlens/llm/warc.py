"""WARC archives in Zstandard with a dictionary: writer and reader.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, plain or itself compressed; then comes one Zstandard frame for each
record.  The reader loads the dictionary, finds each frame's end from its block
headers, decodes it alone, and checks the version line, the header syntax, the
declared lengths and the payload digest.

Archives travel as rows (archive_id, n_records, data): Spark's own readers and
writers move them, so any store will do; a `.warc.zst` file read with
``binaryFile`` is such a row too.

Defined results: a null payload is empty; null urls give no target header; null
ids are written as "null" and read as null.  Rows with equal id and payload as
the first of their group are all responses.  A broken archive raises.  Only the
named columns are read, so others may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import by_value, durable, give_back, text_bytes

by_value(__name__)

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: An archive is closed after so many bytes of records.
ARCHIVE_BYTES = 8_000_000
#: The dictionary is trained on at most so many records of its archive, so many bytes of each.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 100, 2048, 8192
#: Records have no capture time of their own; the writer's parameter stands in.
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Repeated digests that are broadcast (some 30 bytes each); salts of a longer table.
MOST_SENT, SALT = 200_000, 16

ARCHIVE_SCHEMA = "archive_id string, n_records long, data binary"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class BrokenArchive(ValueError):
    pass


def with_first_copies(pages: DataFrame, *, id_column: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest (20 bytes), refers_to: the smallest id with the same payload, null if that is the row's own.

    Digests alone are shuffled to find the repeated ones.  A table of at most
    ``MOST_SENT`` of those goes to the pages, whose payloads then stay where they
    were read; a longer one meets them by digest and salt, so that a hot group's
    pages are dealt to many tasks.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text_bytes(F.col(payload)).alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = durable(groups.where("n > 1").select("digest", "first"), "repeated-payloads")
    if first.count() <= MOST_SENT:
        both = rows.join(F.broadcast(first), "digest", "left")
    else:
        dealt = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        both = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(dealt, ["digest", "salt"], "left")
    return both.select("page_id", "url", "payload", "digest", F.when(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.col("first")).alias("refers_to"))


def record(page_id, url: str | None, payload: bytes, digest: bytes, refers_to, date: str) -> bytes:
    name = base64.b32encode(digest).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{name}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], level: int = 3) -> bytes:
    """One archive of these records, with a dictionary trained on a bounded number of them."""
    step = max(1, len(records) // SAMPLES)
    samples = [x[:SAMPLE_BYTES] for x in records[::step][:SAMPLES]]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform records to train on
        trained = b"".join(samples)[:DICTIONARY_BYTES].ljust(16, b" ")
    words = zstandard.ZstdCompressionDict(trained)
    press = zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(trained)), trained, *map(press.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends."""
    try:
        (magic,) = struct.unpack_from("<I", data, at)
        if magic != FRAME_MAGIC:
            raise BrokenArchive(f"no frame at byte {at}")
        flags = data[at + 4]
        single, content = flags >> 5 & 1, flags >> 6
        at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[content])
        last = 0
        while not last:
            head = data[at] | data[at + 1] << 8 | data[at + 2] << 16
            last, kind = head & 1, head >> 1 & 3
            at += 3 + (1 if kind == 1 else head >> 3)
        at += 4 * (flags >> 2 & 1)
    except (struct.error, IndexError) as e:
        raise BrokenArchive("the archive ends within a frame") from e
    if at > len(data):
        raise BrokenArchive("the archive ends within a frame")
    return at


def split_frames(data: bytes) -> Iterator[bytes]:
    """Decoded records of an archive, one frame each."""
    view, at = memoryview(data), 0
    unpress = zstandard.ZstdDecompressor()
    if len(data) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_MAGIC:
        at = 8 + struct.unpack_from("<I", view, 4)[0]
        if at > len(data):
            raise BrokenArchive("the archive ends within its dictionary")
        words = bytes(view[8:at])
        if words[:4] == struct.pack("<I", FRAME_MAGIC):
            words = zstandard.ZstdDecompressor().decompressobj().decompress(words)
        unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    while at < len(data):
        end = frame_end(view, at)
        try:
            yield unpress.decompressobj().decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise BrokenArchive(f"frame at byte {at}: {e}") from e
        at = end


def parse_record(raw: bytes) -> dict:
    """Fields of one record, all lengths and the payload's digest checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise BrokenArchive("no WARC header")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise BrokenArchive(f"header line {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(fields)
    if missing:
        raise BrokenArchive(f"headers missing: {sorted(missing)}")
    if not fields["content-length"].isdigit() or len(rest) != (size := int(fields["content-length"])) + 4 or rest[size:] != b"\r\n\r\n":
        raise BrokenArchive("the content length is wrong")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    declared = next((int(x[15:]) for x in http.split(b"\r\n") if x[:15].lower() == b"content-length:"), None)
    if not gap or declared is None:
        raise BrokenArchive("no HTTP header")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if len(payload) != declared:
            raise BrokenArchive("the payload length is wrong")
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise BrokenArchive("the payload digest is wrong")
    number = lambda x: None if x is None or x[10:-1] == "null" else int(x[10:-1])  # noqa: E731  <urn:page:N>
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to")),
        "payload_bytes": declared, "payload_digest": digest, "payload": payload if fields["warc-type"] == "response" else None,
    }


def write_archives(pages: DataFrame, *, date: str = DATE, **options) -> DataFrame:
    """Archives of all rows of ``pages`` as rows (archive_id, n_records, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def close() -> pd.DataFrame:
            data = archive(held)
            return pd.DataFrame({"archive_id": [hashlib.sha1(data).hexdigest()], "n_records": [len(held)], "data": [data]})

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch[c].astype(object).tolist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                held.append(record(None if pd.isna(page_id) else int(page_id), None if url is None else str(url), bytes(payload), bytes(digest), None if pd.isna(refers_to) else int(refers_to), date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()
        del held
        give_back()

    rows = with_first_copies(pages, **options)
    # ids go as text: pandas would turn a nullable long into a float
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers_to"))
    return rows.mapInPandas(run, ARCHIVE_SCHEMA)


def read_archives(archives: DataFrame, *, data: str = "data", payload: bool = True) -> DataFrame:
    """All records of the archives in column ``data``; ``payload=False`` checks the payloads but does not return them."""
    fields = [x for x in ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload") if payload or x != "payload"]
    schema = ", ".join(x for x in RECORD_SCHEMA.split(", ") if x.split()[0] in fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["data"]:
                rows, size = [], 0
                for one in [] if raw is None else split_frames(bytes(raw)):
                    rows.append(parse_record(one))
                    size += len(one)
                    if size >= ARCHIVE_BYTES:
                        yield framed(rows)
                        rows, size = [], 0
                yield framed(rows)
        give_back()

    def framed(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame({x: pd.Series([r[x] for r in rows], dtype=object) for x in fields})
        return out.astype({x: "Int64" for x in ("page_id", "refers_to", "payload_bytes")})

    return archives.select(F.col(data).alias("data")).mapInPandas(run, schema)
