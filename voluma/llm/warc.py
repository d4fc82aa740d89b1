"""WARC archives with one Zstandard frame a record and a dictionary in a leading skippable frame.

Pages get their payload digest natively; of equal payloads of at least ``REVISIT_BYTES`` bytes the smallest
page_id is the response (an aggregate with map-side combine, joined back on the digest, which AQE splits
where many pages are equal). A task then streams its pages into archives: the first ``SAMPLE_BYTES`` of
records are held back, a dictionary is trained on them, written in a skippable frame, and every record is
compressed by itself with it. Archives are closed at ``ARCHIVE_BYTES``. Names carry a random part, and the
manifest lists those of the tasks that succeeded, so a retried task leaves no double. Reading streams frame
by frame with memory for one record; a response's length and digest are computed of the payload that was read, and
a difference from its header fails.

Scale: one shuffle of the pages, by digest; memory is bounded by the sample and one record; the manifest is
one row an archive and is itself a written table.

Defined cases: a null html is an empty payload, a response; a null url is the empty target; rows that share
a ``page_id`` and payload are a response and revisits of it in no fixed order if the payload is long enough;
extra columns are left out; an empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voluma.llm.common import NULL_ID, cut, id_or_least, map_rows, read, shared_dir

REVISIT_BYTES = 100
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
ARCHIVE_BYTES = 256 << 20
_SKIPPABLE = 0x184D2A5D
_FRAME = 0xFD2FB528


def record(row: dict) -> bytes:
    """A WARC/1.1 record of (page, url, payload, n_bytes, digest, refers_to)."""
    payload = row["payload"]
    revisit = row["refers_to"] is not None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["n_bytes"]
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:x-page:{row['page']}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[4:4] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:x-page:{row['refers_to']}>")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields, in lower case, and the payload of a record; a revisit's payload is empty."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields | {"payload": payload, "payload_bytes": length}


def verified(fields: dict) -> dict:
    """A parsed record, with length and digest taken from the payload itself where the record holds one; they must be those of the header."""
    if fields["warc-type"] == "response":
        length, digest = len(fields["payload"]), f"sha256:{hashlib.sha256(fields['payload']).hexdigest()}"
        if (length, digest) != (fields["payload_bytes"], fields["warc-payload-digest"]):
            raise ValueError(f"record {fields['warc-record-id']}: payload and header differ")
        fields |= {"payload_bytes": length, "warc-payload-digest": digest}
    return fields


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the samples, or None where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 10)), samples, level=3)
    except zstandard.ZstdError:
        return None


class Archive:
    """A file of records; records before the sample is full are held back."""

    def __init__(self, stream) -> None:
        self.stream, self.held, self.size, self.written, self.count, self.packer = stream, [], 0, 0, 0, None

    def add(self, data: bytes) -> None:
        self.count += 1
        self.size += len(data)
        if self.packer:
            self._write(data)
            return
        self.held.append(data)
        if self.size >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        learned = dictionary([x[: 128 << 10] for x in self.held])
        packed = learned.as_bytes() if learned else b""
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(packed)) + packed)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=learned, write_content_size=True, write_checksum=True)
        for x in self.held:
            self._write(x)
        self.held = []

    def _write(self, data: bytes) -> None:
        frame = self.packer.compress(data)
        self.written += len(frame)
        self.stream.write(frame)

    def close(self) -> None:
        if not self.packer:
            self._start()
        self.stream.close()


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != _SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    packed = stream.read(size)
    learned = zstandard.ZstdCompressionDict(packed) if packed else None
    unpacker = zstandard.ZstdDecompressor(dict_data=learned)
    rest = b""
    while True:
        job, out, begun = unpacker.decompressobj(), io.BytesIO(), False
        while not job.eof:
            rest = rest or stream.read(1 << 16)
            if not rest:
                break
            begun = True
            out.write(job.decompress(rest))
            rest = job.unused_data if job.eof else b""
        if not job.eof:
            if begun:
                raise ValueError("an archive ends inside a record")
            return
        yield out.getvalue()


def _open(uri: str, mode: str):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    if mode == "r":
        return files.open_input_stream(path, compression=None)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    return files.open_output_stream(path, compression=None)


def plan_records(pages: DataFrame) -> DataFrame:
    """page, url, payload, n_bytes, digest, refers_to for each page."""
    known = pages.select(id_or_least("page_id").alias("page"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    known = known.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    first = known.where(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = known.join(first, "digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("first") < F.col("page"), F.col("first"))).drop("first")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, records): the archives of the pages, written under ``folder`` (a URI all executors reach)."""

    def run(rows: Iterable[dict]) -> Iterator[tuple]:
        archive = path = None
        for r in rows:
            if archive is None:
                path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                archive = Archive(_open(path, "w"))
            r["payload"] = r["payload"].encode()
            archive.add(record(r))
            if archive.written >= archive_bytes:
                archive.close()
                yield path, archive.count
                archive = None
        if archive is not None:
            archive.close()
            yield path, archive.count

    return cut(map_rows(plan_records(pages), "path string, records long", run, out_rows=1))


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload (binary; empty for a revisit), payload_bytes, payload_digest, record_type, refers_to of each record."""

    def number(urn: str | None) -> int | None:
        return int(urn.removeprefix("<urn:x-page:").rstrip(">")) if urn else None

    def run(rows: Iterable[dict]) -> Iterator[tuple]:
        for r in rows:
            with _open(r["path"], "r") as stream:
                for data in frames(stream):
                    x = verified(parse(data))
                    yield (number(x["warc-record-id"]), x["warc-target-uri"], x["payload"], x["payload_bytes"], x["warc-payload-digest"].removeprefix("sha256:"), x["warc-type"], number(x.get("warc-refers-to")))

    spread = manifest.repartition(max(1, manifest.count()), "path") if not manifest.isEmpty() else manifest
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return map_rows(spread, schema, run, out_rows=256)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(read(spark, sf_dir, "pages"), folder)
    back = read_archives(manifest)
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return back.select(real("page_id"), "payload_bytes", "payload_digest", "record_type", real("refers_to"))
