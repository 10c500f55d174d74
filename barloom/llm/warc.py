"""Web archives of Zstandard frames: one frame a record, the dictionary in a leading skippable frame.

Writing and reading are Spark jobs. Each task packs its rows into archives of a bounded size, written next to each other
in a folder that driver and executors share; the manifest of those written by tasks that succeeded is what is read, so a
retried task leaves no record twice. Each archive is read whole by one task: the dictionary first, then frame by frame,
with headers, lengths and digests validated.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import new_path, saved

#: Bytes of records in an archive, before compression; of samples that its dictionary learns from; and of the dictionary.
ARCHIVE, SAMPLES, DICTIONARY = 32 << 20, 2 << 20, 64 << 10
SKIPPABLE, FRAME, TRAINED = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def make_record(page_id, url, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response record, or a revisit record that keeps the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c for c in url or "about:blank" if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; ValueError if anything in it doesn't agree."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    h = {}
    for x in lines[1:]:
        name, colon, value = x.partition(":")
        if not colon:
            raise ValueError(f"header without a colon: {x[:80]!r}")
        h[name.strip().lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - h.keys():
        raise ValueError(f"header lacks {sorted(missing)}")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes; Content-Length is {n}")
    block = rest[:n]
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no HTTP header")
    inner = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    if "warc-block-digest" in h and h["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("the block's digest differs")
    h["payload"], h["payload-length"] = payload, int(inner["content-length"])
    if h["warc-type"] == "response" and (len(payload) != h["payload-length"] or h.get("warc-payload-digest") != f"sha1:{base32_sha1(payload)}"):
        raise ValueError("the payload's length or digest differs")
    if h["warc-type"] == "revisit" and (payload or "warc-refers-to" not in h):
        raise ValueError("a revisit has no payload and refers to a record")
    return h


def make_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the samples, or, if there are too few, their beginnings as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def make_archive(records: list[bytes]) -> bytes:
    samples, size = [], 0
    for r in records:
        if size >= SAMPLES:
            break
        samples.append(r[: SAMPLES // 16])
        size += len(samples[-1])
    known = make_dictionary(samples)
    packed = zstandard.ZstdCompressor(level=6).compress(known.as_bytes())
    press = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed + b"".join(map(press.compress, records))


def frame_size(data: memoryview, at: int) -> int:
    """Bytes of the Zstandard frame that begins there."""
    start = at
    if len(data) < at + 6 or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise ValueError("no Zstandard frame")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    last = 0
    while not last:
        if len(data) < at + 3:
            raise ValueError("a frame is cut short")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind = block & 1, block >> 1 & 3
        at += 3 + (1 if kind == 1 else block >> 3)
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ValueError("a frame is cut short")
    return at - start


def read_archive(data: bytes):
    """The raw records of an archive, one frame each."""
    view, at, known = memoryview(data), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", view, 4)[0]
        at = 8 + size
        if at > len(view):
            raise ValueError("the dictionary's frame is cut short")
        raw = bytes(view[8:at])
        if raw[:4] == struct.pack("<I", FRAME):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == struct.pack("<I", TRAINED) else zstandard.DICT_TYPE_RAWCONTENT
        known = zstandard.ZstdCompressionDict(raw, dict_type=kind) if raw else None
    reader = zstandard.ZstdDecompressor(dict_data=known)
    while at < len(view):
        size = frame_size(view, at)
        yield reader.decompressobj().decompress(view[at : at + size])
        at += size


def payload_key(html: str = "html") -> Column:
    return F.sha1(F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8"))


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, first): first is the page_id that a revisit refers to, or null for a response.

    The payload's smallest page_id is pre-aggregated, so the shuffle on the digest carries a row a key to the join, and
    adaptive skew joins can split the pages of a very common payload.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", payload_key().alias("key"))
    first = saved(own.groupBy("key").agg(F.min("page_id").alias("least")), "payloads")
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes
    other = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    return own.join(first, "key").select("page_id", "url", "html", F.when(large & other, F.col("least")).alias("first"))


def write_archives(marked: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes mark_revisits()' rows as archives to the folder (any URI that pyarrow.fs opens) and returns the manifest."""

    def written(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        held, size = [], 0

        def flush():
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(path) as f:
                f.write(make_archive(held))
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(held)]})

        for b in batches:
            for page_id, url, html, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                held.append(make_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), first, first is not None, date))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return saved(marked.mapInArrow(written, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record in the archives."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def read(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        number = lambda uri: int(x) if (x := uri.removeprefix("<urn:x-page:").removesuffix(">")) else None
        for b in batches:
            for path, expected in zip(b.column("path").to_pylist(), b.column("n_records").to_pylist(), strict=True):
                with store.open_input_stream(path) as f:
                    data = f.read()
                rows, size, n = [], 0, 0
                for raw in read_archive(data):
                    h = parse_record(raw)
                    row = (number(h["warc-record-id"]), h.get("warc-target-uri"), h["payload-length"], h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], number(h["warc-refers-to"]) if "warc-refers-to" in h else None)
                    rows.append((*row, h["payload"]) if payloads else row)
                    size, n = size + (len(h["payload"]) if payloads else 0), n + 1
                    if len(rows) >= 2048 or size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if n != expected:
                    raise ValueError(f"{path} has {n} records; {expected} were written")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    spread = manifest.repartition(max(1, min(10_000, manifest.count())), "path")
    return spread.mapInArrow(read, schema)


def archive_pages(pages: DataFrame, least_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Writes ``pages`` (page_id, url, html; other columns are ignored) to archives and reads them back.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the smallest page_id is a response and the
    others revisit it; smaller ones are all responses. A null html is an empty payload, a null url about:blank. Repeated
    rows of the smallest page_id are each a response; a null page_id revisits a page that has one, and is a response if
    none has. An empty table gives none.
    """
    folder = new_path(pages.sparkSession, "archives")
    return read_archives(write_archives(mark_revisits(pages, least_bytes), folder), folder, payloads)
