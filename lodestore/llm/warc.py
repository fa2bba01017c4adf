"""WARC archives as seekable Zstandard bundles (operator 1).

A bundle is a sequence of independent Zstandard frames of whole WARC records, closed
by a skippable frame with the seek table of the frames' sizes (the public seekable
format). Bundles are rows of a table in the shared folder: an archive column, and the
bundle's index, which maps record ids to frame number, offset inside the frame and
length. One record is read by inflating its frame alone.

Records with equal payloads of at least ``SMALLEST`` bytes are stored once: the one
with the smallest page_id is the response, others are revisit records that name its
record id. Rows that repeat that smallest page_id are responses too. A row without
page_id can't be referred to or compared; it is a response. Payloads may be of any
length; blanks and line breaks in a url become one blank; columns besides page_id, url
and html aren't stored. Ids cross into Python as text, so that all 64 bits survive.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import materialise, text_id

SMALLEST, FRAME, BUNDLE = 100, 1 << 18, 1 << 22
# Fixed values of the seekable format: magic numbers of the table and its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
# Fixed values of the WARC format: the profile of revisits by equal payloads, and what a
# response's payload lies in.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_BUNDLES = "bundle string, archive binary, records array<struct<record_id:string,page_id:long,frame:int,start:int,length:int>>"


def record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the record that ``data`` begins with."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    return headers, rest[: int(headers["Content-Length"])]


def seal(frames: list[bytes], sizes: list[int]) -> bytes:
    """Frames with their seek table."""
    table = b"".join(struct.pack("<II", len(f), n) for f, n in zip(frames, sizes, strict=True))
    table += struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return b"".join(frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """Position, stored and inflated size of each frame, from the footer."""
    count, flags, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width, out, at = 12 if flags & 0x80 else 8, [], 0
    table = archive[-9 - count * width : -9]
    for k in range(count):
        stored, size = struct.unpack_from("<II", table, k * width)
        out.append((at, stored, size))
        at += stored
    return out


def read_frame(archive: bytes, place: tuple[int, int, int]) -> bytes:
    at, stored, size = place
    return zstandard.ZstdDecompressor().decompress(archive[at : at + stored], max_output_size=max(size, 1))


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def _bundle_batches(date: str):
    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, part = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()
        frames: list[bytes] = []
        sizes: list[int] = []
        index: list[dict] = []
        open_, made, total = bytearray(), 0, 0

        def close_frame():
            nonlocal total
            if open_:
                frames.append(packer.compress(bytes(open_)))
                sizes.append(len(open_))
                total += len(frames[-1])
                open_.clear()

        def close_bundle() -> pd.DataFrame:
            nonlocal made, total
            close_frame()
            row = pd.DataFrame({"bundle": [f"{part:06d}-{made:06d}"], "archive": [seal(frames, sizes)], "records": [list(index)]})
            frames.clear(), sizes.clear(), index.clear()
            made, total = made + 1, 0
            return row

        number, last = 0, ""
        for batch in batches:
            for page, url, html, digest, first, refers in zip(*(batch[c] for c in ("page", "url", "html", "digest", "first", "refers")), strict=True):
                # Revisits name the response by page and digest alone; rows arrive sorted by
                # digest, so a second row of that page and payload directly follows the first.
                name, number = _record_id(page, digest), number + 1
                if first is None or page != first or name == last:
                    name = _record_id(page, digest, part, number)
                else:
                    last = name
                headers = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", date)]
                headers += [] if page is None else [("WARC-Page-ID", page)]
                headers += [("WARC-Target-URI", " ".join((url or "about:blank").split())), ("WARC-Payload-Digest", f"sha256:{digest}")]
                if refers is None:
                    data = record([*headers, ("Content-Type", "application/http; msgtype=response")], HTTP_HEAD + (html or "").encode("utf-8", "surrogatepass"))
                else:
                    data = record([*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers, digest)), ("WARC-Refers-To-Page", refers)], b"")
                index.append({"record_id": name, "page_id": None if page is None else int(page), "frame": len(frames), "start": len(open_), "length": len(data)})
                open_ += data
                if len(open_) >= FRAME:
                    close_frame()
                if total >= BUNDLE:
                    yield close_bundle()
        if index:
            yield close_bundle()

    return bundle


def write_archives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); the table of bundles,
    already in the shared folder. ``date`` is the time of capture, which pages lack."""
    rows = pages.select(F.col("page_id").cast("long").alias("page"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = rows.withColumn("digest", F.sha2(body, 256)).withColumn("size", F.octet_length(body))
    first = rows.where((F.col("size") >= SMALLEST) & F.col("page").isNotNull()).groupBy("digest").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    first = first.where("first <> last").select(F.col("digest").alias("of"), "first")
    refers = F.when(F.col("page") > F.col("first"), F.col("first"))
    joined = rows.join(first, F.col("digest") == F.col("of"), "left").withColumn("refers", refers)
    # Within a digest the pages of responses come first, next to each other.
    placed = joined.sortWithinPartitions("digest", "page").select(
        text_id("page"), "url", F.when(F.col("refers").isNull(), F.col("html")).alias("html"), "digest", text_id("first"), text_id("refers"),
    )
    return materialise(placed.mapInPandas(_bundle_batches(date), _BUNDLES), "warc")


def payload_of(block: bytes) -> bytes:
    """A response's payload: what follows the HTTP head."""
    return block.partition(b"\r\n\r\n")[2]


def _record_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for archive, records in zip(batch["archive"], batch["records"], strict=True):
            places, at, data, rows = seek_table(archive), -1, b"", []
            for entry in records:
                if entry["frame"] != at:
                    at = entry["frame"]
                    data = read_frame(archive, places[at])
                headers, block = parse(data[entry["start"] : entry["start"] + entry["length"]])
                if headers["WARC-Record-ID"] != entry["record_id"]:
                    raise ValueError(f"the index doesn't fit at {entry['record_id']}")
                kind, promised, size = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:"), None
                if kind == "response":
                    payload = payload_of(block)
                    size = str(len(payload))
                    if hashlib.sha256(payload).hexdigest() != promised:
                        raise ValueError(f"payload of {entry['record_id']}")
                rows.append((headers.get("WARC-Page-ID"), size, promised, kind, headers.get("WARC-Refers-To-Page"), entry["record_id"], headers.get("WARC-Refers-To")))
            yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_record"], dtype=object)


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and record_id of
    all records; a revisit has the payload of the response whose record id it names. Each
    archive is inflated once; what is read from it is small."""
    schema = "page_id string, payload_bytes string, payload_digest string, record_type string, refers_to string, record_id string, refers_to_record string"
    records = materialise(archives.select("archive", "records").mapInPandas(_record_batches, schema), "records")
    responses = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("of")).agg(F.max("payload_bytes").alias("full"))
    joined = records.join(responses, F.col("refers_to_record") == F.col("of"), "left")
    return joined.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("payload_bytes", "full").cast("long").alias("payload_bytes"),
        "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "record_id",
    )


def fetch(archives: DataFrame, page_ids: list[int]) -> DataFrame:
    """Payloads of some records (page_id, payload): the index names bundle, frame and
    place, and only those frames are inflated."""
    wanted = archives.withColumn("records", F.filter("records", lambda r: r["page_id"].isin(*page_ids))).where(F.size("records") > 0)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, records in zip(batch["archive"], batch["records"], strict=True):
                places = seek_table(archive)
                got = [(str(e["page_id"]), payload_of(parse(read_frame(archive, places[e["frame"]])[e["start"] :][: e["length"]])[1])) for e in records]
                yield pd.DataFrame(got, columns=["page_id", "payload"])

    return wanted.select("archive", "records").mapInPandas(read, "page_id string, payload binary").select(F.col("page_id").cast("long").alias("page_id"), "payload")
