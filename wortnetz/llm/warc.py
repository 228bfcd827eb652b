"""Operator 7, WARC: seekable Zstandard bundles of records, with revisits for repeated payloads."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, shared_path, table, text_of

#: Equal payloads of at least so many bytes are stored once.
LEAST_REVISIT = 1000
#: A frame is closed once it holds so many bytes, a bundle once its frames do.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 256 << 20, 3
#: Fixed values of the seekable format: the skippable frame that holds the seek table, and the mark at its end.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value: the date in every record, so that the same pages give the same bytes.
DATE = "2024-01-01T00:00:00Z"


def file_system(uri: str):
    """(Arrow file system, path) of the shared folder, which may be local or in any store that Arrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else f"file://{uri}")


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists (compressed, plain) sizes of all frames before it."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f: BinaryIO, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame of an open bundle."""
    f.seek(size - 9)
    count, flags, mark = struct.unpack("<IBI", f.read(9))
    if mark != SEEKABLE or flags & 0x80:
        raise ValueError("not a seekable bundle without checksums")
    f.seek(size - 9 - 8 * count)
    at, out = 0, []
    for packed, plain in struct.iter_unpack("<II", f.read(8 * count)):
        out.append((at, packed, plain))
        at += packed
    return out


def record(kind: str, url: str, payload: bytes, digest: str, size: int, page_id: int | None, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head alone; digest and length are those of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {page_id} {url} {digest}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub('[^!-~]', lambda m: ''.join(f'%{b:02X}' for b in m[0].encode()), url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(frame: memoryview, at: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record that starts at an offset of a plain frame."""
    raw = bytes(frame[at : at + 8192])
    end = raw.find(b"\r\n\r\n")
    while end < 0 and len(raw) < len(frame) - at:
        raw = bytes(frame[at : at + 2 * len(raw)])
        end = raw.find(b"\r\n\r\n")
    version, *lines = raw[:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("no record at this offset")
    head = dict(x.split(": ", 1) for x in lines)
    start = at + end + 4
    return head, bytes(frame[start : start + int(head["Content-Length"])])


def read_record(head: dict[str, str], block: bytes) -> dict:
    """What the contract asks back of a record; the payload's digest and length are taken from it where it is there."""
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda k: int(head[k]) if k in head else None
    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(re.search(rb"Content-Length: (\d+)", http)[1])
    if head["WARC-Type"] == "response":
        if (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
            raise ValueError("payload and header differ")
    return {"page_id": number("X-Page-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID")}


def _writer(folder: str):
    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Bundles of one partition. Their names are new in each attempt, and only a finished attempt's rows count, so a
        lost or repeated task leaves files that nothing refers to."""
        store, top = file_system(folder)
        store.create_dir(top, recursive=True)
        packer = zstandard.ZstdCompressor(level=LEVEL)
        out = name = None
        frames: list[tuple[int, int]] = []
        held, rows, done = bytearray(), [], []

        def close_frame() -> None:
            nonlocal out, name, held
            if held:
                if out is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                packed = packer.compress(bytes(held))
                out.write(packed)
                done.extend((name, len(frames), *r) for r in rows)
                frames.append((len(packed), len(held)))
                held = bytearray()
                rows.clear()

        def close_bundle() -> None:
            nonlocal out
            close_frame()
            if out is not None:
                out.write(seek_table(frames))
                out.close()
                out = None
                frames.clear()

        def flush() -> pd.DataFrame:
            made = pd.DataFrame(done, columns=["bundle", "frame", "start", "size", "page_id"]).astype({"page_id": "Int64"})
            done.clear()
            return made

        for part in parts:
            for page_id, no_id, url, html, digest, size, kind, refers_to in zip(*(part[c] for c in ("page_id", "no_id", "url", "html", "digest", "size", "kind", "refers_to"))):
                data = record(kind, url, html.encode() if kind == "response" else b"", digest, size, None if no_id else int(page_id), int(refers_to) if kind == "revisit" else None)
                if held and len(held) + len(data) > FRAME_BYTES:
                    close_frame()
                    if sum(f[0] for f in frames) >= BUNDLE_BYTES:
                        close_bundle()
                rows.append((len(held), len(data), None if no_id else int(page_id)))
                held += data
            yield flush()
        close_bundle()
        yield flush()

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row into bundles in ``folder``; the stored index (bundle, frame, start, size, page_id) maps
    record identifiers to places inside frames.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the largest id are responses, the others
    revisit it; a null id is less than any other, and if all are null, all rows are responses. Null html is an empty
    payload, a null url an empty one; repeated rows are a record each. A payload that a third of the rows share
    is one row in the choice of responses, and the join on it can be split. A table without rows writes nothing.
    """
    bound_batches(pages.sparkSession, 256)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), text_of(url_col).alias("url"), text_of(html_col).alias("html")
    ).select("*", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    first = cut(rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest", "size").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "size", "top"))
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    chosen = rows.join(first, ["digest", "size"], "left").select(
        F.coalesce("page_id", F.lit(0)).alias("page_id"), F.col("page_id").isNull().alias("no_id"), "url",
        F.when(~again, F.col("html")).otherwise("").alias("html"), "digest", "size",
        F.when(again, "revisit").otherwise("response").alias("kind"), F.coalesce("top", F.lit(0)).alias("refers_to"),
    )
    return cut(chosen.mapInPandas(_writer(folder), "bundle string, frame int, start long, size long, page_id long"))


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records of the index, read from the bundles.

    Each frame is found by its bundle's seek table and unpacked alone; frames are dealt out one by one.
    """
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = file_system(folder)
        unpacker, name, f, places = zstandard.ZstdDecompressor(), None, None, []
        for part in parts:
            out = []
            for bundle, frame, starts in zip(part["bundle"], part["frame"], part["starts"]):
                if bundle != name:
                    if f is not None:
                        f.close()
                    name, f = bundle, store.open_input_file(f"{top}/{bundle}")
                    places = read_seek_table(f, f.size())
                at, packed, plain = places[frame]
                f.seek(at)
                data = memoryview(unpacker.decompress(f.read(packed), max_output_size=plain))
                out += [read_record(*parse(data, s)) for s in starts]
            yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})
        if f is not None:
            f.close()

    frames = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    # by range, so that a task reads neighbouring frames, and few bytes of index are not taken for little work
    return frames.repartitionByRange(n, "bundle", "frame").sortWithinPartitions("bundle", "frame").mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back. A null html is an empty payload; repeated rows are records of their own;
    a table without rows gives none."""
    folder = shared_path(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (
  SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS top FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM r
"""
