"""Web archives in seekable Zstandard bundles: records in independent frames, a footer that tells where frames are, and an index of records.

A bundle is a series of Zstandard frames, each of whole WARC/1.1 records, and a last skippable frame with the seek table: compressed and
decompressed size of each frame, their number, and a magic number. Any Zstandard reader gives the records in a row; a reader of the seek table
fetches one frame. The index has a row for each record: its identifier, bundle, frame, offset in the frame's records, and length.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fissure.llm.shared import materialise, new_folder, released, table
from fissure.llm.tokens import _filesystem, _open

#: Fixed values of the seekable format: magic numbers of the skippable frame and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records that close a frame and compressed bytes that close a bundle; payloads shorter than LEAST are never revisits.
FRAME, BUNDLE, LEVEL, LEAST = 1 << 18, 1 << 30, 3, 100
#: Equal payloads' first ids that are broadcast; more are joined by shuffle, each in SALTS parts.
BROADCAST_ROWS, SALTS = 200_000, 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, path string, frame long, offset long, length long"


def record_id(page_id: int | None) -> str:
    return "urn:x-page:" + ("none" if page_id is None else str(page_id))


def _header_value(text: str) -> str:
    """Text that stays on one header line: control characters become %XX."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit, which has the payload's size and digest alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: memoryview | bytes) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name, and where what follows them starts."""
    end = bytes(raw).index(b"\r\n\r\n")
    lines = bytes(raw[:end]).decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, end + 4


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(header fields, block, offset, length) of each record of a frame."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        fields, start = _headers(raw[at : end + 4])
        start += at
        size = int(fields["content-length"])
        if raw[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield fields, raw[start : start + size], at, start + size + 4 - at
        at = start + size + 4


class BundleWriter:
    """Writes records into frames, and at the end the seek table."""

    def __init__(self, sink, frame: int = FRAME, level: int = LEVEL):
        import zstandard

        self.sink, self.frame, self.zstd = sink, frame, zstandard.ZstdCompressor(level=level)
        self.waiting: list[bytes] = []
        self.size = self.written = 0
        self.frames: list[tuple[int, int]] = []

    def add(self, record: bytes) -> tuple[int, int]:
        """The record's frame and its offset there."""
        if self.size and self.size + len(record) > self.frame:
            self._close_frame()
        place = (len(self.frames), self.size)
        self.waiting.append(record)
        self.size += len(record)
        return place

    def _close_frame(self) -> None:
        packed = self.zstd.compress(b"".join(self.waiting))
        self.sink.write(packed)
        self.frames.append((len(packed), self.size))
        self.written += len(packed)
        self.waiting, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._close_frame()
        rows = b"".join(struct.pack("<II", *f) for f in self.frames)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(self.frames), 0, SEEKABLE))


def seek_table(file) -> list[tuple[int, int, int]]:
    """(place, compressed size, decompressed size) of each frame, from a bundle's last bytes."""
    end = file.seek(0, 2)
    file.seek(end - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("the file does not end in a seek table")
    file.seek(end - 9 - 8 * count)
    sizes, out, at = struct.unpack(f"<{2 * count}I", file.read(8 * count)), [], 0
    for packed, size in zip(sizes[::2], sizes[1::2], strict=True):
        out.append((at, packed, size))
        at += packed
    return out


def read_frame(file, place: int, packed: int, size: int) -> bytes:
    import zstandard

    file.seek(place)
    return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=size)


def read_record(path: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record: reads the seek table and one frame."""
    with _open(path) as file:
        raw = read_frame(file, *seek_table(file)[frame])[offset : offset + length]
    fields, block, _, _ = next(parse_records(raw))
    return fields, block


def _write_bundles(folder: str, frame: int, bundle: int, date: str):
    """mapInArrow body: rows (page_id, url, payload, digest, size, refers_to) to bundles named by partition, attempt and number; gives the index."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, fs, number = TaskContext.get(), None, 0
        sink = writer = path = None
        for batch in batches:
            out = []
            for page_id, url, payload, digest, size, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    fs, root = _filesystem(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.zst"
                    sink, path = fs.open_output_stream(posixpath.join(root, name), compression=None), posixpath.join(folder, name)
                    writer, number = BundleWriter(sink, frame), number + 1
                record = warc_record(page_id, url, payload, digest, size, refers_to, date)
                out.append((record_id(page_id), path, *writer.add(record), len(record)))
                if writer.written >= bundle:
                    writer.close()
                    sink.close()
                    writer = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)], [c.split()[0] for c in INDEX.split(", ")])
        if writer is not None:
            writer.close()
            sink.close()

    return write


def with_firsts(pages: DataFrame, least: int = LEAST, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pages (page_id, url, payload) with digest, size and refers_to: of equal payloads of at least so many bytes, the smallest page_id.

    Ids and digests alone are counted by digest, and only payloads that stand more than once are looked up again. Where
    those are too many to broadcast, pages meet them in salted parts, so that a payload of very many pages needs no task of its own.
    """
    rows = pages.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    ids = rows.filter(F.col("size") >= least).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    firsts = ids.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n")).alias("first"), F.sum("n").alias("n"))
    firsts = firsts.filter("n > 1 and not first.none").select("digest", F.col("first.page_id").alias("first_id"), (F.col("first.n") > 1).alias("again"))
    firsts = materialise(firsts, "firsts")
    if firsts.count() <= broadcast_rows:
        rows = rows.join(F.broadcast(firsts), "digest", "left")
    else:
        salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left").drop("salt")
    rows = rows.withColumn("is_first", F.col("page_id") == F.col("first_id"))
    refers = F.when(F.col("first_id").isNotNull() & ~F.coalesce("is_first", F.lit(False)), F.col("first_id"))
    rows = rows.withColumn("refers_to", refers)
    columns = ["page_id", "url", "payload", "digest", "size", "refers_to"]
    if firsts.filter("again").isEmpty():
        return rows.select(columns)
    # The smallest page_id itself stands several times with this payload: the first by url, one row of it, is the response.
    twice = F.coalesce(F.col("again") & F.col("is_first"), F.lit(False))
    counted = rows.filter(twice).groupBy("digest", "page_id", "url").agg(F.count(F.lit(1)).alias("n"), F.first("payload").alias("payload"), F.first("size").alias("size"))
    head = counted.groupBy("digest", "page_id").agg(F.min(F.struct(F.col("url").isNull().alias("none"), "url")).alias("head"))
    counted = counted.join(head, ["digest", "page_id"]).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n"))))
    is_head = (F.col("at") == 1) & F.col("url").eqNullSafe(F.col("head.url"))
    counted = counted.select("page_id", "url", F.when(is_head, F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "digest", "size", F.when(~is_head, F.col("page_id")).alias("refers_to"))
    return rows.filter(~twice).select(columns).unionByName(counted)


def write_warc(pages: DataFrame, folder: str | None = None, frame: int = FRAME, bundle: int = BUNDLE, date: str = "1970-01-01T00:00:00Z", least: int = LEAST, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC records into bundles under folder; returns their index (record_id, path, frame, offset, length).

    A page is a response with its html in UTF-8 (null: empty). Of equal payloads of at least `least` bytes the smallest page_id is the response,
    and the others are revisits that refer to it; rows that repeat its page_id and payload are revisits but for one, the first by url. A page
    without an id is record `urn:x-page:none`, a revisit where a page with an id has its payload, else a response. A null url leaves the record without a target;
    control characters in urls are escaped. A record lies whole in one frame, however long. An empty table writes no file; other columns are ignored.
    A bundle that the index lacks is that of an attempt that failed or came second.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = with_firsts(rows, least, broadcast_rows)
    payload = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))  # a revisit has no payload to carry to the writer
    rows = rows.select("page_id", "url", payload.alias("payload"), "digest", "size", "refers_to")
    return materialise(rows.mapInArrow(released(_write_bundles(folder, frame, bundle, date)), INDEX), "index")


def _page(urn: str) -> int | None:
    name = urn.strip("<>").removeprefix("urn:x-page:")
    return None if name == "none" else int(name)


def _read_bundles(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: paths of bundles and ranges of frames to a row for each record, with the digest of what was read."""
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    for batch in files:
        for path, frames in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with _open(path) as file:
                where = seek_table(file)
                for i in frames:
                    out = []
                    for fields, block, _, _ in parse_records(read_frame(file, *where[i])):
                        http, start = _headers(block)
                        size, digest, kind = int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
                        if kind == "response":
                            payload = block[start:]
                            if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{path}: the payload of {fields['warc-record-id']} is not what its header says")
                        target = fields.get("warc-refers-to")
                        out.append((_page(fields["warc-record-id"]), size, digest, kind, _page(target) if target else None))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def read_warc(index: DataFrame, frames: int = 64) -> DataFrame:
    """Every record of the bundles of an index, frame by frame: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Frames are independent, so a bundle is read by several tasks, each with up to `frames` frames. Payloads are checked against their digests.
    """
    places = index.groupBy("path", F.floor(F.col("frame") / frames).alias("range")).agg(F.array_sort(F.collect_set("frame")).alias("frames"))
    tasks = places.repartition("path", "range").select("path", "frames")
    return tasks.mapInArrow(released(_read_bundles), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(table(spark, sf_dir, "pages")))
