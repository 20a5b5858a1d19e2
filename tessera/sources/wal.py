"""Write-ahead-log segments: records, pages, files, and a DataFrame of records."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lsn import ALIGN, PAGE, SEGMENT, segment_name

#: Fixed values of the format: page magic, sizes of page headers and of a record's header.
MAGIC, SHORT, LONG, HEADER = 0xD11D, 24, 40, 24
CONTINUES, FIRST_PAGE = 0x0001, 0x0002
HAS_IMAGE, HAS_DATA, WILL_INIT, SAME_RELATION = 0x01, 0x02, 0x04, 0x08
HAS_HOLE, COMPRESSED, APPLY = 0x01, 0x02, 0x04
END_OF_BLOCKS, LONG_MAIN, MOST_BLOCKS, MOST_BYTES = 0xFF, 0xFF, 32, 1 << 30

BLOCK = "struct<id:int,spc:bigint,db:bigint,rel:bigint,fork:int,block:bigint,flags:int,data:binary,image:binary,hole_offset:int,hole_length:int,image_flags:int>"
SCHEMA = f"lsn long, rmgr_id int, info int, xid long, prev_lsn long, tot_len long, main_data binary, block_refs array<{BLOCK}>"


class LogError(ValueError):
    """A segment or record that isn't as the format says."""


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)  # the Castagnoli polynomial, reflected
        table.append(n)
    return table


_CRC = _crc_table()


_STEPS = np.array(_CRC, np.uint32)
#: Records that are decoded at a time.
TOGETHER = 20_000
#: Records of like length from which on their checksums are computed side by side.
SIDE_BY_SIDE = 32


def checksums(data: list[bytes]) -> list[int]:
    """CRC-32C of each. Records of like length are aligned at their ends and go through the table a
    column at a time: zeros in front leave a zero register as it is, and the register's start is
    folded into the first four bytes."""
    out = [0] * len(data)
    kinds: dict[int, list[int]] = {}
    for k, x in enumerate(data):
        kinds.setdefault(len(x).bit_length(), []).append(k)
    for bits, own in kinds.items():
        if len(own) < SIDE_BY_SIDE or bits < 3:
            for k in own:
                out[k] = crc32c(data[k])
            continue
        for at in range(0, len(own), max(1, (32 << 20) >> bits)):
            some = own[at : at + max(1, (32 << 20) >> bits)]
            width = max(len(data[k]) for k in some)
            table = np.frombuffer(b"".join(data[k].rjust(width, b"\0") for k in some), np.uint8).reshape(len(some), width).T.copy()
            start = width - np.array([len(data[k]) for k in some])
            for j in range(4):
                table[start + j, np.arange(len(some))] ^= 0xFF
            crc = np.zeros(len(some), np.uint32)
            for column in table:
                crc = _STEPS[(crc ^ column) & np.uint32(0xFF)] ^ crc >> np.uint32(8)
            for k, x in zip(some, (crc ^ np.uint32(0xFFFFFFFF)).tolist(), strict=True):
                out[k] = x
    return out


def crc32c(*parts: bytes) -> int:
    crc = 0xFFFFFFFF
    for part in parts:
        for b in part:
            crc = _CRC[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


@dataclass
class Block:
    """A block that a record touches."""

    id: int
    rel: int
    block: int
    spc: int = 0
    db: int = 0
    fork: int = 0
    data: bytes = b""
    flags: int = 0
    image: bytes | None = None
    hole_offset: int = 0
    hole_length: int = 0
    image_flags: int = 0

    def row(self) -> dict:
        return {k: getattr(self, k) for k in ("id", "spc", "db", "rel", "fork", "block", "flags", "data", "image", "hole_offset", "hole_length", "image_flags")}


@dataclass
class Record:
    rmgr_id: int
    info: int
    xid: int
    main_data: bytes = b""
    blocks: list[Block] = field(default_factory=list)
    prev_lsn: int = 0
    lsn: int = 0
    tot_len: int = 0

    def row(self) -> dict:
        return {"lsn": self.lsn, "rmgr_id": self.rmgr_id, "info": self.info, "xid": self.xid, "prev_lsn": self.prev_lsn, "tot_len": self.tot_len, "main_data": self.main_data, "block_refs": [b.row() for b in self.blocks]}


def padded(n: int) -> int:
    return -(-n // ALIGN) * ALIGN


def encode(r: Record) -> bytes:
    """Block headers, main data's length, images, block data, main data; a CRC-32C over that and the
    header before it. A main part of 255 bytes or more has the long form, and a hole two bytes."""
    heads, previous = [], None
    for b in r.blocks:
        if not 0 <= b.id < MOST_BLOCKS:
            raise LogError(f"block id {b.id}")
        place = (b.spc, b.db, b.rel)
        flags = b.flags & ~(SAME_RELATION | HAS_IMAGE | HAS_DATA) | (SAME_RELATION if place == previous else 0) | (HAS_IMAGE if b.image is not None else 0) | (HAS_DATA if b.data else 0)
        heads.append(struct.pack("<BBH", b.id, flags, len(b.data)))
        if place != previous:
            heads.append(struct.pack("<III", *place))
            previous = place
        heads.append(struct.pack("<IB", b.block, b.fork))
        if b.image is not None:
            heads.append(struct.pack("<HHBH", len(b.image), b.hole_offset, b.image_flags, b.hole_length))
    size = len(r.main_data)
    heads.append(bytes([END_OF_BLOCKS]) + (bytes([size]) if size < LONG_MAIN else struct.pack("<BH", LONG_MAIN, size)))
    body = b"".join([*heads, *(b.image for b in r.blocks if b.image is not None), *(b.data for b in r.blocks), r.main_data])
    head = struct.pack("<IIQBBxx", HEADER + len(body), r.xid, r.prev_lsn, r.info, r.rmgr_id)
    out = head + struct.pack("<I", crc32c(body, head)) + body
    return out.ljust(padded(len(out)), b"\0")


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, layout: str) -> tuple:
        size = struct.calcsize(layout)
        return struct.unpack(layout, self.bytes(size))

    def bytes(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise LogError("a record is too short")
        self.at += n
        return self.data[self.at - n : self.at]


def decode(data: bytes, lsn: int, known: int | None = None) -> Record:
    """The record at the start of `data`, if its length and CRC (`known` if computed already) are right."""
    if len(data) < HEADER:
        raise LogError("a record is too short")
    total, xid, prev, info, rmgr, crc = struct.unpack("<IIQBBxxI", data[:HEADER])
    if not HEADER <= total <= min(MOST_BYTES, len(data)):
        raise LogError(f"a record of {total} bytes")
    if (crc32c(data[HEADER:total], data[:20]) if known is None else known) != crc:
        raise LogError(f"CRC mismatch at {lsn}")
    r, blocks, sizes, place = _Reader(data[HEADER:total]), [], [], (0, 0, 0)
    while (number := r.take("<B")[0]) != END_OF_BLOCKS:
        if number >= MOST_BLOCKS or any(b.id == number for b in blocks):
            raise LogError(f"block id {number}")
        flags, size = r.take("<BH")
        if not flags & SAME_RELATION:
            place = r.take("<III")
        block, fork = r.take("<IB")
        image = r.take("<HHBH") if flags & HAS_IMAGE else None
        blocks.append(Block(number, place[2], block, place[0], place[1], fork, flags=flags))
        sizes.append((size, image))
    main = r.take("<B")[0]
    if main == LONG_MAIN:
        main = r.take("<H")[0]
    for b, (_, image) in zip(blocks, sizes, strict=True):
        if image:
            b.image, b.hole_offset, b.image_flags, b.hole_length = r.bytes(image[0]), image[1], image[2], image[3] if image[2] & HAS_HOLE else 0
    for b, (size, _) in zip(blocks, sizes, strict=True):
        b.data = r.bytes(size)
    return Record(rmgr, info, xid, r.bytes(main), blocks, prev, lsn, total)


def restored(image: bytes, hole_offset: int, hole_length: int, size: int = PAGE) -> bytes:
    """A page from its image: zeros stand where the hole was."""
    page = image[:hole_offset] + bytes(hole_length) + image[hole_offset:]
    return page[:size].ljust(size, b"\0")


class Segments:
    """Writes records into segments. A record that doesn't fit the rest of a segment begins the next
    one, so each segment can be read alone."""

    def __init__(self, start: int = 0, timeline: int = 1, size: int = SEGMENT, system: int = 0):
        self.timeline, self.size, self.system = timeline, size, system
        self.data: dict[int, bytearray] = {}
        self.lsn, self.last = start // size * size, 0

    def _header(self) -> bytes:
        first = self.lsn % self.size == 0
        head = struct.pack("<HHIQI4x", MAGIC, FIRST_PAGE if first else 0, self.timeline, self.lsn, 0)
        return head + (struct.pack("<QII", self.system, self.size, PAGE) if first else b"")

    def _put(self, data: bytes) -> None:
        while data:
            own = self.data.setdefault(self.lsn // self.size, bytearray())
            if self.lsn % PAGE == 0:
                head = self._header()
                own += head
                self.lsn += len(head)
            n = min(len(data), PAGE - self.lsn % PAGE)
            own += data[:n]
            self.lsn += n
            data = data[n:]

    def _end_of(self, start: int, n: int) -> int:
        """Where n bytes from start on end, with the page headers between."""
        while n:
            if start % PAGE == 0:
                start += LONG if start % self.size == 0 else SHORT
            step = min(n, PAGE - start % PAGE)
            start, n = start + step, n - step
        return start

    def append(self, r: Record) -> int:
        """The record's position."""
        r.prev_lsn = self.last
        data = encode(r)
        end = (self.lsn // self.size + 1) * self.size
        if self.lsn % self.size and self._end_of(self.lsn, len(data)) > end:
            self.lsn = end
        if self._end_of(self.lsn, len(data)) > (self.lsn // self.size + 1) * self.size:
            raise LogError("a record is longer than a segment")
        at = self.lsn + (0 if self.lsn % PAGE else LONG if self.lsn % self.size == 0 else SHORT)
        self._put(data)
        self.last = r.lsn = at
        return at

    def files(self) -> Iterator[tuple[str, bytes]]:
        for number, data in sorted(self.data.items()):
            yield segment_name(number, self.timeline, self.size), bytes(data).ljust(self.size, b"\0")


def records_in(data: bytes, start: int, timeline: int, size: int = SEGMENT) -> Iterator[Record]:
    """The records of the segment that begins at position `start`; zeros end it."""
    if len(data) != size:
        raise LogError(f"a segment of {len(data)} bytes instead of {size}")
    at = 0

    def enter() -> bool:
        """Passes over the page header at a page's start; False where nothing was written."""
        nonlocal at
        if at >= size:
            return False
        if at % PAGE == 0:
            magic, _, line = struct.unpack_from("<HHI", data, at)
            if (magic, line) == (0, 0) and at:
                return False
            if magic != MAGIC or line != timeline:
                raise LogError(f"page at {start + at}: magic {magic:04X}, timeline {line}")
            at += SHORT if at else LONG
        return True

    def read(n: int) -> bytes | None:
        nonlocal at
        out = []
        while n:
            if not enter():
                return None
            step = min(n, PAGE - at % PAGE)
            out.append(data[at : at + step])
            at, n = at + step, n - step
        return b"".join(out)

    held: list[tuple[int, bytes]] = []

    def decoded() -> Iterator[Record]:
        for (lsn, data), crc in zip(held, checksums([x[HEADER:] + x[:20] for _, x in held]), strict=True):
            yield decode(data, lsn, crc)
        held.clear()

    while enter():
        lsn = start + at
        head = read(HEADER)
        if head is None or not (total := struct.unpack_from("<I", head)[0]):
            break
        if not HEADER <= total <= MOST_BYTES:
            yield from decoded()
            raise LogError(f"a record of {total} bytes at {lsn}")
        rest = read(padded(total) - HEADER)
        if rest is None:
            break
        held.append((lsn, (head + rest)[:total]))
        if len(held) >= TOGETHER:
            yield from decoded()
    yield from decoded()


def write_segments(spark: SparkSession, segments: Segments, folder: str) -> None:
    """Writes the files through Spark's file system, so any store works."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name, data in segments.files():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(data))
        out.close()


def listed(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(path, name) of the files in a folder, by Spark's file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return sorted((f.getPath().toString(), f.getPath().getName()) for f in path.getFileSystem(conf).listStatus(path))


def read_log(spark: SparkSession, folder: str, timeline: int = 1, start: int = 0, end: int | None = None, size: int = SEGMENT) -> DataFrame:
    """Records that begin in [start, end), one task a segment or a few. Segments are told by their file
    names, and only those in the range are read; a missing one just ends there."""
    per = (1 << 32) // size
    wanted = []
    for path, name in listed(spark, folder):
        if re.fullmatch("[0-9A-F]{24}", name) and int(name[:8], 16) == timeline:
            at = (int(name[8:16], 16) * per + int(name[16:], 16)) * size
            if at + size > start and (end is None or at < end):
                wanted.append(path)
    if not wanted:
        return spark.createDataFrame([], SCHEMA)
    files = spark.read.format("binaryFile").load(wanted).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    number = F.conv(F.substring("name", 9, 8), 16, 10).cast("long") * per + F.conv(F.substring("name", 17, 8), 16, 10).cast("long")
    chosen = files.select((number * size).alias("at"), "content")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for r in records_in(content, at, timeline, size):
                    if end is not None and r.lsn >= end:
                        break
                    if r.lsn >= start:
                        rows.append(r.row())
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=target)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=target)

    return chosen.mapInArrow(parse, SCHEMA)
