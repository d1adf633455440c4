"""BAM files as a Python data source.

``spark.read.format("bam")`` with options

* ``path``: files, comma-separated;
* ``columns``: ``record`` (default), ``flag`` (file, block and flag of each
  record) or ``count`` (records per file, block and flag, counted while reading,
  which is what an index is built from);
* ``mode``: ``FAILFAST`` (default) raises at a bad block, ``PERMISSIVE`` keeps
  what stands before it, ``RESYNC`` goes on at the next block;
* ``required``, ``forbidden``: a mask (flag literals) applied while parsing;
* ``blocks``: block ids to read, comma-separated, all others are not opened;
* ``partition_bytes``: compressed bytes of a partition (32 MiB, 256 at least);
* ``push``: take pushed-down filters; only for sessions that push to Python
  sources (``read`` sets it by the session).

A block is a member of the compressed file, and its id the member's byte offset.
The driver reads the file's header and deals out byte ranges; a range's blocks
are those that start in it, and its task finds the first one by looking for a
full block header that another one, or the end, follows.  With ``FAILFAST`` a task
also checks that its last block ends where the next range's first one begins.
``PERMISSIVE`` alone needs a walk over all headers before, as it stops at
the file's first bad block.  A record belongs to the block in which it
starts; one that crosses a partition's end is finished from the blocks that
follow, and a partition that starts within a record finds the next one by
checking that a chain of plausible records follows.
"""

from __future__ import annotations

import bisect
import itertools
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..functions.flags import Mask, parse_flag

#: Fixed values of the block format: header length, least and greatest size, magic.
HEADER, LEAST, MOST, MAGIC = 18, 26, 65536, b"\x1f\x8b"
#: Least bytes of a range, and inflated bytes that are scanned together.
LEAST_RANGE, TOGETHER = 256, 1 << 20
FLAG_SCHEMA = "file STRING, block_id BIGINT, flag INT"
COUNT_SCHEMA = "file STRING, block_id BIGINT, flag INT, read_count BIGINT"
RECORD_SCHEMA = (
    "file STRING, block_id BIGINT, flag INT, qname STRING, tid INT, pos BIGINT, mapq INT, cigar ARRAY<STRUCT<op: STRING, len: INT>>, "
    "mtid INT, mpos BIGINT, insert_size BIGINT, seq STRING, qual BINARY"
)
_FLAG_TYPES = [("file", pa.string()), ("block_id", pa.int64()), ("flag", pa.int32())]
_COUNT_TYPES = [*_FLAG_TYPES, ("read_count", pa.int64())]
_RECORD_TYPES = [
    *_FLAG_TYPES, ("qname", pa.string()), ("tid", pa.int32()), ("pos", pa.int64()), ("mapq", pa.int32()),
    ("cigar", pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))), ("mtid", pa.int32()), ("mpos", pa.int64()),
    ("insert_size", pa.int64()), ("seq", pa.string()), ("qual", pa.binary()),
]
#: Fixed values of the record format: operations and bases by their codes.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"


class BadBlock(ValueError):
    """A block header that cannot be."""


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (pafs.LocalFileSystem(), path)


def full_header(head: bytes) -> bool:
    """Is this a member with the extra field that holds its size?"""
    return len(head) >= HEADER and head[:2] == MAGIC and head[2] == 8 and head[3] & 4 != 0 and head[12:14] == b"BC" and head[14:16] == b"\x02\x00"


def walk(f: pa.NativeFile, path: str, at: int, end: int, mode: str) -> Iterator[tuple[int, int]]:
    """Offset and size of each block from ``at`` on; a block cut off at the end is left out."""
    while at + HEADER <= end:
        head = f.read_at(HEADER, at)
        total = struct.unpack_from("<H", head, 16)[0] + 1
        if head[:2] != MAGIC or not LEAST <= total <= MOST or mode == "RESYNC" and not full_header(head):
            if mode == "FAILFAST":
                raise BadBlock(f"{path}: no block at offset {at}")
            if mode == "PERMISSIVE":
                return
            at = _next_header(f, at + 1, end)
            continue
        if at + total > end:
            return
        yield at, total
        at += total


def walk_range(f: pa.NativeFile, path: str, low: int, high: int, end: int, mode: str, known: bool) -> Iterator[tuple[int, int]]:
    """The blocks that start in a range, and then those after it; ``known`` says that one starts at ``low``."""
    at = low if known else _next_header(f, low, end)
    if at >= high:
        return
    seam = False
    for at, total in walk(f, path, at, end, mode):
        if at >= high and not seam:
            seam = True
            if mode == "FAILFAST" and _next_header(f, high, end) != at:
                raise BadBlock(f"{path}: no block at offset {at}")
        yield at, total


def ranges(low: int, end: int, size: int) -> list[tuple[int, int]]:
    return [(at, min(at + size, end)) for at in range(low, end, size)]


def discover_blocks(path: str, mode: str = "FAILFAST") -> list[tuple[int, int]]:
    """Offset and size of every block, by walking all headers of a file."""
    fs, name = _open(path)
    with fs.open_input_file(name) as f:
        return list(walk(f, path, 0, fs.get_file_info(name).size, mode))


def _next_header(f: pa.NativeFile, at: int, end: int) -> int:
    """The next offset with a full header whose block is followed by another or by the end."""
    while at + HEADER <= end:
        data = f.read_at(MOST + HEADER, at)
        k = data.find(MAGIC)
        while 0 <= k <= len(data) - HEADER:
            if full_header(data[k:]):
                after = at + k + struct.unpack_from("<H", data, k + 16)[0] + 1
                if after == end or after + HEADER <= end and full_header(f.read_at(HEADER, after)):
                    return at + k
            k = data.find(MAGIC, k + 1)
        at += max(1, len(data) - HEADER + 1)
    return end


def blocks(spark: SparkSession, path: str, mode: str = "FAILFAST", range_bytes: int = 64 << 20) -> DataFrame:
    """The blocks as a table ``start_pos, total_size``, found in byte ranges by as many tasks; ``PERMISSIVE`` in one walk."""
    kinds = "start_pos bigint, total_size bigint"
    if mode == "PERMISSIVE":
        return spark.createDataFrame(discover_blocks(path, mode), kinds)
    fs, name = _open(path)
    end = fs.get_file_info(name).size
    dealt = ranges(0, end, max(range_bytes, LEAST_RANGE))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, name = _open(path)
        with fs.open_input_file(name) as f:
            for batch in batches:
                for low, high in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    # The first block after the range is looked at for the check of the seam, and left to the next one.
                    found = list(itertools.takewhile(lambda b: b[0] < high, walk_range(f, path, low, high, end, mode, low == 0 and mode == "FAILFAST")))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([x[0] for x in found], [x[1] for x in found])], names=["start_pos", "total_size"])

    table = spark.createDataFrame(dealt, "low bigint, high bigint").repartition(max(1, len(dealt)), "low")
    return table.mapInArrow(find, kinds)


class _Stream:
    """The payload of blocks from one on, with the place where each block starts."""

    def __init__(self, f: pa.NativeFile, found: Iterable[tuple[int, int]], mode: str):
        self.f, self.left, self.mode = f, iter(found), mode
        self.data, self.starts = b"", []
        #: Where the last block that was read ends in the file.
        self.end = 0

    def more(self) -> bool:
        for at, total in self.left:
            self.end = at + total
            try:
                payload = zlib.decompress(self.f.read_at(total, at), 31)
            except zlib.error as e:
                if self.mode == "FAILFAST":
                    raise BadBlock(f"block at offset {at} does not inflate") from e
                if self.mode == "PERMISSIVE":
                    self.left = iter(())
                    return False
                continue
            self.starts.append((len(self.data), at))
            self.data += payload
            return True
        return False

    def need(self, end: int) -> bool:
        while len(self.data) < end:
            if not self.more():
                return False
        return True

    def cut(self, at: int) -> int:
        """Forget what stands before ``at``; the new place of it."""
        keep = max((i for i, (start, _) in enumerate(self.starts) if start <= at), default=0)
        self.starts = [(start - at, block) for start, block in self.starts[keep:]]
        self.data = self.data[at:]
        return 0

    def block(self, at: int) -> int:
        return next(block for start, block in reversed(self.starts) if start <= at)


@dataclass(frozen=True)
class Header:
    text: str
    names: tuple[str, ...]
    lengths: tuple[int, ...]
    #: Block of the first record, and its place in the payload.
    block: int
    offset: int


def read_header(path: str, found: Iterable[tuple[int, int]] | None = None, mode: str = "FAILFAST") -> Header:
    """The header, by its own lengths, over as many blocks as it takes, and no more."""
    fs, name = _open(path)
    with fs.open_input_file(name) as f:
        s = _Stream(f, walk(f, path, 0, fs.get_file_info(name).size, mode) if found is None else found, mode)
        if not s.need(12) or s.data[:4] != b"BAM\x01":
            return Header("", (), (), s.starts[0][1] if s.starts else -1, 0)
        (size,) = struct.unpack_from("<i", s.data, 4)
        at = 8 + size
        if not s.need(at + 4):
            raise BadBlock(f"{path}: header cut off")
        text = s.data[8:at].split(b"\0")[0].decode("utf-8", "replace")
        (n,) = struct.unpack_from("<i", s.data, at)
        at, names, lengths = at + 4, [], []
        for _ in range(n):
            if not s.need(at + 4):
                raise BadBlock(f"{path}: header cut off")
            (size,) = struct.unpack_from("<i", s.data, at)
            if not s.need(at + 8 + size):
                raise BadBlock(f"{path}: header cut off")
            names.append(s.data[at + 4 : at + 3 + size].decode("utf-8", "replace"))
            lengths.append(struct.unpack_from("<i", s.data, at + 4 + size)[0])
            at += 8 + size
        if not s.need(at + 1):  # no record follows
            return Header(text, tuple(names), tuple(lengths), -1, 0)
        start, block = next(x for x in reversed(s.starts) if x[0] <= at)
        return Header(text, tuple(names), tuple(lengths), block, at - start)


@dataclass
class _Part(InputPartition):
    path: str
    #: Blocks that start from ``low`` on and before ``high``; none is read from ``end`` on.
    low: int
    high: int
    end: int
    #: Place of the first record in the first block's payload; -1 where it must be found.
    offset: int
    refs: int
    #: Ids in the range whose records are wanted; None for all.
    wanted: frozenset[int] | None


def plausible(data: bytes, at: int, refs: int) -> int:
    """The end of the record at ``at`` if it can be one, else -1; at the data's end ``at`` itself."""
    if len(data) - at < 36:
        return at
    size, tid, pos, named, _, _, cigar, _, bases, mtid, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if size < 32 or not -1 <= tid < refs or not -1 <= mtid < refs or pos < -1 or mpos < -1 or named < 1 or bases < 0:
        return -1
    if 32 + named + 4 * cigar + (bases + 1) // 2 + bases > size or len(data) >= at + 36 + named and data[at + 35 + named] != 0:
        return -1
    return at + 4 + size


def first_record(data: bytes, refs: int, chain: int = 3) -> int:
    """The first place from which plausible records follow each other; -1 without one."""
    for start in range(len(data)):
        at, seen = start, 0
        while seen < chain and 0 <= at < len(data) and len(data) - at >= 36:
            at, seen = plausible(data, at, refs), seen + 1
        if at >= 0 and seen:
            return start
    return -1


class BamReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.kind = options.get("columns", "record").lower()
        self.mode = options.get("mode", "FAILFAST").upper()
        if self.kind not in ("record", "flag", "count") or self.mode not in ("FAILFAST", "PERMISSIVE", "RESYNC"):
            raise ValueError(f"columns {self.kind!r}, mode {self.mode!r}")
        self.mask = Mask(parse_flag(options.get("required", "0")), parse_flag(options.get("forbidden", "0")))
        self.size = int(options.get("partition_bytes", 32 << 20))
        wanted = options.get("blocks")
        self.wanted = None if wanted is None else frozenset(int(x) for x in wanted.split(",") if x)
        self.flags: frozenset[int] | None = None
        self.schema = schema

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        wanted = None if self.wanted is None else sorted(self.wanted)
        for path in self.paths:
            fs, name = _open(path)
            end = fs.get_file_info(name).size
            if self.mode == "PERMISSIVE":
                end = sum(next(reversed(discover_blocks(path, self.mode)), (0, 0)))
            head = read_header(path, None, self.mode)
            if head.block < 0:
                continue
            for low, high in ranges(head.block, end, max(self.size, LEAST_RANGE)):
                some = None if wanted is None else frozenset(wanted[bisect.bisect_left(wanted, low) : bisect.bisect_left(wanted, high)])
                if some is None or some:
                    out.append(_Part(path, low, high, end, head.offset if low == head.block else -1, len(head.names), some))
        return out or [_Part("", 0, 0, 0, 0, 0, None)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, name = _open(partition.path)
        with fs.open_input_file(name) as f:
            if self.kind == "record":
                yield from _batches((_fields(partition.path, *r) for r in self._records(partition, f)), _RECORD_TYPES)
                return
            counts: Counter = Counter()
            for block, flag in self._flags(partition, f):
                if self.kind == "flag":
                    yield _columns(partition.path, [block, flag], _FLAG_TYPES)
                else:
                    keys, n = np.unique(block << 16 | flag, return_counts=True)
                    counts.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
            if counts:
                keys = np.fromiter(counts, np.int64, len(counts))
                yield _columns(partition.path, [keys >> 16, keys & 0xFFFF, np.fromiter(counts.values(), np.int64, len(counts))], _COUNT_TYPES)

    def _opened(self, part: _Part, f: pa.NativeFile) -> tuple[_Stream, int]:
        """The range's stream and the place of its first record; -1 if none starts in it."""
        s = _Stream(f, walk_range(f, part.path, part.low, part.high, part.end, self.mode, part.offset >= 0), self.mode)
        if not s.more():
            return s, -1
        at = part.offset
        if at < 0:
            at = first_record(s.data, part.refs)
            while at < 0:  # a record over whole blocks
                if s.end >= part.high or not s.more():
                    next(s.left, None)  # for the check of the seam
                    return s, -1
                at = first_record(s.data, part.refs)
        return s, at

    def _flags(self, part: _Part, f: pa.NativeFile) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks and flags of the partition's matching records, some blocks at a time."""
        s, at = self._opened(part, f)
        size_at = struct.Struct("<I").unpack_from
        while at >= 0:
            places, data, n = [], s.data, len(s.data)
            while at + 4 <= n:
                end = at + 4 + size_at(data, at)[0]
                if end > n:
                    break
                if end - at >= 20:
                    places.append(at)
                at = end
            if places:
                raw, place = np.frombuffer(data, np.uint8), np.array(places)
                starts = np.array(s.starts)
                block = starts[np.searchsorted(starts[:, 0], place, "right") - 1, 1]
                flag = raw[place + 18].astype(np.int64) | raw[place + 19].astype(np.int64) << 8
                hit = (block < part.high) & (flag & self.mask.required == self.mask.required) & (flag & self.mask.forbidden == 0)
                if self.flags is not None:
                    hit &= np.isin(flag, np.fromiter(self.flags, np.int64, len(self.flags)))
                if part.wanted is not None:
                    hit &= np.isin(block, np.fromiter(part.wanted, np.int64, len(part.wanted)))
                if hit.any() and not self.mask.is_empty:
                    yield block[hit], flag[hit]
            # The next record starts in a later range, or the blocks that follow are needed to finish it.
            if s.end >= part.high and (at >= n or s.block(at) >= part.high):
                next(s.left, None)  # for the check of the seam
                return
            at = s.cut(at)
            if not s.more():
                return
            while len(s.data) < TOGETHER and s.end < part.high and s.more():
                pass

    def _records(self, part: _Part, f: pa.NativeFile) -> Iterator[tuple[int, int, bytes]]:
        """Block, flag and body of the partition's matching records."""
        s, at = self._opened(part, f)
        if at < 0:
            return
        required, forbidden, refused = self.mask.required, self.mask.forbidden, self.mask.is_empty
        while True:
            if at > 1 << 20:
                at = s.cut(at)
            if not s.need(at + 4):
                return
            block = s.block(at)
            if block >= part.high:
                return
            (size,) = struct.unpack_from("<I", s.data, at)
            if not s.need(at + 4 + size):
                return
            if size >= 16 and not refused:
                (flag,) = struct.unpack_from("<H", s.data, at + 18)
                if flag & required == required and not flag & forbidden and (self.flags is None or flag in self.flags) and (part.wanted is None or block in part.wanted):
                    yield block, flag, s.data[at + 4 : at + 4 + size]
            at += 4 + size


class PushingBamReader(BamReader):
    """For sessions that push filters to Python sources; Spark refuses such a reader in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Equality and membership of flags and blocks are done here, the rest is left to Spark."""
        for f in filters:
            values = frozenset([f.value]) if isinstance(f, EqualTo) else frozenset(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("flag",), ("block_id",)):
                yield f
            elif f.attribute == ("flag",):
                self.flags = values if self.flags is None else self.flags & values
            else:
                self.wanted = values if self.wanted is None else self.wanted & values


def _fields(path: str, block: int, flag: int, body: bytes) -> tuple:
    tid, pos, named, mapq, _, n, _, bases, mtid, mpos, size = struct.unpack_from("<iiBBHHHiiii", body.ljust(32, b"\0"))
    at = 32 + named
    qname = body[32 : at - 1].decode("ascii", "replace")
    cigar = [{"op": OPS[c & 15] if c & 15 < len(OPS) else "?", "len": c >> 4} for c in struct.unpack_from(f"<{n}I", body, at)]
    at += 4 * n
    packed = body[at : at + (bases + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:bases]
    at += (bases + 1) // 2
    return path, block, flag, qname, tid, pos, mapq, cigar, mtid, mpos, size, seq, body[at : at + bases]


def _columns(path: str, columns: list[np.ndarray], types: list) -> pa.RecordBatch:
    schema = pa.schema(types)
    files = pa.DictionaryArray.from_arrays(np.zeros(len(columns[0]), np.int32), [path]).dictionary_decode()
    return pa.RecordBatch.from_arrays([files, *(pa.array(c).cast(t) for c, t in zip(columns, schema.types[1:], strict=True))], schema=schema)


def _batches(rows: Iterator[tuple], types: list, size: int = 4096) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(types)
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class BamDataSource(DataSource):
    """Register with ``spark.dataSource.register(BamDataSource)``."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return {"flag": FLAG_SCHEMA, "count": COUNT_SCHEMA}.get(self.options.get("columns", "record").lower(), RECORD_SCHEMA)

    def reader(self, schema: StructType) -> BamReader:
        kind = PushingBamReader if self.options.get("push", "false").lower() == "true" else BamReader
        return kind(dict(self.options), schema)


def read(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    spark.dataSource.register(BamDataSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    found = spark.read.format("bam").option("path", path).option("push", push)
    for key, value in options.items():
        found = found.option(key, str(value))
    return found.load()
