"""Records as BAM files: a directory in which each task's file is complete.

A file holds the header, whole records in blocks of at most 65,280 bytes of
payload (so no record that fits one crosses blocks), and the end marker.  Files
are named by task attempt; the commit removes what other attempts left.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .bam import BASES, OPS, _open

#: Fixed values of the format: payload of a block, a member's first 16 bytes, the end marker.
PAYLOAD = 65280
HEAD = bytes.fromhex("1f8b08040000000000ff060042430200")
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(payload: bytes) -> bytes:
    """One member of the compressed file."""
    for level in (6, 0):
        c = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = c.compress(payload) + c.flush()
        if len(body) + 26 <= 1 << 16:
            break
    return HEAD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(payload), len(payload))


def header(text: str, names: list[str], lengths: list[int]) -> bytes:
    raw = text.encode()
    out = b"BAM\x01" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(names))
    for name, length in zip(names, lengths, strict=True):
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    return out


def _bin(start: int, end: int) -> int:
    """The smallest of the nested intervals of 2^14 to 2^29 positions that holds [start, end)."""
    for shift in range(14, 29, 3):
        if start >> shift == (end - 1) >> shift:
            return ((1 << (29 - shift)) - 1) // 7 + (start >> shift)
    return 0


def encode(row: dict) -> bytes:
    """A record's bytes with their length."""
    name, seq, cigar = (row["qname"] or "*").encode() + b"\0", row["seq"] or "", row["cigar"] or []
    codes = [BASES.find(c.upper()) if c.upper() in BASES else 15 for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    qual = row["qual"] if row["qual"] is not None and len(row["qual"]) == len(seq) else b"\xff" * len(seq)
    number = lambda key, default: default if row[key] is None else row[key]
    pos = number("pos", -1)
    covered = sum(c["len"] for c in cigar if c["op"] in "MDN=X") or 1
    body = struct.pack("<iiBBHHHiiii", number("tid", -1), pos, len(name), number("mapq", 255), _bin(pos, pos + covered) if pos >= 0 else 4680, len(cigar), row["flag"], len(seq), number("mtid", -1), number("mpos", -1), number("insert_size", 0))
    body += name + b"".join(struct.pack("<I", c["len"] << 4 | OPS.index(c["op"])) for c in cigar) + packed + bytes(qual)
    return struct.pack("<I", len(body)) + body


@dataclass
class _Done(WriterCommitMessage):
    name: str | None


class BamWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.head = header(options.get("header", ""), [x for x in options.get("names", "").split(",") if x], [int(x) for x in options.get("lengths", "").split(",") if x])
        fs, root = _open(self.path)
        if fs.get_file_info(root).type != pafs.FileType.NotFound and fs.get_file_info(pafs.FileSelector(root)) and not overwrite:
            raise ValueError(f"{self.path} holds files already")
        fs.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.bam"
        fs, root = _open(self.path)
        sink, held = None, b""
        for batch in iterator:
            for row in batch.to_pylist():
                if sink is None:
                    sink = fs.open_output_stream(f"{root}/{name}")
                    for at in range(0, len(self.head), PAYLOAD):
                        sink.write(block(self.head[at : at + PAYLOAD]))
                data = encode(row)
                if held and len(held) + len(data) > PAYLOAD:
                    sink.write(block(held))
                    held = b""
                held += data
                while len(held) > PAYLOAD:  # a record longer than a block
                    sink.write(block(held[:PAYLOAD]))
                    held = held[PAYLOAD:]
        if sink is None:
            return _Done(None)
        if held:
            sink.write(block(held))
        sink.write(END)
        sink.close()
        return _Done(name)

    def _keep(self, names: set[str]) -> None:
        fs, root = _open(self.path)
        for info in fs.get_file_info(pafs.FileSelector(root)):
            if info.base_name.endswith(".bam") and info.base_name not in names:
                fs.delete_file(info.path)

    def commit(self, messages: list[_Done | None]) -> None:
        self._keep({m.name for m in messages if m is not None and m.name})

    def abort(self, messages: list[_Done | None]) -> None:
        if not self.overwrite:
            self._keep(set())


class BamSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam_sink"

    def writer(self, schema: StructType, overwrite: bool) -> BamWriter:
        return BamWriter(dict(self.options), overwrite)


def write(records: DataFrame, path: str, text: str = "", names: tuple[str, ...] = (), lengths: tuple[int, ...] = (), mode: str = "append") -> None:
    """Write records (of ``bam.read``'s columns) as complete BAM files below ``path``."""
    records.sparkSession.dataSource.register(BamSink)
    rows = records.select("flag", "qname", "tid", "pos", "mapq", "cigar", "mtid", "mpos", "insert_size", "seq", "qual")
    rows.write.format("bam_sink").mode(mode).options(path=path, header=text, names=",".join(names), lengths=",".join(map(str, lengths))).save()
