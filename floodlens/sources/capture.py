"""Capture files as a Spark data source: `spark.read.format("capture").load(path)`.

A file is one partition here; `capture_splits` reads large uncompressed files in parallel. A file
is read in blocks; within a block only the record boundaries are walked one by one, all header
fields are taken out of the block with numpy. Files ending in `.gz` and `.bz2` are decompressed on
the fly.
"""

from __future__ import annotations

import bz2
import glob
import gzip
import posixpath
import struct
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from floodlens.schemas import CAPTURED, PACKETS
from floodlens.session import ship_package

# Magic numbers (microseconds, nanoseconds), link types, frame and protocol numbers.
MAGIC = (0xA1B2C3D4, 0xA1B23C4D)
ETHERNET, COOKED, COOKED_2 = 1, 113, 276
RAW = (12, 14, 101, 228)
IPV4 = 0x0800
TAGS = (0x8100, 0x88A8, 0x9100)
MOST_CAPTURED = 262_144  # no tool captures more of a frame, whatever the file header says
TCP, UDP = 6, 17
FLAG_BITS = {"ns": 256, "cwr": 128, "ece": 64, "urg": 32, "ack": 16,
             "psh": 8, "rst": 4, "syn": 2, "fin": 1}
FILE_HEADER, RECORD_HEADER, FRAME_HEADER = 24, 16, 14  # the last one for Ethernet
BLOCK = 4 * 1024 * 1024  # some 10 bytes are held for each of them
WRITE_ROWS_BYTES = 2 * 1024 * 1024


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:"):]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_files(path: str) -> list[str]:
    """Capture files at a path, comma-separated paths, a folder or a local pattern."""
    files = []
    for part in path.split(","):
        if "://" not in part and any(c in part for c in "*?["):
            files.extend(sorted(glob.glob(part)))
            continue
        filesystem, inner = _filesystem(part)
        info = filesystem.get_file_info(inner)
        prefix = part[:-len(inner)] if part.endswith(inner) else ""
        if info.type == fs.FileType.Directory:
            found = filesystem.get_file_info(fs.FileSelector(inner, recursive=True))
            files.extend(prefix + f.path for f in sorted(found, key=lambda f: f.path)
                         if f.type == fs.FileType.File
                         and not f.base_name.startswith(("_", ".")))
        elif info.type == fs.FileType.File:
            files.append(part)
        else:
            raise FileNotFoundError(part)
    return files


@dataclass
class CaptureFile(InputPartition):
    path: str


def _boundaries(block: bytes, order: str, limit: int) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Offsets and captured lengths of the whole records of a block, where they end, and whether a
    record of more than `limit` bytes follows, which no capture holds."""
    length_of = struct.Struct(order + "I").unpack_from
    offsets, lengths, at, broken = [], [], 0, False
    while at + RECORD_HEADER <= len(block):
        (length,) = length_of(block, at + 8)
        if length > limit:
            broken = True
            break
        if at + RECORD_HEADER + length > len(block):
            break
        offsets.append(at)
        lengths.append(length)
        at += RECORD_HEADER + length
    return np.array(offsets, np.int64), np.array(lengths, np.int64), at, broken


def _dotted(numbers: np.ndarray) -> pa.Array:
    values, place = np.unique(numbers, return_inverse=True)
    text = [f"{v >> 24}.{v >> 16 & 255}.{v >> 8 & 255}.{v & 255}" for v in values.tolist()]
    return pa.DictionaryArray.from_arrays(
        pa.array(place.astype(np.int32)), pa.array(text, pa.string())).cast(pa.string())


Number = Callable[[np.ndarray, int], np.ndarray]


def _network_layer(link: int, frame: np.ndarray, end: np.ndarray, number: Number
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Where the packet in each frame starts, and the number of its protocol."""
    if link in RAW:
        return frame, np.full(len(frame), IPV4)
    if link == COOKED:
        return frame + 16, number(frame + 14, 2)
    if link == COOKED_2:
        return frame + 20, number(frame, 2)
    start, kind = frame + 14, number(frame + 12, 2)
    while (tagged := np.isin(kind, TAGS) & (start + 4 <= end)).any():
        kind = np.where(tagged, number(start + 2, 2), kind)
        start = np.where(tagged, start + 4, start)
    return start, kind


@dataclass(frozen=True)
class Condition:
    """A condition on one column that the reader applies before it builds any column."""

    column: str
    kind: str
    values: tuple

    def holds(self, values: np.ndarray, valid: np.ndarray | None) -> np.ndarray:
        """Rows that meet the condition; null rows never do."""
        wanted = self.values[0] if self.values else None
        found = {
            "in": lambda: np.isin(values, np.array(self.values, np.int64)),
            "<": lambda: values < wanted, "<=": lambda: values <= wanted,
            ">": lambda: values > wanted, ">=": lambda: values >= wanted,
            "notnull": lambda: np.ones(len(values), bool),
        }[self.kind]()
        return found if valid is None else found & valid


class Frames:
    """The IPv4 frames among the records of a block. Columns are computed when they are asked for,
    and only for the rows that are left."""

    def __init__(self, block: bytes, order: str, link: int, record: np.ndarray,
                 captured: np.ndarray, nanos: bool = False) -> None:
        self.data = np.frombuffer(block, np.uint8)
        self.order, self.nanos = order, nanos
        frame = record + RECORD_HEADER
        end = frame + captured
        ip, kind = _network_layer(link, frame, end, self.number)
        kept = (kind == IPV4) & (ip + 20 <= end) & (self.number(ip, 1) >> 4 == 4)
        self._set(record[kept], end[kept], ip[kept])

    def _set(self, record: np.ndarray, end: np.ndarray, ip: np.ndarray) -> None:
        self.record, self.end, self.ip = record, end, ip
        self.header = self.number(ip, 1) & 15
        self.transport = ip + self.header * 4
        self.protocol = self.number(ip + 9, 1)
        first = (self.number(ip + 6, 2) & 0x1FFF) == 0
        self.is_tcp = (self.protocol == TCP) & first & (self.transport + 20 <= end)
        self.is_udp = (self.protocol == UDP) & first & (self.transport + 8 <= end)

    def keep(self, conditions: Sequence[Condition]) -> None:
        """Leave out the rows that fail a condition."""
        kept = np.ones(len(self.record), bool)
        for condition in conditions:
            kept &= condition.holds(*self.numbers(condition.column))
        if not kept.all():
            self._set(self.record[kept], self.end[kept], self.ip[kept])

    def number(self, at: np.ndarray, size: int) -> np.ndarray:
        value = np.zeros(len(at), np.int64)
        for i in range(size):
            # Positions beyond the block belong to rows that are masked out.
            value = value << 8 | self.data[np.minimum(at + i, len(self.data) - 1)]
        return value

    def _clock(self, at: int) -> np.ndarray:
        return np.ascontiguousarray(
            self.data[self.record[:, None] + np.arange(at, at + 4)]).view(
            self.order + "u4").ravel().astype(np.int64)

    def numbers(self, name: str) -> tuple[np.ndarray, np.ndarray | None]:
        """A column as numbers (addresses too), and which rows have it, if not all."""
        ip, transport = self.ip, self.transport
        if name in _IP_FIELDS:
            at, size, shift, mask = _IP_FIELDS[name]
            return self.number(ip + at, size) >> shift & mask, None
        if name in _TCP_FIELDS:
            at, size, shift, mask = _TCP_FIELDS[name]
            return self.number(transport + at, size) >> shift & mask, self.is_tcp
        if name in _UDP_FIELDS:
            at, size = _UDP_FIELDS[name]
            return self.number(transport + at, size), self.is_udp
        if name == "ts":
            return self._clock(0), None
        if name == "ts_micros":
            fraction = self._clock(4)
            return self._clock(0) * 1_000_000 + (fraction // 1000 if self.nanos else fraction), None
        if name == "ip_header_length":
            return self.header, None
        if name == "tcp_len":
            words = np.maximum(self.number(transport + 12, 1) >> 4, 5)
            total = self.number(ip + 2, 2)
            return np.maximum(total - self.header * 4 - words * 4, 0), self.is_tcp
        raise KeyError(name)

    def payload(self) -> pa.Array:
        """The bytes behind the TCP or UDP header, as far as captured and without padding behind
        the packet; null for other packets. One gather for the whole block: what lies between the
        payloads is masked out."""
        words = np.maximum(self.number(self.transport + 12, 1) >> 4, 5)
        start = self.transport + np.where(self.is_tcp, words * 4, 8)
        total = self.number(self.ip + 2, 2)
        # A length of zero is left to the network card (segmentation offload).
        stop = np.where(total > 0, np.minimum(self.end, self.ip + total), self.end)
        held = self.is_tcp | self.is_udp
        start = np.minimum(start, self.end)
        size = np.where(held, np.maximum(stop - start, 0), 0)
        some = size > 0
        edges = np.zeros(len(self.data) + 1, np.int8)
        edges[start[some]] += 1
        edges[(start + size)[some]] -= 1
        body = self.data[np.cumsum(edges[:-1], dtype=np.int8).view(bool)]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        valid = pa.array(held).buffers()[1]
        return pa.Array.from_buffers(
            pa.binary(), len(held), [valid, pa.py_buffer(offsets), pa.py_buffer(body)])

    def column(self, name: str) -> pa.Array:
        if name == "payload":
            return self.payload()
        values, valid = self.numbers(name)
        if name in ("ip_src", "ip_dst"):
            return _dotted(values)
        column = pa.array(values, mask=None if valid is None else ~valid)
        return column.cast(pa.string()) if name == "udp_checksum" else column


# Place, size, shift and mask of the header fields.
_IP_FIELDS = {
    "ip_version": (0, 1, 4, 15), "ip_tos": (1, 1, 0, 255), "ip_total_length": (2, 2, 0, 65535),
    "ip_id": (4, 2, 0, 65535), "ip_flags": (6, 2, 13, 7), "ip_more_fragments": (6, 2, 13, 1),
    "ip_frag_offset": (6, 2, 0, 0x1FFF), "ip_ttl": (8, 1, 0, 255), "ip_proto": (9, 1, 0, 255),
    "ip_checksum": (10, 2, 0, 65535), "ip_src": (12, 4, 0, 0xFFFFFFFF),
    "ip_dst": (16, 4, 0, 0xFFFFFFFF),
}
_TCP_FIELDS = {
    "tcp_sport": (0, 2, 0, 65535), "tcp_dport": (2, 2, 0, 65535),
    "tcp_seq_id": (4, 4, 0, 0xFFFFFFFF), "tcp_ack_id": (8, 4, 0, 0xFFFFFFFF),
    "tcp_offset": (12, 1, 4, 15),
    **{f"tcp_{name}": (12, 2, bit.bit_length() - 1, 1) for name, bit in FLAG_BITS.items()},
    "tcp_window": (14, 2, 0, 65535),
}
_UDP_FIELDS = {"udp_sport": (0, 2), "udp_dport": (2, 2), "udp_len": (4, 2), "udp_checksum": (6, 2)}


@dataclass(frozen=True)
class Wanted:
    """Columns to build, in order, and conditions on the rows."""

    columns: tuple[str, ...] = tuple(PACKETS.names)
    conditions: tuple[Condition, ...] = ()

    def schema(self) -> pa.Schema:
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(),
                 "binary": pa.binary()}
        return pa.schema([(n, kinds[CAPTURED[n].dataType.simpleString()]) for n in self.columns])


HEADERS = Wanted()


def decode(block: bytes, order: str, link: int = ETHERNET, limit: int = MOST_CAPTURED,
           wanted: Wanted = HEADERS, nanos: bool = False
           ) -> tuple[dict[str, pa.Array], int, int, bool]:
    """The wanted columns of the IPv4 frames in a block, their number, the number of bytes used,
    and whether a broken record follows."""
    record, captured, used, broken = _boundaries(block, order, limit)
    frames = Frames(block, order, link, record, captured, nanos)
    frames.keep(wanted.conditions)
    columns = {name: frames.column(name) for name in wanted.columns}
    return columns, len(frames.record), used, broken


def byte_order(head: bytes, path: str) -> str:
    """Byte order of a capture from the header of its file."""
    for order in "<>":
        if len(head) == FILE_HEADER and struct.unpack_from(order + "I", head)[0] in MAGIC:
            return order
    raise ValueError(f"{path} is not a capture file")


def counts_nanos(head: bytes, order: str) -> bool:
    """Whether fractions of seconds are nanoseconds, from the header of the file."""
    return struct.unpack_from(order + "I", head)[0] == MAGIC[1]


def link_type(head: bytes, order: str, path: str) -> int:
    """Link type of a capture; raises for those that are not decoded."""
    link = struct.unpack_from(order + "I", head, 20)[0] & 0xFFFF
    if link not in (ETHERNET, COOKED, COOKED_2, *RAW):
        raise ValueError(f"{path}: link type {link} is not supported")
    return link


def _batches(take: Callable[[int], bytes], head: bytes, order: str, path: str, strict: bool,
             wanted: Wanted = HEADERS) -> Iterator[pa.RecordBatch]:
    """Decode what `take` gives, block by block. A record cut off by the end of the file ends it; a
    broken one raises if `strict`, else it ends the file too."""
    schema = wanted.schema()
    nanos = counts_nanos(head, order)
    link = link_type(head, order, path)
    limit = max(MOST_CAPTURED, struct.unpack_from(order + "I", head, 16)[0])
    if limit > 64 * MOST_CAPTURED:  # some writers leave the field unset or all ones
        limit = MOST_CAPTURED
    rest = b""
    while more := take(BLOCK):
        block = rest + more
        columns, count, used, broken = decode(block, order, link, limit, wanted, nanos)
        rest = block[used:]
        if count:
            yield pa.RecordBatch.from_arrays(
                [columns[f.name].cast(f.type) for f in schema], schema=schema)
        if broken and strict:
            raise ValueError(f"{path}: a record claims more bytes than a frame can have; "
                             "read with badRecords=stop to keep what is before it")
        if broken:
            return


def read_capture(path: str, strict: bool = True, wanted: Wanted = HEADERS
                 ) -> Iterator[pa.RecordBatch]:
    """The packets of one file; a truncated tail ends it, a broken record raises if `strict`."""
    filesystem, inner = _filesystem(path)
    with filesystem.open_input_stream(inner, compression=None) as raw:
        stream = raw
        if inner.endswith(".gz"):
            stream = gzip.GzipFile(fileobj=raw)
        elif inner.endswith((".bz", ".bz2")):
            stream = bz2.BZ2File(raw)

        def take(size: int) -> bytes:
            if stream is raw:
                return bytes(raw.read(size))
            # Piecewise, so that a torn compressed file still gives what is before the tear.
            parts, missing = [], size
            try:
                while missing and (part := stream.read1(missing)):
                    parts.append(part)
                    missing -= len(part)
            except EOFError:
                pass
            return b"".join(parts)

        head = take(FILE_HEADER)
        yield from _batches(take, head, byte_order(head, path), path, strict, wanted)


def read_range(path: str, start: int, end: int, strict: bool = True, wanted: Wanted = HEADERS
               ) -> Iterator[pa.RecordBatch]:
    """The packets between two record boundaries of an uncompressed file."""
    filesystem, inner = _filesystem(path)
    with filesystem.open_input_file(inner) as file:
        head = file.read(FILE_HEADER)
        file.seek(start)
        yield from _batches(lambda size: file.read(min(size, end - file.tell())), head,
                            byte_order(head, path), path, strict, wanted)


def _address_number(text: str) -> int | None:
    """Number of a dotted address as the reader writes it, or None."""
    parts = text.split(".")
    if len(parts) != 4 or not all(p.isascii() and p.isdigit() and len(p) < 4 for p in parts):
        return None
    numbers = [int(p) for p in parts]
    if max(numbers) > 255 or ".".join(map(str, numbers)) != text:
        return None
    return sum(n << s for n, s in zip(numbers, (24, 16, 8, 0)))


_COMPARED = {EqualTo: "in", EqualNullSafe: "in", In: "in", LessThan: "<", LessThanOrEqual: "<=",
             GreaterThan: ">", GreaterThanOrEqual: ">=", IsNotNull: "notnull"}


def condition_of(found: Filter) -> Condition | None:
    """What the reader can do for a filter: equality, order and membership of numbers, equality and
    membership of addresses, presence. None for all others."""
    kind = _COMPARED.get(type(found))
    name = ".".join(found.attribute) if kind else None
    if name in ("payload", "udp_checksum") or name not in CAPTURED.names:
        return None
    if kind == "notnull":
        return Condition(name, kind, ())
    values = list(found.value) if isinstance(found, In) else [found.value]
    values = [v for v in values if v is not None]  # equal to nothing
    if isinstance(found, EqualNullSafe) and not values:
        return None
    if name in ("ip_src", "ip_dst"):
        if kind != "in":
            return None
        values = [n for v in values if (n := _address_number(v)) is not None]
    return Condition(name, kind, tuple(values)) if values or kind == "in" else None


class CaptureReader(DataSourceReader):
    """Reads the columns of its schema; filters that it can apply to headers are applied before any
    column is built."""

    def __init__(self, path: str, strict: bool, columns: tuple[str, ...]) -> None:
        self.path = path
        self.strict = strict
        self.wanted = Wanted(columns)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for found in filters:
            condition = condition_of(found)
            if condition is None:
                yield found
            else:
                self.wanted = replace(
                    self.wanted, conditions=(*self.wanted.conditions, condition))

    def partitions(self) -> list[CaptureFile]:
        return [CaptureFile(f) for f in list_files(self.path)]

    def read(self, partition: CaptureFile) -> Iterator[pa.RecordBatch]:
        return read_capture(partition.path, self.strict, self.wanted)


def encode(batch: pa.RecordBatch) -> bytes:
    """Packets as capture records that hold the headers, and the payloads of TCP and UDP packets and
    fractions of seconds if there are columns `payload` and `ts_micros`."""
    def column(name: str) -> np.ndarray:
        values = batch.column(batch.schema.get_field_index(name)).cast(pa.int64())
        return values.fill_null(0).to_numpy(zero_copy_only=False)

    def address(name: str) -> np.ndarray:
        values = batch.column(batch.schema.get_field_index(name)).fill_null("0.0.0.0")
        coded = values.dictionary_encode()
        numbers = [sum(int(part) << s for part, s in zip(text.split("."), (24, 16, 8, 0)))
                   for text in coded.dictionary.to_pylist()]
        return np.array(numbers, np.int64)[coded.indices.to_numpy()]

    protocol = column("ip_proto")
    is_tcp, is_udp = protocol == TCP, protocol == UDP
    headers = FRAME_HEADER + 20 + np.where(is_tcp, 20, np.where(is_udp, 8, 0))
    body, sizes = np.zeros(0, np.uint8), np.zeros(len(protocol), np.int64)
    if "payload" in batch.schema.names:
        held = batch.column(batch.schema.get_field_index("payload")).fill_null(b"")
        held = pc.if_else(pa.array(is_tcp | is_udp), held, pa.scalar(b"", held.type))
        sizes = pc.binary_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
        body = np.frombuffer(b"".join(held.to_pylist()), np.uint8)
    captured = headers + sizes
    ends = np.cumsum(captured + RECORD_HEADER)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    record = ends - captured - RECORD_HEADER

    def put(at: np.ndarray, values: np.ndarray, size: int, little: bool = False) -> None:
        for i in range(size):
            shift = 8 * (i if little else size - 1 - i)
            out[at + i] = values >> shift & 255

    put(record, column("ts"), 4, little=True)
    if "ts_micros" in batch.schema.names:
        put(record + 4, column("ts_micros") % 1_000_000, 4, little=True)
    if len(body):
        some = sizes > 0
        edges = np.zeros(len(out) + 1, np.int8)
        edges[(record + RECORD_HEADER + headers)[some]] += 1
        edges[ends[some]] -= 1
        out[np.cumsum(edges[:-1], dtype=np.int8).view(bool)] = body
    put(record + 8, captured, 4, little=True)
    put(record + 12, FRAME_HEADER + column("ip_total_length"), 4, little=True)
    ip = record + RECORD_HEADER + FRAME_HEADER
    put(ip - 2, np.full(len(ip), IPV4), 2)
    put(ip, np.full(len(ip), 0x45), 1)
    put(ip + 1, column("ip_tos"), 1)
    put(ip + 2, column("ip_total_length"), 2)
    put(ip + 4, column("ip_id"), 2)
    put(ip + 6, (column("ip_flags") & 6 | column("ip_more_fragments") & 1) << 13, 2)
    put(ip + 8, column("ip_ttl"), 1)
    put(ip + 9, protocol, 1)
    put(ip + 10, column("ip_checksum"), 2)
    put(ip + 12, address("ip_src"), 4)
    put(ip + 16, address("ip_dst"), 4)
    at = ip[is_tcp] + 20
    put(at, column("tcp_sport")[is_tcp], 2)
    put(at + 2, column("tcp_dport")[is_tcp], 2)
    put(at + 4, column("tcp_seq_id")[is_tcp], 4)
    put(at + 8, column("tcp_ack_id")[is_tcp], 4)
    bits = sum((column(f"tcp_{name}") & 1) * bit for name, bit in FLAG_BITS.items())
    put(at + 12, (column("tcp_offset") << 12 | bits)[is_tcp], 2)
    put(at + 14, column("tcp_window")[is_tcp], 2)
    at = ip[is_udp] + 20
    put(at, column("udp_sport")[is_udp], 2)
    put(at + 2, column("udp_dport")[is_udp], 2)
    put(at + 4, column("udp_len")[is_udp], 2)
    checksum = batch.column(batch.schema.get_field_index("udp_checksum"))
    numeric = checksum.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    put(at + 6, numeric[is_udp], 2)
    return out.tobytes()


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch with payloads of at most `WRITE_ROWS_BYTES`, or one row with a larger one."""
    if "payload" not in batch.schema.names:
        yield batch
        return
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index("payload"))).fill_null(0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(ends):
        held = ends[low - 1] if low else 0
        high = int(np.searchsorted(ends, held + WRITE_ROWS_BYTES, side="right"))
        high = max(high, low + 1)
        yield batch.slice(low, high - low)
        low = high


@dataclass
class Written(WriterCommitMessage):
    file: str


class CaptureWriter(DataSourceArrowWriter):
    """One capture file per task, moved into place when the whole job has succeeded."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path = path.rstrip("/")
        self.overwrite = overwrite

    def _pending(self, inner: str) -> str:
        return posixpath.join(inner, "_temporary")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        filesystem, inner = _filesystem(self.path)
        filesystem.create_dir(self._pending(inner), recursive=True)
        name = f"part-{uuid.uuid4().hex}.pcap"
        with filesystem.open_output_stream(posixpath.join(self._pending(inner), name)) as out:
            out.write(struct.pack("<IHHiIII", MAGIC[0], 2, 4, 0, 0, 65535, ETHERNET))
            for batch in iterator:
                for part in _parts(batch):
                    out.write(encode(part))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        filesystem, inner = _filesystem(self.path)
        filesystem.create_dir(inner, recursive=True)
        if self.overwrite:
            for old in filesystem.get_file_info(fs.FileSelector(inner)):
                if old.type == fs.FileType.File:
                    filesystem.delete_file(old.path)
        for message in messages:
            if message is not None:
                filesystem.move(posixpath.join(self._pending(inner), message.file),
                                posixpath.join(inner, message.file))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        filesystem, inner = _filesystem(self.path)
        if filesystem.get_file_info(self._pending(inner)).type == fs.FileType.Directory:
            filesystem.delete_dir(self._pending(inner))


class CaptureSource(DataSource):
    """Packets from and to capture files; options `path` and `badRecords`: `raise` (default) or
    `stop`, which keeps what a file holds before a record that no capture can hold.

    The schema may be any choice of the columns of `CAPTURED`; only these are built.
    """

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> StructType:
        return PACKETS

    def reader(self, schema: StructType) -> CaptureReader:
        choice = self.options.get("badRecords", "raise")
        if choice not in ("raise", "stop"):
            raise ValueError("badRecords is raise or stop")
        unknown = [name for name in schema.names if name not in CAPTURED.names]
        if unknown:
            raise ValueError(f"captures have no columns {', '.join(unknown)}")
        return CaptureReader(self.options["path"], choice == "raise", tuple(schema.names))

    def writer(self, schema: StructType, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options["path"], overwrite)


def register_capture(spark: SparkSession) -> None:
    """Make the `capture` format known to the session, and let filters reach it."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)


def packet_scan_pcap(spark: SparkSession, path: str, bad_records: str = "raise",
                     columns: Sequence[str] | None = None) -> DataFrame:
    """Capture files as packets, one partition per file; frames that are not IPv4 are dropped.

    Frames of Ethernet (tagged or not), raw IP and the cooked form are read; other link types
    raise. `bad_records` says what happens at a record that claims more bytes than a frame can
    have: `raise`, or `stop` reading that file there. `columns` names the columns to build, of
    `schemas.CAPTURED`; without it the packet layout is read, which has no payload.
    """
    register_capture(spark)
    reader = spark.read.format("capture").option("badRecords", bad_records)
    if columns is not None:
        reader = reader.schema(StructType([CAPTURED[name] for name in columns]))
    return reader.load(path)
