"""Importing and exporting the binary files of an embedded store: log segments and sorted files.

Files are read whole by Spark's binary source, one task per file or more files per task, and
decoded in Arrow batches; they are at most a few hundred megabytes by the store's own limits. They are
written by the executors under a temporary name and then renamed.
"""

from __future__ import annotations

import bisect
import itertools
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import bloom
from ..model import Corrupt, InvalidWrite

# Fixed values of the formats; all numbers are little-endian.
LOG_TYPES = {1: "P", 2: "D", 3: "B", 4: "E"}
LOG_FRAME, LOG_HEAD, MAX_FRAME = struct.Struct("<II"), struct.Struct("<BQ"), 16 << 20
FILE_MAGIC, FILE_HEADER, FILE_VERSIONS = b"LSMTSST1", struct.Struct("<8sII"), (1, 2)
TRAILER, END_MAGIC = struct.Struct("<II"), 0x31545353
FOOTER = {1: struct.Struct("<IQQQIQQI"), 2: struct.Struct("<IQQQIQQIQQI")}
BLOCK_ENTRY, BLOOM_HEAD, LENGTH = struct.Struct("<QII"), struct.Struct("<III"), struct.Struct("<I")
FILE_PUT, FILE_DELETE, BLOCK_BYTES = 1, 2, 64 << 10

LOG_SCHEMA = "segment int, lsn long, type string, key binary, value binary"
FILE_SCHEMA = "id long, key binary, op byte, value binary"


def _bytes_at(data: bytes, at: int) -> tuple[bytes, int]:
    """The counted bytes at a position, and the position after them."""
    (n,) = LENGTH.unpack_from(data, at)
    end = at + LENGTH.size + n
    if end > len(data):
        raise struct.error("too short")
    return data[end - n : end], end


# -- log segments --------------------------------------------------------------


def encode_log(records: Iterable[tuple[int, str, bytes | None, bytes | None]]) -> bytes:
    """Frames of ``(lsn, type, key, value)``; a record that recovery would take for damage is refused."""
    code, out = {v: k for k, v in LOG_TYPES.items()}, []
    for lsn, kind, key, value in records:
        body = LOG_HEAD.pack(code[kind], lsn)
        for part in {"P": (key, value), "D": (key,)}.get(kind, ()):
            body += LENGTH.pack(len(part or b"")) + (part or b"")
        if len(body) > MAX_FRAME:
            raise InvalidWrite(f"record {lsn} has more than {MAX_FRAME} bytes")
        out += [LOG_FRAME.pack(len(body), zlib.crc32(body)), body]
    return b"".join(out)


def _frames(data: bytes) -> Iterator[tuple[int, tuple[int, str, bytes | None, bytes | None]]]:
    """The end of each sound frame and its record."""
    at = 0
    while at + LOG_FRAME.size <= len(data):
        size, crc = LOG_FRAME.unpack_from(data, at)
        at += LOG_FRAME.size
        body = data[at : at + size]
        at += size
        if not 0 < size <= MAX_FRAME or len(body) < size or zlib.crc32(body) != crc:
            return
        try:
            kind, lsn = LOG_HEAD.unpack_from(body)
            letter = LOG_TYPES[kind]
            key = value = None
            if letter in "PD":
                key, end = _bytes_at(body, LOG_HEAD.size)
            if letter == "P":
                value, end = _bytes_at(body, end)
        except (struct.error, KeyError):
            return
        yield at, (lsn, letter, key, value)


def decode_log(data: bytes) -> Iterator[tuple[int, str, bytes | None, bytes | None]]:
    """The records before the first frame that is cut off, empty, too large, damaged or unknown."""
    return (record for _, record in _frames(data))


def sound_bytes(data: bytes) -> int:
    """The length of the part of a segment that ``decode_log`` reads."""
    end = 0
    for end, _ in _frames(data):
        pass
    return end


# -- sorted files --------------------------------------------------------------


def encode_sorted(entries: Iterable[tuple[bytes, int, bytes | None]]) -> bytes:
    """A sorted file of ``(key, op, value)``; keys must be strictly increasing and not empty."""
    data, blocks, keys, start = bytearray(), [], [], 0
    for key, op, value in entries:
        if not key or (keys and key <= keys[-1]):
            raise InvalidWrite("keys of a sorted file must be strictly increasing and not empty")
        if start == len(data):
            first = key
        data += bytes([FILE_PUT if op == 1 else FILE_DELETE]) + LENGTH.pack(len(key)) + key
        if op == 1:
            data += LENGTH.pack(len(value or b"")) + (value or b"")
        keys.append(key)
        if len(data) - start >= BLOCK_BYTES:
            blocks.append((start, len(data) - start, first))
            start = len(data)
    if start < len(data):
        blocks.append((start, len(data) - start, first))
    offset = FILE_HEADER.size
    index = LENGTH.pack(len(blocks)) + b"".join(BLOCK_ENTRY.pack(offset + a, n, len(k)) + k for a, n, k in blocks) if blocks else b""
    bits = bloom.build(keys)
    filters = BLOOM_HEAD.pack(1, bloom.PROBES, len(bits)) + bits if bits else b""
    at = offset + len(data)
    low, high = (keys[0], keys[-1]) if keys else (b"", b"")
    footer = FOOTER[2].pack(2, len(keys), offset, len(data), zlib.crc32(data), at, len(index), zlib.crc32(index), at + len(index), len(filters), zlib.crc32(filters))
    footer += LENGTH.pack(len(low)) + low + LENGTH.pack(len(high)) + high
    return FILE_HEADER.pack(FILE_MAGIC, 2, 0) + bytes(data) + index + filters + footer + TRAILER.pack(len(footer), END_MAGIC)


def decode_sorted(data: bytes) -> list[tuple[bytes, int, bytes | None]]:
    """All entries of a sorted file of version 1 or 2; raises ``Corrupt`` where header, footer, index, filter or data aren't sound."""
    try:
        return _decode_sorted(data)
    except (struct.error, KeyError, IndexError) as e:
        raise Corrupt(f"the file is cut off or damaged: {e}") from e


def _expect(ok: bool, what: str) -> None:
    if not ok:
        raise Corrupt(what)


def _sections(data: bytes) -> tuple[int, int, bytes, bytes, bytes, bytes, int, int, int]:
    """``(count, start, index, filter, low, high, body's start, its end, its checksum)`` of a sorted file whose frame is sound."""
    _expect(len(data) >= FILE_HEADER.size + TRAILER.size, "the file is too small")
    magic, version, _ = FILE_HEADER.unpack_from(data)
    _expect(magic == FILE_MAGIC and version in FILE_VERSIONS, "unknown magic or version")
    size, end = TRAILER.unpack_from(data, len(data) - TRAILER.size)
    footer_at = len(data) - TRAILER.size - size
    _expect(end == END_MAGIC and footer_at >= FILE_HEADER.size, "wrong trailer")
    (kind,) = LENGTH.unpack_from(data, footer_at)
    _expect(kind in FOOTER, "unknown version of the footer")
    _, count, at, length, crc, index_at, index_len, index_crc, *rest = FOOTER[kind].unpack_from(data, footer_at)
    bloom_at, bloom_len, bloom_crc = rest or (index_at + index_len, 0, 0)
    low, after = _bytes_at(data, footer_at + FOOTER[kind].size)
    high, after = _bytes_at(data, after)
    _expect(at == FILE_HEADER.size and index_at == at + length and bloom_at == index_at + index_len and bloom_at + bloom_len == footer_at and after == len(data) - TRAILER.size, "sections don't follow one another")
    index, filters = data[index_at:bloom_at], data[bloom_at:footer_at]
    _expect(zlib.crc32(index) == index_crc and zlib.crc32(filters) == bloom_crc, "wrong checksum")
    _check_index(index, at, length)
    if filters:
        v, probes, n = BLOOM_HEAD.unpack_from(filters)
        _expect(v == 1 and probes > 0 and BLOOM_HEAD.size + n == len(filters), "wrong filter")
    return count, version, index, filters, low, high, at, index_at, crc


def _entries(data: bytes, pos: int, end: int) -> Iterator[tuple[bytes, int, bytes | None]]:
    previous = None
    while pos < end:
        op = data[pos]
        _expect(op in (FILE_PUT, FILE_DELETE), "unknown operation")
        key, pos = _bytes_at(data, pos + 1)
        value = None
        if op == FILE_PUT:
            value, pos = _bytes_at(data, pos)
        _expect(previous is None or key > previous, "keys aren't increasing")
        previous = key
        yield key, 1 if op == FILE_PUT else 0, value
    _expect(pos == end, "an entry crosses the end of its block")


def _decode_sorted(data: bytes) -> list[tuple[bytes, int, bytes | None]]:
    count, _, _, _, low, high, at, end, crc = _sections(data)
    _expect(zlib.crc32(data[at:end]) == crc, "wrong checksum")
    out = list(_entries(data, at, end))
    _expect(len(out) == count and (not out or (low, high) == (out[0][0], out[-1][0])), "count or bounds are wrong")
    return out


def _blocks(index: bytes) -> list[tuple[bytes, int, int]]:
    """``(first key, start, end)`` of each block."""
    out, pos = [], LENGTH.size
    for _ in range(LENGTH.unpack_from(index)[0] if index else 0):
        start, size, n = BLOCK_ENTRY.unpack_from(index, pos)
        out.append((index[pos + BLOCK_ENTRY.size : pos + BLOCK_ENTRY.size + n], start, start + size))
        pos += BLOCK_ENTRY.size + n
    return out


def decode_range(data: bytes, start: bytes | None = None, end: bytes | None = None) -> list[tuple[bytes, int, bytes | None]]:
    """The entries of a sorted file with keys in ``[start, end)``. A file whose bounds lie outside is passed over, and of others only blocks that may hold such keys are decoded."""
    try:
        count, _, index, _, low, high, at, stop, _ = _sections(data)
        if not count or (start is not None and high < start) or (end is not None and low >= end):
            return []
        blocks = _blocks(index) or [(low, at, stop)]
        firsts = [b[0] for b in blocks]
        lo = 0 if start is None else max(0, bisect.bisect_right(firsts, start) - 1)
        hi = len(blocks) if end is None else bisect.bisect_left(firsts, end)
        found = itertools.chain.from_iterable(_entries(data, a, b) for _, a, b in blocks[lo:hi])
        return [e for e in found if (start is None or e[0] >= start) and (end is None or e[0] < end)]
    except (struct.error, KeyError, IndexError) as e:
        raise Corrupt(f"the file is cut off or damaged: {e}") from e


def find_keys(data: bytes, keys: list[bytes]) -> list[tuple[bytes, int, bytes | None]]:
    """The entries of a sorted file with these keys: what its bounds and its filter don't exclude is looked up in one block each."""
    try:
        count, _, index, filters, low, high, at, stop, _ = _sections(data)
        near = sorted({k for k in keys if count and low <= k <= high})
        if filters and near:
            _, probes, _ = BLOOM_HEAD.unpack_from(filters)
            near = [k for k, may in zip(near, bloom.may_contain(filters[BLOOM_HEAD.size :], probes, near)) if may]
        blocks = _blocks(index) or [(low, at, stop)]
        firsts = [b[0] for b in blocks]
        out = []
        for block, own in itertools.groupby(near, lambda k: max(0, bisect.bisect_right(firsts, k) - 1)):
            wanted = set(own)
            out += [e for e in _entries(data, blocks[block][1], blocks[block][2]) if e[0] in wanted]
        return out
    except (struct.error, KeyError, IndexError) as e:
        raise Corrupt(f"the file is cut off or damaged: {e}") from e


def _check_index(index: bytes, at: int, length: int) -> None:
    """Blocks must cover the data without gaps, with increasing first keys."""
    pos, expected, previous = LENGTH.size, at, None
    for _ in range(LENGTH.unpack_from(index)[0] if index else 0):
        start, size, n = BLOCK_ENTRY.unpack_from(index, pos)
        key = index[pos + BLOCK_ENTRY.size : pos + BLOCK_ENTRY.size + n]
        _expect(start == expected and size > 0 and len(key) == n > 0 and (previous is None or key > previous), "wrong block index")
        pos, expected, previous = pos + BLOCK_ENTRY.size + n, start + size, key
    _expect(expected == at + length and pos == max(LENGTH.size, len(index)), "the block index doesn't cover the data")


# -- as tables -----------------------------------------------------------------


def _read(spark: SparkSession, path: str, suffix: str, decode, schema: str, types: list) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                number = int(re.search(r"(\d+)\.\w+$", file)[1])
                rows = iter(decode(content))
                while part := list(itertools.islice(rows, 50_000)):
                    cols = [[number] * len(part), *zip(*part)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return _files(spark, path, suffix).mapInArrow(run, schema)


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", f"*.{suffix}").load(path)
    return files.where(F.col("path").rlike(rf"/\d+\.{suffix}$")).select("path", "content")


def read_log(spark: SparkSession, path: str, from_segment: int = 1) -> DataFrame:
    """``(segment, lsn, type, key, value)`` of the segments in a folder: of each, what stands before its first bad frame."""
    return _read(spark, path, "wal", decode_log, LOG_SCHEMA, [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()]).where(F.col("segment") >= from_segment)


_SORTED_TYPES = [pa.int64(), pa.binary(), pa.int8(), pa.binary()]


def read_sorted(spark: SparkSession, path: str, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """``(id, key, op, value)`` of the sorted files in a folder, whole or of keys in ``[start, end)``; a damaged file fails the query.

    A whole file's data checksum is compared; of a range only frame, index, filter and the decoded blocks are checked.
    """
    decode = decode_sorted if start is None and end is None else lambda data: decode_range(data, start, end)
    return _read(spark, path, "sst", decode, FILE_SCHEMA, _SORTED_TYPES)


def find_sorted(spark: SparkSession, path: str, keys: list[bytes]) -> DataFrame:
    """``(id, key, op, value)`` of some keys in the sorted files of a folder."""
    return _read(spark, path, "sst", lambda data: find_keys(data, keys), FILE_SCHEMA, _SORTED_TYPES)


def repair_log(spark: SparkSession, path: str) -> DataFrame:
    """Cut each segment of a folder behind its last sound frame; ``(segment, kept, cut)`` in bytes. Sound segments aren't written."""

    def run(batches):
        for batch in batches:
            out = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept = sound_bytes(content)
                if kept < len(content):
                    system, at = fs.FileSystem.from_uri(file)
                    hidden = f"{at.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp"
                    with system.open_output_stream(hidden) as stream:
                        stream.write(content[:kept])
                    system.move(hidden, at)
                out.append((int(re.search(r"(\d+)\.\w+$", file)[1]), kept, len(content) - kept))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()))], ["segment", "kept", "cut"])

    done = _files(spark, path, "wal").mapInArrow(run, "segment int, kept long, cut long").collect()  # one row a segment; repairing happens once
    return spark.createDataFrame(done, "segment int, kept long, cut long")


def _write(df: DataFrame, path: str, suffix: str, order: list[str], encode) -> list[str]:
    """One file for each value of the first column; returns their names. A file is made in memory, as it is read."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by([(c, "ascending") for c in order])
        data = encode(zip(*(rows.column(c).to_pylist() for c in rows.column_names[1:])))
        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        name, hidden = f"{key[0].as_py():06d}.{suffix}", f".{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(f"{root}/{hidden}") as out:
            out.write(data)
        system.move(f"{root}/{hidden}", f"{root}/{name}")
        return pa.table({"name": pa.array([name])})

    return sorted(r.name for r in df.groupBy(df.columns[0]).applyInArrow(run, "name string").collect())


def write_log(records: DataFrame, path: str) -> list[str]:
    """Write ``(segment, lsn, type, key, value)`` as segment files in LSN order."""
    return _write(records.select("segment", "lsn", "type", "key", "value"), path, "wal", ["lsn"], encode_log)


def write_sorted(entries: DataFrame, path: str) -> list[str]:
    """Write ``(id, key, op, value)`` as sorted files; a file with a repeated or empty key isn't written."""
    return _write(entries.select("id", "key", "op", "value"), path, "sst", ["key"], encode_sorted)
