import random
import struct
import zlib

import pytest

from foldstone.model import Corrupt, InvalidWrite
from foldstone.sources import binary
from tables import b, order, rows

LOG = [(1, "P", b"a", b"1"), (2, "B", None, None), (3, "D", b"", None), (4, "P", b"k" * 300, b""), (5, "E", None, None)]


def test_log_round_trip_and_every_cut():
    data = binary.encode_log(LOG)
    assert list(binary.decode_log(data)) == LOG
    ends = [len(binary.encode_log(LOG[:n])) for n in range(len(LOG) + 1)]
    for cut in range(len(data)):
        assert list(binary.decode_log(data[:cut])) == LOG[: sum(e <= cut for e in ends) - 1]


@pytest.mark.parametrize("bad", [b"\0" * 8, struct.pack("<II", 17 << 20, 0), struct.pack("<II", 9, 1) + b"\1" * 9, struct.pack("<II", 9, zlib.crc32(b"\x09" * 9)) + b"\x09" * 9, struct.pack("<II", 3, zlib.crc32(b"abc")) + b"abc"])
def test_log_ends_at_the_first_bad_frame(bad):
    data = binary.encode_log(LOG[:2])
    assert list(binary.decode_log(data + bad + binary.encode_log(LOG[2:]))) == LOG[:2]


def test_too_large_records_are_refused():
    with pytest.raises(InvalidWrite):
        binary.encode_log([(1, "P", b"k", b"x" * (16 << 20))])


ENTRIES = [(b"k%03d" % i, i % 7 and 1, b"v" * 2048 if i % 7 else None) for i in range(80)]


def test_sorted_round_trip_over_blocks():
    for entries in ([], ENTRIES[:1], ENTRIES):
        assert binary.decode_sorted(binary.encode_sorted(entries)) == entries
    assert binary.encode_sorted(ENTRIES).count(b"k032") == 1 and len(binary.encode_sorted(ENTRIES)) > 2 * binary.BLOCK_BYTES


@pytest.mark.parametrize("entries", [[(b"b", 1, b""), (b"a", 1, b"")], [(b"a", 1, b""), (b"a", 0, None)], [(b"", 1, b"")]])
def test_unsorted_repeated_and_empty_keys_are_refused(entries):
    with pytest.raises(InvalidWrite):
        binary.encode_sorted(entries)


def test_every_damaged_byte_is_found():
    data = binary.encode_sorted(ENTRIES[:5])
    for at in range(len(data)):
        if 12 <= at < 16:  # reserved
            continue
        with pytest.raises(Corrupt):
            binary.decode_sorted(data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :])
    for cut in range(0, len(data), 7):
        with pytest.raises(Corrupt):
            binary.decode_sorted(data[:cut])


def test_files_as_tables(spark, tmp_path):
    rng = random.Random(1)
    log = [(s, n, rng.choice("PDBE"), b"k%d" % n, b"v") for s in (1, 2, 12) for n in range(20)]
    log = [(s, n, t, k if t in "PD" else None, v if t == "P" else None) for s, n, t, k, v in log]
    df = spark.createDataFrame([(s, n, t, b(k), b(v), "x") for s, n, t, k, v in log], binary.LOG_SCHEMA + ", extra string").repartition(3)
    assert binary.write_log(df, f"file://{tmp_path}/log") == ["000001.wal", "000002.wal", "000012.wal"]
    (tmp_path / "log" / "junk.wal").write_bytes(b"x")
    first = tmp_path / "log" / "000001.wal"
    first.write_bytes(first.read_bytes()[:-1])
    kept = [r for r in log if r[:2] != (1, 19)]
    assert rows(binary.read_log(spark, f"file://{tmp_path}/log"), "segment", "lsn", "type", "key", "value") == order(kept)
    assert rows(binary.read_log(spark, f"file://{tmp_path}/log", 2), "segment").count((1,)) == 0
    runs = spark.createDataFrame([(i, b(k), op, b(v)) for i in (3, 4) for k, op, v in ENTRIES], "id long, key binary, op byte, value binary").repartition(4)
    assert binary.write_sorted(runs, f"file://{tmp_path}/runs") == ["000003.sst", "000004.sst"]
    assert rows(binary.read_sorted(spark, f"file://{tmp_path}/runs")) == rows(runs)


def test_ranges_and_points_decode_few_blocks(monkeypatch):
    data, keys = binary.encode_sorted(ENTRIES), [e[0] for e in ENTRIES]
    decoded = []
    entries = binary._entries
    monkeypatch.setattr(binary, "_entries", lambda d, a, b: decoded.append((a, b)) or entries(d, a, b))
    for start, end in ((None, None), (b"k010", b"k012"), (None, b"k001"), (b"k079", None), (b"k0311", b"k0319"), (b"z", None), (None, b""), (b"k05", b"k05")):
        assert binary.decode_range(data, start, end) == [e for e in ENTRIES if (start is None or e[0] >= start) and (end is None or e[0] < end)]
    decoded.clear()
    assert binary.decode_range(data, b"k010", b"k012") == ENTRIES[10:12] and len(decoded) == 1
    decoded.clear()
    assert binary.find_keys(data, [keys[70], keys[3], b"k0035", b"a", b"zz", keys[3]]) == [ENTRIES[3], ENTRIES[70]] and len(decoded) <= 3
    assert binary.find_keys(binary.encode_sorted([]), keys) == binary.decode_range(binary.encode_sorted([])) == []
    with pytest.raises(Corrupt):
        binary.find_keys(data[:-1], keys)


def test_torn_segments_are_cut(spark, tmp_path):
    df = spark.createDataFrame([(s, n, "P", b("k"), b("v")) for s in (1, 2) for n in range(5)], binary.LOG_SCHEMA)
    path = f"file://{tmp_path}/log"
    binary.write_log(df, path)
    torn = tmp_path / "log" / "000002.wal"
    whole = torn.read_bytes()
    torn.write_bytes(whole + whole[:9])
    assert rows(binary.repair_log(spark, path), "segment", "kept", "cut") == [(1, len(whole), 0), (2, len(whole), 9)]
    assert torn.read_bytes() == whole and rows(binary.repair_log(spark, path), "cut") == [(0,), (0,)]
