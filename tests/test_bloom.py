import zlib

from foldstone.functions import bloom
from tables import b, order, rows


def slow_bits(keys, size):
    out = bytearray(size)
    for k in keys:
        h = bloom.FNV_OFFSET
        for byte in k:
            h = (h ^ byte) * bloom.FNV_PRIME % 2**64
        c = zlib.crc32(k) or bloom.NO_CRC
        for i in range(bloom.PROBES):
            at = (h + i * c + i * i) % 2**64 % (size * 8)
            out[at // 8] |= 1 << at % 8
    return bytes(out)


def test_bits_and_members():
    for n in (1, 3, 7, 100, 5000):
        keys = [b"key-%d" % (i * i) for i in range(n)] + [b""]
        bits = bloom.build(keys)
        assert len(bits) == max(8, (len(keys) * 10 + 7) // 8) and bloom.may_contain(bits, 6, keys).all()
        if n <= 100:
            assert bits == slow_bits(keys, len(bits))
    assert bloom.may_contain(bits, 6, [b"other%d" % i for i in range(20_000)]).mean() < 0.02
    assert bloom.build([]) == b"" and bloom.may_contain(None, 6, [b"a"]).all() and bloom.may_contain(bits, 6, []).size == 0


def test_health(spark):
    data = [(1, b"a"), (1, b"b"), (2, b"c"), (3, b"d"), (3, b"d"), (4, b"e"), (None, b"x"), (5, None)]
    entries = spark.createDataFrame([(r, b(k), "extra") for r, k in data], "run_id long, key binary, bits string")
    filters = spark.createDataFrame([(1, 6, bytearray(bloom.build([b"a", b"b"]))), (2, 6, bytearray(8)), (2, 6, bytearray(8)), (3, 6, None), (9, 6, bytearray(8))], "run_id long, hash_count int, bits binary")
    assert rows(bloom.filter_health(entries, filters), "run_id", "state", "lost_keys") == order([(1, "sound", 0), (2, "damaged", 1), (3, "missing", 0), (4, "missing", 0)])


def test_given_filters_mostly_hold_their_runs(spark, data):
    """The table's filters are built by the fixed format; only some of them are damaged or missing."""
    got = bloom.filter_health(spark.read.parquet(f"{data}/sst_entries.parquet"), spark.read.parquet(f"{data}/bloom_filters.parquet"))
    states = [r.state for r in got.collect()]
    assert states.count("sound") > 0.8 * len(states)


def test_keys_of_very_unequal_length():
    keys = [b"", b"a", b"x" * 70_000, bytes(range(256)), b"\0", b"\0\0"]

    def fnv(key):
        h = bloom.FNV_OFFSET
        for c in key:
            h = (h ^ c) * bloom.FNV_PRIME % 2**64
        return h

    assert bloom.hash_pair(keys)[0].tolist() == [fnv(k) for k in keys] and bloom.hash_pair([])[0].tolist() == []
