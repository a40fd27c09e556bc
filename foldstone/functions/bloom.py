"""The bloom filters that sorted runs carry: building, probing and checking them."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed values of the filter's format.
BITS_PER_KEY, PROBES, MIN_BYTES = 10, 6, 8
FNV_OFFSET, FNV_PRIME, NO_CRC = 0xCBF29CE484222325, 0x100000001B3, 0x9E3779B97F4A7C15


def hash_pair(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """FNV-1a of 64 bits and CRC-32 (a fixed value in place of 0) of each key, keys of similar length at once byte by byte."""
    lengths = np.array([len(k) for k in keys], np.int64)
    h = np.full(len(keys), FNV_OFFSET, np.uint64)
    sizes = np.array([int(n).bit_length() for n in lengths])
    for size in np.unique(sizes[lengths > 0]):  # padded to less than twice their bytes
        own = np.flatnonzero(sizes == size)
        n, width = lengths[own], int(lengths[own].max())
        rows = np.frombuffer(b"".join(keys[i].ljust(width, b"\0") for i in own), np.uint8).reshape(len(own), width)
        part = h[own]
        with np.errstate(over="ignore"):
            for j in range(width):
                part = np.where(n > j, (part ^ rows[:, j]) * np.uint64(FNV_PRIME), part)
        h[own] = part
    crc = np.array([zlib.crc32(k) or NO_CRC for k in keys], np.uint64)
    return h, crc


def _bits(keys: list[bytes], bits: int, probes: int) -> np.ndarray:
    a, b = hash_pair(keys)
    i = np.arange(probes, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return (a[:, None] + i * b[:, None] + i * i) % np.uint64(bits)


def build(keys: list[bytes]) -> bytes:
    """The bits of a filter over ``keys``; none for no keys."""
    if not keys:
        return b""
    size = max(MIN_BYTES, (len(keys) * BITS_PER_KEY + 7) // 8)
    flags = np.zeros(size * 8, np.uint8)
    flags[_bits(keys, size * 8, PROBES).ravel()] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def may_contain(bits: bytes | None, probes: int | None, keys: list[bytes]) -> np.ndarray:
    """For each key whether the filter may hold it; without a filter all may be there."""
    if not bits or not probes or probes < 0 or not keys:
        return np.ones(len(keys), bool)
    flags = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
    return flags[_bits(keys, len(flags), probes)].all(axis=1)


def _check(_key, entries: pa.Table, filters: pa.Table) -> pa.Table:
    by_run: dict[int, list[bytes]] = {}
    for run, key in zip(entries.column("run_id").to_pylist(), entries.column("key").to_pylist()):
        by_run.setdefault(run, []).append(key)
    have: dict[int, list] = {}
    for run, count, bits in zip(filters.column("run_id").to_pylist(), filters.column("hash_count").to_pylist(), filters.column("bits").to_pylist()):
        have.setdefault(run, []).append((count, bits))
    out = []
    for run, keys in by_run.items():
        states = have.get(run)
        missing = states is None or all(bits is None for _, bits in states)
        lost = 0 if missing else min(int((~may_contain(bits, count, keys)).sum()) for count, bits in states if bits is not None)
        out.append((run, len(keys), "missing" if missing else "damaged" if lost else "sound", lost))
    cols = list(zip(*out)) if out else [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["run_id", "keys", "state", "lost_keys"])


def filter_health(entries: DataFrame, filters: DataFrame, keys_in_task: int = 200_000) -> DataFrame:
    """``(run_id, keys, state, lost_keys)`` of each run with entries: whether its filter is missing, damaged (it denies
    keys that the run holds) or sound. Of several filters of a run the best counts. NULL keys are left out."""
    buckets = max(1, -(-entries.count() // keys_in_task))
    slot = lambda df: df.withColumn("_b", F.pmod(F.xxhash64("run_id"), F.lit(buckets)))
    keys = slot(entries.select("run_id", "key").where("run_id is not null and key is not null").distinct())
    own = slot(filters.select("run_id", "hash_count", "bits").where("run_id is not null").distinct())
    return keys.groupBy("_b").cogroup(own.groupBy("_b")).applyInArrow(_check, "run_id long, keys long, state string, lost_keys long")
