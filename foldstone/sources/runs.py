"""Sorted runs as Parquet folders: unique keys, sorted within files, disjoint files, bloom filters on the key."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import OPS, Corrupt
from ..operators.consolidate import encoded_bytes
from ..plans.compaction import RunMeta, ranges_overlap
from ..shared import Folder

#: Rows of a file for which its bloom filter is sized; a filter for far more keys than there are would outweigh small files.
BLOOM_MIN, BLOOM_MAX = 1_000, 5_000_000


def sized(ops: DataFrame) -> DataFrame:
    return ops.withColumn("size", encoded_bytes(F.col("key"), F.col("value"), F.col("op")))


def write_rows(ops: DataFrame, root: str, kind: str, *, rows_in_file: int, ranges: int | None = None) -> tuple[str, dict[str, int]]:
    """Write ``OPS`` rows to a new folder below ``root``; returns its relative name and its files with their sizes.

    Rows are sorted by key and newest version; with ``ranges`` files have disjoint key ranges.
    """
    name = f"{kind}/{uuid.uuid4().hex}"
    if ranges:
        ops = ops.repartitionByRange(ranges, "key")
    ndv = min(BLOOM_MAX, max(BLOOM_MIN, rows_in_file))
    writer = ops.sortWithinPartitions("key", F.desc("seq")).write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", ndv)
    writer.parquet(f"{root}/{name}")
    files = {n: size for n, size in Folder(ops.sparkSession, root).list(name).items() if n.endswith(".parquet")}
    return name, files


def read_rows(spark: SparkSession, root: str, names: Iterable[str]) -> DataFrame:
    """The rows of published folders; no folder gives an empty DataFrame."""
    paths = [f"{root}/{n}" for n in names]
    return spark.read.schema(OPS).parquet(*paths) if paths else spark.createDataFrame([], OPS)


def measure(rows: DataFrame) -> dict:
    """Count, bytes and bounds of rows, and whether their keys are unique."""
    r = sized(rows).agg(F.count("*").alias("record_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("data_length"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.coalesce(F.max("seq"), F.lit(0)).alias("max_seq"), F.coalesce(F.min("seq"), F.lit(0)).alias("min_seq")).first()
    return {k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items()}


def check_files(folder: Folder, name: str, files: dict[str, int], what: str) -> None:
    """Compare a published folder with what the manifest says about its files."""
    there = {n: size for n, size in folder.list(name).items() if n.endswith(".parquet")}
    if missing := set(files) - set(there):
        raise Corrupt(f"{what}: files are missing, {sorted(missing)[:3]}")
    if wrong := [n for n in files if there[n] != files[n]]:
        raise Corrupt(f"{what}: files have other sizes, {wrong[:3]}")


def check_content(spark: SparkSession, root: str, run: RunMeta) -> None:
    """Read a run and compare count, bytes and bounds with the manifest."""
    try:
        got = measure(read_rows(spark, root, [run.path]))
    except Exception as e:
        raise Corrupt(f"run {run.id} can't be read: {e}") from e
    for field in ("record_count", "data_length", "min_key", "max_key"):
        if got[field] != getattr(run, field):
            raise Corrupt(f"run {run.id}: {field} is {got[field]!r}, published was {getattr(run, field)!r}")


def prune(runs: Iterable[RunMeta], start: bytes | None, end: bytes | None) -> list[RunMeta]:
    """The runs that may hold keys in ``[start, end)``, by their bounds alone."""
    out = []
    for r in runs:
        low = start if start is not None else r.min_key
        if r.min_key is None or (end is not None and r.min_key >= end):
            continue
        if ranges_overlap(low, r.max_key if end is None else max(end, low), r.min_key, r.max_key):
            out.append(r)
    return out
