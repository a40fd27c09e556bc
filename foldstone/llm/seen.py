"""Whether each incoming key was seen before, by filters over sealed batches of earlier keys.

The history is sealed in generations: each (generation, key bucket) gets one immutable peeling filter of about
20 bits a key (``xorfilter``), kept in a shared folder. What is sealed stays: a generation has fixed borders, a later
sealing adds a generation for what lies beyond them and builds nothing else anew. The arrivals are cut into a few
batches with filters of their own. A key of the current batch is compared exactly with that batch and
probed in the filters of the history and of all earlier batches. Filters have no false negatives, so what no filter has
is new, and only positives are looked up among the keys themselves: the history is reduced to them before it is shuffled.

Every group by key is pre-aggregated before the shuffle, so that a key with a third of all rows
weighs one row per task. Each generation has as many buckets as its own keys need.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import Folder, dump, materialize, work_dir
from . import xorfilter

#: Keys of one part in one bucket, at most about; it sets the number of buckets, a power of two.
BUCKET_KEYS = 200_000
GENERATIONS, BATCHES = 4, 8
#: Bytes of distinct positive keys up to which they are sent to each task that reads the history.
SENT_BYTES = 32 << 20
FILTERS = "part int, bucket int, bits int, n_keys long, seed int, cells binary"


@dataclass
class Seen:
    """firsts: ``key, batch, first, part_hits, prior`` of each key's first row in each batch, where
    ``part_hits`` is the number of filters that may hold it and ``prior`` whether the exact check
    found it; arrivals: distinct ``(probe_id)``; filters: ``part, bucket, bits, n_keys, seed, cells``."""

    arrivals: DataFrame
    firsts: DataFrame
    filters: DataFrame
    generations: int
    batches: int


def _slot(col, lo, hi, n: int):
    """The part of [lo, hi] that a number lies in, of n equal ones."""
    width = max(1, -(-(hi - lo + 1) // n))
    return F.least(F.lit(n - 1), F.floor((col - F.lit(lo)) / F.lit(width)).cast("int"))


def _span(df: DataFrame, col: str) -> tuple[int, int] | None:
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    return (lo, hi) if lo is not None else None


def _build(key: tuple, table: pa.Table) -> pa.Table:
    hashes = table.column("h").to_numpy()
    seed, cells = xorfilter.build(hashes)
    part, bucket, bits = (x.as_py() for x in key)
    return pa.table({"part": pa.array([part], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "bits": pa.array([bits], pa.int32()), "n_keys": pa.array([len(hashes)], pa.int64()), "seed": pa.array([seed], pa.int32()), "cells": pa.array([cells], pa.binary())})


def build_filters(hashes: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Filters of distinct ``(part, h)``; each part has as many buckets as its keys need."""
    sizes = {r.part: r["count"] for r in hashes.groupBy("part").count().collect()}  # as many rows as parts
    if not sizes:
        return hashes.sparkSession.createDataFrame([], FILTERS)
    bits = F.create_map(*(x for p, n in sizes.items() for x in (F.lit(p), F.lit(max(0, (-(-n // bucket_keys) - 1).bit_length())))))
    spread = hashes.withColumn("bits", bits[F.col("part")]).withColumn("bucket", F.expr("cast(h & (shiftleft(1L, bits) - 1) as int)"))
    return spread.groupBy("part", "bucket", "bits").applyInArrow(_build, FILTERS)


class Sealed:
    """The sealed generations in a shared folder: ``parts/N.json`` with a generation's borders (its rows' order lies
    above ``above`` and up to ``through``) and the folder of its filters. A generation is never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)

    def parts(self) -> list[dict]:
        return [json.loads(self.folder.read(f"parts/{n}")) for n in sorted(self.folder.list("parts")) if n.endswith(".json") and not n.startswith(".")]

    def filters(self) -> DataFrame:
        """``part, bucket, bits, n_keys, seed, cells`` of all generations."""
        folders = sorted({p["folder"] for p in self.parts()})
        return self.spark.read.schema(FILTERS).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], FILTERS)

    def seal(self, history: DataFrame, *, key: str = "key", order: str = "run_id", slices: int = 1, bucket_keys: int = BUCKET_KEYS) -> list[int]:
        """Seal what lies beyond the last generation's border, as ``slices`` generations of equal spans of ``order``; returns their numbers.

        Rows with a NULL key are left out. A NULL order is the least, so such rows are sealed by the first sealing only. A sealed
        span doesn't get more rows later (runs are immutable). Of two sealings at once the second fails and changes nothing.
        """
        old = self.parts()
        rows = history.select(F.col(key).alias("key"), F.col(order).alias("at")).where("key is not null")
        if old:
            rows = rows.where(F.col("at") > old[-1]["through"])
        span = _span(rows, "at")
        if span is None:
            if old or rows.isEmpty():
                return []
            span = (0, 0)  # every order is NULL
        part = (F.coalesce(_slot(F.col("at"), *span, slices), F.lit(0)) + len(old)).alias("part")
        hashes = materialize(rows.select(part, F.xxhash64("key").alias("h")).distinct(), "seen-hashes")
        name = f"filters-{uuid.uuid4().hex}"
        build_filters(hashes, bucket_keys).write.parquet(f"{self.path}/{name}")
        made = sorted(r.part for r in self.spark.read.schema(FILTERS).parquet(f"{self.path}/{name}").select("part").distinct().collect())
        above = old[-1]["through"] if old else None
        for i, number in enumerate(made):
            last = span[0] + max(1, -(-(span[1] - span[0] + 1) // slices)) * (number - len(old) + 1) - 1
            through = span[1] if i == len(made) - 1 else last
            if not self.folder.create(f"parts/{number:09d}.json", dump({"part": number, "above": above, "through": through, "folder": name})):
                raise RuntimeError(f"generation {number} was sealed by another writer")
            above = through
        return made


def _probe(generations: list[int], first_batch: int):
    def run(key: tuple, firsts: pa.Table, filters: pa.Table) -> pa.Table:
        h, batch = firsts.column("h").to_numpy(), firsts.column("batch").to_numpy()
        hits = np.zeros(len(h), np.int32)
        for part, seed, cells in zip(filters.column("part").to_pylist(), filters.column("seed").to_pylist(), filters.column("cells").to_pylist()):
            at = np.flatnonzero(batch > part - first_batch) if part >= first_batch else np.arange(len(h))
            if len(at):
                hits[at] += xorfilter.contains(seed, cells, h[at])
        return firsts.select(["key", "batch", "first"]).append_column("part_hits", pa.array(hits))

    return run


def _reduced(keys: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The distinct rows of ``keys`` whose key is wanted. Few wanted keys go to the tasks that read ``keys``, so that these aren't shuffled; else both are."""
    if size <= SENT_BYTES:
        return keys.join(F.broadcast(wanted), "key", "left_semi").distinct()
    return keys.distinct().join(wanted, "key", "left_semi")


def seen_before(incoming: DataFrame, history: DataFrame, *, id_col: str = "probe_id", key_col: str = "key", history_key: str = "key", history_order: str = "run_id", sealed: Sealed | None = None, generations: int = GENERATIONS, batches: int = BATCHES, bucket_keys: int = BUCKET_KEYS) -> Seen:
    """Filter, probe and check ``incoming`` against ``history`` and against itself.

    ``sealed`` has the generations from earlier runs; what the history has beyond them is sealed first. Without it the history
    is sealed in ``generations`` of equal spans. Order of arrival is ``id_col``. Repeated rows (same id, same key) count once. Rows with a NULL
    key or id are left out; the empty key is a key. NULL keys of the history are left out and a
    NULL ``history_order`` falls in the first generation. Either table may be empty. Only the
    named columns are read, so other columns and their names don't matter.
    """
    spark = incoming.sparkSession
    rows = incoming.select(F.col(id_col).alias("id"), F.col(key_col).alias("key")).where("id is not null and key is not null")
    sealed = sealed or Sealed(spark, work_dir(spark, "seen-sealed"))
    sealed.seal(history, key=history_key, order=history_order, slices=1 if sealed.parts() else generations, bucket_keys=bucket_keys)
    parts = [p["part"] for p in sealed.parts()]
    first_batch = max(parts, default=-1) + 1

    lo, hi = _span(rows, "id") or (0, 0)
    firsts = materialize(rows.withColumn("batch", _slot(F.col("id"), lo, hi, batches)).groupBy("key", "batch").agg(F.min("id").alias("first")).withColumn("h", F.xxhash64("key")), "seen-firsts")
    own = build_filters(firsts.where(F.col("batch") < batches - 1).select((F.col("batch") + first_batch).alias("part"), "h").distinct(), bucket_keys)
    filters = materialize(sealed.filters().unionByName(own), "seen-filters")

    # rows are probed in as many groups as the largest part has buckets; the filters of smaller parts go to several groups
    most = filters.agg(F.coalesce(F.max("bits"), F.lit(0))).first()[0]
    copies = filters.withColumn("group", F.explode(F.expr(f"transform(sequence(0, cast(shiftleft(1, {most} - bits) - 1 as int)), j -> bucket + shiftleft(j, bits))")))
    grouped = firsts.withColumn("group", F.expr(f"cast(h & {(1 << most) - 1}L as int)"))
    probed = materialize(grouped.groupBy("group").cogroup(copies.groupBy("group")).applyInArrow(_probe(parts, first_batch), "key binary, batch int, first long, part_hits int"), "seen-probed")

    positive = probed.where("part_hits > 0")
    wanted = positive.select("key").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("key") + 16), F.lit(0))).first()[0]
    old = _reduced(history.select(F.col(history_key).alias("key")).where("key is not null"), wanted, size)
    since = old.select("key", F.lit(-1).alias("batch")).union(_reduced(firsts.select("key", "batch"), wanted, size)).groupBy("key").agg(F.min("batch").alias("since"))
    checked = positive.join(since, "key").select("key", "batch", "first", "part_hits", (F.col("since") < F.col("batch")).alias("prior"))
    return Seen(rows.select(F.col("id").alias(id_col)).distinct(), probed.where("part_hits = 0").withColumn("prior", F.lit(False)).unionByName(checked), filters, len(parts), batches)


def found(seen: Seen) -> DataFrame:
    """The ids of rows whose key was there before: all but each new key's first row."""
    id_col = seen.arrivals.columns[0]
    new = seen.firsts.where(~F.col("prior")).select(F.col("first").alias(id_col))
    return seen.arrivals.join(new, id_col, "left_anti")


def error_rates(seen: Seen) -> DataFrame:
    """One row per batch: how many filters its keys meet, and expected and measured wrong answers.

    ``expected_rate`` compounds the filters; ``measured_rate`` is the share of new keys that some
    filter took for an old one (all of them caught by the exact check; NULL without new keys).
    """
    expected = F.create_map(*(x for b in range(seen.batches) for x in (F.lit(b), F.lit(float(xorfilter.compounded(seen.generations + b))))))
    wrong = (F.col("part_hits") > 0) & ~F.col("prior")
    return (
        seen.firsts.groupBy("batch")
        .agg(F.count("*").alias("keys"), F.sum((~F.col("prior")).cast("long")).alias("new_keys"), F.sum(wrong.cast("long")).alias("wrong"))
        .select("batch", (F.col("batch") + seen.generations).alias("filters"), "keys", "new_keys", "wrong", expected[F.col("batch")].alias("expected_rate"), F.expr("wrong / nullif(new_keys, 0)").alias("measured_rate"))
    )


def filter_sizes(seen: Seen) -> DataFrame:
    """One row per part: keys, bytes of its filters and bits a key."""
    return seen.filters.groupBy("part").agg(F.sum("n_keys").alias("keys"), F.sum(F.length("cells").cast("long")).alias("bytes")).withColumn("bits_a_key", F.col("bytes") * 8 / F.col("keys"))
