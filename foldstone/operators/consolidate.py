"""Consolidation of small sorted runs into few runs of good size.

Runs below their level's size are picked from the metadata. Their entries are range-partitioned by
(group, key, run) and each range is merged in key order by Spark's external sorter, which spills
sorted pieces and merges them k ways; nothing is folded, so repeated entries stay. While the merged
entries stream by, they are rolled into runs by bytes, one Parquet file each, under names made from range and number, so that a
repeated task replaces its own files. Each file is read back and compared by the task that wrote it. Only if the entries of every group are proven the
same, by count and additive checksum over all files, the new runs' metadata and the map from old to new runs are published, in one exclusively created file.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..shared import Folder, dump, materialize, work_dir
from .chunking import starts
from .diff import latest_rows

#: Bytes of a run that is large enough at level 1; it doubles with each level.
SMALL_RUN = 512
#: Bytes at which an output run is closed, about, and bytes of one key range; a smaller group is never cut.
TARGET_RUN, RANGE_BYTES = 64 << 20, 256 << 20
ENTRIES = "store_id int, level int, size long, run_id long, key binary, value binary, op tinyint"


def encoded_bytes(key: Column, value: Column, op: Column) -> Column:
    """Bytes of an entry in a run: operation, key length and key, and for a put value length and value."""
    put = F.when(op == 1, 4 + F.coalesce(F.octet_length(value), F.lit(0))).otherwise(F.lit(0))
    return (5 + F.octet_length(key) + put).cast("long")


def small_runs(meta: DataFrame, small_run: int = SMALL_RUN) -> DataFrame:
    """``(id, store_id, level, file_size)`` of current runs that are too small and not alone in their store's level.

    The newest row of an id counts. Runs without level or with no bytes are left alone. The members of a group are
    counted before the join back, so that a large group is no single task. A NULL store is a group.
    """
    rows = latest_rows(meta, "id", "recorded_at", ["store_id", "level", "file_size"]).select(F.col("k").alias("id"), F.col("f0").alias("store_id"), F.col("f1").alias("level"), F.col("f2").alias("file_size"))
    limit = F.lit(float(small_run)) * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.col("level") - 1))
    small = rows.where(F.col("level").isNotNull() & (F.col("file_size") > 0) & (F.col("file_size") < limit))
    groups = small.groupBy(F.col("store_id").alias("g_store"), F.col("level").alias("g_level")).agg(F.count("*").alias("members")).where("members > 1")
    return small.join(groups, F.col("store_id").eqNullSafe(F.col("g_store")) & (F.col("level") == F.col("g_level")), "left_semi")


def _cut(target: int):
    """Cut the batches of a sorted partition into ``(number of the run, rows)``: a new run at each group and once ``target`` bytes are reached."""

    def run(batches):
        number, filled, group = -1, -1, None
        for batch in batches:
            ids = np.stack([batch.column(i).cast(pa.int64()).fill_null(-(2**40)).to_numpy() for i in (0, 1)])
            sizes = batch.column(2).to_numpy()
            borders = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            for low, high in zip([0, *borders], [*borders, batch.num_rows]):
                if low == high:
                    continue
                if (own := tuple(ids[:, low])) != group:
                    group, filled = own, -1
                    number += 1
                cuts, filled = starts(sizes[low:high], filled, target, False)
                for a, b in zip([0, *cuts], [*cuts, high - low]):
                    number += a > 0 or (bool(cuts) and cuts[0] == 0 and b > a)
                    if b > a:
                        yield number, batch.slice(low + a, b - a)

    return run


def _write_runs(path: str, cut):
    """Write each run of a partition as one file, read it back and compare it; gives the counts and checksums of each file's entries by their old run.

    A run is held in memory, which is about ``TARGET_RUN`` bytes. The last column of the rows is their hash and isn't written.
    """

    def run(batches):
        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()

        def close(number: int, pieces: list) -> pa.RecordBatch:
            rows = pa.Table.from_batches(pieces)
            name, hidden, kept = f"run-{part:06d}-{number:06d}.parquet", f"{root}/.{uuid.uuid4().hex}.tmp", rows.drop_columns(["h"])
            with system.open_output_stream(hidden) as out:
                pq.write_table(kept, out, compression="zstd")
            with system.open_input_file(hidden) as back:
                if not pq.read_table(back).equals(kept):
                    raise RuntimeError(f"{name} isn't what was written")
            size = system.get_file_info(hidden).size
            system.move(hidden, f"{root}/{name}")
            h = rows["h"].to_numpy().view(np.uint64)
            sums = pa.table({"run_id": rows["run_id"], "a": (h >> np.uint64(32)).astype(np.int64), "b": (h & np.uint64(0xFFFFFFFF)).astype(np.int64), "bytes": rows["size"]})
            held = sums.group_by("run_id").aggregate([([], "count_all"), ("a", "sum"), ("b", "sum"), ("bytes", "sum")])
            keys, n = rows["key"].drop_null(), held.num_rows
            low, high = (keys[0], keys[-1]) if len(keys) else (pa.scalar(None, pa.binary()),) * 2
            same = lambda value, kind: pa.array([value] * n, kind)
            cols = [same(name, pa.string()), same(size, pa.int64()), same(rows["store_id"][0].as_py(), pa.int32()), same(rows["level"][0].as_py(), pa.int32())]
            cols += [held[c].combine_chunks().cast(pa.int64()) for c in ("run_id", "count_all", "a_sum", "b_sum", "bytes_sum")] + [same(low.as_py(), pa.binary()), same(high.as_py(), pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["file", "file_size", "store_id", "level", "run_id", "n", "a", "b", "bytes", "min_key", "max_key"])

        now, pieces = None, []
        for number, rows in cut(batches):
            if number != now and pieces:
                yield close(now, pieces)
                pieces = []
            now = number
            if rows.num_rows:
                pieces.append(rows)
        if pieces:
            yield close(now, pieces)

    return run


@dataclass
class Consolidated:
    """What was published. inputs: ``id, store_id, level`` of the runs replaced; entries: ``new_run, store_id, level, run_id, key, value, op``;
    runs: the new runs' metadata; replaced: ``id, new_run``, from old to new runs (``new_run`` is NULL for an old run without entries);
    path: the folder of the new runs' files."""

    inputs: DataFrame
    entries: DataFrame
    runs: DataFrame
    replaced: DataFrame
    path: str

    def swapped(self, meta: DataFrame) -> DataFrame:
        """``(id, store_id, level, file_size)`` of the current runs with the old ones exchanged for the new ones."""
        now = latest_rows(meta, "id", "recorded_at", ["store_id", "level", "file_size"]).select(F.col("k").alias("id"), F.col("f0").alias("store_id"), F.col("f1").alias("level"), F.col("f2").alias("file_size"))
        kept = now.join(self.replaced.select("id").distinct(), "id", "left_anti")
        return kept.unionByName(self.runs.select(F.col("new_run").alias("id"), "store_id", "level", "file_size"))


HELD = "file string, file_size long, store_id int, level int, run_id long, n long, a long, b long, bytes long, min_key binary, max_key binary"


def consolidate(meta: DataFrame, entries: DataFrame, small_run: int = SMALL_RUN, target_run: int = TARGET_RUN, range_bytes: int = RANGE_BYTES) -> Consolidated:
    """Merge the small runs of each (store, level) and publish the new ones; raises if an entry would be lost, doubled or changed.

    Picked runs without entries are replaced by nothing. Entries of other runs aren't touched. NULL keys,
    values and operations are carried along as they are. Empty tables give empty results. A group of less than ``range_bytes``
    stays in one range and so becomes runs of full size and one last run. New ids follow the greatest id of the metadata.
    """
    spark = entries.sparkSession
    inputs = materialize(small_runs(meta, small_run).select("id", "store_id", "level"), "consolidate-inputs")
    size = F.coalesce(encoded_bytes(F.col("key"), F.col("value"), F.col("op")), F.lit(5))
    h = F.xxhash64("run_id", F.col("key").isNull(), "key", F.col("value").isNull(), "value", F.col("op").isNull(), "op")
    picked = entries.select("run_id", "key", "value", "op").join(inputs, F.col("run_id") == F.col("id")).select("store_id", "level", size.alias("size"), "run_id", "key", "value", "op", h.alias("h"))
    group = ["store_id", "level"]
    sums = [F.count("*").alias("n"), F.sum(F.shiftrightunsigned("h", 32)).alias("a"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("b"), F.sum("size").alias("bytes")]
    before = materialize(picked.groupBy(*group).agg(*sums), "consolidate-before")
    total, widest = before.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    ranges = max(-(-total // range_bytes), min(spark.sparkContext.defaultParallelism, -(-total // (1 << 20))), 1)
    order, border = [*group, "key", "run_id"], [F.col(c) for c in group]
    if widest > range_bytes:  # only large groups are cut, at keys
        large = before.where(F.col("bytes") > range_bytes).select(F.col("store_id").alias("_s"), F.col("level").alias("_l"), F.lit(True).alias("large"))
        picked = picked.join(large, F.col("store_id").eqNullSafe(F.col("_s")) & (F.col("level") == F.col("_l")), "left")
        border += [F.when(F.col("large"), F.col("key")), F.when(F.col("large"), F.col("run_id"))]
    merged = picked.repartitionByRange(ranges, *border).sortWithinPartitions(*order).select("store_id", "level", "size", "run_id", "key", "value", "op", "h")
    base = work_dir(spark, "consolidate")
    held = materialize(merged.mapInArrow(_write_runs(f"{base}/runs", _cut(target_run)), HELD), "consolidate-held")
    after = held.groupBy(*group).agg(*(F.sum(c).alias(c) for c in ("n", "a", "b", "bytes")))
    proof = before.select(*group, "n", "a", "b", "bytes")
    if wrong := proof.exceptAll(after).union(after.exceptAll(proof)).take(5):
        raise RuntimeError(f"entries changed in {wrong}")
    top = meta.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    runs = held.groupBy("file", "file_size", *group, "min_key", "max_key").agg(F.sum("n").alias("record_count"), F.sum("bytes").alias("data_length"), F.count("*").alias("inputs"))
    # as many rows as new files
    numbered = runs.withColumn("new_run", F.row_number().over(Window.orderBy("file")) + F.lit(top).cast("long"))
    numbered.select("new_run", *group, "file", "file_size", "record_count", "data_length", "min_key", "max_key", "inputs").write.parquet(f"{base}/meta")
    runs = spark.read.schema("new_run long, store_id int, level int, file string, file_size long, record_count long, data_length long, min_key binary, max_key binary, inputs long").parquet(f"{base}/meta")
    named = held.select("file", F.col("run_id").alias("id")).join(runs.select("file", "new_run"), "file").select("id", "new_run")
    inputs.select("id").join(named, "id", "left").write.parquet(f"{base}/replaced")
    Folder(spark, base).create("published.json", dump({"runs": "runs", "meta": "meta", "replaced": "replaced"}))
    replaced = spark.read.schema("id long, new_run long").parquet(f"{base}/replaced")
    out = spark.createDataFrame([], ENTRIES).withColumn("file", F.lit(""))
    if not runs.isEmpty():
        out = spark.read.schema(ENTRIES).parquet(f"{base}/runs").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return Consolidated(inputs, out.join(runs.select("file", "new_run"), "file").select("new_run", *group, "run_id", "key", "value", "op"), runs, replaced, f"{base}/runs")
