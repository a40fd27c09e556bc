"""Rebuilding the current state of a table from a stream of inserts, updates and deletes.

The stream's state keeps, for each key, its last sequence number with the payload or the tombstone
that came with it. A change is accepted only if its number is greater, so repeated, late and
unordered changes don't matter. Each micro-batch writes the keys that it touched to a folder named
after the batch; a repeated batch overwrites its own folder. The newest version of each key in
these folders is the table.

A log is fed in as it grows (``Feed``). What is new is found by position; of a store whose log only went on, just the part behind its last
closed batch is resolved again. Where a delivery changes what was fed before, the store's log is resolved anew and its changes
get a greater epoch, so that they win over what they correct.

State is a built-in streaming aggregate, which is combined before the shuffle: a key with a third
of all changes reaches its state as one row per task.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ledger import _after, type_letter
from ..shared import Folder, dump, materialize, work_dir

#: LSNs of one chunk; markers are looked up within chunks, and chunks among each other.
CHUNK = 16384
#: Bytes of the feed that a micro-batch takes for each core of the cluster.
CORE_BYTES = 4 << 20
KEYS = ["feed", "store_id", "key"]
CHANGES = "feed string, store_id int, key binary, epoch long, seq long, live boolean, value binary"
MARKS = "store_id int, through struct<segment:int,lsn:long>, seen long, settled long, epoch long"
#: Stands for a NULL segment, the lowest.
NO_SEGMENT = -(2**31)


def effective_log(wal: DataFrame, chunk: int = CHUNK, ends: bool = False) -> DataFrame:
    """``(store_id, lsn, letter, key, value)``: puts and deletes in force, after deliveries and batches are resolved; with ``ends`` the ends of batches too.

    Of the deliveries of one LSN the one in the highest segment counts (a NULL segment is the
    lowest; of several the greatest content). A put or delete with a key counts if, in LSN order of
    its store, the marker before it is absent or an end, or is a begin while the next marker is an
    end. Rows without LSN don't count, and of other types neither. Rows without a store are the log of
    one store, the NULL one. Markers are summed up per chunk
    of LSNs and carried between chunks, so one store's log is never a single task.
    """
    chunks = F.floor(F.col("lsn") / chunk)
    rows = wal.where("lsn is not null").select("store_id", F.col("store_id").isNull().alias("none"), chunks.alias("chunk"), "lsn", "segment", type_letter(F.col("type")).alias("letter"), "key", "value")
    # one shuffle by (store, chunk) serves the fold, the window and the summary
    rows = rows.withColumn("store_id", F.coalesce("store_id", F.lit(0)))  # joins don't match NULLs; the NULL store differs from 0 by "none"
    top = rows.repartition("store_id", "none", "chunk").groupBy("store_id", "none", "chunk", "lsn").agg(F.max(F.struct("segment", "letter", "key", "value")).alias("r"))
    log = top.select("store_id", "none", "chunk", "lsn", "r.letter", "r.key", "r.value").withColumn("marker", F.when(F.col("letter").isin("B", "E"), F.col("letter")))
    borders = log.where("marker is not null").groupBy("store_id", "none", "chunk").agg(F.max_by("marker", "lsn").alias("last_in"), F.min_by("marker", "lsn").alias("first_in"))
    here = log.select("store_id", "none", "chunk").distinct().join(borders, ["store_id", "none", "chunk"], "left")
    # lag and lead that skip NULLs take one pass; a frame up to the last row would be read again for each row
    near = "{}({}) IGNORE NULLS OVER (PARTITION BY store_id, none{} ORDER BY {})"
    by_chunk = lambda f, c: F.expr(near.format(f, c, "", "chunk"))
    within = lambda f: F.expr(near.format(f, "marker", ", chunk", "lsn"))
    carried = here.select("store_id", "none", "chunk", by_chunk("lag", "last_in").alias("carry_before"), by_chunk("lead", "first_in").alias("carry_after"))
    seen = log.join(carried, ["store_id", "none", "chunk"]).select(
        F.when(~F.col("none"), F.col("store_id")).alias("store_id"), "lsn", "letter", "key", "value",
        F.coalesce(within("lag"), F.col("carry_before")).alias("before"), F.coalesce(within("lead"), F.col("carry_after")).alias("after"),
    )
    kept = "letter in ('P', 'D') and key is not null and (before is null or before = 'E' or after = 'E')"
    return seen.where(f"{kept} or letter = 'E'" if ends else kept).drop("before", "after")


def log_changes(wal: DataFrame, ends: bool = False) -> DataFrame:
    """The changes of a log as rows of ``CHANGES`` of epoch 0; with ``ends`` the ends of batches too, without a key."""
    live, mark = F.col("letter") == "P", F.col("letter") == "E"
    rows = effective_log(wal, ends=ends)
    return rows.select(F.lit("wal").alias("feed"), "store_id", F.when(~mark, F.col("key")).alias("key"), F.lit(0).cast("long").alias("epoch"), F.col("lsn").alias("seq"), live.alias("live"), F.when(live, F.col("value")).alias("value"))


def command_changes(ops: DataFrame) -> DataFrame:
    """The changes of versioned commands; rows without sequence, key or operation don't count. 1 is a put, all else deletes."""
    live = F.col("op") == 1
    good = ops.where("seq is not null and key is not null and op is not null")
    return good.select(F.lit("mem").alias("feed"), "store_id", "key", F.lit(0).cast("long").alias("epoch"), "seq", live.alias("live"), F.when(live, F.col("value")).alias("value"))


def apply_changes(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream of ``CHANGES`` until its source is exhausted, writing touched keys to ``out/batch=N``.

    May be called again with the same folders to go on where a run ended or failed.
    """
    spark = stream.sparkSession
    newest = F.max(F.struct("epoch", "seq", "live", "value")).alias("s")

    def upsert(df: DataFrame, batch: int) -> None:
        df.select(*KEYS, "s.epoch", "s.seq", "s.live", "s.value").write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={batch}")

    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
        # a batch adds its changes to the state's log instead of uploading whole files, and old versions go soon
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.minBatchesToRetain": "2",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        folded = stream.groupBy(*KEYS).agg(newest)
        folded.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(upsert).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _parts(spark: SparkSession, out: str) -> tuple[int, list[str]]:
    """The last batch that is merged (-1: none), and the folders that hold the table: what was merged, and each batch since."""
    folder = Folder(spark, out)
    merged = max((int(n[7:-5]) for n in folder.list() if n.startswith("merged-") and n.endswith(".json")), default=-1)
    since = sorted(int(n[6:]) for n in folder.list() if n.startswith("batch="))
    return merged, [*([f"merged-{merged}"] if merged >= 0 else []), *(f"batch={n}" for n in since if n > merged)]


def _newest(spark: SparkSession, out: str) -> DataFrame:
    parts = _parts(spark, out)[1]
    rows = spark.read.schema(CHANGES).parquet(*(f"{out}/{p}" for p in parts)) if parts else spark.createDataFrame([], CHANGES)
    return rows.groupBy(*KEYS).agg(F.max(F.struct("epoch", "seq", "live", "value")).alias("s")).select(*KEYS, "s.epoch", "s.seq", "s.live", "s.value")


def current_table(spark: SparkSession, out: str) -> DataFrame:
    """``(feed, store_id, key, seq, live, value)`` of each key's newest version, tombstones among them. A folder without batches is an empty table."""
    return _newest(spark, out).drop("epoch")


def merge_batches(spark: SparkSession, out: str) -> int:
    """Fold the batches so far into one folder, so that reading doesn't get slower with each batch; returns the last batch in it.

    Meant for times when no batch is being repeated (after ``apply_changes`` has returned). The folder counts once its marker is there; what it
    replaces is deleted afterwards, and a merge that died in between is repeated under the same name.
    """
    merged, parts = _parts(spark, out)
    last = max((int(p[6:]) for p in parts if p.startswith("batch=")), default=merged)
    if last > merged:
        _newest(spark, out).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/merged-{last}")
        folder = Folder(spark, out)
        folder.create(f"merged-{last}.json", "{}")
        for p in parts:
            folder.delete(p)
    return last


def _stream(spark: SparkSession, base: str, batch_bytes: int | None) -> DataFrame:
    """Apply what the folder ``base/feed`` has beyond what was applied; returns the current table."""
    size = batch_bytes or CORE_BYTES * spark.sparkContext.defaultParallelism
    stream = spark.readStream.schema(CHANGES).option("maxBytesPerTrigger", size).option("recursiveFileLookup", "true").parquet(f"{base}/feed").where("key is not null")
    apply_changes(stream, f"{base}/table", f"{base}/checkpoint")
    return current_table(spark, f"{base}/table")


def rebuild(changes: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """Feed ``changes`` through the stream in micro-batches of about ``batch_bytes`` (by default ``CORE_BYTES`` a core); returns the current table.

    Of two changes with one number the put wins, then the greater value. Empty feeds give no rows.
    """
    base = work_dir(changes.sparkSession, "cdc")
    changes.write.option("compression", "zstd").parquet(f"{base}/feed")
    return _stream(changes.sparkSession, base, batch_bytes)


class Feed:
    """A growing log, and commands beside it, kept as a table in a shared folder.

    ``marks-N.json`` names what step N has fed and, for each store, the position through which its log was taken (segment and
    LSN), the greatest LSN seen, the last end of a batch (what lies up to it is settled) and the epoch of its changes.
    A step counts once its file is there; its changes are moved to the stream's folder afterwards, and by the next step if this one dies.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)

    def _step(self) -> tuple[int, str]:
        """The number of steps taken, and the folder of the last one's marks; moves changes that a step has left behind."""
        n = 1 + max((int(f[6:-5]) for f in self.folder.list() if f.startswith("marks-") and f.endswith(".json")), default=-1)
        last = json.loads(self.folder.read(f"marks-{n - 1:06d}.json")) if n else {}
        if n and self.folder.exists(last["changes"]):
            self.folder.move(last["changes"], f"feed/{n - 1:06d}")
        return n, last.get("marks", "")

    def advance(self, wal: DataFrame, commands: DataFrame | None = None, batch_bytes: int | None = None) -> DataFrame:
        """Take what ``wal`` has beyond the last step, and all of ``commands`` (repeated ones don't matter); returns the current table.

        A record is new if it stands beyond the position through which its store was taken, so within a segment LSNs are expected
        to ascend; rows with a NULL segment are taken by a store's first step only. Stores without new records aren't resolved again, and of others
        only what lies behind the last end of a batch. Records that are delivered again as they are change nothing. A
        store in which a number up to its greatest so far comes new or with another content is resolved anew; keys that have nothing in force then get tombstones.
        """
        n, before = self._step()
        at = F.struct(F.coalesce(F.col("segment"), F.lit(NO_SEGMENT)).cast("int").alias("segment"), F.col("lsn").alias("lsn"))
        rows = wal.where("lsn is not null").select("store_id", "segment", "lsn", "type", "key", "value", at.alias("at"))
        name = f"step-{n:06d}-{uuid.uuid4().hex}"
        if n:
            old = self.spark.read.schema(MARKS).parquet(f"{self.path}/{before}").select(F.col("store_id").alias("_s"), *(F.col(c).alias(f"_{c}") for c in ("through", "seen", "settled", "epoch")))
            near = rows.join(old, F.col("store_id").eqNullSafe(F.col("_s")), "left")
            new = F.col("_through").isNull() | _after(F.col("at"), F.col("_through"))
            # numbers that were delivered again; it matters only if that changes what counts for the number, which is one row a number
            again = near.where(new & (F.col("lsn") <= F.col("_seen"))).select(F.col("store_id").alias("_a"), F.col("lsn").alias("_n")).distinct()
            content = F.struct("segment", type_letter(F.col("type")).alias("letter"), "key", "value")
            both = near.join(again, F.col("store_id").eqNullSafe(F.col("_a")) & (F.col("lsn") == F.col("_n")), "left_semi").groupBy("store_id", "lsn").agg(F.max(content).alias("now"), F.max(F.when(~new, content)).alias("then"))
            other = reduce(lambda a, b: a | b, [~F.col(f"now.{c}").eqNullSafe(F.col(f"then.{c}")) for c in ("letter", "key", "value")])
            corrected = both.where(F.col("then").isNull() | other).select(F.col("store_id").alias("_c")).distinct().withColumn("late", F.lit(True))
            stores = near.groupBy("store_id").agg(F.bool_or(new).alias("touched"), F.max("at").alias("through"), F.max("lsn").alias("seen"), F.max("_settled").alias("settled"), F.coalesce(F.max("_epoch"), F.lit(0)).alias("epoch"))
            # one row a store
            stores = stores.join(corrected, F.col("store_id").eqNullSafe(F.col("_c")), "left").withColumn("late", F.col("late").isNotNull())
            stores = materialize(stores.select("store_id", "touched", "late", "through", "seen", F.when(~F.col("late"), F.col("settled")).alias("settled"), F.when(F.col("late"), F.lit(n)).otherwise(F.col("epoch")).cast("long").alias("epoch")), "cdc-stores")
            own = stores.select(F.col("store_id").alias("_s"), "touched", "settled", F.col("epoch").alias("_epoch"), "late")
            same = F.col("store_id").eqNullSafe(F.col("_s"))
            wanted = rows.join(own.where("touched"), same).where(F.col("settled").isNull() | (F.col("lsn") > F.col("settled"))).select(*rows.columns)
            changes = log_changes(wanted, ends=True).drop("epoch").join(own.select("_s", F.col("_epoch").alias("epoch")), same).drop("_s")
            changes = materialize(changes.select(*_CHANGE_COLUMNS), "cdc-changes")
            # keys of corrected stores that have nothing in force any more
            kept = changes.where("key is not null").select(F.col("store_id").alias("_s"), F.col("key").alias("_k")).distinct()
            held = _newest(self.spark, f"{self.path}/table").where("feed = 'wal' and live").join(own.where("late").select("_s", F.col("_epoch").alias("now")), same).drop("_s", "epoch")
            gone = held.join(kept, same & (F.col("key") == F.col("_k")), "left_anti")
            changes = changes.unionByName(gone.select("feed", "store_id", "key", F.col("now").alias("epoch"), "seq", F.lit(False).alias("live"), F.lit(None).cast("binary").alias("value")))
        else:
            stores = rows.groupBy("store_id").agg(F.max("at").alias("through"), F.max("lsn").alias("seen"), F.lit(None).cast("long").alias("settled"), F.lit(0).cast("long").alias("epoch"))
            changes = log_changes(rows, ends=True)
        if commands is not None:
            changes = changes.unionByName(command_changes(commands))
        changes.write.option("compression", "zstd").parquet(f"{self.path}/{name}/changes")
        fed = self.spark.read.schema(CHANGES).parquet(f"{self.path}/{name}/changes")
        ends = fed.where("feed = 'wal' and key is null").groupBy(F.col("store_id").alias("_e")).agg(F.max("seq").alias("ended"))
        marks = stores.join(ends, F.col("store_id").eqNullSafe(F.col("_e")), "left").select("store_id", "through", "seen", F.greatest("ended", "settled").alias("settled"), "epoch")
        marks.write.parquet(f"{self.path}/{name}/marks")
        if not self.folder.create(f"marks-{n:06d}.json", dump({"changes": f"{name}/changes", "marks": f"{name}/marks"})):
            raise RuntimeError(f"step {n} was taken by another writer")
        self._step()
        return _stream(self.spark, self.path, batch_bytes)


_CHANGE_COLUMNS = [c.split()[0] for c in CHANGES.split(", ")]
