"""A versioned, ordered key-value store on Parquet, read as DataFrames.

Writes are atomic commits of operations; ``flush`` folds the commits into a sorted run of level 0,
``compact`` merges runs into deeper levels. Each step publishes a new manifest snapshot, and readers
resolve versions by sequence number alone, never by the order of files. Everything
bulk stays distributed; the driver holds the manifest and single rows.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from .model import DELETE, OPS, PUT, Closed, Conflict, Corrupt, Failed, InvalidBatch, InvalidWrite, NotFound, Options
from .operators import fold
from .plans.compaction import Plan, RunMeta, pick
from .shared import Folder, work_dir
from .sources import runs as run_files
from .sources.manifest import LogCommit, Manifest, Snapshot


#: Keys of a multi-get that are sent to the scan as values; Parquet's filters take that many.
FEW_KEYS = 10


class Batch:
    """Ordered commands that become visible together; of several on one key the last wins. It stays filled after ``write``."""

    def __init__(self, owner: Store):
        self.owner = owner
        self.commands: list[tuple[int, bytes, bytes | None]] = []

    def put(self, key: bytes, value: bytes | None) -> None:
        self.commands.append((PUT, bytes(key), bytes(value or b"")))

    def delete(self, key: bytes) -> None:
        self.commands.append((DELETE, bytes(key), None))

    def __len__(self) -> int:
        return len(self.commands)

    def reset(self) -> None:
        self.commands.clear()


class Store:
    """Use ``open_store``. One writer at a time is expected; a second one is refused or retried, never lost."""

    def __init__(self, spark: SparkSession, path: str, options: Options, durable: bool):
        self.spark, self.path, self.options, self.durable = spark, path.rstrip("/"), options, durable
        self.folder, self.manifest = Folder(spark, self.path), Manifest(spark, self.path)
        self.closed, self.failed = False, None

    # -- writing ---------------------------------------------------------

    def put(self, key: bytes, value: bytes | None) -> None:
        """One command, one commit: meant for few writes. A None value is stored as the empty value."""
        self._write_commands([(PUT, bytes(key), bytes(value or b""))])

    def delete(self, key: bytes) -> None:
        """A tombstone, also for a key that isn't there."""
        self._write_commands([(DELETE, bytes(key), None)])

    def new_batch(self) -> Batch:
        return Batch(self)

    def write(self, batch: Batch | None) -> None:
        """Commit a batch, all or nothing. An empty batch publishes nothing."""
        self._ensure_open()
        if batch is None or batch.owner is not self:
            raise InvalidBatch("the batch is None or of another store")
        if batch.commands:
            self._write_commands(list(batch.commands))

    def _write_commands(self, commands: list[tuple[int, bytes, bytes | None]]) -> None:
        self._ensure_open()
        for _, key, value in commands:
            if len(key) + len(value or b"") > self.options.max_record:
                raise InvalidWrite(f"a record has more than {self.options.max_record} bytes")

        def rows(first: int) -> DataFrame:
            return self.spark.createDataFrame([(bytearray(k), first + i, op, None if v is None else bytearray(v)) for i, (op, k, v) in enumerate(commands)], OPS).coalesce(1)

        self._commit(rows, len(commands))

    def write_rows(self, df: DataFrame, order: str | None = None, stream: tuple[str, int] | None = None) -> None:
        """Commit a DataFrame with ``key``, ``value`` and optionally ``op`` (1 put, 0 delete) at once; the bulk way to write.

        With ``order`` the last row of each key by that column counts; without it keys must be unique. NULL keys
        are refused. A put with a NULL value stores the empty value. Other columns are ignored; an empty DataFrame publishes nothing.
        ``stream`` (a name and a batch number) is published with the rows: a batch of that stream that isn't newer than
        the last one published is left out.
        """
        self._ensure_open()
        op = F.col("op").cast("byte") if "op" in df.columns else F.lit(PUT).cast("byte")
        value = F.when(op == PUT, F.coalesce(F.col("value"), F.lit(bytearray()))) if "value" in df.columns else F.lit(None).cast("binary")
        cols = [F.col("key"), op.alias("op"), value.alias("value")]
        ops = df.select(*cols, *([F.col(order).alias("_order")] if order else []))
        large = F.length("key") + F.coalesce(F.length("value"), F.lit(0)) > self.options.max_record
        odd = ops.agg(F.count_if(F.expr("key is null or op is null or op not in (0, 1)")).alias("bad"), F.count_if(large).alias("large")).first()
        if odd.bad or odd.large:
            raise InvalidWrite(f"{odd.bad} rows have no key or no operation, {odd.large} have more than {self.options.max_record} bytes")
        if order:
            ops = fold.latest(ops, seq="_order").drop("_order")
        elif ops.groupBy("key").count().where("count > 1").limit(1).count():
            raise InvalidWrite("a key comes twice, and no order is given")
        self._commit(lambda seq: ops.select("key", F.lit(seq).cast("long").alias("seq"), "op", "value"), 1, stream)

    def _commit(self, rows, numbers: int, stream: tuple[str, int] | None = None) -> None:
        if self.failed:
            raise Failed("an earlier flush or compaction failed") from self.failed
        while True:
            base = self.manifest.load()
            if self.options.auto_flush and sum(c.data_length for c in base.log) > 2 * self.options.memtable:
                self._maintain()  # whoever wrote that much has left it unflushed; writing waits for it
                continue
            if stream and base.streams.get(stream[0], -1) >= stream[1]:
                return
            streams = base.streams | ({stream[0]: stream[1]} if stream else {})
            name, files = run_files.write_rows(rows(base.next_seq), self.path, "log", rows_in_file=numbers)
            stats = run_files.measure(run_files.read_rows(self.spark, self.path, [name]))
            if not stats["record_count"]:
                self.folder.delete(name)
                return
            commit = LogCommit(base.next_segment, name, stats["record_count"], stats["data_length"], stats["min_seq"], stats["max_seq"], files)
            try:
                new = self.manifest.commit(base, log=(*base.log, commit), next_seq=base.next_seq + numbers, next_segment=base.next_segment + 1, streams=streams)
                break
            except Conflict:
                self.folder.delete(name)  # written with numbers that another writer took; they are written anew
        if self.options.auto_flush and sum(c.data_length for c in new.log) > self.options.memtable:
            self._maintain()

    def _maintain(self) -> None:
        """Flush after a write. What was written stays; if the flush fails, this handle refuses further writes until the store is opened again."""
        try:
            self.flush()
        except Conflict:
            pass  # another writer flushed
        except Exception as e:
            self.failed = e
            raise

    # -- reading ---------------------------------------------------------

    def ops(self, start: bytes | None = None, end: bytes | None = None, version: int | None = None) -> DataFrame:
        """Every stored version of keys in ``[start, end)`` in a snapshot, unfolded. Runs out of range aren't opened."""
        self._ensure_open()
        at = self.manifest.load(version)
        names = [*(c.path for c in at.log), *(r.path for r in run_files.prune(at.runs, start, end))]
        return fold.in_range(run_files.read_rows(self.spark, self.path, names), start, end)

    def entries(self, start: bytes | None = None, end: bytes | None = None, version: int | None = None) -> DataFrame:
        """The newest operation of each key, tombstones among them."""
        return fold.latest(self.ops(start, end, version))

    def scan(self, start: bytes | None = None, end: bytes | None = None, version: int | None = None) -> DataFrame:
        """``(key, value)`` of live keys in ``[start, end)``. Unordered until the caller sorts, so that it may be joined or aggregated."""
        return self.entries(start, end, version).where(F.col("op") == PUT).select("key", "value")

    def get(self, key: bytes, version: int | None = None) -> bytes:
        """The value of one key, or ``NotFound``."""
        self._ensure_open()
        at = self.manifest.load(version)
        names = [*(c.path for c in at.log), *(r.path for r in run_files.prune(at.runs, key, key + b"\x00"))]
        # an equality reaches the files' bloom filters; the newest of its few versions needs no shuffle
        rows = run_files.read_rows(self.spark, self.path, names).where(F.col("key") == F.lit(key)).orderBy(F.desc("seq")).select("op", "value").take(1)
        if not rows or rows[0].op != PUT:
            raise NotFound(key)
        return bytes(rows[0].value)

    def multi_get(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """``(key, status, value)`` of many keys; see ``fold.multi_get``.

        Runs beyond the least and greatest key aren't opened. Up to ``FEW_KEYS`` keys are sent to the scan, where
        bounds and bloom filters pass over row groups; more are joined.
        """
        want = keys.select("key").where("key is not null").distinct()
        low, high, n = want.agg(F.min("key"), F.max("key"), F.count("*")).first()
        ops = self.ops(None if low is None else bytes(low), None if high is None else bytes(high) + b"\x00", version)
        if n <= FEW_KEYS:
            ops = ops.where(F.col("key").isin([r.key for r in want.collect()]))
        return fold.multi_get(ops, want)

    def iterator(self, start: bytes | None = None, end: bytes | None = None) -> Iterator[tuple[bytes, bytes]] | None:
        """Live pairs in key order, one partition at a time, from one snapshot; None if the store is closed."""
        if self.closed:
            return None
        return ((bytes(r.key), bytes(r.value)) for r in self.scan(start, end).orderBy("key").toLocalIterator())

    def view(self, name: str, version: int | None = None) -> DataFrame:
        """The live pairs as a temporary view for SQL."""
        df = self.scan(version=version)
        df.createOrReplaceTempView(name)
        return df

    def command_count(self) -> int:
        """Stored commands, not keys, of what isn't flushed."""
        self._ensure_open()
        return sum(c.record_count for c in self.manifest.load().log)

    def snapshot(self) -> Snapshot:
        self._ensure_open()
        return self.manifest.load()

    # -- maintenance -----------------------------------------------------

    def flush(self) -> RunMeta | None:
        """Fold all commits into one run of level 0; None if there are none. Then compact, if that is due."""
        self._ensure_open()
        base = self.manifest.load()
        if not base.log:
            return None
        rows = fold.latest(run_files.read_rows(self.spark, self.path, [c.path for c in base.log]))
        made = self._write_run(rows, sum(c.data_length for c in base.log), sum(c.record_count for c in base.log), 0)
        while True:
            newer = self.manifest.load()
            if newer.log[: len(base.log)] != base.log:
                raise Conflict("the commits were flushed by another writer")
            # ids are taken from the snapshot that is followed, which may be newer than the one that was read
            made = self._numbered(made, newer.next_run_id)
            try:
                self.manifest.commit(newer, log=newer.log[len(base.log) :], runs=(*made, *newer.runs), flushed_segment=base.log[-1].segment, next_run_id=newer.next_run_id + len(made))
                break
            except Conflict:
                continue
        if self.options.auto_compact:
            self.compact()
        return made[0] if made else None

    def _numbered(self, made: list[RunMeta], first_id: int) -> list[RunMeta]:
        """Runs that are about to be published, with their ids; ``Corrupt`` if a vacuum took their files meanwhile."""
        for r in made:
            run_files.check_files(self.folder, r.path, r.files, "an unpublished run")
        return [replace(r, id=first_id + i) for i, r in enumerate(made)]

    def _write_run(self, rows: DataFrame, data_bytes: int, count: int, level: int) -> list[RunMeta]:
        """Write rows as runs of about the level's file size with disjoint key ranges, one file each. They have no ids yet."""
        ranges = max(1, -(-data_bytes // self.options.file_target(level)))
        name, files = run_files.write_rows(rows, self.path, "runs", rows_in_file=max(1, count // ranges), ranges=ranges)
        if not files:
            return []
        read = run_files.sized(self.spark.read.schema(OPS).parquet(f"{self.path}/{name}")).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
        stats = read.groupBy("file").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"), F.max("seq").alias("seq")).orderBy("low").collect()
        if any(r.n != r.keys for r in stats):
            raise Corrupt("a run would hold a key twice")
        return [RunMeta(0, level, f"{name}/{r.file}", files[r.file], r.n, r.bytes, bytes(r.low), bytes(r.high), r.seq, {r.file: files[r.file]}) for r in stats]

    def compact(self) -> Plan | None:
        """Run the next due compaction; None if none is due. Input files stay until ``vacuum``, so readers keep them."""
        self._ensure_open()
        while True:
            base = self.manifest.load()
            plan = pick(list(base.runs), self.options)
            if plan is None:
                return None
            rows = fold.latest(run_files.read_rows(self.spark, self.path, [r.path for r in plan.inputs]))
            if plan.bottommost:
                rows = rows.where(F.col("op") == PUT)  # after the fold; nothing deeper could come back
            made = self._write_run(rows, sum(r.data_length for r in plan.inputs), sum(r.record_count for r in plan.inputs), plan.output_level)
            gone = {r.path for r in plan.inputs}
            while True:
                newer = self.manifest.load()
                if not gone <= {r.path for r in newer.runs} or (plan.bottommost and {r.path for r in newer.runs if r.level > plan.output_level} - {r.path for r in base.runs}):
                    break  # another compaction took inputs, or put runs below; what was written is unreferenced
                made = self._numbered(made, newer.next_run_id)
                try:
                    self.manifest.commit(newer, runs=(*made, *(r for r in newer.runs if r.path not in gone)), next_run_id=newer.next_run_id + len(made))
                    return plan
                except Conflict:
                    continue

    def vacuum(self, keep_versions: int = 1, older_than: float = 3600) -> list[str]:
        """Delete folders that none of the newest snapshots lists and that nobody has written to for ``older_than`` seconds."""
        self._ensure_open()
        versions = self.manifest.versions()[-max(1, keep_versions) :]
        kept = {p.path.split("/")[1] for v in versions for s in [self.manifest.load(v)] for p in (*s.log, *s.runs)}
        gone, now = [], time.time()
        for kind in ("log", "runs"):
            for name in self.folder.list(kind):
                if name not in kept and now - self.folder.modified(f"{kind}/{name}") >= older_than:
                    self.folder.delete(f"{kind}/{name}")
                    gone.append(f"{kind}/{name}")
        if versions:
            self.manifest.forget(versions[0])
        return gone

    def verify(self) -> None:
        """Read all runs of the newest snapshot and compare them with the manifest; raises ``Corrupt``."""
        self._ensure_open()
        for run in self.manifest.load().runs:
            run_files.check_content(self.spark, self.path, run)

    def close(self) -> None:
        """Idempotent; commits that aren't flushed stay in the log. A store without a folder is gone."""
        if not self.closed and not self.durable:
            self.folder.delete("")
        self.closed = True

    def _ensure_open(self) -> None:
        if self.closed:
            raise Closed("the store is closed")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def open_store(spark: SparkSession, path: str = "", options: Options = Options()) -> Store:
    """Open or create a store; without a path it lives as long as it is open.

    Every file that the newest manifest lists must be there with its size, else ``Corrupt``. Files that it
    doesn't list (of writers that died before publishing) are ignored.
    """
    store = Store(spark, path or work_dir(spark, "store"), options, bool(path))
    at = store.manifest.load()
    for c in at.log:
        run_files.check_files(store.folder, c.path, c.files, f"commit {c.segment}")
    for r in at.runs:
        run_files.check_files(store.folder, r.path, r.files, f"run {r.id}")
    return store
