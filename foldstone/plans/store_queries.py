"""Queries that drive the store and the binary formats end to end, with the SQL of what must come out."""

from __future__ import annotations

from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import bloom
from ..model import Options
from ..operators import fold
from ..shared import work_dir
from ..sources import binary
from ..store import Store, open_store
from ..streaming.ingest import ingest
from .kv_queries import GONE, HIGH, LATEST_SQL, LOW, ONE, OPS_SQL, ops
from .maintenance import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
QUIET = Options(auto_flush=False, auto_compact=False, l0_trigger=2)
#: Levels so small that the event log fills several.
LEVELS = Options(auto_flush=False, l0_trigger=2, level_base=200_000, level_mult=2, file_base=100_000)
VISIBLE_SQL = f"WITH {LATEST_SQL} SELECT key, value FROM latest WHERE op = 1"


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as bytes, with the third of its segments that each row is in."""
    rows = ops(spark, sf_dir).select(F.encode("key", "UTF-8").alias("key"), "seq", "op", F.encode("value", "UTF-8").alias("value"), "segment")
    top = (rows.agg(F.max("segment")).first()[0] or 0) + 1
    return rows.withColumn("third", F.floor(F.col("segment") * 3 / top))


def _store(spark: SparkSession, options: Options = QUIET) -> Store:
    return open_store(spark, work_dir(spark, "store"), options)


def _text(df: DataFrame) -> DataFrame:
    return df.select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


@_query(VISIBLE_SQL)
def store_levels(spark, sf_dir):
    """Commits, flushes and compactions over several levels."""
    rows, store = _rows(spark, sf_dir), _store(spark, LEVELS)
    for part in range(3):
        store.write_rows(rows.where(F.col("third") == part), order="seq")
        store.flush()
    while store.compact():
        pass
    return _text(store.scan())


@_query(f"WITH {OPS_SQL}, t AS (SELECT max(segment) + 1 AS top FROM ops) SELECT key, value FROM (SELECT * FROM ops, t WHERE segment * 3 // top < 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 1")
def store_as_of(spark, sf_dir):
    """A snapshot from before the last commit, read after it and after a compaction."""
    rows, store = _rows(spark, sf_dir), _store(spark)
    store.write_rows(rows.where("third < 2"), order="seq")
    version = store.snapshot().version
    store.write_rows(rows.where("third = 2"), order="seq")
    store.flush()
    return _text(store.scan(version=version))


@_query(VISIBLE_SQL)
def store_vacuumed(spark, sf_dir):
    """What is left after a compaction and the deletion of all that no snapshot needs, checked against the manifest, by a new handle."""
    rows, store = _rows(spark, sf_dir), _store(spark)
    for part in range(3):
        store.write_rows(rows.where(F.col("third") == part), order="seq")
        store.flush()
    store.compact()
    store.vacuum(older_than=0)
    again = open_store(spark, store.path, QUIET)
    again.verify()
    return _text(again.scan())


@_query(VISIBLE_SQL)
def store_concurrent(spark, sf_dir):
    """A compaction by another handle that publishes between a flush's reading and its publishing, and a compaction after both."""
    rows, store = _rows(spark, sf_dir), _store(spark)
    other, write = open_store(spark, store.path, QUIET), store._write_run
    for part in range(3):
        store.write_rows(rows.where(F.col("third") == part), order="seq")
        if part < 2:
            store.flush()

    def beside(*args):
        made = write(*args)
        other.compact()
        return made

    store._write_run = beside
    store.flush()
    store._write_run = write
    store.compact()
    return _text(store.scan())


@_query(f"WITH {LATEST_SQL} SELECT count(*) AS records, min(key) AS low, max(key) AS high, 1 AS levels FROM latest WHERE op = 1")
def store_manifest(spark, sf_dir):
    """Counts and bounds by the manifest alone, after the log was written twice and compacted to the bottom."""
    rows, store = _rows(spark, sf_dir), _store(spark)
    for _ in range(2):
        store.write_rows(rows, order="seq")
        store.flush()
    store.compact()
    runs = store.snapshot().runs
    made = [(sum(r.record_count for r in runs), min((r.min_key for r in runs), default=b"").decode(), max((r.max_key for r in runs), default=b"").decode(), len({r.level for r in runs}))]
    return spark.createDataFrame(made, "records long, low string, high string, levels int")


@_query(f"WITH {LATEST_SQL} SELECT CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS place, key, value FROM latest WHERE op = 1 AND key >= '{LOW}' AND key < '{HIGH}'")
def ordered_cursor(spark, sf_dir):
    """The pairs of a range as the store's iterator gives them, with their places."""
    store = _store(spark)
    store.write_rows(_rows(spark, sf_dir), order="seq")
    found = [(i, k.decode(), v.decode()) for i, (k, v) in enumerate(store.iterator(LOW.encode(), HIGH.encode()))]
    return spark.createDataFrame(found, "place long, key string, value string")


@_query("SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_regionkey = 0 THEN 'again' ELSE n_name END AS value FROM nation WHERE n_regionkey <> 0 OR n_nationkey < 10")
def store_batches(spark, sf_dir):
    """Three batches over the nations: all of them, the first region deleted, and some of it put again; one that is reset publishes nothing."""
    rows, store = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect(), _store(spark)
    batch = store.new_batch()
    for r in rows:
        batch.put(str(r.n_nationkey).encode(), r.n_name.encode())
    store.write(batch)
    batch.reset()
    store.write(batch)
    for r in rows:
        if r.n_regionkey == 0:
            batch.delete(str(r.n_nationkey).encode())
    store.write(batch)
    store.flush()
    again = store.new_batch()
    for r in rows:
        if r.n_regionkey == 0 and r.n_nationkey < 10:
            again.put(str(r.n_nationkey).encode(), b"again")
    store.write(again)
    return _text(store.scan())


@_query(f"WITH {OPS_SQL} SELECT key, value FROM (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY key ORDER BY segment % 2 DESC, seq DESC) = 1) WHERE op = 1")
def ingest_streams(spark, sf_dir):
    """Two streams into one store, one after the other: segments with even numbers, then those with odd ones."""
    store, base = _store(spark), work_dir(spark, "feeds")
    for odd in range(2):
        _rows(spark, sf_dir).where(F.col("segment") % 2 == odd).select("key", "seq", "op", "value").coalesce(1).write.parquet(f"{base}/{odd}")
        ingest(spark.readStream.schema("key binary, seq long, op int, value binary").parquet(f"{base}/{odd}"), store, f"{base}/checkpoint{odd}", order="seq")
    return _text(store.scan())


@_query(f"WITH {OPS_SQL} SELECT segment + 1 AS segment, seq AS lsn, CASE op WHEN 1 THEN 'P' ELSE 'D' END AS type, key, CASE op WHEN 1 THEN coalesce(value, '') END AS value FROM ops WHERE segment >= 2")
def log_files(spark, sf_dir):
    """The event log as binary segments, read back from the third one on."""
    path = work_dir(spark, "segments")
    kind = F.when(F.col("op") == 1, "P").otherwise("D")
    binary.write_log(_rows(spark, sf_dir).select((F.col("segment") + 1).alias("segment"), F.col("seq").alias("lsn"), kind.alias("type"), "key", "value"), path)
    return binary.read_log(spark, path, 3).select("segment", "lsn", "type", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


_BY_SEGMENT = f"{OPS_SQL}, runs AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY segment, key ORDER BY seq DESC) = 1)"


_RUN_ROWS = "CAST(segment AS BIGINT) AS id, key, op, CASE op WHEN 1 THEN coalesce(value, '') END AS value FROM runs"


def _read_back(df: DataFrame) -> DataFrame:
    return df.select("id", F.decode("key", "UTF-8").alias("key"), F.col("op").cast("int").alias("op"), F.decode("value", "UTF-8").alias("value"))


def _sorted_files(spark, sf_dir) -> tuple[str, list[str]]:
    rows = fold.latest(_rows(spark, sf_dir).select("key", "segment", "seq", "op", "value"), ["key", "segment"])
    path = work_dir(spark, "sorted")
    return path, binary.write_sorted(rows.select(F.col("segment").cast("long").alias("id"), "key", F.col("op").cast("byte").alias("op"), "value"), path)


@_query(f"WITH {_BY_SEGMENT} SELECT {_RUN_ROWS}")
def sorted_files(spark, sf_dir):
    """Each segment folded into a binary sorted file, with index and filter, read back and checked."""
    return _read_back(binary.read_sorted(spark, _sorted_files(spark, sf_dir)[0]))


@_query(f"WITH {_BY_SEGMENT} SELECT {_RUN_ROWS} WHERE key >= '{LOW}' AND key < '{HIGH}'")
def sorted_file_range(spark, sf_dir):
    """A range of each sorted file, of which only the blocks that the index names are decoded."""
    return _read_back(binary.read_sorted(spark, _sorted_files(spark, sf_dir)[0], LOW.encode(), HIGH.encode()))


@_query(f"WITH {_BY_SEGMENT} SELECT {_RUN_ROWS} WHERE key IN ('{ONE}', '{LOW}', 'u:00000003', '{GONE}')")
def sorted_file_points(spark, sf_dir):
    """Some keys in each sorted file, by bounds, filter and block index."""
    return _read_back(binary.find_sorted(spark, _sorted_files(spark, sf_dir)[0], [k.encode() for k in (ONE, LOW, "u:00000003", GONE)]))


@_query(f"WITH {LATEST_SQL} SELECT key, seq FROM latest WHERE op = 1 ORDER BY key DESC LIMIT 10")
def last_keys(spark, sf_dir):
    """The ten greatest live keys; a limit over an order keeps ten rows a task."""
    return fold.visible(ops(spark, sf_dir).select("key", "seq", "op")).orderBy(F.desc("key")).limit(10).select("key", "seq")


_HALVES = f"{OPS_SQL}, a AS (SELECT DISTINCT key FROM ops WHERE op = 1), b AS (SELECT DISTINCT key FROM ops WHERE op = 0)"


@_query(f"WITH {_HALVES} SELECT key FROM a INTERSECT SELECT key FROM b")
def keys_put_and_deleted(spark, sf_dir):
    rows = ops(spark, sf_dir)
    return rows.where("op = 1").select("key").intersect(rows.where("op = 0").select("key"))


@_query(f"WITH {_HALVES} SELECT key FROM a EXCEPT SELECT key FROM b")
def keys_never_deleted(spark, sf_dir):
    rows = ops(spark, sf_dir)
    return rows.where("op = 1").select("key").subtract(rows.where("op = 0").select("key"))


@_query(f"WITH {_BY_SEGMENT} SELECT DISTINCT lpad(CAST(segment AS VARCHAR), 6, '0') || '.sst' AS name FROM runs")
def sorted_file_names(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in _sorted_files(spark, sf_dir)[1]], "name string")


@_query("SELECT * FROM (VALUES ('block', 65536), ('file_base', 67108864), ('file_mult', 2), ('l0_trigger', 4), ('level_base', 536870912), ('level_mult', 10), ('max_levels', 7), ('max_record', 16777216), ('memtable', 67108864)) t(name, size)")
def option_defaults(spark, sf_dir):
    return spark.createDataFrame([(k, v) for k, v in asdict(Options()).items() if not isinstance(v, bool)], "name string, size long")


def _fnv(batches):
    for batch in batches:
        h, _ = bloom.hash_pair(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.astype(str), pa.string())], ["key", "hash"])


@_query("""
    WITH k AS (SELECT DISTINCT key FROM sst_entries WHERE key IS NOT NULL),
    b AS (SELECT hex(key) AS x, octet_length(key) AS n FROM k)
    SELECT x AS key_hex, CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, n + 1), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS HUGEINT))),
        lambda h, c: ((((h // 256) * 256) + xor(h % 256, c)) * 1099511628211) % 18446744073709551616) AS VARCHAR) AS hash FROM b""")
def key_hashes(spark, sf_dir):
    """The 64-bit hash of the filters' format of every key of the runs."""
    keys = table(spark, sf_dir, "sst_entries").where("key is not null").select("key").distinct()
    return keys.mapInArrow(_fnv, "key binary, hash string").select(F.hex("key").alias("key_hex"), "hash")
