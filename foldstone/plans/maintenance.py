"""Queries of the general table-maintenance operators (p2 to p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import consolidate as merge, diff, ledger
from ..shared import work_dir
from ..streaming import cdc

RUN_FIELDS = ["level", "file_size", "record_count", "data_length", "min_key", "max_key"]
ALL_RUN_FIELDS = ["level", "file_size", "record_count", "data_length", "block_index_length", "bloom_filter_length", "min_key", "max_key"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, copy = table(spark, sf_dir, "run_meta"), table(spark, sf_dir, "run_meta_copy")
    return diff.differences(main, copy, key="id", order="recorded_at", fields=RUN_FIELDS).select("id", "field_name")


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, copy = table(spark, sf_dir, "run_meta"), table(spark, sf_dir, "run_meta_copy")
    return diff.differences(main, copy, key="id", order="recorded_at", fields=ALL_RUN_FIELDS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.take_up(table(spark, sf_dir, "wal_records"), table(spark, sf_dir, "manifest_log"), work_dir(spark, "ledger"))


def p2_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells of the checksum matrix are unequal, by column; what isn't is never read again."""
    main, copy = table(spark, sf_dir, "run_meta"), table(spark, sf_dir, "run_meta_copy")
    return diff.pruned(main, copy, key="id", order="recorded_at", fields=RUN_FIELDS)


class _Hand:
    """A clock that is set by hand."""

    now = 0.0

    def __call__(self) -> float:
        return self.now


def p3_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p3_found`` in two runs: the first over the older half of the segments by a worker that dies before it finishes, whose
    leases expire and are taken over; the second over the whole log, which takes up only what came since."""
    wal, manifest, clock = table(spark, sf_dir, "wal_records"), table(spark, sf_dir, "manifest_log"), _Hand()
    book = ledger.Ledger(spark, work_dir(spark, "ledger"), clock)
    half = wal.where(F.col("segment") <= (wal.agg(F.max("segment")).first()[0] or 0) // 2)
    ledger.plan_flush(book, half, manifest)
    ledger.write_items(book, half, book.lease("dies", seconds=60))
    clock.now += 61
    ledger.take_up(half, manifest, book, "takes over")
    return ledger.take_up(wal, manifest, book, "second run").distinct()


def p3_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.last_saved_marks(table(spark, sf_dir, "manifest_log"))


def _fed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.Feed(spark, work_dir(spark, "feed")).advance(table(spark, sf_dir, "wal_records"), table(spark, sf_dir, "memtable_ops"))


def _live(rows: DataFrame) -> DataFrame:
    return rows.where("live").select("feed", "store_id", F.hex("key").alias("key_hex"), F.col("seq").alias("version_no"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(_fed(spark, sf_dir))


def p4_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p4_found`` in two steps, the log up to the middle segment and then all of it, with the batches merged in between."""
    wal, commands, feed = table(spark, sf_dir, "wal_records"), table(spark, sf_dir, "memtable_ops"), cdc.Feed(spark, work_dir(spark, "feed"))
    half = (wal.agg(F.max("segment")).first()[0] or 0) // 2
    feed.advance(wal.where(F.col("segment").isNull() | (F.col("segment") <= half)), commands.where("seq % 2 = 0"))
    cdc.merge_batches(spark, f"{feed.path}/table")
    return _live(feed.advance(wal, commands))


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rebuilt table with values and tombstones."""
    rows = _fed(spark, sf_dir)
    return rows.select("feed", "store_id", F.hex("key").alias("key_hex"), F.col("seq").alias("version_no"), "live", F.hex("value").alias("value_hex"))


def _consolidated(spark: SparkSession, sf_dir: str) -> merge.Consolidated:
    return merge.consolidate(table(spark, sf_dir, "run_meta"), table(spark, sf_dir, "sst_entries"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old runs of the published map from old to new runs."""
    return _consolidated(spark, sf_dir).replaced.select("id").distinct()


def p5_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries each (store, level) has after the merge, and how often its commonest entry is repeated."""
    rows = _consolidated(spark, sf_dir).entries.groupBy("store_id", "level", "run_id", "key").agg(F.count("*").alias("n"))
    return rows.groupBy("store_id", "level").agg(F.sum("n").alias("entries"), F.max("n").alias("most_repeated"), F.hex(F.min("key")).alias("min_key_hex"), F.hex(F.max("key")).alias("max_key_hex"))


def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new runs with their updated ranges."""
    return _consolidated(spark, sf_dir).runs.select("store_id", "level", "record_count", "data_length", F.hex("min_key").alias("min_key_hex"), F.hex("max_key").alias("max_key_hex"), "inputs")


def p5_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs each (store, level) has after the exchange."""
    rows = _consolidated(spark, sf_dir).swapped(table(spark, sf_dir, "run_meta"))
    return rows.groupBy("store_id", "level").agg(F.count("*").alias("runs"))


_P2_CURRENT = """
WITH a AS (SELECT * FROM run_meta QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC NULLS LAST) = 1),
     b AS (SELECT * FROM run_meta_copy QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC NULLS LAST) = 1)
"""


def _p2_sql(fields: list[str], values: bool) -> str:
    text = lambda t, c: f"upper(hex({t}.{c}))" if c.endswith("_key") else f"CAST({t}.{c} AS VARCHAR)"
    none = ", CAST(NULL AS VARCHAR) AS main_value, CAST(NULL AS VARCHAR) AS copy_value" if values else ""
    parts = [
        f"SELECT id, 'missing_in_copy' AS field_name{none} FROM a WHERE id NOT IN (SELECT id FROM b)",
        f"SELECT id, 'missing_in_main' AS field_name{none} FROM b WHERE id NOT IN (SELECT id FROM a)",
    ]
    for c in fields:
        both = f", {text('a', c)} AS main_value, {text('b', c)} AS copy_value" if values else ""
        parts.append(f"SELECT a.id, '{c}' AS field_name{both} FROM a JOIN b ON a.id = b.id WHERE a.{c} IS DISTINCT FROM b.{c}")
    return _P2_CURRENT + " UNION ALL ".join(parts)


_LETTER = "upper(substr(ltrim(type, ' ' || chr(9) || chr(10) || chr(13)), 1, 1))"

_P4_STATE = f"""
WITH folded AS (
  SELECT store_id, lsn, {_LETTER} AS letter, key, value FROM wal_records WHERE lsn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY store_id, lsn ORDER BY segment DESC NULLS LAST) = 1),
marked AS (
  SELECT *,
    last_value(CASE WHEN letter IN ('B', 'E') THEN letter END IGNORE NULLS) OVER (PARTITION BY store_id ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    first_value(CASE WHEN letter IN ('B', 'E') THEN letter END IGNORE NULLS) OVER (PARTITION BY store_id ORDER BY lsn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
  FROM folded),
feed AS (
  SELECT 'wal' AS feed, store_id, key, lsn AS seq, letter = 'P' AS live, CASE WHEN letter = 'P' THEN value END AS value FROM marked
  WHERE letter IN ('P', 'D') AND key IS NOT NULL AND (before IS NULL OR before = 'E' OR after = 'E')
  UNION ALL
  SELECT 'mem', store_id, key, seq, op = 1, CASE WHEN op = 1 THEN value END FROM memtable_ops WHERE seq IS NOT NULL AND key IS NOT NULL AND op IS NOT NULL),
newest AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY feed, store_id, key ORDER BY seq DESC, live DESC, value DESC NULLS LAST) = 1)
"""

_P3_SQL = f"""
    WITH w AS (SELECT store_id, lsn, segment, {_LETTER} AS letter, key, value FROM wal_records WHERE lsn IS NOT NULL AND segment IS NOT NULL),
    m AS (SELECT store_id, max_by(flushed_wal_segment, manifest_version) AS mark FROM manifest_log
          WHERE outcome = 'committed' AND flushed_wal_segment IS NOT NULL GROUP BY store_id),
    c AS (SELECT w.store_id, lsn, min(segment) AS since, coalesce(any_value(mark), 0) AS mark FROM w LEFT JOIN m ON w.store_id IS NOT DISTINCT FROM m.store_id
          GROUP BY w.store_id, lsn, letter, key, value)
    SELECT DISTINCT store_id, lsn FROM c WHERE since > mark"""

_P5_SMALL = """
WITH cur AS (SELECT * FROM run_meta QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC NULLS LAST) = 1),
small AS (
  SELECT *, count(*) OVER (PARTITION BY store_id, level) AS members FROM cur
  WHERE level IS NOT NULL AND file_size > 0 AND file_size < 512 * pow(2, greatest(0, level - 1)))
"""


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_values, p2_buckets, p3_found, p3_resumed, p3_marks, p4_found, p4_resumed, p4_table, p5_found, p5_entries, p5_runs, p5_swapped)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _p2_sql(RUN_FIELDS, False),
        "p2_values": _p2_sql(ALL_RUN_FIELDS, True),
        "p3_found": _P3_SQL,
        "p3_resumed": _P3_SQL,
        "p3_marks": """
            SELECT store_id, max_by(flushed_wal_segment, manifest_version) AS mark FROM manifest_log
            WHERE outcome = 'committed' AND flushed_wal_segment IS NOT NULL GROUP BY store_id""",
        **dict.fromkeys(("p4_found", "p4_resumed"), _P4_STATE + "SELECT feed, store_id, upper(hex(key)) AS key_hex, seq AS version_no FROM newest WHERE live"),
        "p4_table": _P4_STATE + "SELECT feed, store_id, upper(hex(key)) AS key_hex, seq AS version_no, live, upper(hex(value)) AS value_hex FROM newest",
        "p5_found": _P5_SMALL + "SELECT id FROM small WHERE members > 1",
        "p5_runs": _P5_SMALL
        + """, e AS (SELECT s.store_id, s.level, run_id, key, coalesce(5 + octet_length(key) + CASE WHEN op = 1 THEN 4 + coalesce(octet_length(value), 0) ELSE 0 END, 5) AS size
                     FROM sst_entries JOIN small s ON run_id = s.id WHERE members > 1)
            SELECT store_id, level, count(*) AS record_count, CAST(sum(size) AS BIGINT) AS data_length, upper(hex(min(key))) AS min_key_hex, upper(hex(max(key))) AS max_key_hex,
                   count(DISTINCT run_id) AS inputs FROM e GROUP BY store_id, level""",
        "p5_swapped": _P5_SMALL
        + """, gone AS (SELECT id, store_id, level FROM small WHERE members > 1), made AS (SELECT DISTINCT g.store_id, g.level FROM gone g JOIN sst_entries ON run_id = g.id)
            SELECT store_id, level, CAST(sum(n) AS BIGINT) AS runs FROM (
              SELECT store_id, level, count(*) AS n FROM cur WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM gone) GROUP BY store_id, level
              UNION ALL SELECT store_id, level, 1 FROM made) GROUP BY store_id, level""",
        "p5_entries": _P5_SMALL
        + """, e AS (SELECT s.store_id, s.level, run_id, key, count(*) AS n FROM sst_entries JOIN small s ON run_id = s.id WHERE members > 1 GROUP BY ALL)
            SELECT store_id, level, CAST(sum(n) AS BIGINT) AS entries, max(n) AS most_repeated, upper(hex(min(key))) AS min_key_hex, upper(hex(max(key))) AS max_key_hex FROM e GROUP BY store_id, level""",
    }
