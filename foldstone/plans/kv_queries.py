"""Queries of the store's own operators over the event log and the run metadata, with their SQL.

Events are operations: the key is the user, the version the event's id, errors are deletes and ``props``
is the value; a run or a log segment is a thousand events. Keys are given as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import bloom
from ..model import Options
from ..operators import chunking, fold
from ..shared import work_dir
from ..sources import binary, recovery
from ..store import open_store
from . import compaction
from .maintenance import table

LOW, HIGH, ONE, GONE = "u:00000040", "u:00000090", "u:00000042", "u:99999999"
BLOCK, SPLIT = 512, 2048
#: Adjacent runs that a partial merge makes one run of.
MERGED = 4
#: Levels as small as the test runs, so that scores pass 1.
SMALL = Options(l0_trigger=4, level_base=10_000, level_mult=10)


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", 0).otherwise(1)
    return e.select(
        F.concat(F.lit("u:"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.when(op == 1, F.col("props")).alias("value"), F.floor(F.col("event_id") / 1000).cast("int").alias("segment"), "event_type"
    )


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops(spark, sf_dir).select("key", "seq", "op", "value")


OPS_SQL = """ops AS (
    SELECT 'u:' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op,
           CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, CAST(event_id // 1000 AS INTEGER) AS segment, event_type FROM events)"""
LATEST_SQL = f"{OPS_SQL}, latest AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    """Register a query with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@_query(f"WITH {OPS_SQL} SELECT key, seq, op, value, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS version_rank FROM ops")
def raw_versions(spark, sf_dir):
    return fold.raw_versions(_plain(spark, sf_dir))


@_query(f"WITH {LATEST_SQL} SELECT key, seq, op, value FROM latest")
def latest_entries(spark, sf_dir):
    return fold.latest(_plain(spark, sf_dir))


@_query(f"WITH {LATEST_SQL} SELECT key, seq, op, value FROM latest")
def latest_entries_window(spark, sf_dir):
    return fold.latest_by_window(_plain(spark, sf_dir))


@_query(f"WITH {LATEST_SQL} SELECT key, value FROM latest WHERE op = 1")
def visible_values(spark, sf_dir):
    return fold.visible(_plain(spark, sf_dir)).select("key", "value")


@_query(f"WITH {LATEST_SQL} SELECT key, value FROM latest WHERE op = 1 AND key = '{ONE}'")
def point_get(spark, sf_dir):
    return fold.visible(_plain(spark, sf_dir)).where(F.col("key") == ONE).select("key", "value")


@_query(f"WITH {LATEST_SQL} SELECT key, seq FROM latest WHERE op = 0")
def deleted_keys(spark, sf_dir):
    return fold.latest(_plain(spark, sf_dir)).where("op = 0").select("key", "seq")


@_query(f"""
    WITH {LATEST_SQL}, want AS (SELECT DISTINCT 'u:' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer)
    SELECT w.key, CASE WHEN op IS NULL THEN 'missing' WHEN op = 1 THEN 'value' ELSE 'deleted' END AS status, CASE WHEN op = 1 THEN value END AS value
    FROM want w LEFT JOIN latest l ON w.key = l.key""")
def multi_get_status(spark, sf_dir):
    want = table(spark, sf_dir, "customer").select(F.concat(F.lit("u:"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("key"))
    return fold.multi_get(_plain(spark, sf_dir), want)


def _range(name: str, start, end, condition: str):
    def query(spark, sf_dir):
        return fold.in_range(fold.visible(_plain(spark, sf_dir)), start, end).select("key", "value")

    query.__name__ = name
    _query(f"WITH {LATEST_SQL} SELECT key, value FROM latest WHERE op = 1 AND {condition}")(query)


_range("range_scan", LOW, HIGH, f"key >= '{LOW}' AND key < '{HIGH}'")
_range("range_from", HIGH, None, f"key >= '{HIGH}'")
_range("range_to", None, LOW, f"key < '{LOW}'")
_range("range_empty", LOW, LOW, "false")


@_query(f"""
    WITH {LATEST_SQL}, p AS (SELECT DISTINCT 'u:' || lpad(CAST(o_custkey * 3 AS VARCHAR), 8, '0') AS probe FROM orders)
    SELECT probe, min(key) AS found FROM p LEFT JOIN latest ON key >= probe GROUP BY probe""")
def lower_bound(spark, sf_dir):
    probes = table(spark, sf_dir, "orders").select(F.concat(F.lit("u:"), F.lpad((F.col("o_custkey") * 3).cast("string"), 8, "0")).alias("probe"))
    return fold.lower_bound(fold.latest(_plain(spark, sf_dir)), probes)


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("k"))


@_query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def membership(spark, sf_dir):
    return fold.members(_customers(spark, sf_dir), table(spark, sf_dir, "events").select(F.col("user_id").alias("k")), "k").select("c_custkey")


@_query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def non_membership(spark, sf_dir):
    return fold.members(_customers(spark, sf_dir), table(spark, sf_dir, "events").select(F.col("user_id").alias("k")), "k", absent=True).select("c_custkey")


@_query(f"WITH {LATEST_SQL} SELECT key, seq, op, value FROM latest")
def merge_runs(spark, sf_dir):
    """Runs folded each for itself, then merged by version whatever their order."""
    rows = ops(spark, sf_dir)
    runs = fold.latest(rows.select("key", "segment", "seq", "op", "value"), ["key", "segment"])
    older, newer = runs.where("segment % 2 = 0").drop("segment"), runs.where("segment % 2 = 1").drop("segment")
    return fold.merge_runs([newer, older])


@_query(f"WITH {OPS_SQL}, half AS (SELECT max(seq) // 2 AS n FROM ops) SELECT key, seq, value FROM (SELECT * FROM ops WHERE seq <= (SELECT n FROM half) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 1")
def as_of_seq(spark, sf_dir):
    rows = _plain(spark, sf_dir)
    half = (rows.agg(F.max("seq")).first()[0] or 0) // 2
    return fold.visible(fold.as_of(rows, half)).select("key", "seq", "value")


@_query(f"WITH {OPS_SQL} SELECT key, seq, op, value FROM (SELECT * FROM ops WHERE segment >= 3 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)")
def replay_from_segment(spark, sf_dir):
    return fold.latest(ops(spark, sf_dir).where("segment >= 3").select("key", "seq", "op", "value"))


@_query(f"""
    WITH {OPS_SQL}, bad AS (SELECT segment AS s, min(seq) AS first_bad FROM ops WHERE op = 0 AND seq % 97 = 0 GROUP BY segment)
    SELECT key, seq, segment FROM ops LEFT JOIN bad ON segment = s WHERE first_bad IS NULL OR seq < first_bad""")
def valid_prefix(spark, sf_dir):
    rows = ops(spark, sf_dir)
    return fold.valid_prefix(rows, "segment", "seq", (F.col("op") == 0) & (F.col("seq") % 97 == 0)).select("key", "seq", "segment")


_BATCH_SQL = f"""{OPS_SQL}, t AS (SELECT *, CASE event_type WHEN 'signup' THEN 'B' WHEN 'purchase' THEN 'E' WHEN 'error' THEN 'D' ELSE 'P' END AS kind FROM ops),
    m AS (SELECT *, last_value(CASE WHEN kind IN ('B', 'E') THEN kind END IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
                 first_value(CASE WHEN kind IN ('B', 'E') THEN kind END IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM t),
    kept AS (SELECT key, seq, kind, value FROM m WHERE kind IN ('P', 'D') AND (before IS NULL OR before = 'E' OR (before = 'B' AND after = 'E')))"""


def _kinds(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "B").when(F.col("event_type") == "purchase", "E").when(F.col("event_type") == "error", "D").otherwise("P")
    return ops(spark, sf_dir).withColumn("kind", kind)


@_query(f"WITH {_BATCH_SQL} SELECT key, seq, kind FROM kept")
def batch_atomicity(spark, sf_dir):
    """Records in force; a batch may go on in later segments."""
    return fold.closed_batches(_kinds(spark, sf_dir), "segment", "seq", "kind").select("key", "seq", "kind")


@_query(f"""WITH {_BATCH_SQL} SELECT key, coalesce(value, '') AS value FROM (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE kind = 'P'""")
def recover_log(spark, sf_dir):
    """The event log written as binary segments, recovered into an empty store and scanned."""
    rows = _kinds(spark, sf_dir)
    path = work_dir(spark, "segments")
    binary.write_log(rows.select((F.col("segment") + 1).alias("segment"), F.col("seq").alias("lsn"), F.col("kind").alias("type"), F.encode("key", "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value")), path)
    store = open_store(spark, work_dir(spark, "recovered"), Options(auto_flush=False))
    recovery.recover(store, path)
    return store.scan().select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


_SIZE = "(5 + length(key) + CASE WHEN op = 1 THEN 4 + coalesce(length(value), 0) ELSE 0 END)"


def _sized(spark, sf_dir):
    """Each segment as a run: the newest version of its keys with the entry's bytes."""
    rows = fold.latest(ops(spark, sf_dir).select("key", "segment", "seq", "op", "value"), ["key", "segment"])
    return rows.withColumn("size", F.expr(_SIZE).cast("long"))


_RUNS_SQL = f"{OPS_SQL}, runs AS (SELECT *, CAST({_SIZE} AS BIGINT) AS size FROM ops QUALIFY row_number() OVER (PARTITION BY segment, key ORDER BY seq DESC) = 1)"


@_query(f"WITH {_RUNS_SQL} SELECT segment, count(*) AS record_count, CAST(sum(size) AS BIGINT) AS data_length, min(key) AS min_key, max(key) AS max_key FROM runs GROUP BY segment")
def run_stats(spark, sf_dir):
    return chunking.run_stats(_sized(spark, sf_dir), "segment")


def _pieces_sql(start: str, cut: str, target: int) -> str:
    return f"""
    WITH RECURSIVE {_RUNS_SQL}, n AS (SELECT segment, key, size, row_number() OVER (PARTITION BY segment ORDER BY key) AS i FROM runs),
    w AS (SELECT segment, key, size, i, 0 AS piece, size AS filled FROM n WHERE i = 1
          UNION ALL SELECT n.segment, n.key, n.size, n.i, CASE WHEN {cut.format(t=target)} THEN w.piece + 1 ELSE w.piece END,
                           CASE WHEN {cut.format(t=target)} THEN n.size ELSE w.filled + n.size END FROM w JOIN n ON n.segment = w.segment AND n.i = w.i + 1)
    SELECT segment, key, piece FROM w"""


@_query(_pieces_sql("", "w.filled + n.size > {t}", SPLIT))
def output_split(spark, sf_dir):
    return chunking.output_split(_sized(spark, sf_dir), "segment", ["key"], "size", SPLIT).select("segment", "key", "piece")


@_query(_pieces_sql("", "w.filled >= {t}", BLOCK))
def block_cut(spark, sf_dir):
    return chunking.block_cut(_sized(spark, sf_dir), "segment", ["key"], "size", BLOCK).select("segment", "key", "piece")


@_query(f"WITH {OPS_SQL} SELECT segment // {MERGED} AS run, key, seq, op FROM ops QUALIFY row_number() OVER (PARTITION BY segment // {MERGED}, key ORDER BY seq DESC) = 1")
def compact_keep(spark, sf_dir):
    """Merging each group of adjacent runs keeps tombstones, as older runs may hold what they hide; every run is in a group."""
    rows = ops(spark, sf_dir).withColumn("run", F.floor(F.col("segment") / MERGED).cast("int"))
    return fold.latest(rows.select("run", "key", "seq", "op", "value"), ["run", "key"]).select("run", "key", "seq", "op")


@_query(f"WITH {LATEST_SQL} SELECT key, seq FROM latest WHERE op = 1")
def compact_drop(spark, sf_dir):
    """Merging down to the bottom drops them."""
    return fold.visible(_plain(spark, sf_dir)).select("key", "seq")


@_query(f"WITH {OPS_SQL} SELECT key, count(*) - 1 AS shadowed, CAST(sum(1 - op) AS BIGINT) AS tombstones FROM ops GROUP BY key")
def shadowed_versions(spark, sf_dir):
    return _plain(spark, sf_dir).groupBy("key").agg((F.count("*") - 1).alias("shadowed"), F.sum(1 - F.col("op")).alias("tombstones"))


@_query(f"WITH {LATEST_SQL} SELECT (SELECT count(*) FROM ops) AS stored, (SELECT count(*) FROM latest WHERE op = 1) AS live, (SELECT count(*) FROM latest WHERE op = 0) AS tombstones")
def space_amp(spark, sf_dir):
    per_key = _plain(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"), F.max_by("op", "seq").alias("op"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("stored"), F.count_if(F.col("op") == 1).alias("live"), F.count_if(F.col("op") == 0).alias("tombstones"))


@_query("SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderkey AS seq, o_orderpriority AS value FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AND o_orderstatus <> 'F'")
def keyed_orders_state(spark, sf_dir):
    """Orders as a second log: the newest order of each customer, a finished one being a delete."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("op"), F.col("o_orderpriority").alias("value"))
    return fold.visible(o).select("key", "seq", "value")


@_query("SELECT event_type, list_sort(list(value))[CAST(floor((count(value) - 1) * 95 / 100) AS BIGINT) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_p95(spark, sf_dir):
    return fold.nearest_rank(table(spark, sf_dir, "events"), "value", 95, ["event_type"])


@_query("SELECT event_type, CAST(user_id % 3 AS BIGINT) AS workload, count(*) AS runs, round(avg(CAST(event_id AS DOUBLE)), 6) AS mean FROM events GROUP BY 1, 2")
def bench_avg(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", (F.col("user_id") % 3).alias("workload")).agg(F.count("*").alias("runs"), F.round(F.avg(F.col("event_id").cast("double")), 6).alias("mean"))


# -- run metadata ------------------------------------------------------------

_META_SQL = "meta AS (SELECT * FROM run_meta QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC NULLS LAST) = 1)"


def _meta(spark, sf_dir):
    rows = table(spark, sf_dir, "run_meta").select("id", "recorded_at", "store_id", "level", "file_size", "min_key", "max_key")
    return fold.latest(rows, ["id"], "recorded_at")


@_query(f"""WITH {_META_SQL} SELECT store_id, level, CAST(sum(coalesce(file_size, 0)) AS BIGINT) AS bytes, round(sum(coalesce(file_size, 0)) / ({SMALL.level_base} * pow({SMALL.level_mult}, level - 1)), 9) AS score
    FROM meta WHERE level BETWEEN 1 AND {SMALL.max_levels - 2} GROUP BY store_id, level""")
def level_scores(spark, sf_dir):
    return compaction.level_scores(_meta(spark, sf_dir), SMALL).select("store_id", "level", "bytes", F.round("score", 9).alias("score"))


@_query(f"""WITH {_META_SQL}, s AS (SELECT store_id, level, sum(coalesce(file_size, 0)) / ({SMALL.level_base} * pow({SMALL.level_mult}, level - 1)) AS score FROM meta WHERE level BETWEEN 1 AND {SMALL.max_levels - 2} GROUP BY store_id, level)
    SELECT store_id, level FROM s WHERE score > 1 QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY score DESC, level) = 1""")
def pick_level(spark, sf_dir):
    return compaction.pick_level(_meta(spark, sf_dir), SMALL)


_L0_SQL = f"{_META_SQL}, hull AS (SELECT store_id AS s, min(min_key) AS low, max(max_key) AS high FROM meta WHERE level = 0 GROUP BY store_id HAVING count(*) >= {SMALL.l0_trigger})"


@_query(f"WITH {_L0_SQL} SELECT store_id, id, level FROM meta JOIN hull ON store_id = s WHERE level = 0 OR (level = 1 AND max_key >= low AND min_key <= high)")
def pick_l0_inputs(spark, sf_dir):
    return compaction.pick_l0(_meta(spark, sf_dir), SMALL)


@_query(f"""WITH {_META_SQL}, s AS (SELECT store_id, level, sum(coalesce(file_size, 0)) / ({SMALL.level_base} * pow({SMALL.level_mult}, level - 1)) AS score FROM meta WHERE level BETWEEN 1 AND {SMALL.max_levels - 2} GROUP BY store_id, level),
    best AS (SELECT store_id AS st, level AS lv FROM s WHERE score > 1 QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY score DESC, level) = 1),
    src AS (SELECT store_id AS st, level AS lv, id, min_key, max_key FROM meta JOIN best ON store_id IS NOT DISTINCT FROM st AND level = lv QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY id) = 1)
    SELECT st AS store_id, id, CAST(lv AS INTEGER) AS level FROM src UNION ALL
    SELECT m.store_id, m.id, m.level FROM meta m JOIN src ON m.store_id IS NOT DISTINCT FROM st AND m.level = lv + 1 AND m.max_key >= src.min_key AND m.min_key <= src.max_key""")
def pick_next_inputs(spark, sf_dir):
    """The inputs of each store's compaction from its fullest level to the next."""
    return compaction.pick_next(_meta(spark, sf_dir), SMALL)


@_query(f"""WITH {_META_SQL} SELECT a.store_id, a.level, a.id, count(b.id) AS overlapping FROM meta a LEFT JOIN meta b
    ON b.store_id = a.store_id AND b.level = a.level + 1 AND b.max_key >= a.min_key AND b.min_key <= a.max_key
    WHERE a.level IS NOT NULL AND a.min_key IS NOT NULL AND a.max_key IS NOT NULL GROUP BY a.store_id, a.level, a.id""")
def run_overlaps(spark, sf_dir):
    """With how many runs of the next level each run shares a key."""
    m = _meta(spark, sf_dir).where("level is not null")
    return compaction.overlap_counts(m, m.withColumn("level", F.col("level") - 1), ["store_id", "level"]).select("store_id", "level", "id", "overlapping")


@_query(f"""WITH {_META_SQL}, plan AS (SELECT store_id AS s, min(min_key) AS low, max(max_key) AS high FROM meta WHERE level = 0 GROUP BY store_id)
    SELECT s AS store_id, 1 AS output_level, NOT EXISTS (SELECT 1 FROM meta WHERE store_id = s AND level > 1 AND max_key >= low AND min_key <= high) AS bottommost FROM plan""")
def bottommost_flag(spark, sf_dir):
    m = _meta(spark, sf_dir)
    plans = m.where("level = 0").groupBy("store_id").agg(F.min("min_key").alias("low"), F.max("max_key").alias("high")).withColumn("output_level", F.lit(1))
    return compaction.bottommost(plans, m)


@_query(f"""WITH {_META_SQL}, k AS (SELECT DISTINCT store_id AS s, key FROM memtable_ops WHERE key IS NOT NULL)
    SELECT s AS store_id, hex(key) AS key_hex, count(id) AS may_hold FROM k LEFT JOIN meta ON store_id IS NOT DISTINCT FROM s AND min_key <= key AND max_key >= key GROUP BY s, key""")
def run_prune(spark, sf_dir):
    """How many runs of any level, a NULL one too, may hold each key, by their bounds alone."""
    keys = table(spark, sf_dir, "memtable_ops").where("key is not null").select("store_id", "key").distinct()
    asked = keys.withColumn("id", F.xxhash64("store_id", "key"))
    counts = compaction.overlap_counts(asked.withColumn("min_key", F.col("key")).withColumn("max_key", F.col("key")), _meta(spark, sf_dir), ["store_id"])
    counts = counts.withColumnRenamed("store_id", "s").withColumnRenamed("id", "q")
    return asked.join(counts, F.col("store_id").eqNullSafe(F.col("s")) & (F.col("id") == F.col("q"))).select("store_id", F.hex("key").alias("key_hex"), F.col("overlapping").alias("may_hold"))


@_query("SELECT DISTINCT id FROM run_meta WHERE id IS NOT NULL EXCEPT SELECT id FROM run_meta_copy")
def set_difference_ids(spark, sf_dir):
    return table(spark, sf_dir, "run_meta").where("id is not null").select("id").subtract(table(spark, sf_dir, "run_meta_copy").select("id"))


@_query(f"""SELECT store_id, hex(key) AS key_hex, seq, op = 1 AS live FROM memtable_ops WHERE key IS NOT NULL AND seq IS NOT NULL AND op IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY store_id, key ORDER BY seq DESC) = 1""")
def memtable_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "memtable_ops").where("op is not null").select("store_id", "key", "seq", "op", "value")
    return fold.latest(rows, ["store_id", "key"]).select("store_id", F.hex("key").alias("key_hex"), "seq", (F.col("op") == 1).alias("live"))


@_query("SELECT run_id, count(*) AS record_count, hex(min(key)) AS min_hex, hex(max(key)) AS max_hex FROM (SELECT DISTINCT run_id, key FROM sst_entries WHERE run_id IS NOT NULL AND key IS NOT NULL) GROUP BY run_id")
def sorted_run_bounds(spark, sf_dir):
    rows = table(spark, sf_dir, "sst_entries").where("run_id is not null and key is not null").select("run_id", "key").distinct().withColumn("size", F.lit(1))
    return chunking.run_stats(rows, "run_id").select("run_id", "record_count", F.hex("min_key").alias("min_hex"), F.hex("max_key").alias("max_hex"))


_BYTES_SQL = "list_transform(range(1, n + 1), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS HUGEINT))"
_FNV_SQL = f"list_reduce(list_prepend(14695981039346656037::HUGEINT, {_BYTES_SQL}), lambda h, c: ((((h // 256) * 256) + xor(h % 256, c)) * 1099511628211) % 18446744073709551616)"


@_query(f"""
    WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
    e AS (SELECT DISTINCT run_id, key FROM sst_entries WHERE run_id IS NOT NULL AND key IS NOT NULL),
    k AS (SELECT key, hex(key) AS x, octet_length(key) AS n FROM (SELECT DISTINCT key FROM e)),
    c AS (SELECT key, {_FNV_SQL} AS a, xor(list_reduce(list_prepend(4294967295::HUGEINT, {_BYTES_SQL}), lambda c, b: xor(c // 256, tab[CAST(xor(c % 256, b) AS INTEGER) + 1]::HUGEINT)), 4294967295::HUGEINT) AS crc FROM k, t),
    h AS (SELECT key, a, CASE crc WHEN 0 THEN {bloom.NO_CRC}::HUGEINT ELSE crc END AS b FROM c),
    f AS (SELECT DISTINCT run_id, hash_count, bits FROM bloom_filters WHERE run_id IS NOT NULL AND bits IS NOT NULL),
    fx AS (SELECT run_id, coalesce(hash_count, 0) AS probes, hex(bits) AS hx, octet_length(bits) * 8 AS m, row_number() OVER () AS fid FROM f),
    probed AS (SELECT e.run_id, fid, CASE WHEN m = 0 OR probes <= 0 THEN true ELSE len(list_filter(range(probes), lambda i:
        ((CAST('0x' || substr(hx, CAST(2 * ((((a + i * b + i * i) % 18446744073709551616) % m) // 8) + 1 AS BIGINT), 2) AS INTEGER) >> CAST(((a + i * b + i * i) % 18446744073709551616) % m % 8 AS INTEGER)) & 1) = 0)) = 0 END AS may
        FROM e JOIN h ON e.key = h.key JOIN fx ON fx.run_id = e.run_id),
    lost AS (SELECT run_id, min(n) AS n FROM (SELECT run_id, fid, count(*) FILTER (WHERE NOT may) AS n FROM probed GROUP BY run_id, fid) GROUP BY run_id)
    SELECT e.run_id, count(*) AS keys, CASE WHEN any_value(lost.n) IS NULL THEN 'missing' WHEN any_value(lost.n) > 0 THEN 'damaged' ELSE 'sound' END AS state, coalesce(any_value(lost.n), 0) AS lost_keys
    FROM e LEFT JOIN lost ON lost.run_id = e.run_id GROUP BY e.run_id""")
def bloom_health(spark, sf_dir):
    return bloom.filter_health(table(spark, sf_dir, "sst_entries"), table(spark, sf_dir, "bloom_filters"))


@_query(f"WITH {LATEST_SQL} SELECT key, value FROM latest WHERE op = 1")
def store_roundtrip(spark, sf_dir):
    """The whole event log written through a store in three commits, flushed, compacted and scanned."""
    rows = ops(spark, sf_dir).select(F.encode("key", "UTF-8").alias("key"), "seq", "op", F.encode("value", "UTF-8").alias("value"), "segment")
    store = open_store(spark, "", Options(l0_trigger=2, auto_flush=False))
    store.durable = True  # the result is read after this function returns
    top = (rows.agg(F.max("segment")).first()[0] or 0) + 1
    for part in range(3):
        store.write_rows(rows.where(F.floor(F.col("segment") * 3 / top) == part), order="seq")
        if part < 2:
            store.flush()
    return store.scan().select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))
