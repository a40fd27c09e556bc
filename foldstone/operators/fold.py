"""The core of the store: an append-only log of versioned operations, folded to the newest per key.

``ops`` is any DataFrame with ``key``, a version column (``seq``), ``op`` (1 put, 0 delete) and more
columns. Tombstones are dropped after the fold and never before it, or older values would come
back. Filters on ``key`` may stand on either side of the fold; Catalyst moves them into the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..shared import materialize


def raw_versions(ops: DataFrame, keys: Sequence[str] = ("key",), seq: str = "seq") -> DataFrame:
    """Every version with ``version_rank``: 1 is the newest of its key. Key ascending, newest first is the reading order."""
    return ops.withColumn("version_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(seq))))


def latest(ops: DataFrame, keys: Sequence[str] = ("key",), seq: str = "seq") -> DataFrame:
    """The newest row of each key, tombstones kept, all columns kept.

    Rows with a NULL key or version aren't operations and are left out. Of equal versions, the row
    that sorts greatest by its other columns wins, so the result doesn't depend on their order.
    The fold is an aggregate with a partial step before the shuffle, so a key with very many
    versions is one row per task when it is exchanged. Empty input gives no rows.
    """
    rest = [c for c in ops.columns if c not in (*keys, seq)]
    good = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, seq)])
    top = ops.where(good).groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("_newest"))
    return top.select(*[F.col(c) if c in keys else F.col(f"_newest.{c}").alias(c) for c in ops.columns])


def latest_by_window(ops: DataFrame, keys: Sequence[str] = ("key",), seq: str = "seq") -> DataFrame:
    """As ``latest``, by a ranking window. It works for columns that have no order, such as maps; Spark limits groups before the shuffle."""
    good = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, seq)])
    ranked = ops.where(good).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq))))
    return ranked.where("_rank = 1").drop("_rank")


def visible(ops: DataFrame, keys: Sequence[str] = ("key",), seq: str = "seq", op: str = "op") -> DataFrame:
    """The rows a reader sees: folded, then without tombstones."""
    return latest(ops, keys, seq).where(F.col(op) == 1)


def in_range(df: DataFrame, start=None, end=None, key: str = "key") -> DataFrame:
    """Keys in ``[start, end)``; None is unbounded. An empty ``end`` that isn't None gives nothing, as every key is at least empty."""
    if start is not None:
        df = df.where(F.col(key) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(key) < F.lit(end))
    return df


def as_of(ops: DataFrame, seq_limit: int, seq: str = "seq") -> DataFrame:
    """The log as it was when ``seq_limit`` was its newest version."""
    return ops.where(F.col(seq) <= seq_limit)


def merge_runs(runs: Sequence[DataFrame], keys: Sequence[str] = ("key",), seq: str = "seq") -> DataFrame:
    """Several runs as one, the newest version of each key, by version and not by the order of the runs."""
    return latest(reduce(lambda a, b: a.unionByName(b), runs), keys, seq)


def lower_bound(table: DataFrame, probes: DataFrame, key: str = "key", probe: str = "probe") -> DataFrame:
    """``(probe, found)``: the first key not below each probe, NULL if there is none.

    Probes and keys are sorted together in key ranges; within a range the next key is found by
    looking ahead, and what no range holds is taken from the first key of the next range that has one. No
    probe meets more than its own range, however many keys there are.
    """
    both = probes.select(F.col(probe).alias("k"), F.lit(1).alias("is_probe")).where("k is not null").distinct().unionByName(table.select(F.col(key).alias("k"), F.lit(0).alias("is_probe")).where("k is not null").distinct())
    # written, as two readings of a range exchange may be cut differently
    ranged = materialize(both.repartitionByRange("k").withColumn("part", F.spark_partition_id()), "lower-bound")
    # of equal ones the probe comes first, so that it finds the equal key ahead of it
    ahead = "lead(CASE WHEN is_probe = 0 THEN k END) IGNORE NULLS OVER (PARTITION BY part ORDER BY k, is_probe DESC)"
    near = ranged.withColumn("found", F.expr(ahead))
    # as many rows as partitions: for each the first key of the next one that has a key
    heads = ranged.groupBy("part").agg(F.min(F.when(F.col("is_probe") == 0, F.col("k"))).alias("first_key"))
    after = heads.select("part", F.expr("lead(first_key) IGNORE NULLS OVER (ORDER BY part)").alias("next_key"))
    missing = near.where("is_probe = 1 and found is null").select("k", "part")
    carried = missing.join(after, "part", "left").select("k", F.col("next_key").alias("found"))
    hit = near.where("is_probe = 1 and found is not null").select("k", "found")
    return hit.unionByName(carried).select(F.col("k").alias(probe), "found")


def multi_get(ops: DataFrame, wanted: DataFrame, key: str = "key", seq: str = "seq", op: str = "op", value: str = "value") -> DataFrame:
    """``(key, status, value)`` of each wanted key: ``value``, ``deleted`` or ``missing``.

    Repeated wanted keys give one row, NULL ones none. Only versions of wanted keys are folded.
    """
    want = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    near = latest(ops.select(key, seq, op, value).join(want, key, "left_semi"), [key], seq)
    status = F.when(F.col(op).isNull(), "missing").when(F.col(op) == 1, "value").otherwise("deleted")
    return want.join(near, key, "left").select(key, status.alias("status"), F.when(F.col(op) == 1, F.col(value)).alias("value"))


def members(probes: DataFrame, table: DataFrame, key: str = "key", absent: bool = False) -> DataFrame:
    """The probes whose key is in the table, or with ``absent`` those whose key isn't. A NULL key is in no table."""
    return probes.join(table.select(key).distinct(), key, "left_anti" if absent else "left_semi")


def valid_prefix(log: DataFrame, segment: str, order: str, bad: Column) -> DataFrame:
    """The rows of each segment before its first bad one. Only the least bad position of a segment is exchanged, no segment is gathered."""
    first_bad = log.where(bad).groupBy(F.col(segment).alias("_segment")).agg(F.min(order).alias("_first_bad"))
    joined = log.join(first_bad, F.col(segment).eqNullSafe(F.col("_segment")), "left")
    return joined.where(F.col("_first_bad").isNull() | (F.col(order) < F.col("_first_bad"))).drop("_segment", "_first_bad")


def closed_batches(log: DataFrame, segment: str, order: str, type_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Puts and deletes in force: outside of batches, or in a batch that is closed before another begins.

    Types are P, D, B (begin) and E (end). The log of each ``by`` runs on from segment to segment (a NULL segment is the
    first), and so do open batches. Markers are looked up within a segment, and only the first and the last one of each
    segment is carried to the others, so a log is never a single task.
    """
    names = [f"_by{i}" for i in range(len(by))]
    same = lambda: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip([segment, *by], ["_segment", *names])])
    marker = F.when(F.col(type_col).isin("B", "E"), F.col(type_col))
    ends = log.groupBy(F.col(segment).alias("_segment"), *(F.col(c).alias(n) for c, n in zip(by, names))).agg(F.max_by(marker, F.when(marker.isNotNull(), F.col(order))).alias("_last"), F.min_by(marker, F.when(marker.isNotNull(), F.col(order))).alias("_first"))
    # one row a segment
    along = "{} IGNORE NULLS OVER (%s ORDER BY _segment NULLS FIRST)" % (f"PARTITION BY {', '.join(names)}" if names else "")
    carried = ends.select("_segment", *names, F.expr(along.format("lag(_last)")).alias("_carried"), F.expr(along.format("lead(_first)")).alias("_coming"))
    near = "{}(CASE WHEN `%s` IN ('B', 'E') THEN `%s` END) IGNORE NULLS OVER (PARTITION BY %s ORDER BY `%s`)" % (type_col, type_col, ", ".join(f"`{c}`" for c in (segment, *by)), order)
    marked = log.withColumn("_before", F.expr(near.format("lag"))).withColumn("_after", F.expr(near.format("lead"))).join(carried, same(), "left")
    before, after = F.coalesce("_before", "_carried"), F.coalesce("_after", "_coming")
    return marked.where(F.col(type_col).isin("P", "D") & F.coalesce(before.isNull() | (before == "E") | (after == "E"), F.lit(False))).select(*log.columns)


def nearest_rank(df: DataFrame, value: str, percent: int, by: Sequence[str] = ()) -> DataFrame:
    """The value at position ``(n - 1) * percent / 100`` (truncated) of the sorted values of each group; NULLs are left out.

    Values are sorted in ranges over all groups and positions are counted range by range, so neither a
    large group nor the whole column is sorted by one task.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, value)
    ranged = materialize(rows.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "nearest-rank")
    # as many rows as groups in partitions
    counts = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    placed = counts.select(*by, "_part", F.sum("_n").over(over).alias("_total"), (F.sum("_n").over(over.orderBy("_part")) - F.col("_n")).alias("_skipped"), "_n")
    target = placed.withColumn("_target", F.floor((F.col("_total") - 1) * percent / 100) - F.col("_skipped")).where("_target >= 0 and _target < _n").select(*by, "_part", "_target")
    mine = ranged.join(target, [*by, "_part"]).withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(value)) - 1)
    return mine.where("_at = _target").select(*by, F.col(value).alias(f"p{percent}"))
